import pyarrow as pa
import pytest

from citespark.llm.common import word_vocabulary
from citespark.llm.tokens import encoder, read_ranks

PATH = word_vocabulary()
TEXTS = [
    "a's don't I'LL x_y 12٣ a\x1cb", "x² ½ 3.5 <|endoftext|> é", "ΑΣ Σας", "Привет, мир!", "你好 world", "ǅ ŉ İ ª º",
    "a\xa0b\x85c d _ __ a_b 'S", "\"'s'", "``foo'' --", "", " ", "é", " x\x01y ", "5²", "մի ՙ", "–—“x”", "ß ẞ SS",
    "don't's'", "\n a \n", "...a..b,,c", None, "q.,.q ,a .b", "ΩϴK",
]


def test_ids_are_the_tokenizers(small):
    use = encoder(PATH)
    texts = TEXTS + [r["text"] for r in small.select("text").collect()]
    for text, ids in zip(texts, use.encode(pa.array(texts, pa.string()))):
        assert ids.tolist() == use.exact(text or "").tolist(), text
    assert use.encode(pa.array([], pa.string())) == []
    assert [i.tolist() for i in use.encode(pa.array(["x", "a b"]).slice(1))] == [use.exact("a b").tolist()]


def test_ranks_are_the_order_of_merges():
    """Every word part is what its own bytes merge to by rank: then merging by rank equals merging by pairs."""
    ranks = read_ranks(PATH)
    assert len(ranks) == len(set(ranks.values()))
    for word, rank in ranks.items():
        parts = [bytes([b]) for b in word]
        if len(parts) > 1 and parts[-1] == b"\x01":
            parts[-2:] = [b"".join(parts[-2:])]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], 1 << 30))
            assert parts[best] + parts[best + 1] in ranks, word
            assert ranks[parts[best] + parts[best + 1]] <= rank
            parts[best:best + 2] = [parts[best] + parts[best + 1]]


@pytest.mark.parametrize("size", [1, 50, 10**7])
def test_blocks_cover_all(size):
    from citespark.llm.tokens import blocks

    texts = pa.array(["abc", None, "", "x" * 100, "y"])
    got = list(blocks(texts, size))
    assert [k for a, b in got for k in range(a, b)] == list(range(5))


def test_a_task_encodes_two_megabytes_at_once():
    from citespark.llm.tokens import blocks

    texts = pa.array(["x" * 1_500_000, "y" * 400_000, None, "z" * 1_000_000, "u" * 3_000_000, "v"])
    assert list(blocks(texts)) == [(0, 3), (3, 4), (4, 5), (5, 6)]
