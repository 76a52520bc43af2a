import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from citespark.llm.common import word_vocabulary
from citespark.llm.packing import Packer, pack_sequences, pieces
from citespark.llm.tokens import encoder

PATH = word_vocabulary()


def check(rows, texts, max_tokens=4096, max_segments=256, max_loss=4096):
    use = encoder(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for doc, text in texts:
        want[doc].append(np.append(use.exact(text or ""), np.uint32(2)).astype("<u4"))
    assert by_doc.keys() == want.keys()
    for doc, own in by_doc.items():
        if len(want[doc]) == 1:
            ids, at = want[doc][0], 0
            for r in sorted(own, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                part = ids[at:at + r["length"]].tobytes()
                assert zlib.crc32(part) == (r["ids_crc32"] if "ids_crc32" in r else zlib.crc32(r["ids"]))
                at += r["length"]
            assert at == len(ids)
        else:
            assert sum(r["length"] for r in own) == sum(map(len, want[doc]))
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= max_tokens and len(own) <= max_segments and sum(r["loss_tokens"] for r in own) <= max_loss
        assert at == max_tokens or at & (at - 1) == 0  # no padding at all


def test_documents_are_covered_without_padding(small):
    check([r.asDict() for r in pieces(small).collect()], [(r["doc_id"], r["text"]) for r in small.collect()])


def test_odd_rows(odd, nothing):
    check([r.asDict() for r in pieces(odd).collect()], [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert pieces(nothing).count() == 0


@pytest.mark.parametrize("limits", [(64, 3, 64), (64, 8, 20), (4096, 256, 1), (7, 1, 7), (1, 1, 1)])
def test_three_limits(limits):
    rng = random.Random(1)
    packer, docs, made = Packer(*limits, at_hand=16), {}, []
    for k in range(60):
        n = rng.choice([1, 2, 9, 40, 300])
        docs[k] = (k, np.arange(n), rng.choice([0, 0, n // 2, n]))
        made += list(packer.add(docs[k]))
    made += list(packer.rest())
    seen = defaultdict(int)
    for sequence in made:
        assert sum(p[2] for p in sequence) <= limits[0] and len(sequence) <= limits[1]
        assert sum(packer.loss(*p) for p in sequence) <= limits[2]
        for doc, start, length in sequence:
            assert length > 0
            seen[doc[0]] += length
    assert seen == {k: len(d[1]) for k, d in docs.items()}


def test_limits_below_one_are_refused():
    with pytest.raises(ValueError):
        Packer(4096, 0, 1)


def test_prompt_tokens_bear_no_loss(spark):
    df = spark.createDataFrame([(1, "a b c d", 2), (2, "e f", None)], "doc_id long, text string, p int")
    got = {r["doc_id"]: r["loss_tokens"] for r in pack_sequences(df.coalesce(1), PATH, prompt_tokens="p").groupBy(
        "doc_id").sum("loss_tokens").withColumnRenamed("sum(loss_tokens)", "loss_tokens").collect()}
    assert got == {1: 3, 2: 3}
