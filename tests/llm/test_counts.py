import random

import pyarrow as pa

from citespark.llm.common import word_vocabulary
from citespark.llm.counts import CountTree, build_trees, cut, edit_kept_trees, op10, settle_all
from citespark.llm.tokens import encoder

PATH = word_vocabulary()


def count(text):
    return len(encoder(PATH).encode(pa.array([text], pa.string()))[0])


def test_random_edits_equal_whole_counts():
    rng = random.Random(5)
    signs = list("ab c, d.\n e't") + ["hello ", "<|endoftext|>", " 12", "é"]
    for _ in range(25):
        text = "".join(rng.choice(signs) for _ in range(rng.choice([0, 3, 50, 3000])))
        tree = CountTree(cut(text), [count(x) for x in cut(text)])
        for _ in range(20):
            start = rng.randint(0, len(text))
            end = min(len(text), start + rng.choice([0, 1, 5, 700]))
            new = "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 5, 40, 1500])))
            tree.edit(start, end, new)
            text = text[:start] + new + text[end:]
            if rng.random() < 0.5:  # else the next edit meets stale leaves
                continue
            settle_all([tree], PATH)
            assert "".join(tree.leaves) == text and tree.tokens[1] == count(text) and tree.chars[1] == len(text)


def test_small_edits_encode_little():
    text = "some words of a text, again. " * 2000
    tree = CountTree(cut(text), [count(x) for x in cut(text)])
    assert tree.edit(30_000, 30_004, "new") < 2000


def test_query_counts_the_edited_texts(spark):
    import zlib

    use = encoder(PATH)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op10(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]
        n, c = len(text), zlib.crc32(str(r["doc_id"]).encode())
        place = [c * k % max(n, 1) for k in (1, 7, 31)]
        now = text
        for start, end, new in ((place[0], place[0] + 9, text[:12]), (place[1], place[1] + c % 400, ""),
                                (place[2], place[2], text[19:919])):
            start = min(start, len(now))
            now = now[:start] + new + now[min(end, len(now)):]
        before, after = use.encode(pa.array([text, now], pa.string()))
        assert (r["tokens_before"], r["n_tokens"], r["n_chars"]) == (len(before), len(after), len(now))


def test_kept_trees_take_a_log_in_order(spark, odd, nothing):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x" * 2000)], "doc_id long, text string")
    log = spark.createDataFrame(
        [(1, 2, 0, 1, "zz "), (1, 1, 5, 5, " tail"), (2, 1, 0, 0, "new text"), (9, 1, 0, 0, "lost"), (1, None, 0, 0, "no"),
         (3, 1, -5, None, None)], "doc_id long, seq long, start long, end long, text string")
    got = {r["doc_id"]: "".join(r["leaves"]) for r in edit_kept_trees(build_trees(docs, PATH), log, PATH).collect()}
    assert got == {1: "zz  b c tail", 2: "new text", 3: "x" * 2000}
    assert build_trees(odd, PATH).count() == odd.count() and build_trees(nothing, PATH).count() == 0
