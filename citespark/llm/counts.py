"""Edit-aware token counts: a segment tree of pre-token segments per document.

A document is cut into leaves in front of white space, where no token reaches across. The tree keeps characters and
tokens of every subtree. An edit goes down the tree to the leaves it touches, takes in the leaf before if its last word
could grow together with the new text, encodes that region alone, and renews the sums on the way up. All other leaves
keep their counts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import bounded_batches, query, table, word_vocabulary

LEAF = 512
CUT = re.compile("[ \n\t]")
TREE = "leaves array<string>, chars array<bigint>, tokens array<bigint>"
EDITS = "array<struct<start:bigint,end:bigint,text:string>>"


def cut(text: str) -> list[str]:
    """Leaves of at least ``LEAF`` characters, the last one apart; each but the first begins with white space."""
    leaves, begin = [], 0
    while begin < len(text):
        found = CUT.search(text, begin + LEAF)
        end = found.start() if found else len(text)
        leaves.append(text[begin:end])
        begin = end
    return leaves


class CountTree:
    """Leaves with their sums; node 1 is the root, the children of node k are 2k and 2k + 1."""

    def __init__(self, leaves: list[str], tokens: list[int]):
        self.leaves, self.stale = leaves, set()
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (leaf, n) in enumerate(zip(leaves, tokens)):
            self.chars[self.size + k], self.tokens[self.size + k] = len(leaf), n
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @classmethod
    def kept(cls, leaves: list[str], chars: list[int], tokens: list[int]) -> "CountTree":
        tree = cls.__new__(cls)
        tree.leaves, tree.chars, tree.tokens, tree.size = leaves, chars, tokens, len(chars) // 2
        tree.stale = set()
        return tree

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, place in it) of a character; the end of the text lies in the last leaf with text."""
        node = 1
        at = min(at, self.chars[1])
        while node < self.size:
            left = self.chars[2 * node]
            node, at = (2 * node, at) if at < left or not self.chars[2 * node + 1] else (2 * node + 1, at - left)
        return min(node - self.size, max(0, len(self.leaves) - 1)), at

    def put(self, k: int, leaf: str, n: int) -> None:
        node = self.size + k
        self.leaves[k] = leaf
        more_chars, more_tokens = len(leaf) - self.chars[node], n - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, start: int, end: int, text: str) -> int:
        """Put ``text`` in place of the characters from ``start`` to ``end``; the number of characters in the region.

        The region's leaves are stale, with no tokens, until ``settle`` gets their counts: finding a place takes
        characters only, so the edits of many documents can be encoded together, each leaf once.
        """
        start = max(0, min(start, self.chars[1]))
        end = max(start, min(end, self.chars[1]))
        if not self.leaves:
            new = cut(text)
            self.__init__(new, [0] * len(new))
            self.stale = set(range(len(new)))
            return len(text)
        first, at = self.find(start)
        last, to = self.find(end)
        region = self.leaves[first][:at] + text + self.leaves[last][to:]
        while first and not CUT.match(region):
            first -= 1
            region = self.leaves[first] + region
        new = cut(region)
        more = len(new) - (last - first + 1)
        if more <= 0:
            for k in range(first, last + 1):
                self.put(k, new[k - first] if k - first < len(new) else "", 0)
            self.stale.update(range(first, last + 1))
        else:
            known = self.tokens[self.size:self.size + len(self.leaves)]
            stale = {k if k < first else k + more for k in self.stale if k < first or k > last}
            self.__init__(self.leaves[:first] + new + self.leaves[last + 1:],
                          known[:first] + [0] * len(new) + known[last + 1:])
            self.stale = stale | set(range(first, first + len(new)))
        return len(region)

    def settle(self, counts) -> None:
        """Counts of the stale leaves, in order of place."""
        for k, n in zip(sorted(self.stale), counts):
            self.put(k, self.leaves[k], n)
        self.stale = set()


def settle_all(trees: list[CountTree], path: str) -> None:
    """Encode the stale leaves of all trees, in blocks."""
    import pyarrow as pa

    from citespark.llm.tokens import encode_all

    leaves = [t.leaves[k] for t in trees for k in sorted(t.stale)]
    counts = iter([len(ids) for _, ids in encode_all(path, pa.array(leaves, pa.string()))])
    for tree in trees:
        tree.settle([next(counts) for _ in range(len(tree.stale))])


def build_trees(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, leaves, chars, tokens) per row: the tree of each text.

    A null or empty text has no leaves and one sum, 0. A very long run without white space is one leaf. Repeated rows
    have a tree each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{k}`") for k in keep],
                       F.col(f"`{text_col}`").cast("string").alias("_text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from citespark.llm.tokens import blocks, encoder

        use = encoder(path)
        for batch in batches:
            texts = batch.columns[-1]
            for begin, end in blocks(texts, 4_000_000):
                leaves = [cut(t.as_py() or "") for t in texts.slice(begin, end - begin)]
                flat = pa.array([x for own in leaves for x in own], pa.string())
                counts = [len(i) for i in use.encode(flat)] if len(flat) else []
                ends = np.cumsum([len(own) for own in leaves]).tolist()
                trees = [CountTree(own, counts[e - len(own):e]) for own, e in zip(leaves, ends)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(begin, end - begin) for c in batch.columns[:-1]),
                     pa.array([t.leaves for t in trees], pa.list_(pa.string())),
                     pa.array([t.chars for t in trees], pa.list_(pa.int64())),
                     pa.array([t.tokens for t in trees], pa.list_(pa.int64()))],
                    [*batch.schema.names[:-1], "leaves", "chars", "tokens"])

    return bounded_batches(rows).mapInArrow(run, f"{head}, {TREE}")


def edited(trees: DataFrame, edits: str, path: str) -> DataFrame:
    """The trees after the edits in the array column ``edits``, applied in its order; offsets mean the text at that time.

    Adds ``tokens_before``, ``n_tokens``, ``n_chars`` and ``encoded_chars``, the characters of the regions the edits made stale. A
    null list has no edits, a null replacement is empty, offsets outside of the text are moved to its ends.
    """
    rows = trees.select("doc_id", F.col(f"`{edits}`").cast(EDITS).alias("_edits"), "leaves", "chars", "tokens")
    schema = (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {TREE}, tokens_before bigint, n_tokens bigint, "
              "n_chars bigint, encoded_chars bigint")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            trees, figures = [], []
            for steps, *kept in zip(*(c.to_pylist() for c in batch.columns[1:])):
                tree = CountTree.kept(*kept)
                before = tree.tokens[1]
                anew = sum(tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "") for e in steps or [])
                trees.append(tree)
                figures.append((before, anew))
            settle_all(trees, path)
            out = [(t.leaves, t.chars, t.tokens, before, t.tokens[1], t.chars[1], anew)
                   for t, (before, anew) in zip(trees, figures)]
            types = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())] + [pa.int64()] * 4
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "leaves", "chars", "tokens", "tokens_before", "n_tokens", "n_chars", "encoded_chars"])

    return bounded_batches(rows).mapInArrow(run, schema)


def edit_kept_trees(trees: DataFrame, log: DataFrame, path: str) -> DataFrame:
    """Kept trees after a log of edits (doc_id, seq, start, end, text), in the order of ``seq`` within a document.

    Edits of one document depend on each other, so they stay in order in one task; it reads them as a sorted stream and
    holds one tree. Edits without a tree are ignored; trees without edits come back as they are. Ids are unique here.
    """
    none = F.lit(None)
    both = trees.select("doc_id", none.cast("bigint").alias("seq"), none.cast("bigint").alias("start"),
                        none.cast("bigint").alias("end"), none.cast("string").alias("text"), "leaves", "chars", "tokens")
    steps = log.where("seq IS NOT NULL").select(
        "doc_id", F.col("seq").cast("bigint"), F.col("start").cast("bigint"), F.col("end").cast("bigint"), "text",
        none.cast("array<string>").alias("leaves"), none.cast("array<bigint>").alias("chars"),
        none.cast("array<bigint>").alias("tokens"))
    rows = both.union(steps).repartition("doc_id").sortWithinPartitions("doc_id", F.col("seq").asc_nulls_first())
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {TREE}, n_tokens bigint, encoded_chars bigint"

    def run(batches):
        import pyarrow as pa

        now = None

        def row(doc, tree, anew):
            settle_all([tree], path)
            return pa.RecordBatch.from_pylist([{
                "doc_id": doc, "leaves": tree.leaves, "chars": tree.chars, "tokens": tree.tokens,
                "n_tokens": tree.tokens[1], "encoded_chars": anew}], pa.schema([
                    ("doc_id", kind), ("leaves", pa.list_(pa.string())), ("chars", pa.list_(pa.int64())),
                    ("tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("encoded_chars", pa.int64())]))

        for batch in batches:
            kind = batch.column(0).type
            for doc, seq, start, end, text, *tree in zip(*(c.to_pylist() for c in batch.columns)):
                if seq is None:
                    if now:
                        yield row(*now)
                    now = [doc, CountTree.kept(*tree), 0]
                elif now and now[0] == doc:
                    now[2] += now[1].edit(start or 0, end or 0, text or "")
        if now:
            yield row(*now)

    return bounded_batches(rows).mapInArrow(run, schema)


@query("op10_token_counts")
def op10(spark, sf_dir):
    """Three edits for every document, made of its own text: a word's place, a cut and an insertion.

    Checked against encoding the edited texts as a whole in ``tests/llm/test_counts.py``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n, r = F.length("text"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    place = [F.pmod(r * k, F.greatest(n, F.lit(1))) for k in (1, 7, 31)]
    steps = F.array(
        F.struct(place[0].alias("start"), (place[0] + 9).alias("end"), F.substring("text", F.lit(1), F.lit(12)).alias("text")),
        F.struct(place[1].alias("start"), (place[1] + r % 400).alias("end"), F.lit("").alias("text")),
        F.struct(place[2].alias("start"), place[2].alias("end"), F.substring("text", F.lit(20), F.lit(900)).alias("text")))
    trees = build_trees(docs.withColumn("edits", F.when(n > 0, steps)), word_vocabulary(), keep=("edits",))
    return edited(trees, "edits", word_vocabulary()).select(
        "doc_id", "tokens_before", "n_tokens", "n_chars", "encoded_chars", F.size("leaves").alias("n_leaves"))
