"""Ranked lexical search: impact vectors ordered by length, buckets pruned by norm, coordinate bounds, exact integers.

A document is the vector of its term impacts, cut to the terms of the searched items (no other coordinate can count); an
item is the vector of its term weights. The score is their inner product.

1. One pass over the texts counts terms (``vectors``); N, L and the document frequencies come from its table.
2. The impact vectors are ordered by length (``repartitionByRange``) and written: neighbours have like lengths.
3. A task cuts its rows into buckets. With the k-th best score of an item as bound, a bucket goes if the Cauchy-Schwarz
   product of both lengths is below the bound, or the sum of the item's weights times the largest impact of each
   coordinate in the bucket. Inside, the fewest heaviest coordinates whose remainder cannot reach the bound are summed;
   a document goes if that sum plus what the rest can add at most (by coordinates, and by Cauchy-Schwarz over the
   lengths left) is below the bound. Survivors are scored in 64-bit integers.
4. The longest vectors are searched first; their k-th best scores are the first bounds for all others.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citespark.llm.common import bounded_batches, query, table
from citespark.session import cut_lineage

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
PIECE = 1 << 20
BUCKET = 1024
SLACK = 1 + 1e-9  # float bounds are raised by it, so that rounding loses nobody


def term_counts(text: str | None) -> dict[bytes, int]:
    """Terms of the whole text with their counts; only A to Z are lower-cased. Counted in pieces that end between terms."""
    from collections import Counter

    data = (text or "").encode("utf-8", "surrogatepass").lower()
    counts: Counter = Counter()
    at = 0
    while at < len(data):
        cut = BREAK.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = cut.end() if cut else len(data)
        counts.update(TERM.findall(data[at:end]))
        at = end
    return counts


def vectors(docs: DataFrame, places) -> DataFrame:
    """(doc_id, n, places, tf) per row of (doc_id, text): all terms counted, those of the broadcast ``places`` listed."""
    import numpy as np

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        known = places.value
        for batch in batches:
            n, where, tf = [], [], []
            for text in batch.column(1):
                counts = term_counts(text.as_py())
                own = {known[t]: c for t, c in counts.items() if t in known}
                n.append(sum(counts.values()))
                where.append(np.fromiter(own.keys(), np.int32, len(own)).tobytes())
                tf.append(np.fromiter(own.values(), np.int32, len(own)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(where, pa.binary()), pa.array(tf, pa.binary())],
                ["doc_id", "n", "places", "tf"])

    return bounded_batches(docs).mapInArrow(run, f"doc_id {kind}, n long, places binary, tf binary")


def frequencies(made: DataFrame, size: int):
    """(N, L, documents per place): partial counts of each task, then sums; the driver gets ``size`` numbers at most."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        df = np.zeros(size, np.int64)
        for batch in batches:
            for where in batch.column(0):
                df[np.frombuffer(where.as_py(), np.int32)] += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(df[used], pa.int64())], ["place", "df"])

    total = made.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = made.select("places").mapInArrow(run, "place int, df long").groupBy("place").agg(F.sum("df").alias("df"))
    out = np.zeros(size, np.int64)
    for row in parts.collect():
        out[row["place"]] = row["df"]
    return total[0], total[1], out


def by_length(made: DataFrame, documents: int, terms: int) -> DataFrame:
    """(doc_id, length, places, impacts), longest first; vectors without any coordinate are left out."""
    import numpy as np

    kind = made.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length, out = [], []
            for n, tf in zip(batch.column(1).to_pylist(), batch.column(3)):
                tf = np.frombuffer(tf.as_py(), np.int32).astype(np.int64)
                m = 100 - 75 + (75 * n * documents) // terms
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
                length.append(math.sqrt(float((impact.astype(np.float64) ** 2).sum())))
                out.append(impact.astype(np.int32).tobytes())  # below 1,000,000
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(length, pa.float64()), batch.column(2), pa.array(out, pa.binary())],
                ["doc_id", "length", "places", "impacts"])

    found = made.where("length(places) > 0").mapInArrow(
        run, f"doc_id {kind}, length double, places binary, impacts binary")
    return found.repartitionByRange(F.col("length").desc()).sortWithinPartitions(F.col("length").desc())


class Bucket:
    """Some documents of like length, with the postings of their coordinates."""

    def __init__(self, ids, lengths, places, impacts, size: int):
        import numpy as np

        self.np, self.ids, self.lengths = np, ids, np.array(lengths)
        places = [np.frombuffer(p, np.int32) for p in places]
        self.begin = np.concatenate([[0], np.cumsum([len(p) for p in places])])
        self.places = np.concatenate(places)
        self.impacts = np.concatenate([np.frombuffer(v, np.int32) for v in impacts]).astype(np.int64)
        order = np.argsort(self.places, kind="stable")
        self.row = np.repeat(np.arange(len(ids)), np.diff(self.begin))[order]
        self.value = self.impacts[order]
        used, self.first = np.unique(self.places[order], return_index=True)
        self.most = np.zeros(size, np.int64)
        self.most[used] = np.maximum.reduceat(self.value, self.first)
        self.slot = np.full(size, -1, np.int64)
        self.slot[used] = np.arange(len(used))
        self.first = np.append(self.first, len(self.row))

    def search(self, item, bound: int):
        """Rows and scores of all documents with a score of ``bound`` or more; some with less may come along.

        ``item``: places and weights, heaviest first, and the lengths of its weights from each position on.
        """
        np, (where, weight, lengths) = self.np, item
        if lengths[0] * self.lengths.max() * SLACK < bound:
            return (), ()
        rest = np.append(np.cumsum((weight * self.most[where])[::-1])[::-1], 0)
        if rest[0] < bound:
            return (), ()
        focus = int(np.argmax(rest < bound))
        score, square = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
        for k in range(focus):
            if (slot := self.slot[where[k]]) >= 0:
                part = slice(self.first[slot], self.first[slot + 1])
                rows, value = self.row[part], self.value[part]
                score[rows] += weight[k] * value
                square[rows] += value.astype(np.float64) ** 2
        left = np.sqrt(np.maximum(self.lengths ** 2 * SLACK - square, 0)) * lengths[focus] * SLACK
        rows = np.flatnonzero((score > 0) & (score + np.minimum(left, rest[focus]) * SLACK + 1 >= bound))
        if rest[focus] == 0:
            return rows, score[rows]
        every = np.zeros(len(self.slot), np.int64)
        every[where] = weight
        exact = [int((every[self.places[a:b]] * self.impacts[a:b]).sum())
                 for a, b in zip(self.begin[rows], self.begin[rows + 1])]
        return rows, np.array(exact, np.int64)


def best(vectors: DataFrame, sent, k: int) -> DataFrame:
    """(item, doc_id, score): the k best rows of each task per item, above 0 and not below the broadcast bounds."""
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import heapq

        import numpy as np
        import pyarrow as pa

        items, bounds, size = sent.value
        bounds, top = list(bounds), [[] for _ in items]

        def scan(columns):
            bucket = Bucket(*columns, size)
            for j, item in enumerate(items):
                rows, scores = bucket.search(item, bounds[j])
                if not len(rows):
                    continue
                least = max(bounds[j], int(np.partition(scores, -k)[-k]) if len(scores) > k else 0)
                good = np.flatnonzero(scores >= least)
                if not len(good):
                    continue
                more = [(-int(scores[g]), bucket.ids[rows[g]] is None, bucket.ids[rows[g]]) for g in good]
                top[j] = heapq.nsmallest(k, top[j] + more)
                if len(top[j]) == k:
                    bounds[j] = max(bounds[j], -top[j][-1][0])

        held = [[], [], [], []]
        for batch in batches:
            for column, values in zip(held, batch.columns):
                column += values.to_pylist()
            while len(held[0]) >= BUCKET:
                scan([column[:BUCKET] for column in held])
                held = [column[BUCKET:] for column in held]
        if held[0]:
            scan(held)
        out = [(j, t[2], -t[0]) for j, rows in enumerate(top) for t in rows]
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_pydict(
            {"item": pa.array(columns[0], pa.int32()), "doc_id": list(columns[1]), "score": pa.array(columns[2], pa.int64())}
        ) if out else pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], id_type), pa.array([], pa.int64())],
                                                 ["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(vectors.schema["doc_id"].dataType)
    return bounded_batches(vectors).mapInArrow(run, f"item int, doc_id {kind}, score long")


def top_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, items: list, k: int, first_share: float) -> DataFrame | None:
    """(item, rank, doc_id, score) of one block of items, each a dict of terms with their counts."""
    import numpy as np

    spark = docs.sparkSession
    places = {t: i for i, t in enumerate(sorted(set().union(*items)))}
    if not places:
        return None
    made = cut_lineage(vectors(docs, spark.sparkContext.broadcast(places)))
    documents, terms, df = frequencies(made, len(places))
    if not documents:
        return None
    # Doubles as the contract has them: one logarithm for each term.
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df]
    sides = []
    for counts in items:
        own = sorted(((weight[places[t]] * c, places[t]) for t, c in counts.items()), reverse=True)
        w = np.array([x for x, _ in own], np.int64)
        tail = np.sqrt(np.append(np.cumsum((w.astype(np.float64) ** 2)[::-1])[::-1], 0.0))
        sides.append((np.array([p for _, p in own], np.int64), w, tail))
    ordered = cut_lineage(by_length(made, documents, terms))
    cut = ordered.agg(F.percentile_approx("length", 1 - first_share, 1000)).first()[0] or 0.0
    sent = spark.sparkContext.broadcast((sides, [1] * len(sides), len(places)))
    longest = cut_lineage(top_k(best(ordered.where(F.col("length") >= cut), sent, k), k))
    bounds = [1] * len(sides)
    for row in longest.where(F.col("rank") == k).collect():  # one number per item of the block
        bounds[row["item"]] = row["score"]
    sent = spark.sparkContext.broadcast((sides, bounds, len(places)))
    others = best(ordered.where(F.col("length") < cut), sent, k)
    return top_k(others.unionByName(longest.drop("rank")), k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_terms: int = 200_000,
           first_share: float = 0.02) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring rows of ``docs`` for each item, scores above 0 only.

    Equal scores go by ascending id, a null id last. A null or empty text has no terms: such a document is never found,
    such an item finds nothing. Each row of ``docs`` is a document of its own, so repeated rows are found and counted
    repeatedly; repeated rows of ``items`` are one item, and an id with several texts has a ranking of each. Empty
    tables give no rows; further columns are ignored. Items are searched in blocks of about ``block_terms`` terms, which
    is what an executor and the driver hold of them; every block is searched over all documents, the longest
    ``first_share`` of the vectors first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    asked = cut_lineage(asked.where("length(text) > 0").distinct())
    length = asked.agg(F.sum(F.size(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    blocks = -(-length // block_terms)
    schema = f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}"
    out = spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, "
                                    f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        found = search_block(docs, [dict(term_counts(r["text"])) for r in rows], k, first_share) if rows else None
        if found is not None:
            names = spark.createDataFrame([(j, r["item_id"]) for j, r in enumerate(rows)], schema)
            found = found.join(F.broadcast(names), "item")  # the items of one block
            out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out


SQL = r"""
WITH items AS (
  SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
wanted AS (
  SELECT i, t, count(*) AS q FROM (SELECT i, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM items) GROUP BY i, t),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
counts AS (
  SELECT r, doc_id, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM docs) GROUP BY r, doc_id, t),
sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM counts GROUP BY r),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
weights AS (
  SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, total WHERE t IN (SELECT t FROM wanted) GROUP BY t, big_n),
scored AS (
  SELECT i, r, doc_id,
         sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM counts JOIN wanted USING (t) JOIN weights USING (t) JOIN sizes USING (r), total GROUP BY i, r, doc_id),
placed AS (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed JOIN items USING (i) WHERE rank <= 10
"""


@query("op11_ranked_search", SQL)
def op11(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
