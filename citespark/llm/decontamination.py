"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, weighted-shingle verification.

DataFrame functions only. A window has as many words as a benchmark item; a document shorter than the item is one window
for it. Its similarity to the item is the weighted
Jaccard similarity of their bags of word shingles; a shingle that several items hold weighs less, any other shingle
``FULL``.

1. A window that starts at a shingle of weight ``FULL`` that it does not share with the item is never more similar than
   the window one word further right, as no shingle weighs more. So the windows that start at a shared shingle, at a
   shingle of less weight (several items hold it) or at the last possible place hold the best one. The shingles of the
   benchmark are looked up in those of the documents. Places are dealt into stretches of the item's length; a window
   lies in the stretch of its start and the next one. If the item's shingles in both weigh less than ``threshold`` times
   the item, the stretch gives no windows, as no similarity of ``threshold`` is possible. Neither step loses a pair.
2. Each distinct window and each item gets a 64-bit SimHash. Windows and items of one length meet if they agree in one of
   ``radius + 1`` blocks of bits: by the pigeonhole principle that finds every pair within the radius. Where a shared
   shingle may weigh less than one that differs, fingerprints may lie further apart: an item with any shingle below
   ``FULL`` is compared with all windows made for it.
3. The exact similarity decides.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import few_files, query, table
from citespark.session import cut_lineage

FULL = 16
BROADCAST_ROWS = 500_000  # of benchmark shingles, some 50 bytes each


def words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingles(word: str, width: int) -> Column:
    """Hashes of the word n-grams of the array column ``word``, in order; empty if it is shorter."""
    step = ", ".join(f"x[i + {k}]" if k else "x[i]" for k in range(width))
    # The outer lambda holds the words: Spark may put their expression in place of the column, and without it they would
    # be split anew for every shingle.
    return F.expr(f"transform(array({word}), x -> if(size(x) >= {width}, transform(sequence(0, size(x) - {width}), "
                  f"i -> xxhash64({step})), array()))[0]").cast("array<bigint>")


def simhash(bags: DataFrame, by: list[str]) -> DataFrame:
    """(by, fingerprint, total) of rows (by, h, weight): bit k is set if most weight has it set."""
    sums = [F.sum(F.when(F.col("h").bitwiseAND(F.lit(1 << k if k < 63 else -(1 << 63))) != 0, F.col("weight"))
                  .otherwise(0)).alias(f"s{k}") for k in range(64)]
    bits = bags.groupBy(*by).agg(F.sum("weight").alias("total"), *sums)
    value = None
    for k in range(64):
        bit = F.when(2 * F.col(f"s{k}") > F.col("total"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0))
        value = bit if value is None else value.bitwiseOR(bit)
    return bits.select(*by, value.cast("long").alias("fingerprint"), "total")


def bit_blocks(fingerprint: Column, radius: int) -> Column:
    """(number, bits) of ``radius + 1`` blocks of bits that lie side by side."""
    count, parts, begin = radius + 1, [], 0
    for k in range(count):
        size = 64 // count + (k < 64 % count)
        parts.append(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, begin).bitwiseAND(
            F.lit((1 << size) - 1)).alias("bits")))
        begin += size
    return F.explode(F.array(*parts))


def windows_beside(listed: DataFrame, side: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item, n, m, weight, total, at, start, window) of the shared shingles; ``side`` goes to every executor.

    A document with fewer shingles than the item is its own window. The window is cut while its document is at hand. "outer" and the cut at 0, as the filters that Spark would add else
    make the shingles twice.
    """
    own = listed.select("doc_id", "text_hash", "s", F.posexplode_outer("s").alias("at", "h"))
    hits = own.join(F.broadcast(side), "h").withColumn("start", F.greatest(F.lit(0), F.expr("least(at, size(s) - m)")))
    return cut_lineage(hits.select("doc_id", "text_hash", "item", "n", "m", "weight", "total", "at", "start",
                                   F.expr("slice(s, start + 1, m)").alias("window")))


def windows_apart(listed: DataFrame, side: DataFrame) -> DataFrame:
    """The same by shuffles: first the places of the shared shingles, then the documents that have any."""
    own = listed.withColumn("size", F.size("s")).select(
        "doc_id", "text_hash", "size", F.posexplode_outer("s").alias("at", "h"))
    hits = cut_lineage(own.join(side, "h").select("text_hash", "item", "n", "m", "weight", "total", "at", F.expr(
        "greatest(0, least(at, size - m))").alias("start")).distinct())
    texts = listed.join(hits.select("text_hash").distinct(), "text_hash", "left_semi")
    return texts.join(hits, "text_hash").select("doc_id", "text_hash", "item", "n", "m", "weight", "total", "at", "start",
                                                F.expr("slice(s, start + 1, m)").alias("window"))


def windows_of_common(listed: DataFrame, stretches: DataFrame, low: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item, n, start, window) that start at a shingle of ``low`` in one of the ``stretches``."""
    own = listed.withColumn("size", F.size("s")).select("text_hash", "size", F.posexplode_outer("s").alias("at", "h"))
    places = cut_lineage(own.join(low, "h").select("text_hash", "size", "at").distinct())
    hits = places.join(stretches, "text_hash").withColumn("start", F.expr("greatest(0, least(at, size - m))")).where(
        "start div m = stretch").select("text_hash", "item", "n", "m", "start").distinct()
    return listed.join(hits, "text_hash").select("doc_id", "text_hash", "item", "n", "start",
                                                 F.expr("slice(s, start + 1, m)").alias("window"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: float = 0.8,
                 radius: int = 23, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, start, n_words): the best window of each document for each item it holds.

    ``start`` counts words from 0: the first of the best windows, those that start at a shared shingle or at the last
    place before others. Only pairs with a similarity of ``threshold`` or more are returned. At that similarity two fingerprints differ in 10 of 64 bits on average, with a deviation of 3, so the
    radius leaves one pair in a million out. Items below ``width`` words are one shingle of all their words; null and
    wordless texts match nothing. A document shorter than an item is one window, and ``n_words`` its length. Repeated documents or
    items give their rows once; ``text_hash`` tells rows of one id apart. Empty tables give no rows; further columns are
    ignored.
    """
    if not 0 < radius < 64:
        raise ValueError("the radius lies between 1 and 63")
    share = Fraction(str(threshold))
    num, den = share.numerator, share.denominator
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), words(F.col(f"`{item_text_col}`")).alias("w"))
    items = items.where("size(w) > 0").withColumn("n", F.size("w")).withColumn("width", F.least("n", F.lit(width)))
    by_width = F.lit(None).cast("array<bigint>")
    for k in range(1, width + 1):
        by_width = F.when(F.col("width") == k, shingles("w", k)).otherwise(by_width)
    items = cut_lineage(few_files(items.select("item_id", "n", "width", by_width.alias("item")).distinct(), benchmark.count()))
    sums = items.groupBy("width").agg(F.sum(F.size("item")), F.count("*")).collect()  # at most ``width`` rows
    widths, n_shingles, n_items = sorted(r[0] for r in sums), sum(r[1] for r in sums), sum(r[2] for r in sums)
    weights = items.select("item", F.explode("item").alias("h")).distinct().groupBy("h").agg(
        F.greatest(F.lit(1), F.round(FULL / F.count("*"))).cast("long").alias("weight"))
    low = cut_lineage(weights.where(F.col("weight") < FULL).select("h"))
    some_low = bool(low.take(1))
    # Per shingle and item once; few enough go to every executor, more are joined by shuffling.
    looked = items.select("width", "n", "item").distinct().select(
        "width", "n", F.xxhash64("item").alias("item"), F.explode("item").alias("h")).join(weights, "h")
    totals = looked.groupBy("item", "n").agg(F.sum("weight").alias("total"))
    looked = cut_lineage(few_files(looked.distinct().join(totals, ["item", "n"]), n_shingles))
    small = looked.count() <= broadcast_rows
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = texts.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    found = None
    for k in widths:
        listed = rows.select("doc_id", "text_hash", shingles("w", k).alias("s"))
        side = looked.where(F.col("width") == k).select("h", "item", "n", (F.col("n") - (k - 1)).alias("m"),
                                                        "weight", "total")
        found_here = windows_beside(listed, side) if small else windows_apart(listed, side)
        parts = found_here.select("text_hash", "doc_id", "item", "n", "m", "weight", "total", "at", F.explode(
            F.array(F.expr("at div m"), F.expr("at div m - 1"))).alias("stretch")).where("stretch >= 0")
        enough = cut_lineage(parts.groupBy("text_hash", "doc_id", "item", "n", "m", "stretch", "total").agg(
            F.sum("weight").alias("most")).where(f"{den} * most >= {num} * total").select(
            "text_hash", "item", "n", "m", "stretch").distinct())
        hits = found_here.withColumn("stretch", F.expr("start div m")).join(
            enough.drop("m"), ["text_hash", "item", "n", "stretch"]).select(
            "doc_id", "text_hash", "item", "n", F.lit(1).alias("own"), (F.size("window") + (k - 1)).alias("n_words"),
            "start", "window")
        if some_low:
            ids = enough.select("text_hash").distinct()
            ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
            again = texts.join(ids, "text_hash", "left_semi").select("doc_id", "text_hash", words(F.col("text")).alias("w"))
            more = windows_of_common(again.select("doc_id", "text_hash", shingles("w", k).alias("s")), enough, low)
            hits = hits.union(more.select("doc_id", "text_hash", "item", "n", F.lit(0).alias("own"),
                                          (F.size("window") + (k - 1)).alias("n_words"), "start", "window"))
        found = hits if found is None else found.union(hits)
    if found is None:
        found = rows.where("false").select("doc_id", "text_hash", F.lit(0).cast("long").alias("item"), F.lit(0).alias("n"),
                                           F.lit(0).alias("own"), F.lit(0).alias("n_words"), F.lit(0).alias("start"),
                                           F.array().cast("array<bigint>").alias("window"))
    # A window is known by the length of its items and its shingles.
    found = cut_lineage(found.distinct().withColumn("wid", F.struct(
        "n", F.xxhash64("window").alias("a"), F.xxhash64(F.lit(1), "window").alias("b"))))
    windows = found.groupBy("wid").agg(F.first("window").alias("window")).select("wid", F.explode("window").alias("h"))
    bags = cut_lineage(windows.join(weights, "h", "left").select(
        "wid", "h", F.coalesce("weight", F.lit(FULL)).alias("weight")))
    item_bags = cut_lineage(few_files(items.select("item_id", "n", "item").select(
        F.struct("item_id", "n", F.xxhash64("item").alias("a")).alias("iid"), F.explode("item").alias("h"))
        .join(weights, "h").select("iid", "h", "weight"), n_shingles))
    w = cut_lineage(few_files(simhash(bags, ["wid"]), found.count()))
    i = cut_lineage(few_files(simhash(item_bags, ["iid"]).join(
        item_bags.groupBy("iid").agg((F.min("weight") < FULL).alias("mixed")), "iid"), n_items))
    left = w.select("wid", F.col("fingerprint").alias("fw"), F.col("total").alias("tw"), F.col("wid.n").alias("n"),
                    bit_blocks(F.col("fingerprint"), radius).alias("x")).select("*", "x.*").drop("x")
    right = i.where("not mixed").select(
        "iid", F.col("fingerprint").alias("fi"), F.col("total").alias("ti"), F.col("iid.n").alias("n"),
        bit_blocks(F.col("fingerprint"), radius).alias("x")).select("*", "x.*").drop("x")
    near = left.join(right, ["n", "block", "bits"]).where(
        F.bit_count(F.col("fw").bitwiseXOR(F.col("fi"))) <= radius).select("wid", "iid", "tw", "ti").distinct()
    direct = found.select("wid", "n", "item").distinct().join(i.where("mixed").select(
        "iid", F.col("total").alias("ti"), F.col("iid.n").alias("n"), F.col("iid.a").alias("item")), ["n", "item"]).join(
        w.select("wid", F.col("total").alias("tw")), "wid").select("wid", "iid", "tw", "ti")
    near = near.union(direct)
    counted = bags.groupBy("wid", "h", "weight").agg(F.count("*").alias("cw"))
    item_counted = item_bags.groupBy("iid", "h").agg(F.count("*").alias("ci"))
    common = near.join(counted, "wid").join(item_counted, ["iid", "h"]).groupBy("wid", "iid", "tw", "ti").agg(
        F.sum(F.col("weight") * F.least("cw", "ci")).alias("both"))
    sure = common.where(f"both * {den + num} >= {num} * (tw + ti)").select(
        "wid", F.col("iid.a").alias("item"), F.col("iid.item_id").alias("item_id"),
        (F.col("both") / (F.col("tw") + F.col("ti") - F.col("both"))).alias("similarity"))
    hits = found.select("doc_id", "text_hash", "wid", "item", "own", "n_words", "start").join(sure, ["wid", "item"])
    return hits.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max(F.struct("similarity", "own", (-F.col("start")).alias("back"), F.col("n_words").alias("n"))).alias("x")).select(
        "doc_id", "text_hash", "item_id", "x.similarity", (-F.col("x.back")).alias("start"),
        F.col("x.n").alias("n_words"))


# The best windows by joins on shingles, without fingerprints.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w
           FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w
      FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, k AS p, list_slice(w, k + 1, k + 5) AS h
       FROM d, UNNEST(range(0, len(w) - 4)) AS t(k) WHERE len(w) >= 5),
bs AS (SELECT item_id, len(w) AS n, list_slice(w, k + 1, k + 5) AS h
       FROM b, UNNEST(range(0, len(w) - 4)) AS t(k) WHERE len(w) >= 5),
wt AS (SELECT h, greatest(1, round(16 / count(DISTINCT item_id))) AS weight FROM bs GROUP BY h),
bag AS (SELECT item_id, n, h, count(*) AS c FROM bs GROUP BY ALL),
total AS (SELECT item_id, sum(c * weight) AS t FROM bag JOIN wt USING (h) GROUP BY item_id),
starts AS (SELECT DISTINCT ds.doc_id, item_id, bag.n, least(ds.p, ds.n - bag.n) AS start
           FROM ds JOIN bag USING (h) WHERE ds.n >= bag.n),
part AS (SELECT s.doc_id, s.item_id, s.n, s.start, ds.h, count(*) AS c
         FROM starts s JOIN ds ON ds.doc_id = s.doc_id AND ds.p BETWEEN s.start AND s.start + s.n - 5 GROUP BY ALL),
sums AS (SELECT p.doc_id, p.item_id, p.n, p.start, sum(p.c * coalesce(weight, 16)) AS tw,
                sum(coalesce(weight, 16) * least(p.c, coalesce(bag.c, 0))) AS shared
         FROM part p LEFT JOIN wt ON wt.h = p.h LEFT JOIN bag ON bag.h = p.h AND bag.item_id = p.item_id
         GROUP BY 1, 2, 3, 4),
best AS (SELECT doc_id, item_id, start, n, shared / (tw + t - shared) AS similarity,
                row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / (tw + t - shared) DESC, start) AS r
         FROM sums JOIN total USING (item_id) WHERE shared * 9 >= 4 * (tw + t))
SELECT doc_id, item_id, CAST(similarity AS DOUBLE) AS similarity, CAST(start AS INTEGER) AS start,
       CAST(n AS INTEGER) AS n_words FROM best WHERE r = 1
"""


@query("op8_benchmark_decontamination", SQL)
def op8(spark, sf_dir):
    """All documents against all benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
