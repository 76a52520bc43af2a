"""N-gram Jaccard join by MinHash banding.

1. Every text becomes its set of word n-grams (64-bit hashes), a 128-bit key of the set and one hash per band of MinHash
   values. Texts with one set are copies and go on as one row with a count.
2. The rows that share a band hash are shuffled together; each points to the least of them. Rows that hang together by
   such pointers form a group of candidates. No pairs are made here, so a hot band costs its rows and not their square.
3. The full sets of candidates only are fetched and compared inside their group, in blocks of bounded size: a task gets
   two blocks, counts each row's links and returns one row per member, never the pairs. All pairs of a group are
   compared, those that share no band included.
4. The links' forest gives the classes.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import bounded_batches, few_files, query, table
from citespark.llm.components import components
from citespark.session import cut_lineage


def choose_bands(threshold: float, recall: float = 0.999, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands find a pair at the threshold with this recall.

    A pair of similarity s agrees in a band of r rows with probability s**r, so b bands find it with 1 - (1 - s**r)**b.
    """
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-threshold**rows))
        if bands * rows > hashes:
            break
        best = bands, rows
    return best


def shingle_sets(texts, width: int):
    """For each text of an Arrow string array the sorted distinct hashes of its word n-grams (numpy, unsigned 64 bits).

    Words are separated by white space. A text of fewer words than ``width`` has one n-gram of all its words; a null or
    wordless text has none.
    """
    import numpy as np
    import pandas as pd
    import pyarrow.compute as pc

    words = pc.utf8_split_whitespace(texts.fill_null(""))
    bounds = words.offsets.to_numpy()
    codes = words.values[bounds[0]:bounds[-1]].dictionary_encode()
    names = codes.dictionary.to_pandas().to_numpy(object)
    hashes = pd.util.hash_array(names, categorize=False).astype(np.uint64) if len(names) else np.zeros(0, np.uint64)
    real = np.array([bool(x) for x in names], bool)
    codes = codes.indices.to_numpy()
    bounds = bounds - bounds[0]
    if len(codes) and not real.all():  # white space at the ends of a text makes empty words
        keep = real[codes]
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        codes = codes[keep]
    flat = hashes[codes]
    odd = np.uint64(0x9E3779B97F4A7C15)

    def mixed(parts):
        total = np.full(len(parts[0]), len(parts), np.uint64)
        for part in parts:
            total = (total ^ part) * odd
            total ^= total >> np.uint64(32)
        return total * odd

    n = len(flat) - width + 1
    grams = mixed([flat[k:k + n] for k in range(width)]) if n > 0 else flat[:0]
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= width:
            yield np.unique(grams[a:b - width + 1])
        elif b > a:
            yield mixed([flat[k:k + 1] for k in range(a, b)])
        else:
            yield flat[:0]


def set_key(grams) -> bytes:
    from hashlib import blake2b

    return blake2b(grams.tobytes(), digest_size=16).digest()


def sketches(rows: DataFrame, width: int, bands: int, per_band: int) -> DataFrame:
    """(doc_id, key, n, bands) of rows (doc_id, text)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from citespark.llm.tokens import blocks

        factors = np.random.default_rng(7).integers(1, 2**63, bands * per_band, np.uint64) * np.uint64(2) + np.uint64(1)
        odd = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for begin, end in blocks(batch.column(1), 2_000_000):
                sets = list(shingle_sets(batch.column(1).slice(begin, end - begin), width))
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                hashes = np.zeros((len(sets), bands), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[k] for k in full])
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for band in range(bands):
                        own = np.full(len(full), band + 1, np.uint64)
                        for row in range(per_band):
                            least = np.minimum.reduceat(flat * factors[band * per_band + row], starts)
                            own = (own ^ least) * odd
                            own ^= own >> np.uint64(32)
                        hashes[full, band] = own * odd
                lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands,
                                                 hashes.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array([set_key(s) for s in sets], pa.binary()),
                     pa.array(sizes, pa.int32()), lists], ["doc_id", "key", "n", "bands"])

    return bounded_batches(rows).mapInArrow(run, f"doc_id {kind}, key binary, n int, bands array<bigint>")


def keyed_sets(texts: DataFrame, width: int) -> DataFrame:
    """(key, grams) of rows (text)."""

    def run(batches):
        import pyarrow as pa

        from citespark.llm.tokens import blocks

        for batch in batches:
            for begin, end in blocks(batch.column(0), 2_000_000):
                sets = list(shingle_sets(batch.column(0).slice(begin, end - begin), width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(s) for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "grams"])

    return bounded_batches(texts).mapInArrow(run, "key binary, grams binary")


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(key, links, root) per member of each pair of blocks; rows (group_id, a, b, block, key, copies, grams)."""
    share = Fraction(str(threshold))
    num, den = share.numerator, share.denominator

    def run(rows):
        import numpy as np
        import pyarrow as pa

        keys, block = rows.column("key").to_pylist(), rows.column("block").to_numpy()
        first, second = rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
        copies = rows.column("copies").to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in rows.column("grams").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        place = np.unique(np.concatenate(sets), return_inverse=True)[1]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        own = [place[a:b] for a, b in zip(cuts, cuts[1:])]
        left = np.flatnonzero(block == first)
        left = left[np.argsort(sizes[left], kind="stable")]
        right = left
        if first != second:
            right = np.flatnonzero(block == second)
            right = right[np.argsort(sizes[right], kind="stable")]
        links, parent = np.zeros(len(keys), np.int64), list(range(len(keys)))

        def root(k):
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        if len(right):
            flat = np.concatenate([own[k] for k in right])
            starts = np.concatenate([[0], np.cumsum(sizes[right])])
            here = np.zeros(len(place) + 1, bool)
            for at, x in enumerate(left):
                low = at + 1 if first == second else np.searchsorted(sizes[right] * den, sizes[x] * num, "left")
                high = np.searchsorted(sizes[right] * num, sizes[x] * den, "right")
                if low >= high:
                    continue
                here[own[x]] = True
                part = here[flat[starts[low]:starts[high]]]
                both = np.add.reduceat(part, starts[low:high] - starts[low], dtype=np.int64)
                here[own[x]] = False
                hits = right[low:high][both * (den + num) >= num * (sizes[x] + sizes[right[low:high]])]
                links[x] += copies[hits].sum()
                links[hits] += copies[x]
                for y in hits.tolist():
                    a, b = root(int(x)), root(y)
                    if a != b:
                        parent[b] = a
        return pa.table([pa.array(keys, pa.binary()), pa.array(links),
                         pa.array([keys[root(k)] for k in range(len(keys))], pa.binary())], ["key", "links", "root"])

    return members.groupBy("group_id", "a", "b").applyInArrow(run, "key binary, links bigint, root binary")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    threshold: float = 0.8, recall: float = 0.999, block_rows: int = 512,
                    block_grams: int = 1_500_000) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies, first_copy) per row: its class of near duplicates, by the least id in it.

    A link joins two rows whose sets of word n-grams have a Jaccard similarity of ``threshold`` or more; a class holds
    what hangs together by links. ``n_links`` counts all other rows linked to this one, copies included; ``n_copies``
    the rows with the same set, this one included. ``first_copy``: its id is the least of its copies.
    A text below ``width`` words is one n-gram. Null and wordless texts have no links and are classes of their own.
    Repeated rows are copies of each other. An empty table gives no rows; further columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    bands, per_band = choose_bands(threshold, recall)
    sketch = cut_lineage(sketches(rows, width, bands, per_band))
    some = sketch.where("n > 0")
    sets = cut_lineage(few_files(some.groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"),
        F.first("bands").alias("bands")), sketch.count()))
    n_sets = sets.count()
    banded = sets.select("key", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    edges = banded.join(least, "band").where("key != least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    groups = components(edges, n_sets * bands).select(F.col("node").alias("key"), F.col("component").alias("group_id"))
    members = cut_lineage(few_files(groups.join(sets.select("key", "rep", "copies", "n"), "key"), n_sets))
    parts = members.groupBy("group_id").agg(F.greatest(
        F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / block_grams)).cast("int").alias("parts"))
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text")
    grams = keyed_sets(texts, width).dropDuplicates(["key"])
    blocks = members.join(parts, "group_id").withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).join(grams, "key")
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "group_id", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "key",
        "copies", "grams")
    linked = cut_lineage(verified(blocks, threshold))
    classes = components(linked.where("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")),
                         linked.count())
    classes = classes.select(F.col("node").alias("key"), F.col("component").alias("class"))
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    named = members.select("key", "rep").join(classes, "key")
    ids = named.groupBy("class").agg(F.min("rep").alias("class_id"))
    found = sets.select("key", "rep", "copies").join(links, "key", "left").join(
        classes.join(ids, "class").select("key", "class_id"), "key", "left")
    found = found.select("key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"),
                         F.coalesce("class_id", "rep").alias("class_id"))
    return sketch.select("doc_id", "key", "n").join(found, "key", "left").select(
        "doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.col("n").eqNullSafe(0) | F.col("doc_id").eqNullSafe(F.col("rep"))).alias("first_copy"))


@query("op5_jaccard_join")
def op5(spark, sf_dir):
    """Checked against all pairs in ``tests/llm/test_jaccard.py``."""
    return jaccard_classes(table(spark, sf_dir, "documents"))
