"""A term index without a driver vocabulary, and a topic model by Gibbs sampling over a token table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from citespark.session import cut_lineage

SENT_COUNTS = 1 << 22  # topic counts of terms that are sent to all tasks at most (32 MB)
PIECE = 3 << 20  # tokens times topics that a task holds at once


def term_index(counts: DataFrame) -> DataFrame:
    """(index, term): the terms of ``counts(document, term, n)`` numbered from 0 in their order.

    Terms are dealt by ranges and numbered inside each range; only the sizes of the ranges meet in one small window.
    """
    dealt = counts.select("term").where("term IS NOT NULL").distinct().repartitionByRange("term").sortWithinPartitions("term")
    place = F.monotonically_increasing_id()
    dealt = cut_lineage(dealt.select("term", F.shiftright(place, 33).alias("_p"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
    ranges = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = ranges.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return dealt.join(F.broadcast(before), "_p").select((F.col("_before") + F.col("_i")).alias("index"), "term")


def term_matrix(counts: DataFrame, index: DataFrame) -> DataFrame:
    """(document, index, n): the document-term matrix in long form."""
    return counts.join(index, "term").groupBy("document", "index").agg(F.sum("n").cast("long").alias("n"))


def _per_topic(tokens: DataFrame, by: str, k: int, name: str) -> DataFrame:
    return tokens.groupBy(by).agg(F.array(*[F.count_if(F.col("topic") == t) for t in range(k)]).alias(name))


def _swept(tokens: DataFrame, k: int, terms: int, alpha: float, beta: float, sweep: int, seed: int) -> DataFrame:
    """Every token drawn anew, given the topics of all other tokens before the sweep."""
    total = tokens.agg(*[F.count_if(F.col("topic") == t).alias(f"n{t}") for t in range(k)]).first()  # k numbers
    held = F.array(*[F.lit(int(n or 0)) for n in total])
    rows = tokens.join(_per_topic(tokens, "index", k, "_w"), "index").join(_per_topic(tokens, "document", k, "_d"), "document")
    rows = rows.withColumn("_t", held)
    weight = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: (
        (F.get("_d", t) - F.when(t == F.col("topic"), 1).otherwise(0) + F.lit(alpha))
        * (F.get("_w", t) - F.when(t == F.col("topic"), 1).otherwise(0) + F.lit(beta))
        / (F.get("_t", t) - F.when(t == F.col("topic"), 1).otherwise(0) + F.lit(beta * terms))))
    spot = F.pmod(F.xxhash64("document", "index", "copy", F.lit(sweep), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    running = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda n: F.aggregate(
        F.slice("_p", F.lit(1), n), F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("_p", weight).withColumn("_c", running)
    drawn = F.size(F.filter("_c", lambda c: c <= spot * F.element_at("_c", -1)))
    return cut_lineage(rows.select("document", "index", "copy", F.least(drawn, F.lit(k - 1)).alias("topic")))


def _mixed(h):
    h = (h ^ (h >> 33)) * 0xC2B2AE3D27D4EB4F
    h = (h ^ (h >> 29)) * 0x165667B19E3779F9
    return h ^ (h >> 32)


def _hash_long(x, seeds):
    """Spark's xxhash64 of unsigned longs, going on from ``seeds`` (numpy, unsigned 64 bits)."""
    x = x * 0xC2B2AE3D27D4EB4F
    h = (seeds + 0x27D4EB2F165667CD) ^ (((x << 31) | (x >> 33)) * 0x9E3779B185EBCA87)
    return _mixed(((h << 27) | (h >> 37)) * 0x9E3779B185EBCA87 + 0x85EBCA77C2B2AE63)


def _hash_int(x, seeds):
    """The same of ints."""
    h = (seeds + 0x27D4EB2F165667C9) ^ ((x & 0xFFFFFFFF) * 0x9E3779B185EBCA87)
    return _mixed(((h << 23) | (h >> 41)) * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9)


def _hash_number(x: int, seeds):
    """The same of a number given in code, which is an int if it fits."""
    import numpy as np

    small = -(1 << 31) <= x < 1 << 31
    return (_hash_int if small else _hash_long)(np.array([x]).astype("i8").view("u8"), seeds)


def _summed(parts: list) -> tuple:
    """One row of counts for each distinct key of ``parts``, pairs of keys and rows of counts."""
    import numpy as np

    keys, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    counts = np.zeros((len(keys), parts[0][1].shape[1]), "i8")
    np.add.at(counts, place, np.concatenate([c for _, c in parts]))
    return keys, counts


def _drawn(topic, pair, doc, code, of_docs, of_terms, totals, spots, alpha: float, beta: float, terms: int):
    """A new topic for each token: ``pair`` is its place in ``doc`` and ``code``, the documents and terms of the matrix rows."""
    import numpy as np

    k = len(totals)
    d, w = of_docs[doc], of_terms[code]
    running, runs = np.zeros(len(topic)), []
    with np.errstate(divide="raise", invalid="raise"):
        for t in range(k):
            others = (d[:, t] + alpha) * (w[:, t] + beta) / (totals[t] + beta * terms)
            own = topic == t
            weight = others[pair]
            at = pair[own]
            weight[own] = (d[at, t] - 1 + alpha) * (w[at, t] - 1 + beta) / (totals[t] - 1 + beta * terms)
            running = running + weight
            runs.append(running)
    spots = spots * running
    return np.minimum(sum((run <= spots).astype("i4") for run in runs), k - 1).astype("i4")


def _packed(*arrays) -> bytes:
    """Whole numbers in their least types, compressed."""
    import io
    import zlib

    import numpy as np

    out = io.BytesIO()
    for x in arrays:
        if x.dtype == "i8" and len(x):
            x = x.astype(next(t for t in ("i1", "i2", "i4", "i8") if x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max))
        np.save(out, x, allow_pickle=False)
    return zlib.compress(out.getvalue(), 1)


def _unpacked(data: bytes) -> list:
    import io
    import zlib

    import numpy as np

    file = io.BytesIO(zlib.decompress(data))
    out = []
    while file.tell() < len(file.getbuffer()):
        out.append(np.load(file, allow_pickle=False))
    return out


def _documents(batches: Iterator, most: int) -> Iterator:
    """Blocks of about ``most`` tokens of rows ``(document, piece, index, start, n, h)``, still without topics."""
    import numpy as np

    for batch in batches:
        bounds = batch.column("n").offsets.to_numpy()
        bounds = bounds - bounds[0]
        ends = np.concatenate([[0], np.cumsum(batch.column("n").flatten().to_numpy())])[bounds[1:]]
        at = 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            part = batch.slice(at, stop - at)
            yield (part.column("document"), part.column("piece").is_valid().to_numpy(zero_copy_only=False),
                   part.column("h").to_numpy(), np.diff(bounds[at:stop + 1]).astype("i8"),
                   *(part.column(x).flatten().to_numpy() for x in ("index", "start", "n")), None)
            at = stop


def _blocks(batches: Iterator) -> Iterator:
    """The same of rows ``(document, cells, topic)`` of the sweep before. Tokens without a document end there."""
    for batch in batches:
        for k in range(len(batch)):
            cut, h, sizes, index, start, n = _unpacked(batch.column("cells")[k].as_py())
            yield (batch.column("document")[k].values, cut, h.astype("i8"), sizes, index.astype("i8"), start.astype("i8"), n.astype("i8"),
                   _unpacked(batch.column("topic")[k].as_py())[0].astype("i8"))


def _sweep(rows: DataFrame, document: str, most: int, ints: bool, k: int, alpha: float, beta: float, sweep: int, seed: int,
           terms: int = 0, sent=None, last: bool = False) -> DataFrame:
    """One sweep over blocks of documents, or with ``sweep`` 0 the first topics of the tokens of documents.

    Returns blocks and, between them, rows ``(term, c)`` and of documents in pieces ``(document, c)`` with their tokens of
    each topic, to be added up. The last sweep returns tokens.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        keys, of_terms, totals, of_large = sent.value if sweep else (None, None, None, {})
        found, names = [], ["document", "cells", "topic", "term", "c"]

        def lists(values, sizes):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4")), values)

        def counted(documents, terms_of, c):
            none = pa.nulls(len(c), pa.binary())
            return pa.record_batch([documents, none, none, terms_of, lists(pa.array(c.ravel()), np.full(len(c), k))], names=names)

        for documents, cut, seeds, sizes, index, start, n, topic in _blocks(batches) if sweep else _documents(batches, most):
            size = len(documents)
            doc, pair = np.repeat(np.arange(size), sizes), np.repeat(np.arange(len(n)), n)
            copy = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n - start, n)
            h = (_hash_int if ints else _hash_long)(index.view("u8"), seeds.view("u8")[doc])
            h = _hash_long(copy.view("u8"), h[pair])
            uniq, place = np.unique(index, return_inverse=True)
            if sweep:
                known = documents.is_valid().to_numpy(zero_copy_only=False)
                h = _hash_number(seed, _hash_number(sweep, h))
                of_docs = np.bincount(doc[pair] * k + topic, minlength=size * k).reshape(-1, k)
                for row in np.flatnonzero(cut & known):
                    of_docs[row] = of_large[documents[int(row)].as_py()]
                topic = _drawn(topic, pair, doc, np.searchsorted(keys, uniq)[place], of_docs, of_terms, totals,
                               (h & ((1 << 52) - 1)) / float(1 << 52), alpha, beta, terms)
                if not known.all():  # such tokens are seen by the first sweep and end there
                    kept = known[doc]
                    topic, pair, copy = (x[kept[pair]] for x in (topic, pair, copy))
                    pair = (np.cumsum(kept) - 1)[pair]
                    doc, index, start, n = (np.cumsum(known) - 1)[doc[kept]], index[kept], start[kept], n[kept]
                    documents, cut, seeds, sizes = documents.drop_null(), cut[known], seeds[known], sizes[known]
                    size, (uniq, place) = len(documents), np.unique(index, return_inverse=True)
            else:
                topic = np.mod(_hash_number(seed, h).view("i8"), k)
            if not len(topic):
                continue
            if last:
                yield pa.record_batch([documents.take(pa.array(doc[pair])), pa.array(index[pair]), pa.array(copy),
                                       pa.array(topic.astype("i4"))], names=["document", "index", "copy", "topic"])
                continue
            yield pa.record_batch([lists(documents, [size]), pa.array([_packed(cut, seeds, sizes, index, start, n)], pa.binary()),
                                   pa.array([_packed(topic)], pa.binary()), pa.nulls(1, pa.int64()),
                                   pa.nulls(1, pa.list_(pa.int64()))], names=names)
            found.append((uniq, np.bincount(place[pair] * k + topic, minlength=len(uniq) * k).reshape(-1, k)))
            if sum(len(x) for x, _ in found) > 100_000:
                found = [_summed(found)]
            if cut.any():
                c = np.bincount(doc[pair] * k + topic, minlength=size * k).reshape(-1, k)[cut]
                yield counted(lists(documents.filter(pa.array(cut)), np.ones(len(c))), pa.nulls(len(c), pa.int64()), c)
        if found:
            uniq, c = _summed(found)
            for i in range(0, len(uniq), 100_000):
                some = uniq[i:i + 100_000]
                yield counted(pa.nulls(len(some), pa.list_(documents.type)), pa.array(some), c[i:i + 100_000])

    return rows.mapInArrow(run, f"document {document}, index bigint, copy bigint, topic int" if last else (
        f"document array<{document}>, cells binary, topic binary, term bigint, c array<bigint>"))


def _fit_rows(matrix: DataFrame, k: int, sweeps: int, alpha: float, beta: float, seed: int, terms: int) -> DataFrame:
    """The tokens after the last sweep. Documents stand whole in blocks, a large one in several pieces; the counts of the
    terms are sent to all tasks."""
    import numpy as np

    spark, kind, document = matrix.sparkSession, matrix.schema["index"].dataType, matrix.schema["document"].dataType.simpleString()
    most = max(1024, PIECE // k)
    sizes = matrix.groupBy(F.col("document").alias("_d")).agg(F.sum("n").alias("_all")).where(F.col("_all") > most)
    large = cut_lineage(sizes)  # at most one document for so many tokens
    rows = matrix.select("document", F.col("index").cast("long").alias("index"), F.lit(None).cast("int").alias("piece"),
                         F.lit(1).cast("long").alias("start"), "n")
    cut = not large.isEmpty()
    if cut:
        rows = rows.join(F.broadcast(large), F.col("document").eqNullSafe(F.col("_d")), "left")
        parts = F.when(F.col("_all").isNotNull(), F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {most}"))).otherwise(
            F.array(F.lit(0).cast("long")))
        rows = rows.withColumn("_cut", F.explode(parts)).select(
            "document", "index", F.pmod(F.xxhash64("index", "_cut"), F.ceil(F.col("_all") * 2 / most)).cast("int").alias("piece"),
            (F.col("_cut") * most + 1).alias("start"),
            F.when(F.col("_all").isNotNull(), F.least(F.lit(most).cast("long"), F.col("n") - F.col("_cut") * most)).otherwise(F.col("n")).alias("n"))
    cells = rows.groupBy("document", "piece").agg(F.collect_list(F.struct("index", "start", "n")).alias("_c"))
    rows = cells.select("document", "piece", *[F.col(f"_c.{x}").alias(x) for x in ("index", "start", "n")], F.xxhash64("document").alias("h"))
    ints = not isinstance(kind, LongType)
    made = cut_lineage(_sweep(rows, document, most, ints, k, alpha, beta, 0, seed))
    for sweep in range(1, sweeps + 1):
        parts = [F.sum(F.col("c")[t]).alias(f"c{t}") for t in range(k)]
        per = made.where("term IS NOT NULL").groupBy("term").agg(*parts).toArrow()  # at most SENT_COUNTS numbers
        of_terms = np.stack([per.column(f"c{t}").to_numpy() for t in range(k)], 1)
        order = np.argsort(keys := per.column("term").to_numpy())
        pieces = made.where("term IS NULL AND c IS NOT NULL").groupBy(F.col("document")[0].alias("document")).agg(*parts)
        of_large = {r["document"]: [r[f"c{t}"] for t in range(k)] for r in pieces.collect()} if cut else {}
        sent = spark.sparkContext.broadcast((keys[order], of_terms[order], of_terms.sum(0).tolist(), of_large))
        blocks = made.where("cells IS NOT NULL").select("document", "cells", "topic")
        made = cut_lineage(_sweep(blocks, document, most, ints, k, alpha, beta, sweep, seed, terms, sent, sweep == sweeps))
        sent.unpersist()
    return made.select("document", F.col("index").cast(kind).alias("index"), "copy", "topic")


def gibbs_fit(matrix: DataFrame, k: int = 6, sweeps: int = 50, alpha: float | None = None, beta: float = 0.1,
              seed: int = 1337) -> DataFrame:
    """(document, index, copy, topic): the topic of each token of ``matrix(document, index, n)`` after the last sweep.

    A sweep takes each token out of the topic counts of its document and of its term and draws from their product; the draw
    is a hash of document, term, copy and sweep. All tokens of a sweep see the counts of the sweep before (the distributed
    form of the sampler), so the rows are the same on every partitioning. Each sweep is written to the shared folder: blocks
    of whole documents, next to the counts of the terms, which the next sweep sends to all tasks. With more
    than ``SENT_COUNTS`` of them, or tokens without a term, each token is joined to the counts instead.
    """
    alpha = 50.0 / k if alpha is None else alpha
    matrix = cut_lineage(matrix.where("n > 0").select("document", "index", "n"))
    tokens = matrix.select("document", "index", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    first = F.pmod(F.xxhash64("document", "index", "copy", F.lit(seed)), F.lit(k)).cast("int")
    tokens = tokens.withColumn("topic", first)
    terms, none = matrix.agg(F.count_distinct("index"), F.count_if(F.col("index").isNull())).first()
    whole = isinstance(matrix.schema["index"].dataType, (ByteType, ShortType, IntegerType, LongType))
    if sweeps > 0 and whole and not none and 0 < terms * k <= SENT_COUNTS:
        return _fit_rows(matrix, k, sweeps, alpha, beta, seed, terms)
    tokens = cut_lineage(tokens)
    for sweep in range(1, sweeps + 1):
        tokens = _swept(tokens, k, terms, alpha, beta, sweep, seed)
    return tokens


def gibbs_doc_topics(tokens: DataFrame, k: int = 6, alpha: float | None = None) -> DataFrame:
    """(document, topic, n, gamma): tokens of each topic in a document and the smoothed share; topics from 1."""
    alpha = 50.0 / k if alpha is None else alpha
    rows = _per_topic(tokens, "document", k, "_n").select("document", F.posexplode("_n").alias("_t", "n"), F.aggregate(
        "_n", F.lit(0).cast("long"), lambda a, x: a + x).alias("_all"))
    return rows.select("document", (F.col("_t") + 1).cast("long").alias("topic"), "n",
                       ((F.col("n") + alpha) / (F.col("_all") + k * alpha)).alias("gamma"))


def gibbs_topic_terms(tokens: DataFrame, index: DataFrame, k: int = 6, beta: float = 0.1) -> DataFrame:
    """(topic, term, n, beta): tokens of each term in a topic and the smoothed share; topics from 1."""
    rows = _per_topic(tokens, "index", k, "_n").select("index", F.posexplode("_n").alias("_t", "n"))
    sizes = rows.groupBy("_t").agg(F.sum("n").alias("_all"), F.count("*").alias("_v"))
    return rows.join(sizes, "_t").join(index, "index").select(
        (F.col("_t") + 1).cast("long").alias("topic"), "term", "n",
        ((F.col("n") + beta) / (F.col("_all") + F.col("_v") * beta)).alias("beta"))
