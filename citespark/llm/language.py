"""Language identification by nearest centroids.

A text is the vector of its character 2- and 3-grams (letters, lower case, runs of anything else one space), hashed into
``bins`` places, weighted by (1 + log tf) * idf and normalised. Inverse document frequencies come from all labelled
training texts. Each language has several centroids, found by spherical k-means on a bounded sample of its training
texts. A text gets the language of the centroid with the largest cosine; one whose distance is beyond what the members
of that centroid show is marked as rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import bounded_batches, query, table

CHUNK = 1 << 20


class Grams:
    """Counts of hashed character n-grams of whole texts, in pieces of a million characters."""

    def __init__(self, bins: int):
        import sys

        import numpy as np

        self.np, self.bins = np, bins
        self.letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)

    def counts(self, text: str | None):
        """(places, counts), or None for a text without letters."""
        np = self.np
        total, tail, any_letter = None, np.array([32], np.uint32), False
        for at in range(0, len(text or ""), CHUNK):
            codes = np.frombuffer(text[at:at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            letters = self.letter[codes]
            any_letter = any_letter or bool(letters.any())
            last = at + CHUNK >= len(text)
            codes = np.concatenate([tail, np.where(letters, codes, 32), np.array([32] * last, np.uint32)])
            codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
            two = codes[:-1] * np.uint32(0x9E3779B1) ^ (codes[1:] + np.uint32(0x7F4A7C15)) * np.uint32(0x85EBCA77)
            three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
            # A 3-gram over the joint of two pieces is made with the next piece; of the 2-grams only new ones count.
            parts = [g ^ (g >> np.uint32(16)) for g in (two if at == 0 else two[len(tail) - 1:], three)]
            here = np.bincount(np.concatenate(parts) & np.uint32(self.bins - 1), minlength=self.bins)
            total = here if total is None else total + here
            tail = codes[-2:]
        if not any_letter:
            return None
        places = np.flatnonzero(total)
        return places, total[places]

    def vector(self, text: str | None, idf):
        found = self.counts(text)
        if found is None:
            return None
        places, counts = found
        weights = (1 + self.np.log(counts)) * idf[places]
        return places, (weights / self.np.sqrt((weights * weights).sum())).astype("f4")


def document_frequencies(texts: DataFrame, bins: int):
    """(documents with letters, documents per place) of rows (text); the driver gets ``bins`` numbers."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        grams, total = Grams(bins), np.zeros(bins + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if (found := grams.counts(text.as_py())) is not None:
                    total[found[0]] += 1
                    total[bins] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["df"])

    parts = bounded_batches(texts).mapInArrow(run, "df array<bigint>")
    rows = parts.select(F.posexplode("df").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(bins + 1, np.int64)
    for row in rows:
        total[row["place"]] = row["n"]
    return int(total[bins]), total[:bins]


def clusters(sample: DataFrame, idf, bins: int, per_language: int, deviations: float):
    """[(language, centroid, least cosine)] by spherical k-means on a bounded sample of rows (lang, text)."""

    def run(rows):
        import numpy as np
        import pyarrow as pa

        grams, lang = Grams(bins), rows.column("lang")[0].as_py()
        texts = sorted(rows.column("text").to_pylist())
        found = [v for t in texts if (v := grams.vector(t, idf)) is not None]
        matrix = np.zeros((len(found), bins), np.float32)
        for k, (places, weights) in enumerate(found):
            matrix[k, places] = weights
        if not len(found):
            return pa.table([pa.array([], pa.string()), pa.array([], pa.binary()), pa.array([], pa.float64())],
                            ["lang", "centroid", "least"])
        centre = matrix.mean(0)
        chosen = [int((matrix @ centre).argmax())]
        while len(chosen) < min(per_language, len(found)):
            chosen.append(int((matrix @ matrix[chosen].T).max(1).argmin()))
        centroids, reached = matrix[chosen].copy(), -1.0
        while True:
            cosines = matrix @ centroids.T
            own = cosines.argmax(1)
            if (now := float(cosines.max(1).sum())) <= reached * (1 + 1e-6):
                break
            reached = now
            for k in range(len(centroids)):
                if (own == k).any():
                    mean = matrix[own == k].mean(0)
                    centroids[k] = mean / np.linalg.norm(mean)
        cosine = (matrix * centroids[own]).sum(1)
        least = [float(cosine[own == k].mean() - deviations * cosine[own == k].std()) if (own == k).any() else 0.0
                 for k in range(len(centroids))]
        return pa.table([pa.array([lang] * len(centroids)), pa.array([c.tobytes() for c in centroids], pa.binary()),
                         pa.array(least)], ["lang", "centroid", "least"])

    rows = sample.groupBy("lang").applyInArrow(run, "lang string, centroid binary, least double").collect()
    return sorted((r["lang"], bytes(r["centroid"]), r["least"]) for r in rows)


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             bins: int = 1 << 14, per_language: int = 4, sample_rows: int = 400, deviations: float = 5.0) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) per row of ``docs``, learned from the text and label of ``train``.

    ``score`` is the cosine to the nearest centroid, from 0 to 1. ``rejected``: it is more than ``deviations`` standard
    deviations below the mean of that centroid's training members, so the text is far from all that was learned. A null
    text and one without letters are ``und`` with score 0, rejected; so is every text if nothing could be learned.
    Equal cosines go to the first language by name. ``sample_rows`` bounds the texts per language for k-means;
    frequencies use all of ``train``. Training rows without label or text are ignored. Whole texts are read. Repeated
    rows are predicted alike; an empty table gives no rows; further columns are ignored.
    """
    import numpy as np

    spark = docs.sparkSession
    train = train.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string")
                         .alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    total, df = document_frequencies(train.select("text"), bins)
    idf = np.log((1 + total) / (1 + df)) + 1
    # The least hashes of each language are cut to the bound per task, before the shuffle, and without the texts.
    keys = train.select("lang", F.xxhash64("text").alias("h")).distinct()
    keys.createOrReplaceTempView("_language_keys")
    least = spark.sql(f"""SELECT lang, h FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS r
                          FROM _language_keys) WHERE r <= {int(sample_rows)}""")
    sample = train.withColumn("h", F.xxhash64("text")).join(F.broadcast(least), ["lang", "h"])  # its size is bounded
    sample = sample.groupBy("lang", "h").agg(F.min("text").alias("text"))
    learned = clusters(sample, idf, bins, per_language, deviations)
    names = [name for name, _, _ in learned]
    matrix = np.array([np.frombuffer(c, np.float32) for _, c, _ in learned]).reshape(-1, bins).T.copy()
    sent = spark.sparkContext.broadcast((idf, matrix, names, [x for _, _, x in learned]))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        idf, matrix, names, least = sent.value
        grams = Grams(bins)
        for batch in batches:
            out = []
            for text in batch.column(1):
                found = grams.vector(text.as_py(), idf) if names else None
                if found is None:
                    out.append(("und", 0.0, True))
                    continue
                cosine = found[1] @ matrix[found[0]]
                k = int(cosine.argmax())
                out.append((names[k], min(1.0, max(0.0, float(cosine[k]))), float(cosine[k]) < least[k]))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()),
                 pa.array(columns[2], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return bounded_batches(rows).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


@query("op4_language_id")
def op4(spark, sf_dir):
    """A null id counts as not held out. Checked by held-out accuracy in ``tests/llm/test_language.py``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(held_out(), F.lit(False))
    found = identify(docs, docs.where(~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
