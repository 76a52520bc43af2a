"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector: one place for each structure statistic and for the length that its metadata give, and ``bins``
places for its words, hashed, with log counts of joint length 1. The machine gives it

    intercept + sum(w_i x_i) + sum over pairs i < j of <v_i, v_j> x_i x_j

where each place has a weight and a short vector. By the identity of the sum of squares the pairs cost no more than the
places: half the sum over factors of (sum v x)^2 - sum (v x)^2. The weights are fitted by
gradient steps on a bounded sample of labelled rows; scores are made of them in one pass over all texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import bounded_batches, query, table
from citespark.session import cut_lineage

SIGNS = "#*$%&|<>"
MARKS = ".,;:-_()[]{}/'\"=+@~^`?"
ENDS = (".", "!", "?", "…", "。", "।", "؟", "۔", ":", ";")
STATISTICS = ("words", "signs", "upper", "exclamation", "stutter", "bars", "distinct", "length", "repeated_lines",
              "digits", "punctuation", "open_lines", "capital", "words_a_line", "commonest", "given_length")
PIECE = 1 << 20


def words_of(text: str):
    """Lists of the words of a text, a piece of about a million characters at a time, cut between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end].split()
        at = end


def features(text: str | None, given: int | None, bins: int):
    """(places, values) of a whole text and the length that its metadata give; a null text is empty."""
    import math
    import zlib
    from collections import Counter
    from operator import eq

    import numpy as np

    text = text or ""
    counts: Counter = Counter()
    stutter, last = 0, None
    for words in words_of(text):
        counts.update(words)
        stutter += sum(map(eq, words, words[1:])) + bool(words and words[0] == last)
        last = words[-1] if words else last
    n = sum(counts.values())
    upper = letters = capital = 0
    hashed: dict[int, int] = {}
    for word, c in counts.items():
        place = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) & (bins - 1)
        hashed[place] = hashed.get(place, 0) + c
        letters += c * len(word)
        if word[0].isupper():
            capital += c
            if len(word) > 1 and word.isupper():
                upper += c
    signs, digits, marks = (sum(map(text.count, some)) for some in (SIGNS, "0123456789", MARKS))
    exclaimed, bars = text.count("!"), counts.get("|", 0)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    repeated = len(lines) - len(set(lines))
    unfinished = sum(not line.rstrip().endswith(ENDS) for line in lines)
    some, rows = max(n, 1), max(len(lines), 1)
    given = len(text) if given is None else max(given, 0)
    made = (math.log1p(n) / 10, min(signs / some, 4) / 2, upper / some, min(exclaimed / some, 4) / 2, stutter / some, bars / some,
            len(counts) / some, min(letters / some / 12, 2), repeated / rows, min(digits / some, 4) / 4,
            min(marks / some, 4) / 4,
            unfinished / rows, capital / some, math.log1p(n / rows) / 6, max(counts.values(), default=0) / some,
            math.log1p(given) / 15)
    places = np.fromiter(sorted(hashed), np.int64, len(hashed))
    values = np.log1p(np.fromiter((hashed[p] for p in places.tolist()), np.float64, len(hashed)))
    length = math.sqrt(float((values * values).sum())) or 1.0
    head = np.arange(len(STATISTICS))
    return np.concatenate([head, places + len(head)]), np.concatenate([np.array(made), values / length])


def machine(places, values, intercept: float, linear, factors) -> float:
    """The machine's output for one vector, in a time linear in its places."""
    own = factors[places] * values[:, None]
    total = own.sum(0)
    return float(intercept + linear[places] @ values + ((total * total).sum() - (own * own).sum()) / 2)


def fit(sample: DataFrame, bins: int, factors: int, epochs: int, regularisation: float, seed: int):
    """(intercept, linear, factors) learned from rows (text, given, label) by Adam steps on the log loss, 300 or more.

    The vectors are made where the rows lie; the steps run in one task, which the bound of the sample keeps small.
    """
    import numpy as np

    size = bins + len(STATISTICS)

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            made = [features(t.as_py(), g.as_py(), bins) for t, g in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array([p.astype(np.int32).tobytes() for p, _ in made], pa.binary()),
                 pa.array([v.tobytes() for _, v in made], pa.binary())], ["label", "places", "weights"])

    def learn(batches):
        import pyarrow as pa

        rows = sorted((p, v, y) for batch in batches for y, p, v in zip(*[c.to_pylist() for c in batch.columns]))
        if not rows:
            return
        places = [np.frombuffer(p, np.int32) for p, _, _ in rows]
        values = [np.frombuffer(v) for _, v, _ in rows]
        labels = np.array([y for _, _, y in rows], np.float64)
        rng = np.random.default_rng(seed)
        state = np.zeros((size, factors + 1))  # factors, then the weight
        state[:, :factors] = rng.normal(0, 0.05, (size, factors))
        bias, mean, square = np.zeros(1), [np.zeros_like(state), np.zeros(1)], [np.zeros_like(state), np.zeros(1)]
        step = 0
        for _ in range(max(epochs, -(-300 * 256 // len(rows)))):  # 300 steps at least
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), 256):
                chosen = order[at:at + 256]
                n = np.array([len(places[k]) for k in chosen])
                row, begin = np.repeat(np.arange(len(chosen)), n), np.concatenate([[0], np.cumsum(n)[:-1]])
                place, x = np.concatenate([places[k] for k in chosen]), np.concatenate([values[k] for k in chosen])
                own = state[place] * x[:, None]
                sums = np.add.reduceat(own, begin)
                squares = np.add.reduceat(own[:, :factors] ** 2, begin)
                z = bias[0] + sums[:, factors] + ((sums[:, :factors] ** 2) - squares).sum(1) / 2
                error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[chosen]) / len(chosen)
                slope = np.concatenate([sums[row, :factors] - own[:, :factors], np.ones((len(x), 1))], 1)
                slope *= (error[row] * x)[:, None]
                grad = np.stack([np.bincount(place, slope[:, f], size) for f in range(factors + 1)], 1) + regularisation * state
                step += 1
                for target, g, m, s in ((state, grad, mean[0], square[0]), (bias, error.sum(keepdims=True), mean[1], square[1])):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    target -= 0.03 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
        yield pa.RecordBatch.from_arrays([pa.array([state.tobytes()], pa.binary()), pa.array([float(bias[0])])], ["state", "bias"])

    rows = sample.select("text", "given", F.col("label").cast("double").alias("label"))
    made = cut_lineage(bounded_batches(rows).mapInArrow(make, "label double, places binary, weights binary"))
    learned = made.coalesce(1).mapInArrow(learn, "state binary, bias double").first()
    if learned is None:
        return None
    state = np.frombuffer(bytes(learned["state"])).reshape(size, factors + 1)
    return learned["bias"], state[:, factors].copy(), state[:, :factors].copy()


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             length_col: str = "n_chars", label_col: str = "label", bins: int = 1 << 12, factors: int = 8,
             epochs: int = 12, regularisation: float = 1e-4, sample_rows: int = 6000, seed: int = 7) -> DataFrame:
    """(doc_id, score, predicted) per row of ``docs``, learned from the rows whose id has a 0/1 label in ``labels``.

    ``score``: the probability of label 1, from 0 to 1; ``predicted``: 1 if it is 0.5 or more. ``sample_rows`` bounds the
    labelled ids that train (about that many, by hash of the id, each with its least text); ids with both labels and rows
    without label or text train nothing. With labels of one kind only, every score is that label; without any, 0.5. A
    null text is empty, a null length that of the text; empty texts get a score of their few statistics. Whole texts are
    read. Repeated rows are scored alike; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(
        "doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(
        F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    sent, fixed = None, float(next(iter(counts))) if len(counts) == 1 else 0.5
    if len(counts) == 2:
        share = min(1.0, sample_rows / sum(counts.values()))
        chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
        own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.struct(
            F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{length_col}`").cast("long").alias("given")).alias("row"))
        sample = own.where("row.text IS NOT NULL").join(F.broadcast(chosen), "doc_id")  # about sample_rows ids
        sample = sample.groupBy("doc_id", "label").agg(F.min("row").alias("row")).select("row.text", "row.given", "label")
        model = fit(sample, bins, factors, epochs, regularisation, seed)
        sent = spark.sparkContext.broadcast(model) if model else None
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.col(f"`{length_col}`").cast("long").alias("given"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import math

        import pyarrow as pa

        for batch in batches:
            scores = []
            for text, given in zip(batch.column(1), batch.column(2)):
                if sent is None:
                    scores.append(fixed)
                    continue
                z = machine(*features(text.as_py(), given.as_py(), bins), *sent.value)
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    found = bounded_batches(rows).mapInArrow(run, f"doc_id {kind}, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op13_quality_classifier")
def op13(spark, sf_dir):
    """A document with contradicting labels trains nothing; a null id is not held out. See ``tests/llm/test_factorisation.py``."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    known = labels.where(~out).select("doc_id", F.col("quality").alias("label"))
    return classify(docs, known).select("doc_id", out.alias("held_out"), "score", "predicted")
