"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

Features of a candidate: length, shares of digits and letters, changes between classes of characters, mean log
probability of its character pairs, cover by words of the corpus' dictionary, the path, and the words beside it. Pair
probabilities and dictionary come from the words of all documents. The forest learns from labelled findings and is Spark's
own; training and scoring run in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citespark.llm.common import query, table
from citespark.llm.pii import bound
from citespark.session import cut_lineage

PATTERN = r"(?<![\p{L}\p{N}+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![\p{L}\p{N}+/_-])"
# Words beside secrets, and beside what only looks like one.
KEY_WORDS = "token|key|apikey|secret|password|passwd|pwd|auth|bearer|credential|credentials|access|private"
PLAIN_WORDS = "sha|sha1|sha256|md5|commit|hash|checksum|digest|uuid|version|example|revision|etag"
PATH_WORDS = "test|tests|example|examples|sample|fixture|fixtures|mock|doc|docs"
FEATURES = ["length", "digits", "upper", "lower", "hex", "changes", "pairs", "cover", "path_depth", "path_plain",
            "key_before", "key_after", "plain_near", "assigned", "quoted"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, nth, finding, before, after) of rows (doc_id, path, text); ``nth`` counts from 0 in a text."""
    both = F.struct(F.split("text", PATTERN, -1).alias("parts"),
                    F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"))
    listed = bound(both, lambda b: F.transform(b["found"], lambda f, k: F.struct(
        f.alias("finding"), F.right(b["parts"][k], F.lit(80)).alias("before"),
        F.left(b["parts"][k + 1], F.lit(80)).alias("after"))))
    rows = docs.where(F.col("text").rlike(PATTERN)).select("doc_id", "path", listed.alias("listed"))
    return rows.select("doc_id", "path", F.posexplode_outer("listed").alias("nth", "x")).select(
        "doc_id", "path", "nth", "x.finding", "x.before", "x.after")


def dictionary(docs: DataFrame) -> DataFrame:
    """(word, n): lower-case ASCII words of all texts with their counts."""
    words = docs.select(F.explode_outer(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return words.where("length(word) > 0").groupBy("word").agg(F.count("*").alias("n"))


def pair_costs(words: DataFrame) -> DataFrame:
    """(pair, cost): minus log of the share of a pair of letters among all pairs in the words; 26 x 26 rows at most."""
    pairs = words.where("length(word) > 1").select("n", F.explode_outer(F.transform(
        F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    pairs = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    # The window meets 676 rows at most.
    return pairs.select("pair", (-F.log(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))).alias("cost"))


def features(found: DataFrame, docs: DataFrame, min_count: int = 5) -> DataFrame:
    """The findings with their features; ``min_count``: how often a dictionary word stands in the corpus."""
    words = cut_lineage(dictionary(docs))
    costs = cut_lineage(pair_costs(words))
    distinct = cut_lineage(found.select("finding").distinct())
    pieces = distinct.select("finding", F.explode_outer(F.split(F.lower("finding"), "[^a-z]+")).alias("word"))
    pieces = pieces.where("length(word) > 2").groupBy("finding", "word").agg(F.count("*").alias("times"))
    known = words.where((F.col("n") >= min_count) & (F.length("word") > 2)).select("word")
    cover = pieces.join(known, "word").groupBy("finding").agg(F.sum(F.length("word") * F.col("times")).alias("covered"))
    pairs = distinct.select("finding", F.explode_outer(F.transform(
        F.sequence(F.lit(1), F.length("finding") - 1), lambda i: F.lower(F.substring("finding", i, F.lit(2)))))
        .alias("pair"))
    # 676 rows at most; pairs that are not two letters cost as much as a very rare one.
    costs = pairs.join(F.broadcast(costs), "pair", "left").groupBy("finding").agg(
        F.avg(F.coalesce("cost", F.lit(14.0))).alias("pairs"))
    own = distinct.join(cover, "finding", "left").join(costs, "finding")
    size = F.length("finding")

    def share(pattern: str):
        return F.length(F.regexp_replace("finding", pattern, "")) / size

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace("finding", "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    own = own.select(
        "finding", size.cast("double").alias("length"), share("[^0-9]").alias("digits"), share("[^A-Z]").alias("upper"),
        share("[^a-z]").alias("lower"), F.col("finding").rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex"),
        ((F.length(kinds) - 1) / (size - 1)).alias("changes"), "pairs",
        (F.coalesce("covered", F.lit(0)) / size).alias("cover"))
    word = r"([\p{L}\p{N}]+)"
    before = F.lower(F.regexp_extract("before", word + r"[^\p{L}\p{N}]*$", 1))
    after = F.lower(F.regexp_extract("after", "^[^\\p{L}\\p{N}]*" + word, 1))
    path = F.coalesce(F.col("path"), F.lit(""))
    flags = {
        "path_depth": F.size(F.split(path, "/")), "path_plain": F.lower(path).rlike(f"(^|[/._-])({PATH_WORDS})([/._-]|$)"),
        "key_before": before.rlike(f"^({KEY_WORDS})$"), "key_after": after.rlike(f"^({KEY_WORDS})$"),
        "plain_near": before.rlike(f"^({PLAIN_WORDS})$") | after.rlike(f"^({PLAIN_WORDS})$"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"'`]?$"), "quoted": F.col("before").rlike("[\"'`]$"),
    }
    return found.select("*", *[v.cast("double").alias(k) for k, v in flags.items()]).join(own, "finding")


def scan(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source",
         sample_rows: int = 4000, trees: int = 20, depth: int = 6, threshold: float = 0.5) -> DataFrame:
    """(doc_id, nth, finding, probability) of the findings that the forest holds for secrets, of whole texts.

    ``labelled``: rows (finding, before, after, path, label 0 or 1), judged by people or by sure rules. At most
    ``sample_rows`` of each label train the forest, those with the least hashes. If one of the labels is missing nothing
    can be removed: all findings come back, with a null probability. Null or empty texts have no findings; a null path
    is empty. Copies of a document each give their findings; an empty table gives no rows; further columns are ignored.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{path_col}`").cast("string").alias("path"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    found = cut_lineage(candidates(docs).where("finding IS NOT NULL"))
    labelled = labelled.select("finding", "before", "after", "path", F.col("label").cast("double").alias("label"))
    labelled = labelled.where("label IN (0, 1) AND finding IS NOT NULL").distinct()
    order = Window.partitionBy("label").orderBy(F.xxhash64("finding", "before", "after", "path"), "finding", "before")
    sample = cut_lineage(labelled.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_rows).drop("r"))
    if {r[0] for r in sample.select("label").distinct().collect()} != {0.0, 1.0}:
        return found.select("doc_id", "nth", "finding", F.lit(None).cast("double").alias("probability"))
    none = F.lit(None)
    both = found.select("doc_id", "nth", "finding", "before", "after", "path", none.cast("double").alias("label")).union(
        sample.select(none.cast(found.schema["doc_id"].dataType), none.cast("int"), "finding", "before", "after", "path",
                      "label"))
    rows = cut_lineage(features(both, docs))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    # One partition of a bounded sample, in a fixed order: the same forest on every run.
    train = cut_lineage(rows.where("label IS NOT NULL").coalesce(1).sortWithinPartitions("label", "finding", "before", "after"))
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=11)
    model = forest.fit(vectors.transform(train))
    scored = model.transform(vectors.transform(rows.where("label IS NULL")))
    return scored.withColumn("probability", F.round(vector_to_array("probability")[1], 9)).where(
        F.col("probability") >= threshold).select("doc_id", "nth", "finding", "probability")


def sure_findings(docs: DataFrame) -> DataFrame:
    """Labelled findings by sure rules, in place of people's: long mixed hexadecimal behind a key word and a sign of
    assignment is a secret; words of letters and plain numbers that nothing assigns are not."""
    found = candidates(docs)
    hexadecimal = F.col("finding").rlike("^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$")
    behind = F.lower("before").rlike(f"(^|[^\\p{{L}}])({KEY_WORDS})\\s*[=:]\\s*[\"'`]?$")
    plain = F.col("finding").rlike("^([A-Za-z]+|[0-9]+)$") & ~F.col("before").rlike(r"[=:]\s*[\"'`]?$")
    return found.withColumn("label", F.when(hexadecimal & behind, 1).when(plain, 0)).where("label IS NOT NULL")


@query("op2_secret_scan")
def op2(spark, sf_dir):
    """Rules label findings of three quarters of the documents; checked on the others in ``tests/llm/test_secrets.py``."""
    docs = table(spark, sf_dir, "documents")
    known = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).select(
        "doc_id", F.col("source").alias("path"), "text")
    found = scan(docs, cut_lineage(sure_findings(known)))
    return found.select("doc_id", "nth", F.concat(F.substring("finding", 1, 4), F.lit("…")).alias("shown"),
                        F.sha2("finding", 256).alias("finding_sha256"), F.length("finding").alias("length"), "probability")
