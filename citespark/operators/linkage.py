"""Cited works written as text, linked to the publications of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.session import cut_lineage

YEAR = r"\(((?:18|19|20)\d\d)\)"


def plain(c: Column | str) -> Column:
    """Lower-case words of letters and digits, one space between them."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def _first_word(c: Column) -> Column:
    return F.split(c, " ")[0]


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= 3))


def parse_references(strings: DataFrame, ref: str = "CR") -> DataFrame:
    """(ref, author, year, words) of each distinct string ``authors, title, (year) source, ...``; parts may be missing."""
    rows = strings.select(F.col(ref).alias("ref")).where("ref IS NOT NULL").distinct()
    year = F.regexp_extract("ref", YEAR, 1)
    head = plain(F.when(year != "", F.regexp_extract("ref", r"(?s)^(.*?)" + YEAR, 1)).otherwise(F.col("ref")))
    return rows.select("ref", _first_word(head).alias("author"), F.when(year != "", year.cast("int")).alias("year"),
                       _words(head).alias("words"))


def resolve_references(pubs: DataFrame, strings: DataFrame, ref: str = "CR", key: str = "XX", author: str = "AU1",
                       year: str = "PY", title: str = "TI", min_share: float = 0.7, rare: int = 3) -> DataFrame:
    """(ref, id, score, status) of each distinct reference string: ``matched``, ``ambiguous`` or ``unmatched``.

    A string matches a publication if it holds at least ``min_share`` of the words of its title, its first word is the
    first author's surname up to one edit, and the years differ by one at most. The best share counts, then an equal
    year, then an equal name; several publications that are equally good are ``ambiguous`` and give no id. Only pairs
    that share one of the ``rare`` least frequent words of the title together with the year or the surname are compared,
    so a string needs one of those words without error, and the year or the
    surname: with errors in both it stays unmatched. Publications that agree in surname, year and words are one
    candidate, and strings are compared once however often they are cited: no hot reference or title makes pairs of its
    copies. Null strings are left out; publications without title words or year are never found.
    """
    works = pubs.select(F.col(key).alias("id"), _first_word(plain(author)).alias("name"), F.col(year).cast("int").alias("y"),
                        F.array_sort(_words(plain(title))).alias("title")).where("size(title) > 0 AND y IS NOT NULL AND name IS NOT NULL")
    works = works.groupBy("name", "y", "title").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    works = cut_lineage(works)  # read for the frequencies and the candidates
    words = works.select("id", F.explode("title").alias("w"))
    often = words.groupBy("w").agg(F.count("*").alias("df"))
    keys = words.join(often, "w").groupBy("id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("df", "w"))), 1, rare)["w"].alias("keys"))  # the words of one title
    works = cut_lineage(works.join(keys, "id").withColumn("_k", F.monotonically_increasing_id()))
    refs = cut_lineage(parse_references(strings, ref).withColumn("_r", F.monotonically_increasing_id()))

    def blocks(df: DataFrame, number: str, words: str, y: str, name: str) -> DataFrame:
        at = df.select(number, y, name, F.explode(words).alias("_w"))
        return at.select(number, F.explode(F.array(F.xxhash64(F.lit("y"), y, "_w"), F.xxhash64(F.lit("a"), name, "_w"))).alias("block"))

    # only two numbers a block travel; the texts join the candidates, which are checked for what the hashes stand for
    near = blocks(refs.where("year IS NOT NULL"), "_r", "words", "year", "author").join(
        blocks(works, "_k", "keys", "y", "name"), "block").select("_r", "_k").distinct()
    pairs = near.join(refs, "_r").join(works, "_k").where(F.arrays_overlap("words", "keys") & (
        (F.col("year") == F.col("y")) | (F.col("author") == F.col("name"))))
    share = F.size(F.array_intersect("title", "words")) / F.size("title")
    good = pairs.withColumn("score", share).where(
        (F.col("score") >= min_share) & (F.abs(F.col("year") - F.col("y")) <= 1) & (F.levenshtein("author", "name") <= 1))
    ranks = good.select("ref", "id", "n", F.struct("score", (F.col("year") == F.col("y")).alias("y"),
                                                   (F.col("author") == F.col("name")).alias("a")).alias("rank")).distinct()
    best = ranks.groupBy("ref", "rank").agg(F.sum("n").alias("n"), F.min("id").alias("id")).groupBy("ref").agg(
        F.max(F.struct("rank", "n", "id")).alias("top"))
    one = F.col("top.n") == 1
    return refs.select("ref").join(best, "ref", "left").select(
        "ref", F.when(one, F.col("top.id")).alias("id"), F.col("top.rank.score").alias("score"),
        F.when(one, "matched").when(F.col("top").isNotNull(), "ambiguous").otherwise("unmatched").alias("status"))


def resolved_citations(cites: DataFrame, resolved: DataFrame, pub: str = "EID", ref: str = "CR") -> DataFrame:
    """(EID, SID) of the citations whose string has one publication: what the citation networks take."""
    known = resolved.where("status = 'matched'").select(F.col("ref").alias(ref), F.col("id").alias("SID"))
    return cites.select(pub, ref).join(known, ref).select(pub, "SID").distinct()
