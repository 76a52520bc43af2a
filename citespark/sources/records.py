"""Nested document records (JSON) and search-result entries (XML)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.functions import clean_author, first_author_label, nest, normalize_missing, squish
from citespark.functions.ranks import top_per_group
from citespark.operators.cleaning import first_authors, squish_strings

# The parts of a record that are used, as a schema.
AFFILIATION = "struct<affilname:string,`@id`:string,`affiliation-city`:string,`affiliation-country`:string>"
RECORD = f"""
coredata struct<eid:string,`source-id`:string>,
authors struct<author:array<struct<`ce:indexed-name`:string,`@auid`:string,affiliation:struct<`@id`:string>>>>,
affiliation string,
`subject-areas` struct<`subject-area`:array<struct<`$`:string,`@code`:string,`@abbrev`:string>>>,
item struct<
  bibrecord:struct<
    `item-info`:struct<itemidlist:struct<itemid:array<struct<`@idtype`:string,`$`:string>>>>,
    tail:struct<bibliography:struct<reference:array<struct<`ref-info`:struct<
      `refd-itemidlist`:struct<itemid:struct<`$`:string>>,
      `ref-publicationyear`:struct<`@first`:string>,
      `ref-title`:struct<`ref-titletext`:string>,
      `ref-sourcetitle`:string,
      `ref-authors`:struct<author:array<struct<`ce:indexed-name`:string>>>>>>>>>,
  `xocs:meta`:struct<`xocs:funding-list`:struct<
    `xocs:funding`:array<struct<`xocs:funding-agency-matched-string`:string,`xocs:funding-agency-acronym`:string,
      `xocs:funding-agency-id`:string,`xocs:funding-agency-country`:string>>,
    `xocs:funding-text`:string>>>
"""


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One record per line; unknown parts are skipped, missing parts are null."""
    df = spark.read.schema(RECORD.replace("\n", " ")).json(path)
    return df.withColumn("EID", F.col("coredata.eid"))


def _text(c: Column | str) -> Column:
    return normalize_missing(squish(F.col(c) if isinstance(c, str) else c))


def author_rows(records: DataFrame) -> DataFrame:
    """(EID, AU, AU_ID, AU_C1_ID, pos), names cleaned."""
    rows = records.select("EID", F.posexplode("authors.author").alias("pos", "_a"))
    return rows.select(
        "EID", clean_author(_text("_a.`ce:indexed-name`")).alias("AU"), _text("_a.`@auid`").alias("AU_ID"),
        _text("_a.affiliation.`@id`").alias("AU_C1_ID"), "pos")


def extract_authors(records: DataFrame, level: str = "document") -> DataFrame:
    """``document``: (EID, AU1, N_AU, AU); ``entity``: (AU_ID, DOC), authors without id in one row."""
    rows = author_rows(records)
    if level == "entity":
        return nest(rows, ["AU_ID"], "DOC")
    nested = nest(rows.select("EID", "pos", "AU", "AU_ID", "AU_C1_ID"), ["EID"], "AU")
    return first_authors(rows).join(nested, "EID")


def affiliation_rows(records: DataFrame) -> DataFrame:
    """(EID, C1, C1_ID, C1_CT, C1_CN) whether the record holds one object, a list or nothing."""
    raw = F.trim("affiliation")
    many = F.when(raw.startswith("["), F.from_json(raw, f"array<{AFFILIATION}>"))
    one = F.when(raw.startswith("{"), F.array(F.from_json(raw, AFFILIATION)))
    rows = records.select("EID", F.explode(F.coalesce(many, one)).alias("_c"))
    return rows.select(
        "EID", _text("_c.affilname").alias("C1"), _text("_c.`@id`").alias("C1_ID"),
        _text("_c.`affiliation-city`").alias("C1_CT"), _text("_c.`affiliation-country`").alias("C1_CN"))


def extract_affiliations(records: DataFrame, level: str = "document") -> DataFrame:
    rows = affiliation_rows(records)
    if level == "entity":
        return nest(rows.select("C1_ID", "EID").dropna().distinct(), ["C1_ID"], "DOC")
    return nest(rows, ["EID"], "C1")


def extract_subjects(records: DataFrame) -> DataFrame:
    """(EID, SC, SC_ID, SC_CODE): subject name, code, abbreviation."""
    rows = records.select("EID", F.explode("subject-areas.subject-area").alias("_s"))
    return rows.select("EID", _text("_s.`$`").alias("SC"), _text("_s.`@code`").alias("SC_ID"), _text("_s.`@abbrev`").alias("SC_CODE"))


def extract_funding(records: DataFrame) -> DataFrame:
    """(EID, FX, FX_CODE, FX_ID, FX_CN, FX_TXT); a record without funding keeps a row of nulls."""
    lst = "item.xocs:meta.xocs:funding-list"
    rows = records.select(
        "EID", F.col(f"{lst}.xocs:funding-text").alias("_t"), F.explode_outer(f"{lst}.xocs:funding").alias("_f"))
    return rows.select(
        "EID", _text("_f.`xocs:funding-agency-matched-string`").alias("FX"), _text("_f.`xocs:funding-agency-acronym`").alias("FX_CODE"),
        _text("_f.`xocs:funding-agency-id`").alias("FX_ID"), _text("_f.`xocs:funding-agency-country`").alias("FX_CN"), _text("_t").alias("FX_TXT"))


def extract_core_ids(records: DataFrame) -> DataFrame:
    """(EID, SO_ID, SID): source id and the group id, the item id marked ``SGR``."""
    ids = F.transform(F.col("item.bibrecord.item-info.itemidlist.itemid"), lambda x: F.concat(F.coalesce(x["@idtype"], F.lit("")), x["$"]))
    group = F.get(F.filter(ids, lambda s: s.contains("SGR")), 0)
    return records.select("EID", F.col("coredata.source-id").alias("SO_ID"), F.replace(group, F.lit("SGR"), F.lit("")).alias("SID"))


def extract_references(records: DataFrame) -> DataFrame:
    """(EID, CR_SID, CR_PY, CR_TI, CR_SO, CR_AU1, CR_N_AU): distinct keyed references."""
    rows = records.select("EID", F.posexplode("item.bibrecord.tail.bibliography.reference.ref-info").alias("_p", "_r"))
    names = F.transform(F.col("_r.`ref-authors`.author"), lambda a: clean_author(a["ce:indexed-name"]))
    rows = rows.select(
        "EID", "_p", _text("_r.`refd-itemidlist`.itemid.`$`").alias("CR_SID"),
        F.col("_r.`ref-publicationyear`.`@first`").try_cast("long").alias("CR_PY"),
        _text("_r.`ref-title`.`ref-titletext`").alias("CR_TI"), _text("_r.`ref-sourcetitle`").alias("CR_SO"),
        first_author_label(names).alias("CR_AU1"), F.size(names).cast("long").alias("CR_N_AU"))
    rows = rows.dropna(subset=["EID", "CR_SID"])
    return top_per_group(rows, ["EID", "CR_SID"], [F.col("_p")], 1).drop("_p")


# search-result entries --------------------------------------------------------------
ENTRY = """
eid string, doi string, `pubmed-id` string,
author array<struct<surname:string,initials:string>>,
affiliation array<struct<affilname:string,`affiliation-country`:string>>,
coverDate string, title string, publicationName string, volume string, issueIdentifier string, pageRange string,
authkeywords string, description string, subtypeDescription string, `citedby-count` string
"""


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True)
        .schema(ENTRY.replace("\n", " ")).load(path)
    )


def flatten_entries(entries: DataFrame) -> DataFrame:
    """Sixteen flat columns per entry; lists are distinct values joined by ``|``."""
    def joined(c: Column) -> Column:
        return F.array_join(F.array_distinct(c), "|")

    authors = F.transform("author", lambda a: F.concat_ws(" ", a["surname"], a["initials"]))
    return squish_strings(entries.select(
        F.col("eid").alias("scopusID"), "doi", F.col("pubmed-id").alias("pmid"), joined(authors).alias("authors"),
        joined(F.col("affiliation.affilname")).alias("affiliations"), joined(F.col("affiliation.affiliation-country")).alias("countries"),
        F.substring("coverDate", 1, 4).alias("year"), F.col("title").alias("articletitle"), F.col("publicationName").alias("journal"),
        "volume", F.col("issueIdentifier").alias("issue"), F.col("pageRange").alias("pages"),
        F.replace("authkeywords", F.lit(" | "), F.lit("|")).alias("keywords"), F.col("description").alias("abstract"),
        F.col("subtypeDescription").alias("ptype"), F.col("citedby-count").alias("timescited")))


