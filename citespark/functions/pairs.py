"""Pairs of members that share items, and nesting, both safe for hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citespark.session import cut_lineage

BLOCK = 4000  # members of one item joined in one cell
HOT = 250  # members from which on an item may be held back
PAIRS_OF_A_TASK = 1_000_000
MOST_TASKS = 20_000


def dealt(left: DataFrame, right: DataFrame, item: str, a: str, b: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Two different sides of a join on ``item``, dealt over (_l, _r) so that no key holds more than ``block`` rows a side.

    Each side is cut into as many blocks as its own rows of the item ask for and repeated for those of the other side.
    """
    rows = left.groupBy(item).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_kl")).join(
        right.groupBy(item).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_kr")), item)
    def own(x, k):
        return F.pmod(F.xxhash64(x), F.col(k).cast("long")).cast("int")

    left = left.join(rows, item).withColumn("_l", own(a, "_kl")).withColumn(
        "_r", F.explode(F.sequence(F.lit(0), F.col("_kr") - 1))).drop("_kl", "_kr")
    right = right.join(rows, item).withColumn("_r", own(b, "_kr")).withColumn(
        "_l", F.explode(F.sequence(F.lit(0), F.col("_kl") - 1))).drop("_kl", "_kr")
    return left, right


def _cells(rows: DataFrame, block: int, blocks: DataFrame | None) -> DataFrame:
    """``(owner, mark, heavy, others)``: a member with those behind it in one block, or in a later block, of one item.

    Members have one order for all items: marked ones first, then by hash. An item with up to ``block`` members is one
    sorted list; a larger one is cut along that order into lists that meet each other once. So a pair has the same
    owner whatever item it shares.
    """
    place = F.pmod(F.xxhash64("member"), F.lit(1 << 32)) / F.lit(float(1 << 33)) + F.when(F.col("mark"), 0.0).otherwise(0.5)
    rows = rows.withColumn("_at", place)
    by = ["item"]
    if blocks is not None:
        by = ["item", "_i", "_k"]
        rows = rows.join(blocks, "item", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
        rows = rows.withColumn("_i", F.floor(F.col("_at") * F.col("_k")).cast("int"))
    lists = rows.repartition(*by).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("_at", "member", "mark", "heavy"))).alias("_m")).withColumn("_ids", F.col("_m.member"))
    inside = lists.where(F.size("_m") > 1).select("_ids", F.posexplode("_m").alias("_p", "_o")).where(F.size("_ids") > F.col("_p") + 1)
    cells = inside.select("_o", F.slice("_ids", F.col("_p") + 2, F.size("_ids")).alias("others"))
    if blocks is not None:
        lists = cut_lineage(lists.where("_k > 1"))
        later = lists.select("item", F.col("_ids").alias("others"), F.explode(F.sequence(F.lit(0), F.col("_i"))).alias("_i"), F.col("_i").alias("_r"))
        across = lists.drop("_ids").join(later.where(F.col("_i") < F.col("_r")), ["item", "_i"])
        cells = cells.unionByName(across.select(F.explode("_m").alias("_o"), "others"))
    return cells.select(F.col("_o.member").alias("owner"), F.col("_o.mark").alias("mark"), F.col("_o.heavy").alias("heavy"), "others")


def _pair_counts(cells: DataFrame, tasks: int) -> DataFrame:
    """``(owner, mark, other, weight)``: lists travel to their owner and become pairs only there, where they are counted.

    The pairs of a heavy owner are dealt by the other member too.
    """
    member = cells.schema["owner"].dataType.simpleString()
    single = F.transform("others", lambda o: F.struct(F.pmod(F.xxhash64(o), F.lit(tasks)).cast("int").alias("_s"), F.array(o).alias("others")))
    whole = F.array(F.struct(F.lit(0).alias("_s"), F.col("others")))
    shape = f"array<struct<_s:int,others:array<{member}>>>"
    dealt = cells.select("owner", "mark", F.inline(F.when(F.col("heavy"), single.cast(shape)).otherwise(whole.cast(shape))))
    return dealt.repartition(tasks, "owner", "_s").select("owner", "mark", "_s", F.explode("others").alias("other")).groupBy(
        "owner", "_s", "mark", "other").agg(F.count(F.lit(1)).alias("weight")).drop("_s")


def _held_items(inc: DataFrame, degree: DataFrame, most: int, hot: int) -> DataFrame:
    """``(member, item)``: up to ``most`` hot items of each member, the most common ones."""
    order = Window.partitionBy("member").orderBy(F.col("deg").desc(), "item")
    ranked = inc.join(degree.where(F.col("deg") > hot), "item").withColumn("_n", F.row_number().over(order))
    return ranked.where(F.col("_n") <= most).select("member", "item")


def shared_item_pairs(incidence: DataFrame, member: str, item: str, min_weight: int = 1, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """``(src, dst, weight)``: member pairs, ``src < dst``, with the number of shared items.

    Repeated (member, item) rows count once; rows with a null are left out. With ``min_weight`` = k >= 2 the k-1 most
    common items of each member, as far as they have more than ``hot`` members, are held back from making candidates: of
    k shared items the rarest is held back by neither member, so no pair is lost. Held-back items are then looked up for
    the candidates only, which keeps weights exact. Members that hold nothing back are cut at k where they are counted.
    """
    inc = cut_lineage(incidence.select(F.col(member).alias("member"), F.col(item).alias("item")).dropna().distinct())
    degree = cut_lineage(inc.groupBy("item").agg(F.count(F.lit(1)).alias("deg")).where(F.col("deg") > 1))
    sizes = degree.agg(F.max("deg").alias("top"), F.sum(F.col("deg").cast("double") * F.col("deg") / 2).alias("pairs")).first()
    tasks = max(1, min(int((sizes["pairs"] or 0) / PAIRS_OF_A_TASK), MOST_TASKS))
    widest = inc.groupBy("member").agg(F.count(F.lit(1)).alias("_n"))
    heavy = cut_lineage(widest.where(F.col("_n") > block).select("member", F.lit(True).alias("heavy")))
    blocks = degree.where(F.col("deg") > block).select("item", F.ceil(F.col("deg") * 2 / F.lit(block)).cast("int").alias("_k"))
    blocks = blocks if (sizes["top"] or 0) > block else None

    held = None
    rows = inc.join(heavy, "member", "left") if not heavy.isEmpty() else inc.withColumn("heavy", F.lit(False))
    rows = rows.withColumns({"heavy": F.coalesce("heavy", F.lit(False)), "mark": F.lit(False)})
    if min_weight > 1 and (sizes["top"] or 0) > hot:
        held = cut_lineage(_held_items(inc, degree, min_weight - 1, hot))
        own = held.groupBy("member").agg(F.collect_set("item").alias("_held"))  # k - 1 at most
        rows = rows.join(own, "member", "left").withColumn("mark", F.col("_held").isNotNull())
        rows = cut_lineage(rows.where(~F.coalesce(F.array_contains("_held", F.col("item")), F.lit(False))).drop("_held"))
    counted = _pair_counts(_cells(rows, block, blocks), tasks)
    # marked members come first in the order: an owner without a mark and its others hold nothing back
    counted = counted.where(F.col("mark") | (F.col("weight") >= min_weight))
    pairs = counted.select(F.least("owner", "other").alias("src"), F.greatest("owner", "other").alias("dst"), "mark", "weight")
    if held is None:
        return pairs.drop("mark")

    pairs = cut_lineage(pairs)
    found = pairs.where("mark").select("src", "dst", "weight")
    # a holds the item back: b may hold it in any way; b holds it back: a must have it open.
    by_src = (
        found.join(held.withColumnRenamed("member", "src"), "src")
        .join(inc.withColumnRenamed("member", "dst"), ["dst", "item"], "left_semi")
    )
    by_dst = (
        found.join(held.withColumnRenamed("member", "dst"), "dst")
        .join(rows.select(F.col("member").alias("src"), "item"), ["src", "item"], "left_semi")
    )
    extra = by_src.select("src", "dst", F.lit(1).cast("long").alias("weight")).unionByName(
        by_dst.select("src", "dst", F.lit(1).cast("long").alias("weight"))
    )
    marked = (
        found.unionByName(extra)
        .groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        .where(F.col("weight") >= min_weight)
    )
    return pairs.where("NOT mark").drop("mark").unionByName(marked)


def nest(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """``(by, name)``: the other columns as an array of structs, one row per group; null keys are a group.

    For records whose parts belong together, such as the references of a publication: the array of a group lives in one
    row. Keep the long table where a group has no bound.
    """
    by = list(by)
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))


def unnest(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Arrays of structs back to rows."""
    explode = F.explode_outer if outer else F.explode
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, explode(name).alias("_e")).select(*keep, "_e.*")
