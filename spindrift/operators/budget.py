"""Selection under a token budget.

The greedy folds walk candidates in rank order.  Candidates are the top ``limit`` of a group (the
operator's own parameter), so what a fold collects is bounded; the rank filter is applied before the
shuffle as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_candidates(rows: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with their rank from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def greedy_skip(ranked: DataFrame, by: list[str], cost: str, budget: int) -> DataFrame:
    """Rows taken when what does not fit is passed over; used: the cost taken so far, the row included."""
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("rank", F.col(cost).cast("long").alias("cost")))),
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank: bigint, used: bigint>>").alias("taken")),
        lambda acc, x: F.when(
            acc["used"] + x["cost"] <= budget,
            F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["taken"], F.array(F.struct(x["rank"].alias("rank"), (acc["used"] + x["cost"]).alias("used")))).alias("taken")),
        ).otherwise(acc),
    )
    taken = ranked.groupBy(*by).agg(fold.alias("f")).select(*by, F.explode("f.taken").alias("t")).select(*by, "t.rank", "t.used")
    return ranked.join(taken, [*by, "rank"])


def greedy_break(ranked: DataFrame, by: list[str], cost: str, budget: int) -> DataFrame:
    """Rows before the first that does not fit; used as in greedy_skip.  Costs are not negative."""
    w = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(cost).over(w).cast("long")).where(F.col("used") <= budget)


def near_best(rows: DataFrame, by: list[str], score: str, order: list, share: float = 0.5) -> DataFrame:
    """Rows of at least ``share`` of their group's best score, and always the first.

    The best of a group is a grouped maximum joined back, so no group is sorted whole.
    """
    best = rows.groupBy(*by).agg(F.max(score).alias("__best"), F.min(F.struct(*order)).alias("__first"))
    joined = rows.join(best, by)
    return joined.where((F.col(score) >= F.col("__best") * share) | (F.struct(*order) == F.col("__first"))).drop("__best", "__first")


def trim(items: DataFrame, by: list[str], cost: str, section_order: list[str], position: str, budget: int) -> DataFrame:
    """items with ``kept``: whole sections lose their last items first, in ``section_order``, until a group fits.

    Items of sections outside section_order are never trimmed.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in section_order]), F.col("section")).cast("long")
    rows = items.withColumn("__s", F.when(place > 0, place))
    w = Window.partitionBy(*by).orderBy(F.col("__s").asc_nulls_last(), F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(cost).over(Window.partitionBy(*by))
    gone = F.coalesce(F.sum(F.when(F.col("__s").isNotNull(), F.col(cost))).over(w), F.lit(0))
    return rows.withColumn("kept", F.col("__s").isNull() | (total - gone <= budget)).drop("__s")
