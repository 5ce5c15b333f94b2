"""Sampling by hash rank: sizes are exact, and the rows depend on the seed and the row's id alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled

#: Draws with repeats that one row of the plan stands for before it is exploded.
DRAWS = 100_000
#: Groups whose one row each may be broadcast.
FEW_GROUPS = 10_000


def draw(seed: int | str, key: str, *more: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *more, F.col(key).cast("string")))


def ranked(df: DataFrame, by: str, order: list[Column], name: str = "rank") -> DataFrame:
    """Ranks within groups; only below a filter on the rank by a literal, which Spark applies before groups meet in one task."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def numbered(df: DataFrame, order: list[Column], name: str = "place", start: int = 1) -> DataFrame:
    """df with each row's place in one order over all rows.

    Rows are dealt by ranges of the order and sorted there; a range's first place is the sum of the sizes of those before it.
    """
    parts = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each range
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, (F.col("_before") + within + start).cast("long")).drop("_at", "_part", "_before")


def _of_groups(groups: DataFrame) -> DataFrame:
    """A table of one row for each group, broadcast if it is small: a join by few groups would bring each of them, whole, to one task."""
    groups = settled(groups, "groups")
    return F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups


def group_ranks(df: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """Ranks from 1 within groups, of which none has to fit a task."""
    rows = numbered(df, [F.col(by), *order], "_place")
    first = _of_groups(rows.groupBy(F.col(by).alias("_by")).agg(F.min("_place").alias("_first")))
    return rows.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first", "_by")


def first_of_group(df: DataFrame, group: Column | str, order: Column | str) -> DataFrame:
    """The first row of each group, by the least value of order (unique within a group). An aggregate, so hot groups are combined before they move."""
    columns = df.columns
    best = df.groupBy(F.col(group) if isinstance(group, str) else group).agg(F.min_by(F.struct(*columns), order).alias("x"))
    return best.select("x.*")


def top(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def simple_sample(df: DataFrame, n: int, key: str, seed: int | str) -> DataFrame:
    return top(df, n, [draw(seed, key), F.col(key)])


def per_group(df: DataFrame, by: str, n: int | dict[str, int], order: list[Column]) -> DataFrame:
    """The first n rows of each group; a dict has n by group, and groups that it lacks have none. Groups are cut in their partitions before they meet."""
    from ..functions.text import lookup

    if isinstance(n, int):
        return ranked(df, by, order, "_rank").filter(F.col("_rank") <= n).drop("_rank")
    limits = {group: most for group, most in n.items() if most > 0}
    if not limits:
        return df.limit(0)
    rows = ranked(df.filter(F.col(by).isin(*limits)), by, order, "_rank").filter(F.col("_rank") <= max(limits.values()))
    return rows.filter(F.col("_rank") <= lookup(F.col(by), limits)).drop("_rank")


def stratified(df: DataFrame, by: str, n: int, key: str, seed: int | str) -> DataFrame:
    return per_group(df, by, n, [draw(seed, key), F.col(key)])


def quota_and_backfill(df: DataFrame, by: str, n: int, key: str, seed: int | str) -> DataFrame:
    """n rows: an equal share of each group, then the best hash ranks of the rest. key is unique."""
    groups = df.agg(F.count_distinct(by)).first()[0]
    order = [draw(seed, key), F.col(key)]
    share = settled(top(per_group(df, by, max(1, n // max(groups, 1)), order), n, [F.col(by), *order]).withColumn("_extra", F.lit(0)), "share")
    rest = top(df.join(F.broadcast(share.select(key)), key, "left_anti"), n, order).withColumn("_extra", F.lit(1))  # at most n rows each
    return top(share.unionByName(rest), n, [F.col("_extra"), *order]).drop("_extra")


def mixed_by_ratio(df: DataFrame, by: str, ratios: dict[str, float], key: str, seed: int | str) -> DataFrame:
    """int(count * ratio) rows of each group (1 where no ratio is given): without repeats up to the group's size, else drawn with repeats.

    A draw picks a rank by a hash of the seed, the group and its number; `copy` tells the draws of one row apart.
    """
    from ..functions.text import lookup

    rows = group_ranks(df, by, [draw(seed, key), F.col(key)], "_rank")
    counts = _of_groups(rows.groupBy(by).agg(F.count("*").alias("_n")))
    ratio = lookup(F.col(by), ratios, F.lit(1.0)) if ratios else F.lit(1.0)
    counts = counts.withColumn("_take", F.floor(F.col("_n") * ratio).cast("long"))
    plain = rows.join(counts.filter("_take <= _n").select(by, "_take"), by).filter(F.col("_rank") <= F.col("_take")).select(*df.columns, F.lit(1).alias("copy"))
    spans = counts.filter("_take > _n").select(by, "_n", "_take", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_take") - 1) / DRAWS))).alias("_span"))
    span = F.sequence(F.col("_span") * DRAWS + 1, F.least(F.col("_take"), (F.col("_span") + 1) * DRAWS))
    picks = spans.repartition(by, "_span").select(by, "_n", F.explode(span).alias("_draw"))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(by), F.col("_draw").cast("string"))), 1, 8)
    picks = picks.select(by, "_draw", (F.conv(digits, 16, 10).cast("long") % F.col("_n") + 1).alias("_rank"))
    picks = picks.withColumn("copy", F.row_number().over(Window.partitionBy(by, "_rank").orderBy("_draw"))).drop("_draw")
    return plain.union(rows.join(picks, [by, "_rank"]).select(*df.columns, "copy"))


def capped(df: DataFrame, by: str, caps: dict[str, int], preferred: Column, order: list[Column]) -> DataFrame:
    """At most caps[group] rows of each group, those of `preferred` first; groups without a cap stay whole."""
    if not caps:
        return df
    limited = F.col(by).isin(*caps)
    return df.filter(~F.coalesce(limited, F.lit(False))).union(per_group(df.filter(limited), by, caps, [(~preferred).cast("int"), *order]))


def fallback_ids(df: DataFrame, key: str, order: list[Column], pattern: str = "aug_%08d") -> DataFrame:
    """Rows without an id, or with a blank one, get one, numbered from 0 in order."""
    lacking = F.coalesce(F.trim(F.col(key).cast("string")) == "", F.lit(True))
    given = numbered(df.filter(lacking), order, "_place", 0).withColumn(key, F.format_string(pattern, F.col("_place"))).drop("_place")
    return df.filter(~lacking).withColumn(key, F.col(key).cast("string")).unionByName(given)


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a column of places from 0."""
    return numbered(df, order, name, 0)


def grid(spark, **values: list) -> DataFrame:
    """Every combination, numbered in the order of nested loops."""
    from itertools import product

    return spark.createDataFrame([(i, *c) for i, c in enumerate(product(*values.values()))], ["ord", *values])


def best_of_grid(scores: DataFrame, by: str, score: str, order: str = "ord") -> DataFrame:
    """The row of the highest score of each group, the first of equal ones."""
    return scores.groupBy(by).agg(F.max_by(F.struct(*[c for c in scores.columns if c != by]), F.struct(F.col(score), -F.col(order))).alias("x")).select(by, "x.*")
