"""Small relational steps that evaluation scripts repeat: id filters, dense row numbers, positional columns, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapgauge.operators.durable import durable


def id_filter(df: DataFrame, key: str, most: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """keys up to a bound (pushed to the scan) and in a list (a semi join); a null key passes neither."""
    if most is not None:
        df = df.where(F.col(key) <= most)
    return df if allowed is None else df.join(allowed.select(key).distinct(), key, "left_semi")


def row_number(df: DataFrame, *order, name: str = "row") -> DataFrame:
    """Dense numbers from 0 in a stated total order. Rows are range-partitioned by the order, numbered within their
    partition and written once (sampled splitters would differ if they were drawn again); the sizes of the partitions
    before, a row for each, are added. No task sees all rows."""
    keys = {f"_o{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(order)}
    rows = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    rows = rows.withColumn("_p", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    rows = durable(rows)
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(sizes), "_p").withColumn(name, F.col("_base") + F.col("_in")).drop("_p", "_in", "_base")


def running(df: DataFrame, keys: list[str], count: str, name: str = "before", of: list[str] | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """df plus `name`: the sum of `count` over the rows before each in the order of keys, which tell all rows apart; and for each
    {column: new name} in `more` another such sum. of: the leading keys that make a group; sums then start anew in each
    group, and `<name>_of` is the group's whole sum. Rows are range-partitioned, summed within their partition and
    written once; the sums of the partitions before, a row for each, are added. No task sees all rows of a group."""
    sums = {count: name} | (more or {})
    rows = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("_p", F.spark_partition_id())
    rows = durable(rows)
    parts = rows.groupBy("_p").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums)])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select("_p", *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    inside = Window.partitionBy("_p").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, n in sums.items()})
    rows = rows.join(F.broadcast(parts), "_p").withColumns({n: F.col(n) + F.col(f"_b{i}") for i, n in enumerate(sums.values())}).drop("_p", *[f"_b{i}" for i in range(len(sums))])
    if of is None:
        return rows
    first = rows.groupBy(*[F.col(c).alias(f"{c}__f") for c in of]).agg(F.min(name).alias("_first"), F.sum(count).alias(f"{name}_of"))
    if not of:
        return rows.crossJoin(F.broadcast(first)).drop("_first")  # one row
    on = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(first[f"{c}__f"]) for c in of])
    return rows.join(first, on).withColumn(name, F.col(name) - F.col("_first")).drop("_first", *[f"{c}__f" for c in of])


def quantiles(df: DataFrame, value: str, shares, *group: str, count: str | None = None, name: str = "q") -> DataFrame:
    """The group and `name`, an array of the quantiles of value at `shares`, interpolated between neighbours; null values play no
    part, a null group is a group. Equal values are counted before the shuffle (or come with their count), and a quantile is
    found by its place among the running counts, so no group's values are gathered."""
    x = df.where(F.col(value).isNotNull())
    x = x.groupBy(*group, F.col(value).cast("double").alias("_v")).agg((F.sum(count) if count else F.count(F.lit(1))).alias("_n"))
    x = running(x, [*group, "_v"], "_n", "_at", of=list(group))
    out = []
    for p in shares:
        place = (F.col("_at_of") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        held = lambda k: F.max(F.when((F.col("_at") <= k) & (k < F.col("_at") + F.col("_n")), F.col("_v")))  # noqa: B023, E731
        a, b = held(low), held(high)
        out.append(a + (b - a) * F.max(place - low))
    return x.groupBy(*group).agg(F.array(*out).alias(name))


def number_within(df: DataFrame, group: list[str], order: list, name: str = "row") -> DataFrame:
    """Dense numbers from 0 within each group, and `<name>_of`, the group's size. A group of any size spans as many tasks as
    it needs: rows are numbered over all groups, and a group's first number is taken off. A null group is a group."""
    rows = row_number(df, *group, *order, name="_g")
    first = rows.groupBy(*[F.col(c).alias(f"{c}__f") for c in group]).agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias(f"{name}_of"))
    on = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(first[f"{c}__f"]) for c in group])
    return rows.join(first, on).withColumn(name, F.col("_g") - F.col("_first")).drop("_g", "_first", *[f"{c}__f" for c in group])


def positional(df: DataFrame, values: DataFrame, order: str, values_order: str, column: str) -> DataFrame:
    """Column of values laid beside df, first to first; the shorter side ends with nulls or is cut to df."""
    v = row_number(values.select(column, values_order), values_order, name="_row").drop(values_order)
    return row_number(df, order, name="_row").join(v, "_row", "left").drop("_row")


def set_operations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys of either side with `place`: left, right or both."""
    both = a.select(key).distinct().withColumn("_l", F.lit(1)).unionByName(b.select(key).distinct().withColumn("_l", F.lit(2)))
    out = both.groupBy(key).agg(F.sum("_l").alias("_s"))
    return out.select(key, F.when(F.col("_s") == 1, "left").when(F.col("_s") == 2, "right").otherwise("both").alias("place"))


def numeric_order(df: DataFrame, key: str) -> DataFrame:
    """Ids kept as text, in the order of their numbers; those that are none come last, by text."""
    return df.orderBy(F.col(key).try_cast("long").asc_nulls_last(), key)


def log_stats(df: DataFrame, group: str, correct: str, error: str) -> DataFrame:
    """Total, correct, incorrect, errors of a whole log; errors stay in the denominator."""
    bad = F.col(error).isNotNull()
    hit = F.coalesce(F.col(correct), F.lit(False)) & ~bad
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("correct"), F.count_if(~hit & ~bad).alias("incorrect"), F.count_if(bad).alias("errors"))
    return out.withColumn("accuracy", F.col("correct") / F.col("total"))
