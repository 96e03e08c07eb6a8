"""Distributions and tests: empirical distribution, histogram, box-plot figures, ranks, correlation, bootstrap, scaling."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapgauge.functions.digest import digits_of, md5_48
from mapgauge.operators.durable import durable
from mapgauge.operators.relational import number_within, quantiles, running

#: Of the bootstrap: values in a block, groups that resamples are dealt to (for each side), numbers hashed at a time.
BLOCK, GROUPS, CHUNK = 1 << 14, 32, 1 << 13


def profile(df: DataFrame, columns, *group: str) -> DataFrame:
    """Count, mean, median, deviation, min and max of each numeric column, of each group (file) where one is named; std is
    null for one value. Columns become rows, so all medians come from one pass over running counts."""
    one = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_x")) for c in columns]
    rows = df.select(*group, F.inline(F.array(*one)))
    x = F.col("_x")
    out = rows.groupBy(*group, "column").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    middle = quantiles(rows, "_x", [0.5], *group, "column")
    out = _beside(out, middle, [*group, "column"])
    return out.select(*group, "column", "n", "mean", F.col("q")[0].alias("median"), "std", "min", "max")


def _beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df left join other on keys, a null key meeting a null key."""
    other = other.withColumnsRenamed({k: f"{k}__o" for k in keys})
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(other[f"{k}__o"]) for k in keys])
    return df.join(other, on, "left").drop(*[f"{k}__o" for k in keys])


def numeric_columns(df: DataFrame) -> list[str]:
    """F12."""
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def coordinate_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """the first columns whose names start like a latitude and a longitude."""
    low = {c.lower(): c for c in df.columns}
    find = lambda *heads: next((low[c] for c in low if c.startswith(heads)), None)
    return find("lat"), find("lon", "lng")


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, nulls as a group of their own; ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k)


def ranked(df: DataFrame, value: str, *group: str) -> DataFrame:
    """df plus `rank` (the mean rank of equal values, from 1) and `_size` (rows of the group); null values are left out.

    Ranks come from running counts over the distinct values, counted before the shuffle and range-partitioned, so neither
    a group's rows nor its values are in one task.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    n = running(n, [*group, value], "_n", "_before", of=list(group))
    return n.withColumnRenamed("_before_of", "_size").withColumn("rank", F.col("_before") + (F.col("_n") + 1) / 2)


def ecdf(df: DataFrame, value: str, order: str, *group: str) -> DataFrame:
    """Rows with their step: row number by (value, order) over the group's rows; ties keep separate steps."""
    rows = number_within(df.where(F.col(value).isNotNull()), list(group), [value, order], "_k")
    return rows.withColumn("ecdf", (F.col("_k") + 1) / F.col("_k_of")).drop("_k", "_k_of")


def histogram(df: DataFrame, value: str, bins: int = 50, zero: float | None = None) -> DataFrame:
    """Equal bins from the smallest to the largest value, the last one closed; zero: what stands for 0. Empty bins stay out."""
    x = F.col(value).cast("double")
    x = F.when(x == 0, zero).otherwise(x) if zero is not None else x
    rows = df.select(x.alias("_x")).where("_x is not null")
    ends = rows.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))  # one row
    rows = rows.crossJoin(F.broadcast(ends))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * bins)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def boxplot(df: DataFrame, value: str, *group: str) -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges."""
    q = quantiles(df, value, [0.25, 0.5, 0.75], *group)
    q = q.select(*group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    values = df.groupBy(*group, value).agg(F.lit(1).alias("_one"))  # distinct values, before they meet the quartiles
    both = _beside(values, q, list(group)) if group else values.crossJoin(F.broadcast(q))  # one row
    inside = both.where((v >= F.col("q1") - fence) & (v <= F.col("q3") + fence))
    return inside.groupBy(*group, "q1", "median", "q3").agg(F.min(v).alias("whisker_low"), F.max(v).alias("whisker_high"))


def spearman(df: DataFrame, columns) -> DataFrame:
    """Rank correlation of every pair of columns, ties averaged; rows with any null are left out. Each column's ranks are
    a join with the running counts of its distinct values."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    for c in columns:
        r = ranked(rows.select(c), c).select(F.col(c).alias("_v"), F.col("rank").alias(f"{c}__r"))
        rows = rows.join(r, F.col(c) == F.col("_v")).drop("_v")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = rows.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(f"{a}__r", f"{b}__r").alias("rho")) for a, b in pairs]).alias("_s"))
    return out.select(F.inline("_s"))


def mann_whitney(df: DataFrame, value: str, side: str, first, second) -> DataFrame:
    """M9: U of the first side, z with tie correction and continuity, and its two-sided p by the normal approximation (asymptotic only)."""
    rows = df.where(F.col(side).isin(first, second) & F.col(value).isNotNull())
    cube = rows.groupBy(F.col(value).alias("_v")).agg(F.count_if(F.col(side) == first).alias("_a"), F.count_if(F.col(side) == second).alias("_b"))
    cube = running(cube.withColumn("_n", F.col("_a") + F.col("_b")), ["_v"], "_n", "_before")
    cube = cube.withColumn("_r", F.col("_before") + (F.col("_n") + 1) / 2)
    t = F.col("_n").cast("double")
    s = cube.agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2"), F.sum(F.col("_a") * F.col("_r")).alias("_w"), F.sum(t * t * t - t).alias("_t"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    s = s.withColumn("u", F.col("_w") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("_t"), n * (n - 1))))
    d = F.abs(F.col("u") - n1 * n2 / 2) - 0.5
    s = s.withColumn("z", F.try_divide(F.greatest(d, F.lit(0.0)), sd))
    return s.select("n1", "n2", "u", "z", normal_tail(F.col("z")).alias("p"))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution by the published rational approximation (error under 1.5e-7)."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def bootstrap_median_difference(df: DataFrame, value: str, side: str, first, second, key: str, reps: int = 2000, seed: int = 0) -> DataFrame:
    """Median difference over resamples with replacement: percentiles 2.5, 50 and 97.5. Row k of a resample is the row
    whose rank is a hash of (seed, rep, k).

    A task has some resamples of a side, and the side's values by rank in blocks: it draws one resample after the other and keeps
    its median, so no draw is a row. It holds 8 bytes for each row of the side, and as many for one resample.
    """
    rows = df.where(F.col(side).isin(first, second) & F.col(value).isNotNull()).select(F.col(side).cast("string").alias("_s"), F.col(value).cast("double").alias("_v"), F.col(key).alias("_k"))
    rows = durable(number_within(rows, ["_s"], ["_k", "_v"], "_r").withColumnRenamed("_r_of", "_n"))
    blocks = rows.groupBy("_s", "_n", F.expr(f"_r div {BLOCK}").alias("_b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]).alias("_values"))
    groups = min(reps, GROUPS)
    part = 2 * F.col("_g") + (F.col("_s") == str(first)).cast("int")
    spread = blocks.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("_p", part)
    spread = spread.repartitionById(2 * groups, "_p").sortWithinPartitions("_b").select("_s", "_n", "_g", "_values")
    m = spread.mapInArrow(_medians(reps, groups, str(seed)), "_s string, rep int, m double")
    m = m.groupBy("rep").agg(F.max(F.when(F.col("_s") == str(first), F.col("m"))).alias("a"), F.max(F.when(F.col("_s") == str(second), F.col("m"))).alias("b"))
    q = m.agg(F.percentile(F.col("a") - F.col("b"), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("_q"))
    return q.select(F.col("_q")[0].alias("low"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("high"))


def _medians(reps: int, groups: int, seed: str):
    def run(batches):
        held, side, n, g = [], None, 0, 0
        for b in batches:  # of one side and one group of resamples
            if b.num_rows:
                side, n, g = (b.column(c)[0].as_py() for c in ("_s", "_n", "_g"))
                held.append(b.column("_values").flatten().to_numpy())
        if not held:
            return
        values = np.concatenate(held)
        del held
        drawn = np.empty(n)
        # chunks of numbers of one length
        chunks, at = [], 0
        while at < n:
            size = min(n, 10 ** len(str(at)), at + CHUNK) - at
            chunks.append((at, digits_of(at, size)))
            at += size
        mine = range(g, reps, groups)
        out = np.empty(len(mine))
        for i, rep in enumerate(mine):
            head = f"{seed}-{rep}-{side}-".encode()
            for at, digits in chunks:
                drawn[at : at + digits.shape[1]] = values[md5_48(head, digits) % n]
            drawn.partition([(n - 1) // 2, n // 2])
            low, high = drawn[(n - 1) // 2], drawn[n // 2]
            out[i] = low + (high - low) / 2 if low != high else low
        yield pa.RecordBatch.from_arrays([pa.array([side] * len(mine)), pa.array(mine, pa.int32()), pa.array(out)], names=["_s", "rep", "m"])

    return run


def minmax(df: DataFrame, value: str, lo: float = 0.0, hi: float = 1.0, alias: str = "scaled") -> DataFrame:
    """M8: value moved to lo..hi by the overall smallest and largest; null where they are equal."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # one row
    x = F.try_divide((F.col(value) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double"))
    return df.crossJoin(F.broadcast(ends)).withColumn(alias, x * (hi - lo) + lo).drop("_lo", "_hi")
