"""Reproducible samples and splits: every choice is by md5(seed-key), never by a random stream."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapgauge.operators.durable import durable
from mapgauge.operators.relational import number_within


def order_key(key, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))


def k_per_group(df: DataFrame, key: str, k: int, *group: str, seed: int = 42) -> DataFrame:
    """K rows of each group; Spark keeps k a task before it shuffles."""
    w = Window.partitionBy(*group).orderBy(order_key(key, seed), key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def split_random(df: DataFrame, key: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Df plus `split`: exactly ceil(share * n) rows are 'test', the others 'train'. The cut is a threshold on the order
    key, found by the exact place of the last one taken, so rows are not sorted in one task."""
    n = df.count()
    take = n - math.ceil(share * n)
    rows = df.withColumn("_o", F.concat(order_key(key, seed), F.lit("-"), F.lpad(F.col(key).cast("string"), 20, "0")))
    if take <= 0:
        return rows.drop("_o").withColumn("split", F.lit("test"))
    # the take-th smallest key: by prefix counts, 4 hex digits at a time
    low, rest = "", take
    for _ in range(8):
        seen = rows.where(F.startswith("_o", F.lit(low))).groupBy(F.substring("_o", 1, len(low) + 4).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
        for r in seen:  # at most 65536 prefixes
            if rest <= r["n"]:
                low, size = r["p"], r["n"]
                break
            rest -= r["n"]
        if size == rest:
            break
    cut = F.substring("_o", 1, len(low)) <= F.lit(low)
    return rows.withColumn("split", F.when(cut, "train").otherwise("test")).drop("_o")


def split_stratified(df: DataFrame, label: str, key: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Df plus `split`: of n - ceil((1-share) n) rows for 'eval', each label gets its quota, by largest remainder with
    ties by label, the rest are 'finetune'."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n").over(Window.partitionBy())
    total = n - F.ceil((1 - share) * n)
    exact = F.col("_n") * total / n
    sizes = sizes.withColumn("_floor", F.floor(exact)).withColumn("_part", F.round(exact - F.floor(exact), 9)).withColumn("_left", total - F.sum(F.floor(exact)).over(Window.partitionBy()))
    sizes = sizes.withColumn("_quota", F.col("_floor") + F.when(F.row_number().over(Window.orderBy(F.desc("_part"), label)) <= F.col("_left"), 1).otherwise(0))
    rows = number_within(df, [label], [order_key(key, seed), key], "_k").withColumn("_k", F.col("_k") + 1).join(F.broadcast(sizes.select(F.col(label).alias("_label"), "_quota")), F.col(label).eqNullSafe(F.col("_label")))  # a row for each label
    return rows.withColumn("split", F.when(F.col("_k") <= F.col("_quota"), "eval").otherwise("finetune")).select(*df.columns, "split")


def split_by_group(df: DataFrame, group: str, key: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """floor(share * size) rows of each group (file) are 'eval'."""
    rows = number_within(df, [group], [order_key(key, seed), key], "_k")
    return rows.withColumn("split", F.when(F.col("_k") < F.floor(F.col("_k_of") * share), "eval").otherwise("finetune")).select(*df.columns, "split")


def oversample(df: DataFrame, label: str, key: str, least: int = 50, seed: int = 42) -> DataFrame:
    """Df plus drawn copies of rows of labels with fewer than `least` rows, with replacement, up to `least`; `copy` is 0 for
    the rows themselves and counts the draws. Only small labels are numbered."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < least)
    small = df.join(F.broadcast(sizes), label)  # labels under `least` rows
    small = small.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1)
    draws = sizes.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.lit(least) - F.col("_n")).cast("int"))))
    pick = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(label).cast("string"), F.col("copy").cast("string"))), 1, 12), 16, 10).cast("long")
    draws = draws.select(F.col(label).alias("_label"), "copy", F.pmod(pick, F.col("_n")).alias("_pick"))
    more = small.join(draws, (F.col(label) == F.col("_label")) & (F.col("_k") == F.col("_pick"))).select(*df.columns, "copy")
    return df.withColumn("copy", F.lit(0)).unionByName(more)


def exemplars(df: DataFrame, key: str, k: int, *group: str, seed: int = 42) -> DataFrame:
    """For each row k other rows of its group, itself excluded (all where there are fewer): the next ones on a ring
    ordered by md5(seed-key). Two sorts and no pairs; rows of a null group have none; columns: key, exemplar, place."""
    rows = durable(number_within(df.select(*group, key), list(group), [order_key(key, seed), key], "_k").withColumnRenamed("_k_of", "_n"))
    ask = rows.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(k)))).where(F.col("place") < F.col("_n"))
    ask = ask.select(*group, F.col(key).alias("_key"), "place", F.pmod(F.col("_k") + F.col("place"), F.col("_n")).alias("_k"))
    got = ask.join(rows.drop("_n").withColumnRenamed(key, "exemplar"), [*group, "_k"])
    return got.select(*group, F.col("_key").alias(key), "place", "exemplar")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """P5: all rows in an order that looks random and is always the same; a range-partitioned sort."""
    return df.orderBy(order_key(key, seed), key)
