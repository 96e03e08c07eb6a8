"""Scores of labelled answers: accuracy, confusion, precision and recall, entropy, error summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapgauge.operators.relational import quantiles, running

KM = (1, 5, 10, 50, 100)
METERS = (5, 10, 50, 100)


def scored(c="predicted") -> Column:
    """true but for error and skipped; a null prediction stays."""
    return ~(F.col(c).eqNullSafe("error") | F.col(c).eqNullSafe("skipped"))


def ratio(a: Column, b: Column) -> Column:
    """A5: a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def accuracy(truth, predicted) -> Column:
    """A1: share of equal labels; a null prediction is wrong."""
    return F.avg(F.coalesce(F.col(truth) == F.col(predicted), F.lit(False)).cast("int"))


def error_summary(df: DataFrame, group: str, error: str, thresholds=KM) -> DataFrame:
    """A2-A5: per group and over all ('all'): rows, parsed, parse rate, mean, median, RMSE, counts and rates within
    thresholds of the parsed. One grouping-sets aggregate, and medians from running counts; a null group is 'unknown', apart
    from 'all'."""
    e = F.col(error)
    aggs = [F.count(F.lit(1)).alias("total"), F.count(e).alias("parsed"), F.avg(e).alias("mean_error"), F.sqrt(F.avg(e * e)).alias("rmse")]
    aggs += [F.count_if(e <= k).alias(f"within_{k}") for k in thresholds]
    df = df.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("unknown")))
    out = df.rollup(group).agg(F.grouping(group).cast("int").alias("_all"), *aggs)
    # medians, of the groups and of all, from counts of equal errors
    each = df.where(e.isNotNull()).groupBy(group, error).agg(F.count(F.lit(1)).alias("_n"))
    both = each.withColumn("_all", F.lit(0)).unionByName(each.withColumn("_all", F.lit(1)).withColumn(group, F.lit(None).cast("string")))
    middle = quantiles(both, error, [0.5], "_all", group, count="_n").select(F.col("_all").alias("_a"), F.col(group).alias("_g"), F.col("q")[0].alias("median_error"))
    out = out.join(middle, (F.col("_all") == F.col("_a")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    out = out.withColumn(group, F.when(F.col("_all") == 1, "all").otherwise(F.col(group))).drop("_all", "_a", "_g")
    out = out.withColumn("parse_rate", ratio(F.col("parsed"), F.col("total")))
    names = [group, "total", "parsed", "mean_error", "median_error", "rmse", *[f"within_{k}" for k in thresholds], "parse_rate"]
    return out.select(*names, *[ratio(F.col(f"within_{k}"), F.col("parsed")).alias(f"rate_{k}") for k in thresholds])


def meters_summary(df: DataFrame, error: str, *group: str) -> DataFrame:
    """MAE, RMSE and rates within thresholds in metres; percentages of all rows, a null error counting as outside."""
    e = F.col(error)
    rates = [(F.count_if(e <= k) * 100.0 / F.count(F.lit(1))).alias(f"pct_{k}m") for k in METERS]
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae_m"), F.sqrt(F.avg(e * e)).alias("rmse_m"), *rates)


def group_stats(df: DataFrame, value: str, *group: str) -> DataFrame:
    """Count, mean, median, sample deviation; null values and null keys are left out first."""
    df = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (value, *group)]))
    out = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    middle = quantiles(df, value, [0.5], *group).select(*group, F.col("q")[0].alias("median"))  # no null group is left
    return out.join(middle, list(group)).select(*group, "n", "mean", "median", "std")


def labels_frame(spark, labels) -> DataFrame:
    return spark.createDataFrame([(x,) for x in labels], "label string")


def counts(df: DataFrame, truth: str, predicted: str, *group: str) -> DataFrame:
    """The cube that the metrics below share: rows by (group, truth, predicted). Its size is that of the label sets."""
    return df.groupBy(*group, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion(cube: DataFrame, labels, *group: str) -> DataFrame:
    """Every cell of a fixed label set, zeros kept."""
    spark = cube.sparkSession
    one = labels_frame(spark, labels)
    grid = one.select(F.col("label").alias("truth")).crossJoin(one.select(F.col("label").alias("predicted")))  # labels x labels: a literal's size
    if group:
        grid = cube.select(*group).distinct().crossJoin(grid)
    return grid.join(cube, [*group, "truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def confusion_wide(cube: DataFrame, labels, *group: str) -> DataFrame:
    """A row for each truth, a column for each prediction."""
    out = cube.groupBy(*group, "truth").pivot("predicted", list(labels)).agg(F.sum("n"))
    return out.fillna(0, list(labels))


def per_class(cube: DataFrame, *group: str, null_label: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support by label of truth or prediction; 0 where a division has no ground."""
    if null_label is not None:
        cube = cube.withColumns({c: F.coalesce(c, F.lit(null_label)) for c in ("truth", "predicted")})
    cube = cube.groupBy(*group, "truth", "predicted").agg(F.sum("n").alias("n"))
    side = lambda own, t, p: cube.select(*group, F.col(own).alias("label"), (F.col("n") * t).alias("t"), (F.col("n") * p).alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("n") * t).otherwise(0).alias("tp"))
    both = side("truth", 1, 0).unionByName(side("predicted", 0, 1)).where("label is not null")
    out = both.groupBy(*group, "label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def weighted(classes: DataFrame, *group: str) -> DataFrame:
    """A8 and the macro row of A9, from per_class()."""
    s = F.col("support")
    aggs = [F.sum("support").alias("n"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy")]
    aggs += [ratio(F.sum(F.col(c) * s), F.sum(s)).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    aggs += [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    return classes.groupBy(*group).agg(*aggs)


def support_accuracy(cube: DataFrame, labels, *group: str) -> DataFrame:
    """Support and accuracy of each label of a fixed set, zeros kept."""
    got = confusion(cube, labels, *group).groupBy(*group, F.col("truth").alias("label"))
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    return got.agg(F.sum("n").alias("support"), hit.alias("correct")).withColumn("accuracy", ratio(F.col("correct"), F.col("support")))


def best(df: DataFrame, value: str, key: str, *group: str) -> DataFrame:
    """The key of the largest value, the smallest key on a tie."""
    pick = F.max_by(key, F.struct(F.col(value), -F.col(key).cast("double")))
    return df.groupBy(*group).agg(pick.alias(f"best_{key}"), F.max(value).alias(f"best_{value}"))


def entropy(cube: DataFrame, *group: str, value: str = "predicted", total: Column | None = None) -> DataFrame:
    """Entropy in bits of the predictions of each group; nulls count in the divisor alone (total), not as a
    class. distribution: the counts as a map, sorted by label. +0.0 keeps a pure group from being -0."""
    whole = Window.partitionBy(*group)
    rows = cube.groupBy(*group, value).agg(F.sum("n").alias("n")).withColumn("_all", F.sum("n").over(whole))
    rows = rows.withColumn("_p", F.col("n") / F.col("_all"))
    part = F.when(F.col(value).isNotNull(), -F.col("_p") * F.log2("_p"))
    kept = F.filter(F.sort_array(F.collect_list(F.struct(F.col(value).alias("key"), F.col("n").alias("value")))), lambda x: x["key"].isNotNull())
    out = rows.groupBy(*group).agg(F.first("_all").alias("total"), (F.coalesce(F.sum(part), F.lit(0.0)) + F.lit(0.0)).alias("entropy"), kept.alias("_d"))
    return out.withColumn("distribution", F.map_from_entries("_d")).drop("_d")


def normalized_entropy(df: DataFrame, columns, classes: int, alias: str = "entropy_norm") -> DataFrame:
    """Over wide count columns, 0 log 0 = 0, divided by log2(classes); null where a row counts nothing."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    terms = []
    for c in columns:
        p = F.try_divide(F.col(c).cast("double"), total)
        terms.append(F.when(F.col(c) > 0, -p * F.log2(p)).otherwise(0.0))
    h = reduce(lambda a, b: a + b, terms)
    return df.withColumn(alias, F.when(total > 0, h / F.log2(F.lit(float(classes))) + F.lit(0.0)))


def dynamic_accuracy(df: DataFrame, columns, predicate: str, alias: str = "accuracy") -> DataFrame:
    """The count in the column that a row names, over the sum of the row's counts."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    table = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])
    return df.withColumn(alias, F.try_divide(F.try_element_at(table, F.col(predicate)).cast("double"), total))


def versus_mean(df: DataFrame, value: str, band: float = 0.05) -> DataFrame:
    """Difference to the overall mean, banded."""
    mean = df.agg(F.avg(value).alias("overall"))  # one row
    d = F.col(value) - F.col("overall")
    effect = F.when(d > band, "Improves").when(d < -band, "Declines").otherwise("Unchanged")
    return df.crossJoin(F.broadcast(mean)).withColumn("difference", d).withColumn("effect", effect)


def running_accuracy(df: DataFrame, order: str, correct: str) -> DataFrame:
    """Accuracy over all rows up to each, by an order that tells them apart; running sums over range partitions, of any number."""
    rows = df.withColumn("_one", F.lit(1)).withColumn("_hit", F.col(correct).cast("int"))
    rows = running(rows, [order], "_one", "_seen", more={"_hit": "_right"})
    rows = rows.withColumn("seen", F.col("_seen") + 1).withColumn("running_accuracy", (F.col("_right") + F.coalesce("_hit", F.lit(0))) / F.col("seen"))
    return rows.drop("_one", "_hit", "_seen", "_right")
