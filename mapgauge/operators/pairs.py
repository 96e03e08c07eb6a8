"""Place pairs: nearest and farthest, names in texts, pair counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapgauge.functions.geo import haversine_km
from mapgauge.functions.text import clean_name
from mapgauge.operators.durable import durable

#: Spots up to which they are broadcast; beyond, their blocks are joined by number.
SMALL = 20_000


def nearest_farthest(places: DataFrame, queries: DataFrame | None = None, name="name", lat="lat", lon="lon", distance=haversine_km, small: int = SMALL) -> DataFrame:
    """For each place of `queries` (all places if not given) the nearest and the farthest other, the first by name on a tie.

    Distances are between spots: places at one position are one, of which the first two names are kept, for a place only ever
    leaves out its own name. Each spot finds its nearest and farthest name, then, for the place of that name, the next best.
    Distances are never kept: each task reduces what it sees. Spots broadcast when they are `small` or fewer; more are cut
    into blocks, and a spot meets every block in another task. A place without a position is nobody's other, and has none.
    """
    spark = places.sparkSession
    queries = places if queries is None else queries
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = queries.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
    rows = places.select(F.col(name).alias("_n"), F.col(lat).alias("_y"), F.col(lon).alias("_x")).dropna()
    one = rows.groupBy("_y", "_x").agg(F.min("_n").alias("_n1"))
    two = rows.join(one, ["_y", "_x"]).where(F.col("_n") != F.col("_n1")).groupBy("_y", "_x").agg(F.min("_n").alias("_n2"))
    spots = durable(one.join(two, ["_y", "_x"], "left"))
    blocks = -(-spots.count() // small)

    def best(at, a, b):
        """at with _near and _far, (distance, name), among the names other than those in its columns a and b."""
        if blocks <= 1:
            both = at.crossJoin(F.broadcast(spots))
        else:
            right = spots.withColumn("_b", F.pmod(F.xxhash64("_y", "_x"), F.lit(blocks)).cast("int"))
            both = at.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(right, "_b")
        both = both.withColumn("_d", F.round(distance("_lat", "_lon", "_y", "_x"), 9))

        def least(d, out):
            n = F.when(out.isNull() | (F.col("_n1") != out), F.col("_n1")).otherwise(F.col("_n2"))
            return F.min(F.when(d.isNotNull() & n.isNotNull(), F.struct(d.alias("_d"), n.alias("_n"))))

        d = F.col("_d")
        return durable(both.groupBy("_lat", "_lon").agg(least(d, a).alias("_near"), least(-d, b).alias("_far")))

    none = F.lit(None).cast("string")
    at = durable(own.select("_lat", "_lon").dropna().distinct().repartition(parts, "_lat", "_lon"))
    found = best(at.repartition(parts, "_lat", "_lon"), none, none)
    firsts = found.select("_lat", "_lon", F.col("_near._n").alias("_na"), F.col("_far._n").alias("_fa")).repartition(parts, "_lat", "_lon")
    others = best(firsts, F.col("_na"), F.col("_fa")).withColumnsRenamed({"_near": "_near2", "_far": "_far2"})
    out = own.join(found.join(others, ["_lat", "_lon"]), ["_lat", "_lon"], "left")
    pick = lambda x, y: F.when(F.col(f"{x}._n") != F.col("name"), F.col(x)).otherwise(F.col(y))
    out = out.groupBy("name").agg(F.min(pick("_near", "_near2")).alias("_near"), F.min(pick("_far", "_far2")).alias("_far"), F.max(F.col("_lat").isNull() | F.col("_lon").isNull()).alias("_void"))
    out = out.where(F.col("_near").isNotNull() | F.col("_void"))
    return out.select("name", F.col("_near._n").alias("near"), F.col("_near._d").alias("near_km"), F.col("_far._n").alias("far"), (-F.col("_far._d")).alias("far_km"))


def first_place(texts: DataFrame, gazetteer: DataFrame, text: str, own: str | None = None, key: str = "id", place: str = "place", order: str = "ord") -> DataFrame:
    """The place named first in each text, between single spaces, the text's own place excluded; null if none.

    A place of k words can only stand where the text has those k words; so texts are cut into runs of words of the lengths that
    the gazetteer has, joined to it by equality, and the first match by position (then by the gazetteer's order) is kept. The
    work grows with the texts, not with texts times places. The first and last word, and words beside other white
    space or punctuation, do not count, as in ` name `.
    """
    places = gazetteer.select(clean_name(place).alias("_p"), F.col(order).alias("_ord")).groupBy("_p").agg(F.min("_ord").alias("_ord"))
    lengths = sorted(r["n"] for r in places.select(F.size(F.split("_p", " ")).alias("n")).distinct().collect())
    rows = texts.select(F.col(key), F.lower(F.col(text)).alias("_t"), (clean_name(own) if own else F.lit(None).cast("string")).alias("_own"))
    words = rows.withColumn("_w", F.split("_t", " ")).where(F.size("_w") >= 3)
    hits = None
    for n in lengths:
        m = F.greatest(F.lit(0), F.size("_w") - 1 - n)
        run = F.slice("_w", F.lit(2), m)  # runs of n words, built by laying shifted copies beside each other
        for k in range(1, n):
            run = F.zip_with(run, F.slice("_w", F.lit(2 + k), m), lambda a, b: F.concat(a, F.lit(" "), b))
        runs = words.select(key, "_own", F.posexplode(run).alias("_i", "_p"))
        hits = runs if hits is None else hits.unionByName(runs)
    if hits is None:
        return texts.select(key).withColumn("place", F.lit(None).cast("string"))
    found = hits.join(places, "_p").where(~F.col("_p").eqNullSafe(F.col("_own")))
    first = found.groupBy(key).agg(F.min(F.struct("_i", "_ord", "_p"))["_p"].alias("place"))
    return texts.select(key).join(first, key, "left")


def pair_counts(df: DataFrame, a: str, b: str, kind: str, kinds) -> DataFrame:
    """A row for each pair, a count column for each kind, zeros kept."""
    return df.groupBy(a, b).pivot(kind, list(kinds)).count().fillna(0, list(kinds))


def with_fallback_key(df: DataFrame, dim: DataFrame, key: str, full: str, short: str, value: str) -> DataFrame:
    """Value of the row of dim whose full name is key, else of the first by full name whose short name is."""
    whole = dim.select(F.col(full).alias("_full"), F.col(value).alias("_v1"))
    part = dim.groupBy(F.col(short).alias("_short")).agg(F.min_by(value, full).alias("_v2"))
    out = df.join(whole, F.col(key) == F.col("_full"), "left").join(part, F.col(key) == F.col("_short"), "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2")).drop("_full", "_short", "_v1", "_v2")
