"""SimHash near-dedup held to a similarity: the fingerprints' index links first, every link tested on whole texts; what
fingerprints miss, for similar texts may differ in any number of bits, comes from prefixes of the shingle sets."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapgauge.llm.common import carried_out, discard, durable, framed, partitions, release, trimmed
from mapgauge.llm.simhash import components, fingerprints, index_links

U = np.uint64
#: A set's sketch: for each of 512 parts, by the shingles' first 9 bits, whether it holds an odd number of them; as 8 longs.
PART, LONGS = U(55), 8
#: A shingle of more documents than this comes last in the order of shingles, if it is one of the HOT commonest found.
OFTEN, HOT = 32, 1 << 16
#: Rounds of stars at least (more while each leaves under half of the pairs) before all pairs that are left are tested, and the
#: pairs a posting at which they are few enough for that.
ROUNDS, FEW = 2, 8


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. Words as in simhash; fewer words than a shingle: one shingle of
    them all; none: the empty one."""
    own = text.lower().split()
    h = np.array([xxhash.xxh64_intdigest(w, 42) for w in own], U)
    if len(own) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(own), 7)], U)
    n = len(own) - words + 1
    v = np.full(n, U(words))
    for k in range(words):
        v ^= h[k : k + n]
        v *= U(0x9E3779B97F4A7C15)
        v ^= v >> U(32)
        v *= U(0xD6E8FEB86659FD93)
        v ^= v >> U(29)
    return np.unique(v)


def prefix(v: np.ndarray, hot: np.ndarray, least: float) -> np.ndarray:
    """The first shingles in the order (hot, hash), as many as two sets of `least` cannot miss each other by."""
    n = len(v) - math.ceil(least * len(v) - 1e-9) + 1
    if not hot.size:
        return v[:n]
    at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
    return np.concatenate([v[hot[at] != v], v[hot[at] == v]])[:n]


def parities(v: np.ndarray) -> np.ndarray:
    """The sketch of a set of shingles."""
    odd = np.bincount((v >> PART).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _slices(batches, rows: int = 1000):
    """Batches of a bounded number of rows, so that a worker holds the shingles of few texts."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def _texts(b):
    return [t or b"" for t in b.column("_t").cast(pa.binary()).to_pylist()]


def common_shingles(rows: DataFrame, words: int) -> np.ndarray:
    """The HOT commonest of the shingles that over OFTEN documents hold, counted where a slice of a batch holds them twice. They set the
    order in which prefixes are taken and nothing else: any order finds every link."""

    def run(batches):
        for b in _slices(batches, 2000):
            v, n = np.unique(np.concatenate([shingles(t, words) for t in _texts(b)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["sh", "n"])

    found = rows.select("_t").mapInArrow(trimmed(run), "sh long, n long").groupBy("sh").agg(F.sum("n").alias("n")).where(F.col("n") > OFTEN)
    return np.sort(found.orderBy(F.desc("n"), "sh").limit(HOT).select("sh").toArrow().column("sh").to_numpy().view(U))


def _sketch(words: int, least: float, hot: np.ndarray):
    def run(batches):
        for b in _slices(batches):
            sets = [shingles(t, words) for t in _texts(b)]
            first = [prefix(v, hot, least).view(np.int64) for v in sets]
            cut = np.cumsum([0, *map(len, first)]).astype(np.int32)
            flat = np.concatenate(first) if first else np.zeros(0, np.int64)
            odd = np.concatenate([parities(v) for v in sets]) if sets else np.zeros(0, np.int64)
            every = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * LONGS)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_th"), pa.array([len(v) for v in sets], pa.int32()), pa.ListArray.from_arrays(every, pa.array(odd)), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))], names=["_id", "_th", "n", "odd", "pre"])

    return run


def _test(words: int, least: float):
    def run(batches):
        last, b_ = None, None
        for b in _slices(batches):
            ok = []
            for v, s, t in zip(b.column("v").to_pylist(), b.column("s").cast(pa.binary()).to_pylist(), b.column("t").cast(pa.binary()).to_pylist(), strict=True):
                if v != last:  # rows come by v where the join sorts
                    last, b_ = v, shingles(t, words)
                ok.append(similarity(shingles(s, words), b_) >= least - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _may(least: float) -> Column:
    """Whether a pair may still reach `least` by the sketches p and q: each part in which they differ holds at least one
    shingle that only one of the two sets has, and sets of n and m shingles can afford (n + m)(1 - least)/(1 + least)."""
    apart = sum((F.bit_count(F.col("p")[k].bitwiseXOR(F.col("q")[k])) for k in range(LONGS)), F.lit(0))
    return apart * (1 + least) <= (1 - least) * (F.col("n") + F.col("m")) + 1e-6


def _possible(least: float):
    """Whether a pair's sizes, and the places where it first meets, still allow `least`."""
    n, m, i, j = (F.col(c) for c in ("n", "m", "i", "j"))
    most = F.least(n - i, m - j)
    return (F.least(n, m) >= least * F.greatest(n, m) - 1e-9) & (most * (1 + least) >= least * (n + m) - 1e-6)


def fingerprint_pairs(docs: DataFrame, sizes: DataFrame, words: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """(u, n, i, v, m, j): each text with the first of its fingerprint, and the firsts of fingerprints that operator 7's index links."""
    fps = durable(fingerprints(docs, words, id_col, text_col, kept=("_id", "_th")).dropDuplicates(["_id", "_th"]).join(sizes, ["_id", "_th"]).select("fp", "node", "n"))
    firsts = durable(fps.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("h")).select("fp", "h.*"))
    zero = F.lit(0)
    own = fps.select("fp", F.col("node").alias("v"), F.col("n").alias("m")).join(firsts.select("fp", F.col("node").alias("u"), "n"), "fp").where("u <> v")
    links = index_links(firsts.select("fp"), most)
    a, b = firsts.select(F.col("fp").alias("a"), F.col("node").alias("u"), "n"), firsts.select(F.col("fp").alias("b"), F.col("node").alias("v"), F.col("n").alias("m"))
    both = own.select("u", "n", "v", "m").unionByName(links.join(a, "a").join(b, "b").select("u", "n", "v", "m"))
    both = durable(both.withColumn("i", zero).withColumn("j", zero))
    discard(fps)
    discard(firsts)
    return both


def long_pairs(lists: DataFrame, first: DataFrame, least: float) -> DataFrame:
    """(u, n, i, v, m, j): the pairs of different components c in long lists that may be similar, each in one list only.

    The sketch goes with each entry, for the join itself to leave out what cannot be similar; and so do the lists that the
    text is in at earlier places. Texts that share one of those meet there, and only the places of the first meeting bound
    what they share (see _possible), so later lists leave the pair out.
    """
    own = lists.groupBy("node").agg(F.collect_list(F.struct("i", "sh")).alias("_all"))
    entries = lists.join(own, "node").join(first.select("node", "odd"), "node")
    i = F.col("i")
    entries = entries.withColumn("_b", F.transform(F.filter("_all", lambda x: x["i"] < i), lambda x: x["sh"])).drop("_all")
    a = entries.select("sh", F.col("node").alias("u"), "n", "i", "c", F.col("odd").alias("p"), F.col("_b").alias("_x"))
    b = entries.select("sh", F.col("node").alias("v"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("d"), F.col("odd").alias("q"), F.col("_b").alias("_y"))
    both = a.join(b, "sh").where((F.col("c") < F.col("d")) & _possible(least) & _may(least) & ~F.arrays_overlap("_x", "_y"))
    return both.select("u", "n", "i", "v", "m", "j")


def star_pairs(lists: DataFrame, k: int) -> DataFrame:
    """(u, n, i, v, m, j): in each list the members of other components with one member of the component that has most there.

    Which member differs by list and by round k: a text that is similar to some of a large component meets as many of them
    as it has lists, in a row for each entry, and need not meet all.
    """
    each = lists.groupBy("sh", "c").agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("node", "n", "i"), F.xxhash64("node", "sh", F.lit(k))).alias("h"))
    heads = each.groupBy("sh").agg(F.max_by(F.struct("h", "c"), F.struct("_n", F.xxhash64("c", F.lit(k)))).alias("h"))
    heads = heads.select("sh", F.col("h.h.node").alias("u"), F.col("h.h.n").alias("n"), F.col("h.h.i").alias("i"), F.col("h.c").alias("c"))
    side = lists.select("sh", F.col("node").alias("v"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("d"))
    return side.join(heads, "sh").where("c <> d").select("u", "n", "i", "v", "m", "j")


def drop_similar(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """docs with one row for each component of linked texts: that of the smallest (id, text hash); all columns stay.

    Texts link when the Jaccard similarity of their sets of `words`-word shingles is `least` or more. Rows that repeat an
    id are told apart by text, so are rows without one; of rows that repeat both one stays. A null or empty text is the set of
    the empty shingle, and links with its like. An empty table stays empty.

    Operator 7's fingerprints of `words`-word shingles and its index (`most` differing bits) name the first pairs. Texts of
    that similarity may lie more bits apart; but every such pair shares a shingle of the two prefixes in a common order, so
    the lists of these name the rest and none is missed. First come the pairs of the index, then stars about one member
    of each posting list's largest component, by which large groups become one component, then all pairs of different components.
    A pair goes on to the test on whole texts if sizes, places in the prefixes and sketches still allow the similarity; these
    bounds are exact, so they lose none.
    """
    spark = docs.sparkSession
    rows = framed(docs, [], id_col, text_col).select("_id", "_th", "_t")
    sketch = rows.mapInArrow(trimmed(_sketch(words, least, common_shingles(rows, words))), "_id long, _th long, n int, odd array<long>, pre array<long>")
    sketch = durable(sketch.dropDuplicates(["_id", "_th"]).withColumn("node", F.monotonically_increasing_id()))
    first = durable(sketch.select("node", "_id", "_th", "n", "odd"))
    # one exchange serves the count and the join with it
    parted = sketch.select("node", "n", F.posexplode("pre").alias("i", "sh")).repartition(partitions(spark), "sh")
    shared = parted.groupBy("sh").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("sh")
    lists = durable(parted.join(shared, "sh", "left_semi"))
    discard(sketch)
    del parted, shared, sketch
    release(spark)
    named = first.select("_id", "_th", "node").join(lists.select("node").distinct(), "node", "left_semi")
    texts = durable(rows.join(named, ["_id", "_th"]).dropDuplicates(["node"]).select("node", "_t"))
    release(spark)
    near = fingerprint_pairs(docs, first, words, most, id_col, text_col)

    def sketched(pairs):
        p, q = first.select(F.col("node").alias("u"), F.col("odd").alias("p")), first.select(F.col("node").alias("v"), F.col("odd").alias("q"))
        return pairs.where(_possible(least)).select("u", "n", "v", "m").distinct().join(p, "u").join(q, "v").where(_may(least))

    def tested(pairs):
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        pairs = pairs.hint("merge").join(texts.select(F.col("node").alias("u"), F.col("_t").alias("s")), "u").join(texts.select(F.col("node").alias("v"), F.col("_t").alias("t")), "v")
        return pairs.mapInArrow(trimmed(_test(words, least)), "a long, b long")

    links = durable(tested(sketched(near)))
    discard(near)
    release(spark)
    label = durable(components(links))
    discard(links)
    last = math.inf
    for k in itertools.count():
        now = lists.select("sh", "node", "n", "i").join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        # pairs left in a list: all less those within a component
        each = now.groupBy("sh", "c").agg(F.count(F.lit(1)).cast("double").alias("g"))
        open_ = each.groupBy("sh").agg(F.sum("g").alias("g"), F.sum(F.col("g") * F.col("g")).alias("own")).withColumn("left", (F.col("g") * F.col("g") - F.col("own")) / 2).where("left > 0")
        open_ = durable(open_)
        left, size = open_.agg(F.sum("left"), F.sum("g")).first()
        if not left:
            discard(open_)
            break
        now = durable(now.join(open_.select("sh", "g"), "sh"))  # a list within one component stays so
        all_ = left <= FEW * size or (k >= ROUNDS and 2 * left > last)
        last = left
        discard(open_)
        discard(lists)
        lists = now
        del open_, each
        if all_:
            side = now.select("sh", "g", F.col("node").alias("v"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("d"))
            few = now.where(F.col("g") <= OFTEN).select("sh", F.col("node").alias("u"), "n", "i", "c")
            pairs = few.join(side.where(F.col("g") <= OFTEN), "sh").where("c < d").where(_possible(least)).select("u", "n", "i", "v", "m", "j")
            pairs = sketched(pairs.unionByName(long_pairs(now.where(F.col("g") > OFTEN), first, least)))
        else:
            pairs = sketched(star_pairs(now, k))
        found = durable(tested(pairs))
        del pairs
        release(spark)
        # links become links of components, of which a large group has few; roots and single texts are not in label
        ends = found.join(label.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        more = durable(components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()))
        up = label.join(more.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        before, label = label, durable(up.unionByName(more))
        for x in (before, more, found):
            discard(x)
        del ends, up, now
        release(spark)
        if all_:
            break
    for x in (lists, texts):
        discard(x)
    first = first.join(label, "node", "left").withColumn("c", F.coalesce("component", "node"))
    first = first.groupBy("c").agg(F.min(F.struct("_id", "_th")).alias("f")).select("f.*")
    rows = framed(docs, docs.columns, id_col, text_col).select("_row", "_id", "_th")
    return rows.join(first.select("_id", "_th"), ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select(*carried_out(docs.columns))
