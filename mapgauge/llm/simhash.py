"""SimHash near-dedup: fingerprints, and their links by a hierarchical index in Gray order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapgauge.llm.blocks import spans
from mapgauge.llm.common import carried_out, discard, durable, framed, id_out, partitions, trimmed

U = np.uint64
FULL = U(0xFFFFFFFFFFFFFFFF)


# --- fingerprints ---------------------------------------------------------------------------------------------


def fingerprint(text: bytes, words: int = 4, seed: int = 42, part: int = 1 << 15) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' XXH64. Words part at ASCII white space, A-Z
    lower-cased; fewer words than a shingle: one shingle of them all; none: 0. Long texts are summed in parts."""
    own = text.lower().split()
    if not own:
        return 0
    line, h = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= words:
        return h(line, seed)
    size = np.fromiter(map(len, own), np.int64, len(own))
    end = np.cumsum(size + 1) - 1
    n = len(own) - words + 1
    starts, ends = (end - size)[:n].tolist(), end[words - 1 :].tolist()
    bits = np.zeros(64, np.int64)
    for a in range(0, n, part):
        v = np.array([h(line[i:j], seed) for i, j in zip(starts[a : a + part], ends[a : a + part], strict=True)], "<u8")
        bits += np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text", kept: tuple[str, ...] = ("_id",)) -> DataFrame:
    """`_id` (or what `kept` names of `_id` and `_th`) and `fp` (a long with the fingerprint's bits) for each row; null text: 0."""

    def run(batches):
        for b in batches:
            texts = b.column("_t").cast(pa.binary()).to_pylist()
            v = np.array([fingerprint(t, words) if t else 0 for t in texts], U)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(v.view(np.int64))], names=[*kept, "fp"])

    rows = framed(docs, [], id_col, text_col).select(*kept, "_t")
    return rows.mapInArrow(trimmed(run), ", ".join(f"{c} long" for c in (*kept, "fp")))


# --- the index ------------------------------------------------------------------------------------------------


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in the Gray order, in which neighbours differ in one bit."""
    v = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> U(s)
    return v


class Forest:
    """Connected components of 0..n-1 under hooked links, by numpy."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while a.size:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            x, y = x[open_], y[open_]
            low = np.minimum(x, y)
            np.minimum.at(label, np.maximum(x, y), low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            self.label = label


class GrayIndex:
    """Fingerprints in Gray order under a forest, a tree for each bucket: a node keeps the bits its members agree on, so the
    agreed bits of upper nodes are shared by all below, and differences counted there only grow on the way down.
    Buckets are sibling groups: all trees are of one height and are gone down together."""

    def __init__(self, v: np.ndarray, bucket: np.ndarray | None = None, leaf: int = 16, fan: int = 4):
        bucket = np.zeros(len(v), np.int64) if bucket is None else bucket
        self.order = np.lexsort((gray_rank(v), bucket))
        self.v = v[self.order]
        own = bucket[self.order]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(v) else np.zeros(0, np.int64)
        size = np.diff(np.append(at, len(v)))
        self.levels, low, high, lo, hi = [], self.v, self.v, np.arange(len(v)), np.arange(len(v)) + 1
        width, self.visits = leaf, 0
        while True:
            first, last, size = self._cut(size, width)
            if first.size:
                low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
                lo, hi = lo[first], hi[last - 1]
            mask = ~(low ^ high)
            # agreed bits and which they are; the nodes below; the fingerprints below
            self.levels.append((low & mask, mask, first, last, lo, hi))
            width = fan
            if (size <= 1).all():
                break

    @staticmethod
    def _cut(size: np.ndarray, width: int):
        """Each group of `size` in runs of `width`: where runs begin and end, and each group's number of runs."""
        runs = -(-size // width)
        base = np.repeat(np.cumsum(size) - size, runs)
        first = base + width * spans(np.zeros(len(size), np.int64), runs)
        return first, np.minimum(first + width, base + np.repeat(size, runs)), runs

    def _product(self, a, b, first, last):
        """All pairs below pairs of nodes, each once."""
        n, m = last[a] - first[a], last[b] - first[b]
        k = spans(np.zeros(len(a), np.int64), n * m)
        of = np.repeat(np.arange(len(a)), n * m)
        x, y = first[a][of] + k // m[of], first[b][of] + k % m[of]
        ok = x <= y
        return x[ok], y[ok]

    def components(self, most: int, chunk: int = 1 << 14) -> np.ndarray:
        """A label for each fingerprint as given: equal where links of at most `most` differing bits, within a bucket,
        connect them.

        Pairs of nodes go down from the roots. A pair whose agreed bits differ in more than `most` places is dropped
        with all below it; a pair that cannot differ in more is linked whole, without naming its pairs.
        """
        n, forest = len(self.v), Forest(len(self.v))
        roots = np.arange(len(self.levels[-1][0]))
        stack = [(len(self.levels) - 1, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > chunk:
                stack += [(level, a[i : i + chunk], b[i : i + chunk]) for i in range(0, len(a), chunk)]
                continue
            pattern, mask, first, last, lo, hi = self.levels[level]
            self.visits += len(a)
            both = mask[a] & mask[b]
            apart = np.bitwise_count((pattern[a] ^ pattern[b]) & both).astype(np.int64)
            free = np.bitwise_count(~both).astype(np.int64)
            near = apart <= most
            whole = near & (apart + free <= most)
            if whole.any():
                side = np.concatenate([a[whole], b[whole]])
                head = np.concatenate([lo[a[whole]]] * 2)
                size = hi[side] - lo[side]
                forest.link(spans(lo[side], size), np.repeat(head, size))
            near &= ~whole
            a, b = a[near], b[near]
            if not a.size:
                continue
            if level:
                stack.append((level - 1, *self._product(a, b, first, last)))
            else:
                for i in range(0, len(a), 4096):
                    x, y = self._product(a[i : i + 4096], b[i : i + 4096], first, last)
                    hit = (np.bitwise_count(self.v[x] ^ self.v[y]) <= most) & (x != y)
                    forest.link(x[hit], y[hit])
        out = np.empty(n, np.int64)
        out[self.order] = self.order[forest.label]
        return out


# --- distribution ---------------------------------------------------------------------------------------------


def _cut(mask: int, parts: int) -> list[int]:
    """The bits of mask in `parts` runs of nearly equal length."""
    bits = [i for i in range(64) if mask >> i & 1]
    n = len(bits)
    return [sum(1 << i for i in bits[k * n // parts : (k + 1) * n // parts]) for k in range(parts)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def buckets(fps: DataFrame, most: int, cap: int = 4096, depth: int = 4) -> DataFrame:
    """(mask, value, fp): two fingerprints within `most` bits share a bucket at least.

    Of most+1 runs of bits two such fingerprints agree on one. A bucket of more than cap is dealt anew by most+1 runs of
    its remaining bits, which the same argument allows, up to depth times. The cap only decides where a bucket is
    cut; none is dropped, and one that is still larger at the last depth goes through the index whole.
    """
    full = (1 << 64) - 1
    now = fps.withColumn("mask", F.explode(F.array(*[F.lit(_signed(m)) for m in _cut(full, most + 1)])))
    now = now.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    done = None
    masks = _cut(full, most + 1)
    for _ in range(depth - 1):
        sizes = now.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("_n"))
        large = sizes.where(F.col("_n") > cap).select("mask", "value")
        if large.isEmpty():
            break
        large = durable(large)
        small = now.join(large, ["mask", "value"], "left_anti")
        done = small if done is None else done.unionByName(small)
        below = {m: [m | x for x in _cut(full & ~m, most + 1)] for m in masks}
        table = F.create_map(*[y for m, xs in below.items() for y in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in xs]))])
        now = now.join(large, ["mask", "value"], "left_semi").withColumn("mask", F.explode(table[F.col("mask")]))
        now = now.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        masks = sorted({x for xs in below.values() for x in xs})
    return now if done is None else done.unionByName(now)


def _links(most: int):
    def run(batches):
        held = [b for b in batches if b.num_rows]  # three longs a row of this partition
        if not held:
            return
        t = pa.Table.from_batches(held)
        mask, value, fp = (t.column(c).to_numpy() for c in ("mask", "value", "fp"))
        order = np.lexsort((value, mask))
        mask, value, fp = mask[order], value[order], fp[order].view(U)
        new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
        bucket = np.cumsum(new) - 1
        several = (np.bincount(bucket) > 1)[bucket]  # a fingerprint alone in its bucket has no links there
        fp, bucket = fp[several], bucket[several]
        label = GrayIndex(fp, bucket).components(most)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        if linked.size:
            a, b = fp[linked].view(np.int64), fp[label[linked]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def index_links(fps: DataFrame, most: int = 4, cap: int = 4096) -> DataFrame:
    """(a, b): links of `most` differing bits or fewer among distinct fingerprints, a spanning forest of each bucket."""
    spread = buckets(fps.select("fp"), most, cap).repartition(partitions(fps.sparkSession), "mask", "value")
    return spread.mapInArrow(trimmed(_links(most)), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that `edges` (a, b) name. Alternates large and small
    stars; every round is a few aggregates and joins by node, each written to the shared folder."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = durable(now)
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, durable(small)
        discard(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(seen)


def simhash_groups(docs: DataFrame, most: int = 4, words: int = 4, cap: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the smallest id that links reach).

    Texts link when their fingerprints differ in `most` bits or fewer. Null and empty texts have fingerprint 0, linked
    like any other. A null id sorts first and comes back as null. Other columns play no part.

    Equal fingerprints first become one class (an aggregate that combines before its shuffle), so copies never
    meet in a bucket. Within a bucket the index links whole groups and hands on a spanning forest, not the pairs.
    """
    fps = durable(fingerprints(docs, words, id_col, text_col))
    classes = durable(fps.groupBy("fp").agg(F.min("_id").alias("node")))
    links = index_links(classes, most, cap)
    named = links.join(classes.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(classes.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b")
    found = components(named.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    classes = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = fps.join(classes, "fp")
    return out.select(id_out().alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_out("component").alias("component_id"))


def drop_near_copies(docs: DataFrame, most: int = 4, words: int = 4, cap: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each component: that of the smallest (id, text hash); all columns stay. Components are of
    fingerprints, so rows that repeat an id, or have none, are told apart by text; of rows that repeat both one stays."""
    fps = durable(fingerprints(docs, words, id_col, text_col, kept=("_id", "_th")))
    classes = durable(fps.groupBy("fp").agg(F.min(F.struct("_id", "_th")).alias("first")))
    found = components(index_links(classes, most, cap)).withColumnRenamed("node", "fp")
    first = classes.join(found, "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min("first").alias("first")).select("first.*")
    rows = framed(docs, docs.columns, id_col, text_col).select("_row", "_id", "_th")
    return rows.join(first, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select(*carried_out(docs.columns))


def op7_simhash(spark, sf_dir) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
