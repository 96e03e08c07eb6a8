"""Mixing sources to target weights: blocks of fixed length, multinomial draws for each output shard, index permutations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mapgauge.llm.common import carried_out, durable, framed, id_out, partitions

#: What a word is, and the weights that sources get in turn.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Rows of a source that one task numbers.
BUCKET_ROWS = 50_000
#: Shards of a group; the driver deals to groups, tasks to shards.
GROUP = 4096


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Shares of share * sum(sizes) by weight; a target stops at most * size and the excess is reshared by weight among the others."""
    out, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def draws(slots: list[int], shard_slots: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, count): each shard's counts are a multinomial draw from what the sources still have to give,
    so the sources' totals over all shards come out exactly. The loop is over shards and sources, never over blocks."""
    left, out, shard = np.array(slots, np.int64), [], 0
    taken = np.zeros(len(slots), np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    while (total := int(left.sum())) > 0:
        n = min(shard_slots, total)
        got = np.minimum(rng.multinomial(n, left / total), left) if n < total else left.copy()
        short = n - int(got.sum())
        for i in np.argsort(-(left - got), kind="stable"):  # what a source could not give, those with most left give
            add = min(short, int(left[i] - got[i]))
            got[i] += add
            short -= add
            if not short:
                break
        out += [(shard, int(i), int(taken[i]), int(got[i])) for i in np.flatnonzero(got)]
        taken += got
        left -= got
        shard += 1
    return out


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def _rounds(x: np.ndarray, n: np.ndarray, key: np.ndarray, order) -> np.ndarray:
    """Feistel rounds over the next even power of two, walked until below n. A round that is its own inverse is
    run in `order`, so the reverse order undoes it."""
    x, n, key = x.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while todo.size:
            h, m, k = half[todo], mask[todo], key[todo]
            side = [x[todo] >> h, x[todo] & m]
            for r in order:  # even rounds change the upper half by the lower one, odd rounds the other way
                side[r & 1] = side[r & 1] ^ (_mix(side[1 - (r & 1)] + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) & m)
            x[todo] = (side[0] << h) | side[1]
            todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, chosen by key, at index: four Feistel rounds."""
    return _rounds(index, n, key, (0, 1, 2, 3))


def unpermute(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The index that permute() sends to place."""
    return _rounds(place, n, key, (3, 2, 1, 0))


def turn_key(source, turn, seed: int):
    """The permutation's key for a source and a pass over it."""
    return (np.asarray(source).astype(np.uint64) << np.uint64(20)) + np.asarray(turn).astype(np.uint64) + np.uint64(seed * 1_000_003)


def slots_for(words: int, size: int, block: int, source: int, seed: int) -> tuple[int, int]:
    """(slots, words of the last one) by which a source of `size` words in blocks of `block` gives exactly `words`. All blocks
    are full but the source's last, whose place in the pass is known; only the mix's last slot is cut."""
    if not words or not size:
        return 0, 0
    blocks = -(-size // block)
    turns, rest = divmod(words, size)
    if not rest:
        return turns * blocks, block
    one = lambda v: np.array([v])
    short = int(unpermute(one(blocks - 1), one(blocks), turn_key(one(source), one(turns), seed))[0])
    lack = blocks * block - size  # what the last block is short of
    n = -(-rest // block)
    if short < n and n * block - lack < rest:
        n += 1
    before = (n - 1) * block - (lack if short < n - 1 else 0)
    return turns * blocks + n, rest - before


def numbered(rows: DataFrame, by: list[str], order: list[str], size: str) -> DataFrame:
    """rows with `_start`: the sum of size over the rows before it in its group, in an order that is the same at each run.

    Two levels, so no group is ever in one task: rows fall into hash buckets of at most about BUCKET_ROWS, several for each task; a running sum
    within (group, bucket) is added to the running sum over the group's buckets.
    """
    buckets = max(4 * partitions(rows.sparkSession), -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    totals = rows.groupBy(*by, "_bucket").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"{c}__b") for c in by], F.col("_bucket").alias("_bucket__b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    same = [rows[c].eqNullSafe(totals[f"{c}__b"]) for c in by] + [rows["_bucket"] == totals["_bucket__b"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.join(totals, on).withColumn("_start", F.col("_base") + F.col("_in")).drop("_base", "_in", "_bucket", "_bucket__b", *[f"{c}__b" for c in by])


class Mix:
    """A mix of sources. `rows`: the documents with their place; `sources`: sizes and targets; `pieces()`: what each output slot holds."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 256, shard_slots: int = 4096, seed: int = 7, id_col="doc_id", text_col="text", source_col="source"):
        """Words are the tokens. A source's documents stand one after another and are cut into blocks of `block` words, its
        last block shorter. A source gets as many slots as its target needs, and its last slot is cut there, so it
        gives its target to the word, however small it is. Every output shard of shard_slots slots draws its counts by
        source; slot i of a source holds block p(i mod n) of its n blocks, p another permutation for each pass. A
        source gives at most `most` passes.

        Null source: a source of its own, the last. Null text: no words, and no place in the mix; so it is with empty texts.
        A text of any length is one row, of which the mix sees the number of words. Null ids and repeated rows are rows
        like others. Sources by code point get the weights in turn. An empty table gives an empty mix. Ids are whole
        numbers, or texts of such. Reruns give the same mix, whatever the partitions: the order of rows is that of
        (id, hash of the text, hash of the row), rows that are equal in these are equal, and the draws are seeded.
        """
        spark = docs.sparkSession
        self.spark, self.id_col, self.block = spark, id_col, block
        rows = framed(docs, docs.columns, id_col, text_col).withColumn("_rh", row_hash(docs.columns, text_col))
        rows = rows.select("_id", F.col("_row").getField(source_col).cast("string").alias("_source"), "_th", "_rh", word_count(F.col("_t")).alias("_size"))
        rows = durable(rows)
        found = rows.groupBy("_source").agg(F.sum("_size").alias("n")).collect()  # a row for each source
        found.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
        sizes = [int(r["n"] or 0) for r in found]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
        need = [slots_for(min(int(most * n), round(g)), n, block, i, seed) for i, (g, n) in enumerate(zip(goal, sizes, strict=True))]
        self.draws = [n for n, _ in need]
        self.shard_slots, self.seed = shard_slots, seed
        kinds = "_name string, _s int, source_size long, target double, _blocks long, _last long, _cut long"
        table = [(r["_source"], i, n, float(g), -(-n // block), k - 1, c) for i, (r, n, g, (k, c)) in enumerate(zip(found, sizes, goal, need, strict=True))]
        self.sources = spark.createDataFrame(table, kinds)
        rows = rows.join(self.sources, F.col("_source").eqNullSafe(F.col("_name")))
        self.rows = numbered(rows, ["_s"], ["_id", "_th", "_rh", "_size"], "_size")

    def plan(self) -> DataFrame:
        """shard, source number, the source's first slot there, count. Drawn twice: the driver deals the slots to groups of
        GROUP shards, tasks deal a group's slots to its shards."""
        groups: dict[int, list] = {}
        for g, s, first, n in draws(self.draws, self.shard_slots * GROUP, self.seed):
            groups.setdefault(g, []).append((s, first, n))
        rows = [(g, [x[0] for x in v], [x[1] for x in v], [x[2] for x in v]) for g, v in groups.items()]
        table = self.spark.createDataFrame(rows, "g long, s array<int>, first array<long>, n array<long>")
        size, seed = self.shard_slots, self.seed

        def deal(batches):
            for b in batches:
                for g, s, first, n in zip(*(b.column(c).to_pylist() for c in ("g", "s", "first", "n")), strict=True):
                    own = np.array(draws(n, size, seed * 1_000_003 + g + 1), np.int64).reshape(-1, 4)
                    s, first = np.array(s, np.int32), np.array(first, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g * GROUP + own[:, 0], s[own[:, 1]], first[own[:, 1]] + own[:, 2], own[:, 3])], names=["shard", "_s", "first", "n"])

        return table.repartition(max(1, min(len(rows), partitions(self.spark)))).mapInArrow(deal, "shard long, _s int, first long, n long")

    def slots(self) -> DataFrame:
        """shard, slot of the source, source number, block number, pass, and the words that the slot takes at most."""
        plan = self.plan().join(self.sources.select("_s", "_blocks", "_last", "_cut"), "_s")
        each = plan.withColumn("_i", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
        seed, block = self.seed, self.block

        def place(batches):
            for b in batches:
                k, i, s, last, cut = (b.column(c).to_numpy() for c in ("_blocks", "_i", "_s", "_last", "_cut"))
                turn = i // k
                most = np.where(i == last, cut, block)
                cols = (b.column("shard"), b.column("_i"), b.column("_s"), permute(i % k, k, turn_key(s, turn, seed)), turn, most)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], names=["shard", "slot", "_s", "_block", "turn", "_most"])

        return each.select("shard", "_s", "_blocks", "_last", "_cut", "_i").mapInArrow(place, "shard long, slot long, _s int, _block long, turn long, _most long")

    def block_pieces(self) -> DataFrame:
        """What each block is made of: the document's row, the first of its words there, where in the block, and how many."""
        rows = self.rows.where("_size > 0")
        block = F.lit(self.block).cast("long")
        rows = rows.withColumn("_block", F.explode(F.sequence(F.expr(f"_start div {self.block}"), F.expr(f"(_start + _size - 1) div {self.block}"))))
        lo = F.greatest(F.col("_start"), F.col("_block") * block)
        hi = F.least(F.col("_start") + F.col("_size"), (F.col("_block") + 1) * block)
        return rows.select("_s", "_block", "_start", "_id", "_th", "_rh", (lo - F.col("_start")).alias("word"), (lo - F.col("_block") * block).alias("at"), (hi - lo).alias("words"))

    def pieces(self) -> DataFrame:
        """The mix itself: for every output slot the pieces of documents it holds, blocks joined by their index."""
        # slots grow with the data, though the plan that they are made of looks small to the optimizer
        both = self.slots().join(self.block_pieces().hint("merge"), ["_s", "_block"]).where("at < _most")
        return both.withColumn("words", F.least("words", F.col("_most") - F.col("at"))).drop("_most", "at")

    def documents(self) -> DataFrame:
        """A row for each document: size, its source's size and target, and the words that the mix takes of it."""
        same = ["_s", "_start", "_id", "_th", "_rh"]  # with the size 0 apart, one row each
        got = self.pieces().groupBy(*same).agg(F.sum("words").alias("taken"))
        rows = self.rows.where("_size > 0").join(got, same, "left").unionByName(self.rows.where("_size = 0").withColumn("taken", F.lit(0).cast("long")))
        return rows.select(id_out().alias(self.id_col), F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def row_hash(columns: list[str], text_col: str) -> Column:
    """A hash of a framed() row less its text, by which rows of one id and text are told apart, and put in order."""
    rest = [F.col("_row").getField(c).alias(f"c{i}") for i, c in enumerate(columns) if c != text_col]
    return F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long")


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """docs as the mix takes them, all columns kept: for each document and each pass over its source a row whose text
    is the words taken in that pass, in order; what the mix leaves out is gone, what it takes twice comes twice.
    Runs of words keep their own white space and are joined by a newline. Rows that are equal in all columns stand for
    each other, so one of them is joined with what the mix takes of any."""
    mix = Mix(docs, id_col=id_col, text_col=text_col, **options)
    taken = mix.pieces().groupBy("_id", "_th", "_rh", "_start", "turn").agg(F.sort_array(F.collect_list(F.struct("word", "words"))).alias("_spans"))
    same = ["_id", "_th", "_rh"]
    rows = framed(docs, docs.columns, id_col, text_col).withColumn("_rh", row_hash(docs.columns, text_col)).where(word_count(F.col("_t")) > 0).dropDuplicates(same)
    out = rows.join(taken, same)
    types = {f.name: f.dataType for f in docs.schema}

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        import re

        word = re.compile(WORD)
        done = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            at = [m.span() for m in word.finditer(text)]
            runs: list[list[int]] = []
            for s in own:
                w, n = s["word"], s["words"]
                if runs and runs[-1][1] == w:
                    runs[-1][1] = w + n
                else:
                    runs.append([w, w + n])
            done.append("\n".join(text[at[a][0] : at[b - 1][1]] for a, b in runs))
        return pa.array(done, pa.string())

    out = out.withColumn("_cut", cut("_t", "_spans"))
    put = {text_col: F.col("_cut"), "n_chars": F.char_length("_cut")}
    return out.select(*[put[c].cast(types[c]).alias(c) if c in put else x for c, x in zip(docs.columns, carried_out(docs.columns), strict=True)])


def op10_mixing(spark, sf_dir) -> DataFrame:
    return Mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).documents()
