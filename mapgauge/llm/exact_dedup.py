"""Exact dedup by a content sort: sampled splitters, external sort, full comparison of neighbours."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapgauge.llm.common import NULL_ID, carried_out, discard, durable, framed, id_out, lower_ascii, partitions, trimmed

_RUNS = "_id long, text_sha256 string, part int, run long, size long, keep long, first boolean, edge boolean"
#: Bytes of a text that a splitter holds at most, and sampled rows for each partition.
HEAD, SAMPLED = 1024, 32


def head_of(norm: Column) -> Column:
    """The first HEAD bytes of a text and its end (byte 255, which no text holds): heads of unlike texts are never the start of each other
    unless both are cut."""
    return F.substring(F.concat(norm.cast("binary"), F.unhex(F.lit("FF"))), 1, HEAD)


def _choose(n: int, total: int):
    """Of the sampled (head, id), sorted, the splitters of n partitions, each head cut to what tells it from its neighbours in the sample."""

    def shared(a: bytes, b: bytes) -> int:
        if a == b:
            return len(a)
        x, y = (np.frombuffer(v[: min(len(a), len(b))], np.uint8) for v in (a, b))
        return int(np.argmax(np.append(x != y, True)))

    def run(batches):
        wanted = {k * total // n for k in range(1, n)}
        before, now, at, held = b"", None, 0, []  # the head before, this one, its place, and the ids wanted of it
        rows = ((h, i) for b in batches for h, i in zip(b.column("head").to_pylist(), b.column("_id").to_pylist(), strict=True))

        def closed(after: bytes):
            size = 1 + max(shared(before, now) if before else 0, shared(now, after) if after else 0)
            return [(now[:size], i) for i in held]

        out = []
        for h, i in rows:
            if h != now:
                if held:
                    out += closed(h)
                before, now, held = now or b"", h, []
            if at in wanted:
                held.append(i)
            at += 1
        if held:
            out += closed(b"")
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.binary()), pa.array([i for _, i in out], pa.int64())], names=["head", "_id"])

    return run


def splitters(rows: DataFrame, n: int, seed: int = 3) -> list[tuple[bytes, int]]:
    """(head, id) of at most n - 1 places in the order of (text, id), from a sample of about SAMPLED * n rows: HEAD bytes each, so what
    one task sorts and the driver gets is bounded by n. Any splitters give right results."""
    total = rows.count()
    if n < 2 or not total:
        return []
    share = min(1.0, SAMPLED * n / total)
    sample = durable((rows.sample(False, share, seed) if share < 1 else rows).select(head_of(F.col("_norm")).alias("head"), "_id"))
    found = sample.repartition(1).sortWithinPartitions("head", "_id").mapInArrow(_choose(n, sample.count()), "head binary, _id long")
    out = sorted({(bytes(r["head"]), r["_id"]) for r in found.collect()})
    discard(sample)
    return out


def _placed(cuts: list[tuple[bytes, int]]):
    """The partition of (head, id), times 2, plus 1 where a splitter's head begins the text: only such texts may be cut by id."""
    by: dict[bytes, list[int]] = {}
    for h, i in cuts:
        by.setdefault(h, []).append(i)
    heads, ids = list(by), list(by.values())
    start = np.cumsum([0, *map(len, ids)]).tolist()

    def place(head: pa.Array, own: pa.Array) -> pa.Array:
        out = []
        for h, i in zip(head.to_pylist(), own.to_pylist(), strict=True):
            k = bisect_right(heads, h) - 1
            if k >= 0 and h.startswith(heads[k]):
                out.append(2 * (start[k] + bisect_right(ids[k], i)) + 1)
            else:
                out.append(2 * start[k + 1])
        return pa.array(out, pa.int64())

    return place


def _runs(largest: bool):
    def scan(batches):
        """Rows come sorted, equal texts together. Of a run of equal texts only the identifiers are held, never the texts."""
        from pyspark import TaskContext

        part, run, last, sha, ids, edge = TaskContext.get().partitionId(), -1, None, "", [], False

        def close():
            all_ids = np.concatenate(ids)
            keep = all_ids.max() if largest else all_ids.min()
            first = np.zeros(len(all_ids), bool)
            first[np.argmax(all_ids == keep)] = True
            n = len(all_ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(all_ids), pa.array([sha]).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, run, np.int64)), pa.array(np.full(n, n, np.int64)), pa.array(np.full(n, keep, np.int64)), pa.array(first), pa.array(np.full(n, edge, bool))],
                names=["_id", "text_sha256", "part", "run", "size", "keep", "first", "edge"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            texts, own, at = batch.column("_norm"), batch.column("_id").to_numpy(), batch.column("_at").to_numpy()
            changed = np.ones(batch.num_rows, bool)
            changed[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
            changed[0] = last is None or texts[0].as_py() != last
            starts = np.flatnonzero(changed)
            done = []
            if starts.size == 0 or starts[0] > 0:
                ids.append(own[: starts[0] if starts.size else None])
            # none starts where all rows of the batch go on with the text before
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows] if starts.size else [], strict=True):
                if ids:
                    done.append(close())
                run, ids, edge = run + 1, [own[a:b]], bool(at[a] & 1)
                sha = hashlib.sha256(texts[a].as_buffer()).hexdigest()
            last = texts[-1].as_py()
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if ids:
            yield close()

    return scan


def exact_dedup(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest (or keep='smallest') id stays; a null id sorts before all others; of rows that repeat the id
    that stays, one is kept. Other columns, whatever their names, play no part. An empty table gives no rows. Ids are
    whole numbers, or texts of such. A text of any length is one row; neighbours are compared one at a time.

    Rows are range-partitioned by (bytes of the text, id) at sampled splitters and sorted so in each partition, outside
    of memory where needed; neighbours are compared in full. A splitter holds the start of a text that tells it from the
    next in the sample; texts with that start may be cut there by id, so a text that a third of all rows share is spread
    over as many tasks as its rows need. Runs of such texts, and of no others, are stitched across partitions.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep: {keep}")
    spark = docs.sparkSession
    rows = framed(docs, [], id_col, text_col).select("_id", lower_ascii(F.col("_t")).alias("_norm"))
    n = partitions(spark)
    cuts = splitters(rows, n)
    rows = rows.withColumn("_at", F.arrow_udf(_placed(cuts), "long")(head_of(F.col("_norm")), "_id"))
    rows = rows.withColumn("_part", F.expr("cast(_at div 2 as int)"))
    ordered = rows.repartitionById(len(cuts) + 1, "_part").sortWithinPartitions("_norm", "_id")
    runs = durable(ordered.select("_id", "_norm", "_at").mapInArrow(trimmed(_runs(keep == "largest")), _RUNS))
    pick = F.max if keep == "largest" else F.min
    edges = runs.where("edge").groupBy("part", "run", "text_sha256").agg(F.count(F.lit(1)).alias("size"), pick("keep").alias("keep"))
    whole = edges.groupBy("text_sha256").agg(F.sum("size").alias("all_size"), pick("keep").alias("all_keep"))
    edges = edges.join(whole.select(F.col("text_sha256").alias("_sha"), "all_size", "all_keep"), F.col("text_sha256") == F.col("_sha"))
    holder = edges.where("keep = all_keep").groupBy("_sha").agg(F.min(F.struct("part", "run")).alias("_holder")).withColumnRenamed("_sha", "_sha2")
    edges = edges.join(holder, F.col("_sha") == F.col("_sha2")).select("part", "run", "all_size", "all_keep", (F.struct("part", "run") == F.col("_holder")).alias("_holds"))
    out = runs.join(edges, ["part", "run"], "left")
    return out.select(
        id_out().alias(id_col),
        F.nullif(F.coalesce("all_keep", "keep"), F.lit(NULL_ID)).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("first") & F.coalesce("_holds", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay. Of fully repeated rows one stays."""
    stay = exact_dedup(docs, keep, id_col, text_col).where("kept").select(F.coalesce(id_col, F.lit(NULL_ID)).alias("_id"), F.col("text_sha256").alias("_sha"))
    rows = framed(docs, docs.columns, id_col, text_col).select("_row", "_id", F.sha2(lower_ascii(F.col("_t")), 256).alias("_sha"))
    return rows.join(stay, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"]).select(*carried_out(docs.columns))


def op3_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, (count(*) OVER (PARTITION BY t))::BIGINT AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
