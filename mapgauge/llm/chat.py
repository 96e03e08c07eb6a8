"""Chat formatting in windows of a token budget: turn-aligned spans, the system turn kept, limited history repeated, repeated targets masked."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapgauge.llm.common import NULL_ID, partitions

#: Control strings that must not stand in a text as they are. OPEN..SEP and CLOSE are this template's own.
OPEN, SEP, CLOSE = "[TURN]", "[/TURN]", "[/END]"
CONTROL = (OPEN, SEP, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_ESCAPE = re.compile("|".join([r"\\", *(re.escape(c) for c in CONTROL)]))
_BACK = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(CLOSE), re.DOTALL)


def escape(text: str) -> str:
    r"""Doubles each backslash and puts \| after the first character of each control string, so that none is left."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\|" + m[0][1:], text)


def unescape(text: str) -> str:
    """The inverse of escape."""
    return _BACK.sub(lambda m: "" if m[1] == "|" else m[1], text)


def count_tokens(texts: list[str]) -> list[int]:
    """Tokens for the budget: words and marks. A parameter of windows() stands for any other counter."""
    find = re.compile(r"\w+|[^\w\s]").findall
    return [len(find(t)) for t in texts]


WINDOW = "conv_id long, window long, text string, loss array<struct<start:long,end:long>>, n_tokens long, first_turn long, last_turn long, repeated int, system boolean, over boolean"


def _windows(budget: int, history: int, overhead: int, counter):
    def run(batches):
        """Rows come sorted by conversation and turn. Held: the open window and the history that the next may repeat."""
        out: list[tuple] = []
        conv, window, number = None, 0, 0
        system = None  # (role, text, tokens) of a first system turn
        tail: list = []  # turns already emitted that may be repeated: (role, text, tokens)
        span: list = []  # turns of the open window, new ones only
        ends = np.zeros(1, np.int64)

        def emit():
            nonlocal window, tail, span
            keep = [system] if system is not None and window else []
            used = sum(t[2] for t in span) + sum(t[2] for t in keep)
            back, n = [], 0
            for t in reversed(tail):  # the newest turns that fit the history's and the window's budget
                if n + t[2] > history or used + n + t[2] > budget:
                    break
                back.append(t)
                n += t[2]
            back.reverse()
            text, loss = [], []
            at = 0
            for k, (role, body, _) in enumerate([*keep, *back, *span]):
                head, own = f"{OPEN}{escape(role)}{SEP}", escape(body)
                if role == "assistant" and k >= len(keep) + len(back) and own:  # a repeated target is not learned twice
                    loss.append({"start": at + len(head), "end": at + len(head) + len(own)})
                text += [head, own, CLOSE]
                at += len(head) + len(own) + len(CLOSE)
            out.append((conv, window, "".join(text), loss, used + n, number - len(span), number - 1, len(back), bool(keep), used + n > budget))
            window += 1
            tail, n = [*back, *span], 0
            for k in range(len(tail) - 1, -1, -1):  # what no later window can repeat goes
                n += tail[k][2]
                if n > history:
                    tail = tail[k + 1 :]
                    break
            span = []

        for b in batches:
            ids, roles, texts = b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()
            tokens = [n + overhead for n in counter(texts)]
            for c, role, text, n in zip(ids, roles, texts, tokens, strict=True):
                if conv is None or c != conv:
                    if span:
                        emit()
                    conv, window, number, system, tail, span = c, 0, 0, None, [], []
                    ends = np.zeros(1, np.int64)
                turn = (role, text, n)
                if number == 0 and role == "system":
                    system = turn
                room = budget - (system[2] if system is not None and window else 0)
                if span and ends[-1] + n > room:  # ends: prefix sums of the open span's tokens
                    emit()
                    ends = np.zeros(1, np.int64)
                span.append(turn)
                ends = np.append(ends, ends[-1] + n) if len(span) > 1 else np.array([0, n])
                number += 1
            if out:
                yield _batch(out)
                out.clear()
        if span:
            emit()
        if out:
            yield _batch(out)

    return run


def _batch(rows):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.string(), spans, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
    names = ["conv_id", "window", "text", "loss", "n_tokens", "first_turn", "last_turn", "repeated", "system", "over"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def windows(turns: DataFrame, budget: int = 512, history: int = 128, overhead: int = 4, counter=count_tokens) -> DataFrame:
    """One row per window: conv_id, window, text, loss (spans of code points to learn), n_tokens and what it holds.

    turns has conv_id, turn, role, text; other columns play no part. Prefix sums of turn tokens choose spans of whole
    turns: a window takes turns while they fit the budget beside the system turn; a single turn that does not fit has a
    window of its own, whole, marked `over`. Every window but the first starts with the conversation's system turn,
    whatever its size, and repeats the newest earlier turns up to `history` tokens; only new
    assistant turns are under the loss, so each is learned once.

    Null role or text: empty. A null conv_id is a conversation of its own. Turns order by turn (null first), then
    role and text, so ties and repeated rows have one order. Memory: one window and its history, however long the
    conversation; a conversation's turns pass through one task as a stream, since windows follow one another.
    """
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    out = rows.mapInArrow(_windows(budget, history, overhead, counter), WINDOW)
    return out.withColumn("conv_id", F.nullif("conv_id", F.lit(NULL_ID)))


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def _read_back(batches):
    """Windows come sorted by conversation and number: one running digest for each conversation."""
    conv, out = None, []
    turns = chars = loss_chars = n = 0
    a = b = None

    def close():
        out.append((conv, turns, a.hexdigest(), loss_chars, b.hexdigest(), chars, n))

    for batch in batches:
        for row in batch.to_pylist():
            if row["conv_id"] != conv or a is None:
                if a is not None:
                    close()
                conv, turns, chars, loss_chars, n, a, b = row["conv_id"], 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            found = parse(row["text"])
            for role, text in found[int(row["system"]) + row["repeated"] :]:
                a.update(f"{role}\n{text}\n".encode())
                turns += 1
            for s in row["loss"]:
                learned = unescape(row["text"][s["start"] : s["end"]])
                b.update(learned.encode())
                loss_chars += len(learned)
            chars += len(row["text"])
            n += 1
        if out:
            yield _digests(out)
            out.clear()
    if a is not None:
        close()
        yield _digests(out)


def _digests(rows):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows say of each conversation: turns and learned texts, parsed and unescaped, as digests."""
    rows = formatted.select(F.coalesce("conv_id", F.lit(NULL_ID)).alias("conv_id"), "window", "text", "loss", "repeated", "system")
    rows = rows.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")
    out = rows.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
    return out.withColumn("conv_id", F.nullif("conv_id", F.lit(NULL_ID)))


#: The row that the query adds: texts made of control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def op1_chat(spark, sf_dir) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return read_back(windows(turns.unionByName(extra)))


#: Digests of the turns and of the learned texts can be said in SQL; the length of the formatted text cannot, so the query has no SQL.
