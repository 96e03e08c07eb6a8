"""Substring dedup over words: difference-cover anchors find shared stretches, extended to whole windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapgauge.llm import blocks
from mapgauge.llm.common import carried_out, durable, framed, partitions

#: A perfect difference set; any two residues modulo PERIOD are moved into it by one common step.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)


def flush_at(parts: int) -> int:
    """Entries that a task gathers before it deals them out: some thousands for each part, so that blocks stay small rows."""
    return max(1 << 18, min(1 << 21, parts << 13))



def _split(text: bytes) -> list[bytes]:
    """Words part at ASCII white space."""
    return text.split()


def _batches(batch, most: int = 1 << 20):
    """(rows, words) in parts of about `most` words."""
    texts = batch.column("_t").cast(pa.binary()).to_pylist()
    part, held, n = [], [], 0
    for i, t in enumerate(texts):
        w = _split(t)
        part.append(i)
        held.append(w)
        n += len(w)
        if n >= most:
            yield part, held
            part, held, n = [], [], 0
    if part:
        yield part, held


def _symbols(words: list[list[bytes]]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x) for w in words for x in w), np.uint64, sum(map(len, words)))


class _Flush:
    """Entries of several batches, given out together."""

    def __init__(self):
        self.held, self.ids, self.ths, self.n, self.docs = [], [], [], 0, 0

    def add(self, ids, ths, doc, *columns):
        self.held.append((doc + self.docs, *columns))
        self.ids.append(ids)
        self.ths.append(ths)
        self.docs += len(ids)
        self.n += len(doc)

    def take(self):
        out = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        ids, ths = np.concatenate(self.ids), np.concatenate(self.ths)
        self.__init__()
        return ids, ths, out


def _anchors(window: int, parts: int):
    width = window - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def out(f):
        ids, ths, (doc, key, pos) = f.take()
        # keys that two documents of this flush share are known to be shared: they are answered here and asked once
        order = np.lexsort((ids[doc], key))
        doc, key, pos = doc[order], key[order], pos[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        last = first + size - 1
        shared = np.repeat(ids[doc[first]] != ids[doc[last]], size)
        yield from blocks.answers(parts, doc[shared], ids, ths, pos[shared])
        ask = ~shared
        ask[first] = True
        known = shared[ask].astype(np.uint8)
        yield from blocks.questions(parts, key[ask], doc[ask], ids, ths, pos[ask].astype("<u4"), known)

    def run(batches):
        f = _Flush()
        for b in batches:
            ids, ths = b.column("_id").to_numpy(), b.column("_th").to_numpy()
            for part, words in _batches(b):
                n = np.fromiter(map(len, words), np.int64, len(words))
                start = np.cumsum(n) - n
                doc = np.repeat(np.arange(len(words)), n)
                pos = np.arange(len(doc)) - np.repeat(start, n)
                ok = cover[pos % PERIOD] & (pos + width <= n[doc]) & (n[doc] >= window)
                at = np.flatnonzero(ok)
                key = blocks.Rolling(_symbols(words)).at(at, at + width)
                f.add(ids[part], ths[part], doc[at], key, pos[at])
                if f.n >= flush_at(parts):
                    yield from out(f)
        if f.n:
            yield from out(f)

    return run


def _shared(parts: int):
    def decide(asked):
        key, doc, ids, ths, pos, known = blocks.joined(asked)
        order = np.lexsort((ids[doc], key))
        key, doc, pos, known = key[order], doc[order], pos[order], known[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        hit = (ids[doc[first]] != ids[doc[first + size - 1]]) | (np.maximum.reduceat(known, first) > 0)
        hit = np.repeat(hit, size) & (known == 0)
        yield from blocks.answers(parts, doc[hit], ids, ths, pos[hit].astype(np.int64))

    return blocks.judge(decide)


def _windows(window: int, parts: int):
    width = window - PERIOD + 1

    def out(f):
        ids, ths, (doc, key, extra, pos) = f.take()
        order = np.lexsort((ids[doc], extra, key))
        doc, key, extra, pos = doc[order], key[order], extra[order], pos[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (extra[1:] != extra[:-1])]))
        size = np.diff(np.append(first, len(key)))
        low = np.repeat(ids[doc[first]], size)
        later = ids[doc] > low  # the same window starts in a smaller document of this flush
        yield from blocks.answers(parts, doc[later], ids, ths, pos[later])
        ask = ~later
        yield from blocks.questions(parts, key[ask], doc[ask], ids, ths, extra[ask].astype("<u4"), pos[ask].astype("<u4"))

    def run(batches):
        f = _Flush()
        for b in batches:
            ids, ths = b.column("_id").to_numpy(), b.column("_th").to_numpy()
            starts, lens = b.column("starts").to_pylist(), b.column("lens").to_pylist()
            for part, words in _batches(b):
                n = np.fromiter(map(len, words), np.int64, len(words))
                start = np.cumsum(n) - n
                own = [np.frombuffer(starts[i], "<u4").astype(np.int64) for i in part]
                size = [np.frombuffer(lens[i], "<u4").astype(np.int64) for i in part]
                k = np.fromiter(map(len, own), np.int64, len(own))
                doc = np.repeat(np.arange(len(part)), k)
                a, c = np.concatenate(own), np.concatenate(size)
                # windows that hold an anchor at a, a+1, .. a+c-1
                lo = np.maximum(0, a + width - window)
                hi = np.minimum(a + c - 1, n[doc] - window)
                doc, lo, c = blocks.merge(doc[hi >= lo], lo[hi >= lo], (hi - lo + 1)[hi >= lo])
                pos = blocks.spans(lo, c)
                doc = np.repeat(doc, c)
                at = pos + start[doc]
                symbols = _symbols(words)
                key = blocks.Rolling(symbols).at(at, at + window)
                extra = (blocks.Rolling(symbols, 1).at(at, at + window) >> np.uint64(32)).astype(np.uint32)
                f.add(ids[part], ths[part], doc, key, extra, pos)
                if f.n >= flush_at(parts):
                    yield from out(f)
        if f.n:
            yield from out(f)

    return run


def _first_holder(parts: int):
    def decide(asked):
        key, doc, ids, ths, extra, pos = blocks.joined(asked)
        order = np.lexsort((ids[doc], extra, key))
        key, extra, doc, pos = key[order], extra[order], doc[order], pos[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (extra[1:] != extra[:-1])]))
        low = np.repeat(ids[doc[first]], np.diff(np.append(first, len(key))))
        later = ids[doc] > low
        yield from blocks.answers(parts, doc[later], ids, ths, pos[later].astype(np.int64))

    return blocks.judge(decide)


def _remove(window: int):
    def run(batches):
        for b in batches:
            starts, lens = b.column("starts").to_pylist(), b.column("lens").to_pylist()
            kept, total, removed = [], [], []
            for t, s, c in zip(b.column("_t").cast(pa.binary()).to_pylist(), starts, lens, strict=True):
                w = _split(t)
                gone = 0
                if s:
                    a = np.frombuffer(s, "<u4").astype(np.int64)
                    _, a, c = blocks.merge(np.zeros(len(a), np.int64), a, np.frombuffer(c, "<u4").astype(np.int64) + window - 1)
                    gone, at, left = int(c.sum()), 0, []
                    for x, y in zip(a.tolist(), (a + c).tolist(), strict=True):
                        left += w[at:x]
                        at = y
                    left += w[at:]
                else:
                    left = w
                kept.append(b" ".join(left))
                total.append(len(w))
                removed.append(gone)
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), text], names=["_row", "n_words", "n_removed", "kept"])

    return run


def repeated_windows(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _th (the text's hash), and runs of starts of windows that also start in a document with a smaller id."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = framed(docs, [], id_col, text_col).select("_id", "_th", "_t")
    asked = blocks.exchange(rows.mapInArrow(_anchors(window, n), blocks.BLOCKS), n)
    hits = blocks.exchange(asked.mapInArrow(_shared(n), blocks.BLOCKS), n).mapInArrow(blocks.gather, blocks.FOUND)
    del asked
    hits = durable(hits)
    cand = rows.hint("merge").join(hits, ["_id", "_th"])
    asked = blocks.exchange(cand.mapInArrow(_windows(window, n), blocks.BLOCKS), n)
    return blocks.exchange(asked.mapInArrow(_first_holder(n), blocks.BLOCKS), n).mapInArrow(blocks.gather, blocks.FOUND)


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less their text, plus n_words, n_removed and kept (the words left, joined by one space).

    Words part at ASCII white space and are compared unchanged. A window is `window` consecutive words of one document; a
    word goes if a window that covers it also starts in a document with a smaller id. Windows are judged on the input.
    Null and empty texts have no words. A null id sorts first; rows that repeat an id are one document for the
    comparison, each judged by its own text. Other columns pass through; the three new names replace columns so called.

    Step 1 hashes stretches of window - PERIOD + 1 words at positions whose residue modulo PERIOD is in the difference
    cover: two equal windows, wherever they start, hold one such stretch at the same distance. Step 2 extends: only
    windows around a stretch that two documents share are hashed whole (96 bits) and meet those of the same hash, of
    which the smallest id is the first holder. No pairs are formed. What one flush of a task can decide itself it
    answers at once and asks only once for each key, so a passage in a third of all documents reaches its judge a few
    times a task.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    flags = durable(repeated_windows(docs, window, id_col, text_col))
    names = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed", "kept")]
    rows = framed(docs, names, id_col, text_col)
    schema = rows.select("_row").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return rows.hint("merge").join(flags, ["_id", "_th"], "left").select("_row", "_t", "starts", "lens").mapInArrow(_remove(window), schema).select(*carried_out(names), "n_words", "n_removed", "kept")


def op8_substring_dedup(spark, sf_dir) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))




ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM w),
x AS (SELECT doc_id, pos, word, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS win FROM u
      WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT win, min(doc_id) AS d FROM x WHERE n = 50 GROUP BY win),
y AS (SELECT x.doc_id, pos, word, coalesce(m.d < x.doc_id, false) AS hit FROM x LEFT JOIN m ON x.win = m.win AND x.n = 50),
z AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM y),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM z GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
