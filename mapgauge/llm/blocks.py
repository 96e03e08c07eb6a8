"""An exchange of numpy blocks: keyed entries go to the task that owns their key, and what it finds goes back by document.

A row is (kind, part, payload). Kind 0 asks: entries to be judged with all others of their key. Kind 1 answers: values for
documents, already known; it passes through the judging task and on to the document's part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = "kind int, part int, payload binary"
FOUND = "_id long, _th long, starts binary, lens binary"
_KINDS = [np.dtype(x) for x in ("u1", "<u4", "<i8", "<u8", "<i4")]
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _MIX[0]
        x = (x ^ (x >> np.uint64(33))) * _MIX[1]
        return x ^ (x >> np.uint64(33))


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    head = [len(arrays)]
    body = []
    for a in arrays:
        head += [_KINDS.index(a.dtype.newbyteorder("<") if a.dtype.itemsize > 1 else a.dtype), len(a)]
        body.append(a.tobytes())
    return np.array(head, "<i8").tobytes() + b"".join(body)


def unpack(payload: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(payload, "<i8", 1)[0])
    head = np.frombuffer(payload, "<i8", 1 + 2 * n)[1:].reshape(n, 2).tolist()
    at, out = 8 * (1 + 2 * n), []
    for k, size in head:
        out.append(np.frombuffer(payload, _KINDS[k], size, at))
        at += size * _KINDS[k].itemsize
    return out


def rows(kind: int, parts: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    n = len(parts)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(parts, pa.int32()), pa.array(payloads, pa.binary())], names=["kind", "part", "payload"])


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, .. of each count, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first, counts) + np.repeat(starts, counts)


def questions(parts: int, key: np.ndarray, doc: np.ndarray, ids: np.ndarray, ths: np.ndarray, *columns: np.ndarray):
    """Rows of kind 0, a block for each part: key, place in the block's own table of documents, columns, that table."""
    order = np.argsort(key, kind="stable")
    at = part_of(key[order], parts)
    cut = np.flatnonzero(np.diff(at)) + 1
    names, payloads = [], []
    for own in np.split(order, cut):
        if not own.size:
            continue
        table, place = np.unique(doc[own], return_inverse=True)
        names.append(int(part_of(key[own[:1]], parts)[0]))
        payloads.append(pack(key[own].astype("<u8"), place.astype("<u4"), ids[table].astype("<i8"), ths[table].astype("<i8"), *(c[own] for c in columns)))
    if names:
        yield rows(0, names, payloads)


def answers(parts: int, doc: np.ndarray, ids: np.ndarray, ths: np.ndarray, start: np.ndarray, count: np.ndarray | None = None):
    """Rows of kind 1: for documents, by place in ids and ths, starts (and counts; none: 1 each)."""
    if not doc.size:
        return
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    count = np.ones(len(doc), np.int64) if count is None else count[order]
    joined = np.zeros(len(doc), bool)  # runs that meet become one
    joined[1:] = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + count[:-1])
    first = np.flatnonzero(~joined)
    count = np.add.reduceat(count, first)
    doc, start = doc[first], start[first]
    part = part_of(mix(ids[doc].astype(np.int64).view(np.uint64)), parts)
    order = np.lexsort((start, doc, part))
    cut = np.flatnonzero(np.diff(part[order])) + 1
    names, payloads = [], []
    for own in np.split(order, cut):
        table, size = np.unique(doc[own], return_counts=True)
        names.append(int(part[own[0]]))
        payloads.append(pack(ids[table].astype("<i8"), ths[table].astype("<i8"), size.astype("<u4"), start[own].astype("<u4"), count[own].astype("<u4")))
    yield rows(1, names, payloads)


def exchange(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionById(parts, "part")


def judge(decide):
    """For mapInArrow after an exchange: gives decide() the questions' blocks of this task and passes answers on."""

    def run(batches):
        asked = []
        for b in batches:
            kinds = b.column("kind").to_numpy()
            if (kinds == 1).any():
                yield b.filter(pa.array(kinds == 1))
            asked += [unpack(x.as_buffer().to_pybytes()) for x, k in zip(b.column("payload"), kinds, strict=True) if k == 0]
        if asked:
            yield from decide(asked)

    return run


def joined(asked: list[list[np.ndarray]]):
    """The blocks of one task as one: key, document's place, ids, ths, and the other columns."""
    base = np.cumsum([0, *(len(b[2]) for b in asked)])
    key = np.concatenate([b[0] for b in asked])
    doc = np.concatenate([b[1].astype(np.int64) + base[i] for i, b in enumerate(asked)])
    return key, doc, np.concatenate([b[2] for b in asked]), np.concatenate([b[3] for b in asked]), *(np.concatenate([b[k] for b in asked]) for k in range(4, len(asked[0])))


def gather(batches):
    """For mapInArrow after the second exchange: a row for each document, its runs merged, as little-endian 32-bit numbers."""
    held = [unpack(x.as_buffer().to_pybytes()) for b in batches for x in b.column("payload")]
    if not held:
        return
    ids, ths = np.concatenate([b[0] for b in held]), np.concatenate([b[1] for b in held])
    size = np.concatenate([b[2] for b in held]).astype(np.int64)
    start, count = (np.concatenate([b[k] for b in held]).astype(np.int64) for k in (3, 4))
    order = np.lexsort((ths, ids))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (ths[order][1:] != ths[order][:-1])
    name = np.empty(len(ids), np.int64)
    name[order] = np.cumsum(new) - 1
    doc = np.repeat(name, size)
    ids, ths = ids[order][new], ths[order][new]
    doc, start, count = merge(doc, start, count)
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    s, c = start.astype("<u4"), count.astype("<u4")
    for a in range(0, len(ids), 2048):
        z = min(len(ids), a + 2048)
        pieces = [(s[cut[i] : cut[i + 1]].tobytes(), c[cut[i] : cut[i + 1]].tobytes()) for i in range(a, z)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[a:z]), pa.array(ths[a:z]), pa.array([x for x, _ in pieces], pa.binary()), pa.array([x for _, x in pieces], pa.binary())], names=["_id", "_th", "starts", "lens"])


def merge(doc: np.ndarray, start: np.ndarray, count: np.ndarray):
    """Runs of each document that overlap or meet become one."""
    if not doc.size:
        return doc, start, count
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    end = start + count[order]
    # the furthest end so far within the document: ends made to grow from document to document
    lift = doc * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + lift) - lift
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], far[last] - start[first]


#: Multipliers of the two rolling hashes; odd, so that they have inverses modulo 2^64.
_R = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(k)
    if have is None or len(have[0]) < n:
        n = 1 << max(16, (n - 1).bit_length())
        out = []
        for r in (_R[k], pow(_R[k], -1, 1 << 64)):
            a = np.full(n, np.uint64(r))
            a[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(a))
        have = _powers[k] = (out[0], out[1])
    return have


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit symbols in constant time; k picks one of two functions."""

    def __init__(self, symbols: np.ndarray, k: int = 0):
        n = len(symbols)
        power, self.inverse = _power(k, n + 1)
        self.sum = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(symbols * power[:n], out=self.sum[1:])

    def all(self, width: int) -> np.ndarray:
        """Of each start from 0 to n - width."""
        with np.errstate(over="ignore"):
            return mix((self.sum[width:] - self.sum[: len(self.sum) - width]) * self.inverse[: len(self.sum) - width])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sum[end] - self.sum[start]) * self.inverse[start])


class RollingWithin:
    """Rolling over many short sequences that lie end to end: codes are places in a table of symbols, within is each one's
    place in its own sequence. Only powers up to the longest sequence are needed, and the sums are made in bounded parts."""

    def __init__(self, table: np.ndarray, codes: np.ndarray, within: np.ndarray, k: int = 0, part: int = 1 << 20):
        n = len(codes)
        power, self.inverse = _power(k, int(within.max(initial=0)) + 2)
        self.within = within
        self.sum = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for a in range(0, n, part):
                z = min(n, a + part)
                own = table[codes[a:z]] * power[within[a:z]]
                np.cumsum(own, out=own)
                own += self.sum[a]
                self.sum[a + 1 : z + 1] = own

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sum[end] - self.sum[start]) * self.inverse[self.within[start]])
