"""Best-fit packing by length patterns: non-negative least squares fits repeat counts to the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapgauge.llm.common import durable, framed, id_out, trimmed
from mapgauge.llm.mixing import numbered

MAX_TOKENS = 2048
END = 0  # the id that ends a document
VOCABULARY = "byte_bpe_50k.json"
#: Shares of the fitted counts to deal by pattern; the plan of fewest sequences is taken.
SHARES = (1.0, 0.75, 0.5)


# --- tokens ---------------------------------------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """ids of a byte-level BPE tokenizer file, with the ids of frequent words remembered.

    The tokenizer parts text before its merges, and a single space between two characters that are no white space always
    starts a part. So a long text is encoded in segments that begin with such spaces (a text without any is one
    segment), and a segment of such spaces alone is the concatenation of its words, each with its space before it, and
    a word's ids need to be found once. A segment with any other white space around a space is encoded whole, by
    `tokenizers`. Single words go through the same vocabulary as ranks, which is faster on short strings; it is held
    against `tokenizers` when it is built, and left alone where any probe differs.
    """

    def __init__(self, vocabulary: str = VOCABULARY, most: int = 20_000, segment: int = 1 << 16):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        of = _byte_of()
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in special}
        words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.word = lambda x: words.encode_to_numpy(x, disallowed_special=())
        self.opens = np.zeros(1 + max(ranks.values()), bool)  # ids that begin with a space, as the first of a word does
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        probes = [" the", " Étion,", " naïve's", " 12,345.6", "\n\nWas", " <|endoftext|>", " 日本語", " \u00ad\x7f\x00", " don't!?\nwe'll", " \U0001f600x"]
        if any(self.word(x).tolist() != self._whole(x).tolist() for x in probes):
            self.word = self._whole
        self.exotic = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        self.safe = re.compile(r"(?<=\S) (?=\S)").search
        self.most, self.segment = most, segment
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.known = self.used = 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _odd(self, t: str) -> bool:
        """Whether a space has white space beside it, or stands at an end, or white space of a rare kind occurs."""
        return t[0] == " " or t[-1] == " " or any(x in t for x in ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")) or self.exotic(t) is not None

    def _learn(self, at: list, words: list[str]) -> None:
        """Fills the gaps of at, all by one call. The first `most` words stay known; later ones are used once and written over."""
        gaps = [i for i, p in enumerate(at) if p is None]
        new = [words[i] for i in gaps]
        ids = self.word(" " + " ".join(new))
        starts = np.flatnonzero(self.opens[ids])
        k, used = self.known, self.used
        while k + len(new) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + len(ids)] = ids
        self.start[k : k + len(new)] = used + starts
        self.size[k : k + len(new)] = np.diff(np.append(starts, len(ids)))
        for i, p in zip(gaps, range(k, k + len(new)), strict=True):
            at[i] = p
        if k < self.most:
            self.place.update(zip(new, range(k, k + len(new)), strict=True))
            self.known, self.used = k + len(new), used + len(ids)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text of any length; held beside them are those of one segment."""
        out, a = [], 0
        while a < len(text):
            m = self.safe(text, a + self.segment)
            z = m.start() if m else len(text)
            out.append(self._segment(text[a:z], a > 0))
            a = z
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _segment(self, text: str, inner: bool) -> np.ndarray:
        """inner: the text begins with a space that starts a part."""
        if self._odd(text[1:] if inner else text):
            return self._whole(text)
        first, *words = text.split(" ")
        head = np.zeros(0, np.uint32) if inner else self.word(first).astype(np.uint32)
        if not words:
            return head
        at = list(map(self.place.get, words))
        if None in at:
            self._learn(at, words)
        at = np.array(at, np.int64)
        size = self.size[at]
        end = np.cumsum(size)
        return np.concatenate([head, self.flat[np.arange(end[-1]) + np.repeat(self.start[at] - end + size, size)]])


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One for each Python worker, so that what it remembers serves all its tasks."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def pieces(docs: DataFrame, most: int = MAX_TOKENS, vocabulary: str = VOCABULARY, end: int = END, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """_id, _th (the text's hash), piece, start, length, ids_crc32 and, if asked for, the ids, of each piece of each document."""

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            out = defaultdict(list)
            for i, th, t in zip(b.column("_id").to_pylist(), b.column("_th").to_pylist(), b.column("_t").to_pylist(), strict=True):
                v = np.append(enc.encode(t), np.uint32(end)).astype("<u4")
                first = len(v) % most or most
                cuts = [0, *range(first, len(v) + 1, most)]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = v[a:z].tobytes()
                    for c, x in zip(("_id", "_th", "piece", "start", "length", "ids_crc32"), (i, th, k, a, z - a, zlib.crc32(own)), strict=True):
                        out[c].append(x)
                    if ids:
                        out["ids"].append(v[a:z].tolist())
            kinds = {"_id": pa.int64(), "_th": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int64())}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for k, c in out.items()], names=list(out))

    rows = framed(docs, [], id_col, text_col).select("_id", "_th", "_t")
    return rows.mapInArrow(trimmed(run), "_id long, _th long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids)


# --- the plan, from the histogram of lengths alone ------------------------------------------------------------


def patterns(bins: int, most: int = 4) -> list[tuple[int, ...]]:
    """Multisets of up to `most` bins whose sum is bins: what fills a sequence."""
    out = []
    for k in range(1, most):
        for head in combinations_with_replacement(range(1, bins), k):
            last = bins - sum(head)
            if last >= head[-1]:
                out.append((*head, last))
    return out


def nnls(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares with no negative part, by active sets: until no pattern can lower the residual, in floating point."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, goal = a.T @ a, a.T @ y
    last = np.inf
    while True:
        w = goal - gram @ x
        left = float(((y - a @ x) ** 2).sum())
        if left >= last:  # what rounding leaves
            break
        last = left
        w[free] = -np.inf
        j = int(w.argmax())
        if w[j] <= 1e-9 * max(1.0, abs(goal).max()):
            break
        free[j] = True
        while True:
            s = np.zeros(n)
            at = np.flatnonzero(free)
            s[at] = np.linalg.lstsq(gram[np.ix_(at, at)], goal[at], rcond=None)[0]
            if (s[at] > 0).all():
                x = s
                break
            low = at[s[at] <= 0]
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


def plan(histogram: dict[int, int], most: int = MAX_TOKENS, bins: int = 64, parts: int = 4, share: float = 1.0) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): pieces of that length with ranks first.. go to consecutive sequences, at offset.

    Lengths round up to `bins` classes. Patterns of up to `parts` classes fill a sequence; non-negative least squares
    fits their repeat counts to the classes' histogram; the counts, times share and rounded down, are dealt exact lengths. What is left,
    and the gaps in what was dealt, are packed by best fit, longest first, over the histogram. All steps are over
    lengths and patterns, so the work and the plan's size are bounded by `most`, not by the documents.
    """
    left = np.zeros(most + 1, np.int64)
    for k, v in histogram.items():
        left[k] = v
    rank, out, sequence = np.zeros(most + 1, np.int64), [], 0
    room: dict[int, list[list[int]]] = defaultdict(list)  # free tokens -> [[first sequence, count]]

    def put(length: int, count: int, first: int, offset: int) -> None:
        out.append((length, int(rank[length]), count, first, offset))
        rank[length] += count
        left[length] -= count

    if left[most]:
        n = int(left[most])
        put(most, n, 0, 0)
        sequence = n
    width = most // bins
    if width >= 1 and left.sum():
        names = patterns(bins, parts)
        a = np.zeros((bins + 1, len(names)))
        for j, p in enumerate(names):
            for b in p:
                a[b, j] += 1
        of = -(-np.arange(most + 1) // width)
        y = np.bincount(of, weights=left, minlength=bins + 1)[: bins + 1]
        weight = np.sqrt(np.arange(bins + 1) / bins)[:, None]  # long pieces are harder to place later
        counts = np.floor(share * nnls(a * weight, y * weight[:, 0]) + 1e-9).astype(np.int64)
        for j in np.argsort([-max(p) for p in names], kind="stable"):
            todo, p = int(counts[j]), names[j]
            while todo:
                chosen, need = [], {}
                for place, b in enumerate(reversed(p)):  # of each class the longest that is left; the last one the longest that still fits
                    lo, hi = (b - 1) * width + 1, min(b * width, most)
                    if place == len(p) - 1:
                        hi = most - sum(chosen)
                    have = next((k for k in range(hi, lo - 1, -1) if left[k] > need.get(k, 0)), None)
                    if have is None:
                        break
                    chosen.append(have)
                    need[have] = need.get(have, 0) + 1
                if len(chosen) < len(p):
                    break
                n = min(todo, *(int(left[k]) // v for k, v in need.items()))
                at = 0
                for k in chosen:
                    put(k, n, sequence, at)
                    at += k
                if at < most:
                    room[most - at].append([sequence, n])
                sequence += n
                todo -= n
    for length in range(most - 1, 0, -1):  # best fit, longest first
        while left[length]:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                each = most // length  # new sequences, as many of this length in each as fit
                n = -(-int(left[length]) // each)
                room[most].append([sequence, n])
                sequence += n
                continue
            first, n = room[free][-1]
            k = min(n, int(left[length]))
            put(length, k, first, most - free)
            if k == n:
                room[free].pop()
                if not room[free]:
                    del room[free]
            else:
                room[free][-1] = [first + k, n - k]
            if free > length:
                room[free - length].append([first, k])
    return out


def pack(found: DataFrame, most: int = MAX_TOKENS, bins: int = 64, parts: int = 4) -> DataFrame:
    """found (a row for each piece, with `length` from 1 to most) plus sequence_id and offset. An empty table stays empty.

    Only the histogram of lengths reaches the driver: at most `most` rows. A piece's rank among those of its length is
    a two-level running sum, so no length, however frequent, is in one task; the plan, bounded by `most` too, is
    joined by length and rank.
    """
    spark = found.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(k < 1 or k > most for k in histogram):
        raise ValueError(f"a piece longer than {most} tokens, or empty")
    plans = [plan(histogram, most, bins, parts, share) for share in SHARES]
    rows = min(plans, key=lambda p: max((first + n for _, _, n, first, _ in p), default=0))
    kinds = "_length long, _rank long, _count long, _sequence long, _offset long"
    names = ["_length", "_rank", "_count", "_sequence", "_offset"]
    table = spark.createDataFrame(pa.table([pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(5)], names=names), kinds)
    ranked = numbered(found.withColumn("_one", F.lit(1)), ["length"], ["_id", "_th", "piece", "start"], "_one")
    at = (F.col("length") == F.col("_length")) & (F.col("_start") >= F.col("_rank")) & (F.col("_start") < F.col("_rank") + F.col("_count"))
    placed = ranked.join(F.broadcast(table), at)  # the plan's rows are bounded by `most`
    return placed.select(*found.columns, (F.col("_sequence") + F.col("_start") - F.col("_rank")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack_documents(docs: DataFrame, most: int = MAX_TOKENS, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A document is its ids and an end id, so a null or empty text is one piece of length 1. Documents longer than
    `most` are cut into pieces of `most`, the first of which may be shorter; a text of any length is one row, encoded in
    segments, and its ids (four bytes each) are held. Null ids come back as null; repeated rows are packed each; other
    columns play no part. Ids are whole numbers, or texts of such.
    """
    found = durable(pieces(docs, most, vocabulary, id_col=id_col, text_col=text_col, ids=ids))
    out = pack(found, most)
    return out.select(id_out().alias(id_col), "piece", "start", "length", "ids_crc32", *(["ids"] if ids else []), "sequence_id", "offset")


def op6_packing(spark, sf_dir) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
