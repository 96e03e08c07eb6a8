"""Suffix-array dedup over bytes: repeated strings of a fixed length, found by suffix sorting through Lyndon groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapgauge.llm import blocks
from mapgauge.llm.common import carried_out, durable, framed, partitions
from mapgauge.llm.substring_dedup import _Flush, flush_at

# --- suffix sorting -------------------------------------------------------------------------------------------


def lyndon_groups(s: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1 for many texts side by side: (group, previous, length of the longest Lyndon prefix) of each suffix.

    s holds a 0 at place 0 and at the end of each text [begin, end), and no other. On return suffixes of a text are in
    one group if their longest Lyndon prefixes are equal; a group is named by the rank of its first suffix, so groups
    are in order. Every text works on its highest group that is not done, all texts at once: each suffix of the group
    finds the nearest suffix before it of a lower group by following the pointers of those between; the suffixes
    found leave their groups for new ones right above, those found more often above those found less often. A suffix's
    prefix ends where the next suffix that is not above its group begins: it holds those of all that point to it.
    """
    n = len(s)
    text = np.zeros(n, np.int64)
    text[begin] = 1
    key = np.cumsum(text) * (int(s.max()) + 1) + s
    sa = np.argsort(key, kind="stable")
    pos = np.empty(n, np.int64)
    pos[sa] = np.arange(n)
    first = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
    at = np.flatnonzero(first)
    size = np.zeros(n, np.int64)
    size[at] = np.diff(np.append(at, n))
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(at, size[at])
    prev, prefix = np.zeros(n, np.int64), np.ones(n, np.int64)
    mark = np.zeros(n, bool)
    floor, top = begin.copy(), end.copy()
    open_ = top > floor + 1
    floor, top = floor[open_], top[open_]
    while top.size:
        start = group[sa[top - 1]]
        count = top - start
        own = sa[blocks.spans(start, count)]
        level = np.repeat(start, count)
        p = own - 1
        prev[own] = p
        todo = group[p] >= level
        if todo.any():
            o, lv = own[todo], level[todo]
            while o.size:
                p = prev[prev[o]]
                prev[o] = p
                more = group[p] >= lv
                o, lv = o[more], lv[more]
        p = prev[own]
        np.add.at(prefix, p, prefix[own])
        p = p[s[p] != 0]
        if p.size:
            p.sort()
            cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            found, often = p[cut], np.diff(np.append(cut, p.size))
            g = group[found]
            order = np.lexsort((-often, g))
            found, often, g = found[order], often[order], g[order]
            head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            moved = np.diff(np.append(head, g.size))
            stop = g + size[g]
            target = stop - 1 - (np.arange(g.size) - np.repeat(head, moved))
            now = pos[found]
            outside = now < stop - np.repeat(moved, moved)
            if outside.any():
                mark[found] = True
                there = sa[target]
                there = there[~mark[there]]
                mark[found] = False
                sa[now[outside]] = there
                pos[there] = now[outside]
            sa[target] = found
            pos[found] = target
            edge = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (often[1:] != often[:-1])]))
            each = np.diff(np.append(edge, g.size))
            name = target[edge + each - 1]
            size[g[head]] -= moved
            size[name] = each
            group[found] = np.repeat(name, each)
        top = start
        open_ = top > floor + 1
        if not open_.all():
            floor, top = floor[open_], top[open_]
    return group, prev, prefix


def suffix_ranks(s: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Phase 2: the rank of each suffix; a text's ranks are begin..end-1.

    In a group the order is that of the suffixes behind the shared Lyndon prefix. So ranks are given out from the lowest
    group up: when a suffix has its rank, every suffix whose prefix ends at it takes the next free rank of its own
    group. These are of its group or higher ones, one of each; each suffix is placed once, nothing is sorted or named
    anew. All texts advance together, each by the run of suffixes of one group that have ranks and were not yet
    followed up; those of a group behind which the same group follows come after the others, in later runs.
    """
    n = len(s)
    group, _, prefix = lyndon_groups(s, begin, end)
    live = np.flatnonzero(s != 0)
    behind = live + prefix[live]
    many = np.bincount(behind, minlength=n)
    first, placed = np.cumsum(many) - many, live[np.argsort(behind, kind="stable")]
    rank, sa, free = np.full(n, -1, np.int64), np.empty(n, np.int64), np.arange(n)
    rank[end - 1], sa[begin] = begin, end - 1
    free[begin] += 1
    at, stop, end = begin, begin + 1, end.copy()
    while at.size:
        own = sa[blocks.spans(at, stop - at)]
        p = placed[blocks.spans(first[own], many[own])]
        if p.size:
            g = group[p]
            o = np.argsort(g, kind="stable")  # by group; within it in the order in which they were met
            p, g = p[o], g[o]
            head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            count = np.diff(np.append(head, g.size))
            to = free[g] + np.arange(g.size) - np.repeat(head, count)
            sa[to], rank[p] = p, to
            free[g[head]] += count
        at = stop
        open_ = at < end
        if not open_.all():
            at, end = at[open_], end[open_]
        stop = free[group[sa[at]]]
    return rank


def equal_stretches(flat: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the `window` bytes at a are those at b, for each pair. Pairs that lie side by side are compared together."""
    if not a.size:
        return np.zeros(0, bool)
    order = np.lexsort((a, b - a))
    x, y = a[order], b[order]
    new = np.concatenate([[True], (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(x)))
    size = run + window - 1
    wrong = np.concatenate([[0], np.cumsum(flat[blocks.spans(x[first], size)] != flat[blocks.spans(y[first], size)])])
    at = blocks.spans(np.cumsum(size) - size, run)
    out = np.empty(len(x), bool)
    out[order] = wrong[at + window] == wrong[at]
    return out


# --- windows and their anchors --------------------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PIECE = 20  # bits of a place in a piece
_LOW = np.uint64((1 << _PIECE) - 1)


def _pieces(texts: list[bytes], window: int, most: int = 1 << _PIECE):
    """(rows, offsets, bytes) of about 2^20 bytes; a longer text is cut into pieces that overlap by window - 1."""
    part, offset, held, n = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < window:
            continue
        for a in range(0, len(t) - window + 1, most - window + 1):
            own = t[a : a + most]
            if n + len(own) > most and part:
                yield part, offset, held
                part, offset, held, n = [], [], [], 0
            part.append(i)
            offset.append(a)
            held.append(own)
            n += len(own)
    if part:
        yield part, offset, held


class _Anchored:
    """Windows of a piece and their anchors: of the stretches of half a window in it the one of the smallest hash, the
    first among equals. It depends on the window's bytes alone, so equal windows have equal anchors at equal places."""

    def __init__(self, held: list[bytes], window: int):
        half = window // 2
        size = np.fromiter(map(len, held), np.int64, len(held))
        self.base = np.cumsum(size) - size
        self.flat = np.frombuffer(b"".join(held), np.uint8)
        n = len(self.flat)
        self.hash = blocks.Rolling(_BYTE[self.flat]).all(half)
        low = (self.hash & ~_LOW) | np.arange(len(self.hash), dtype=np.uint64)
        span, want = 1, window - half + 1
        while span * 2 <= want:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if want > span:
            low = np.minimum(low[: len(low) - (want - span)], low[want - span :])
        place = (low & _LOW).astype(np.int64)
        # runs of windows of one text with one anchor
        count = size - window + 1
        start = blocks.spans(self.base, count)
        doc = np.repeat(np.arange(len(held)), count)
        place = place[start]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
        at = np.flatnonzero(new)
        self.doc, self.first, self.anchor = doc[at], start[at], place[at]
        self.windows = np.diff(np.append(at, len(start)))
        self.n = n


def _anchors(window: int, parts: int):
    def out(f):
        ids, ths, (doc, key, pos) = f.take()
        order = np.argsort(key, kind="stable")
        doc, key, pos = doc[order], key[order], pos[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        shared = np.repeat(size > 1, size)  # answered here, and asked once
        yield from blocks.answers(parts, doc[shared], ids, ths, pos[shared])
        ask = ~shared
        ask[first] = True
        yield from blocks.questions(parts, key[ask], doc[ask], ids, ths, pos[ask].astype("<u4"), shared[ask].astype(np.uint8))

    def run(batches):
        f = _Flush()
        for b in batches:
            ids, ths = b.column("_id").to_numpy(), b.column("_th").to_numpy()
            for part, offset, held in _pieces(b.column("_t").cast(pa.binary()).to_pylist(), window):
                w = _Anchored(held, window)
                pos = w.anchor - w.base[w.doc] + np.array(offset)[w.doc]
                doc = np.array(part)[w.doc]
                # the overlap of two pieces of one text may name a place twice
                key = blocks.mix(w.hash[w.anchor])  # smallest hashes lie close together; parts want them spread
                once = np.ones(len(doc), bool)
                once[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
                f.add(ids, ths, doc[once], key[once], pos[once])
                if f.n >= flush_at(parts):
                    yield from out(f)
        if f.n:
            yield from out(f)

    return run


def _shared(parts: int):
    def decide(asked):
        key, doc, ids, ths, pos, known = blocks.joined(asked)
        order = np.argsort(key, kind="stable")
        key, doc, pos, known = key[order], doc[order], pos[order], known[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        hit = np.repeat((size > 1) | (np.maximum.reduceat(known, first) > 0), size) & (known == 0)
        yield from blocks.answers(parts, doc[hit], ids, ths, pos[hit].astype(np.int64))

    return blocks.judge(decide)


# --- contexts: an anchor with all windows around it -----------------------------------------------------------


def _contexts(window: int, parts: int):
    most = max(1 << 22, min(1 << 25, parts << 17))  # bytes of contexts that a task gathers before it deals them out

    def out(held, ids, ths):
        key, digest, extra, text, off, doc, start = (np.concatenate([h[k] for h in held]) if k != 3 else [t for h in held for t in h[3]] for k in range(7))
        order = np.lexsort((extra, digest, off, key))
        new = np.ones(len(order), bool)
        for c in (key, off, digest, extra):
            x = c[order]
            new[1:] &= x[1:] == x[:-1]
        new[1:] = ~new[1:]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        length = np.fromiter(map(len, text), np.int64, len(text))
        # contexts that come twice here: all their windows are repeated; answered here, asked once
        twice = order[np.repeat(size > 1, size)]
        yield from blocks.answers(parts, doc[twice], ids, ths, start[twice], length[twice] - window + 1)
        ask = order[first]
        known = (size > 1).astype(np.uint8)
        part = blocks.part_of(key[ask], parts)
        o = np.argsort(part, kind="stable")
        names, payloads = [], []
        for own in np.split(o, np.flatnonzero(np.diff(part[o])) + 1):
            if not own.size:
                continue
            e = ask[own]
            table, place = np.unique(doc[e], return_inverse=True)
            body = np.frombuffer(b"".join(text[i] for i in e.tolist()), np.uint8)
            names.append(int(part[own[0]]))
            payloads.append(blocks.pack(key[e].astype("<u8"), place.astype("<u4"), ids[table].astype("<i8"), ths[table].astype("<i8"), start[e].astype("<u4"), off[e].astype("<u4"), length[e].astype("<u4"), known[own], body))
        yield blocks.rows(0, names, payloads)

    def run(batches):
        held, names, hashes, n = [], [], [], 0
        for b in batches:
            ids, ths = b.column("_id").to_numpy(), b.column("_th").to_numpy()
            starts, lens = b.column("starts").to_pylist(), b.column("lens").to_pylist()
            docs = sum(map(len, names))  # rows of this flush before this batch
            names.append(ids)
            hashes.append(ths)
            hot = [blocks.spans(np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(c, "<u4").astype(np.int64)) for a, c in zip(starts, lens, strict=True)]
            for part, offset, own in _pieces(b.column("_t").cast(pa.binary()).to_pylist(), window):
                w = _Anchored(own, window)
                flag = np.zeros(w.n, bool)
                for k, (i, a) in enumerate(zip(part, offset, strict=True)):
                    h = hot[i] - a
                    flag[h[(h >= 0) & (h < len(own[k]))] + w.base[k]] = True
                take = np.flatnonzero(flag[w.anchor])
                if not take.size:
                    continue
                a, z = w.first[take], w.first[take] + w.windows[take] - 1 + window
                roll, extra = (blocks.Rolling(_BYTE[w.flat], k) for k in (0, 1))
                raw = w.flat.tobytes()
                text = [raw[x:y] for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                d = w.doc[take]
                held.append((blocks.mix(w.hash[w.anchor[take]]), roll.at(a, z), extra.at(a, z), text, w.anchor[take] - a, np.array(part)[d] + docs, a - w.base[d] + np.array(offset)[d]))
                n += int((z - a).sum())
                if n >= most:
                    yield from out(held, np.concatenate(names), np.concatenate(hashes))
                    held, names, hashes, n, docs = [], [ids], [ths], 0, 0
        if held:
            yield from out(held, np.concatenate(names), np.concatenate(hashes))

    return run


#: Contexts that are sorted together at most; a larger group is first parted by what its windows must share. It sets
#: the size of the leaves, not what is found.
TOGETHER = 12
_SORT = 1 << 19
#: Bytes of contexts that a task works on at a time; a larger group is worked on alone.
_WORK = 1 << 20


def repeated_in_contexts(key: np.ndarray, off: np.ndarray, flat: np.ndarray, begin: np.ndarray, length: np.ndarray, weight: np.ndarray, window: int) -> np.ndarray:
    """For each window of each context (one context after another, length - window + 1 of each) whether it is found again.

    Contexts of equal key hold the same anchor, at off. They are sorted as one text by suffixes; windows are found again
    where neighbours in suffix order share `window` bytes, compared byte by byte, or where weight says the context itself
    comes twice.

    A group of over TOGETHER contexts is parted first, by halving the range of distances between a window's start and the
    anchor: all windows of a half share a longer stretch, whose hash parts them further. So a group of near copies
    costs its size times the logarithm of the window, not its square, and no step holds more than its contexts.
    """
    count = length - window + 1
    out_at = np.cumsum(count) - count
    found = np.zeros(int(count.sum()), bool)
    within = blocks.spans(np.zeros(len(length), np.int64), length).astype(np.int32)
    one, two = blocks.RollingWithin(_BYTE, flat, within), blocks.RollingWithin(_BYTE, flat, within, 1)
    anchor = begin + off
    # sub-contexts: context, and the range of distances of window starts before the anchor
    ctx = np.arange(len(key))
    lo, hi = off - (length - window), off.copy()
    name = np.unique(key, return_inverse=True)[1]
    a, b = np.zeros(len(key), np.int64), np.full(len(key), int(hi.max(initial=0)), np.int64)
    a[:] = int(lo.min(initial=0))
    while ctx.size:
        x, y = np.maximum(a, lo[ctx]), np.minimum(b, hi[ctx])
        start, stop = anchor[ctx] - y, anchor[ctx] - x + window
        h1, h2 = one.at(start, stop), two.at(start, stop)
        # equal sub-contexts at equal distances are one
        order = np.lexsort((h2, h1, x, y, name))
        diff = np.zeros(len(order), bool)
        diff[:1] = True
        for c in (name, y, x, h1, h2):
            v = c[order]
            diff[1:] |= v[1:] != v[:-1]
        first = np.flatnonzero(diff)
        times = np.add.reduceat(weight[ctx[order]], first)
        size = np.diff(np.append(first, len(order)))
        twice = order[np.repeat(times > 1, size)]
        at = out_at[ctx[twice]] + off[ctx[twice]] - y[twice]
        found[blocks.spans(at, (y - x + 1)[twice])] = True
        rep = order[first]
        copies = np.repeat(np.arange(len(first)), size)  # which representative each stands for
        g = name[rep]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        many = np.diff(np.append(head, len(g)))
        per = np.repeat(many, many)
        ready = (per > 1) & ((per <= TOGETHER) | (a[rep] == b[rep]))
        if ready.any():
            _sort((order, copies, rep, ready, x, y, name, ctx), found, out_at, off, anchor, flat, window, one)
        # larger groups: two halves, each parted by the stretch all its windows share
        big = np.flatnonzero((per > TOGETHER) & (a[rep] != b[rep]))
        if not big.size:
            break
        is_big = np.zeros(len(first), bool)
        is_big[big] = True
        sel = order[is_big[copies]]
        mid = (a[sel] + b[sel]) // 2
        ctx2 = np.concatenate([ctx[sel], ctx[sel]])
        a2, b2 = np.concatenate([a[sel], mid + 1]), np.concatenate([mid, b[sel]])
        n2 = np.concatenate([name[sel] * 2, name[sel] * 2 + 1])
        has = np.maximum(a2, lo[ctx2]) <= np.minimum(b2, hi[ctx2])
        ctx, a, b, n2 = ctx2[has], a2[has], b2[has], n2[has]
        must = one.at(anchor[ctx] - a, anchor[ctx] - b + window)
        order = np.lexsort((must, n2))
        diff = np.zeros(len(order), bool)
        diff[1:] = (n2[order][1:] != n2[order][:-1]) | (must[order][1:] != must[order][:-1])
        name = np.empty(len(order), np.int64)
        name[order] = np.cumsum(diff)
    return found


def _sort(job, found, out_at, off, anchor, flat, window, one) -> None:
    """Sorts the suffixes of groups of sub-contexts, texts of like length together, and marks windows found again."""
    order, copies, rep, ready, x, y, name, ctx = job
    use = rep[ready]  # sorted by group
    start = anchor[ctx[use]] - y[use]
    half = window // 2
    before, after = y[use], (window - half) - x[use]
    # the anchor, which all contexts of a group share and all their windows hold, is one symbol
    size = before + 1 + after
    span = (y - x)[use] + 1
    g = name[use]
    head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    many = np.diff(np.append(head, len(g)))
    total = np.add.reduceat(size + 1, head)
    by = np.argsort(total, kind="stable")
    hit_of = [None] * len(use)
    a = 0
    while a < len(by):
        z = a + 1
        n = int(total[by[a]])
        while z < len(by) and n + total[by[z]] <= _SORT:
            n += int(total[by[z]])
            z += 1
        groups = by[a:z]
        a = z
        own = blocks.spans(head[groups], many[groups])
        own_size, lead = size[own], before[own]
        # each context and a 1, each text and a 0; a 0 before the first; an anchor is a 2
        last = np.cumsum(many[groups]) - 1
        gap = np.ones(len(own), np.int64)
        gap[last] = 2
        begin = 1 + np.cumsum(own_size + gap) - (own_size + gap)
        s = np.ones(1 + int((own_size + gap).sum()), np.int64)
        s[0] = 0
        s[blocks.spans(begin, lead)] = flat[blocks.spans(start[own], lead)].astype(np.int64) + 3
        s[begin + lead] = 2
        s[blocks.spans(begin + lead + 1, after[own])] = flat[blocks.spans(start[own] + lead + half, after[own])].astype(np.int64) + 3
        ends = begin[last] + own_size[last] + 2
        s[ends - 1] = 0
        t_begin = np.concatenate([[1], ends[:-1]])
        rank = suffix_ranks(s, t_begin, ends)
        # windows in suffix order; neighbours that share a window
        k = span[own]
        w = blocks.spans(begin, k)
        src = blocks.spans(start[own], k)
        text = np.repeat(np.repeat(np.arange(len(groups)), many[groups]), k)
        o = np.argsort(rank[w], kind="stable")
        p, t = src[o], text[o]
        h = one.at(p, p + window)
        same = np.flatnonzero((h[1:] == h[:-1]) & (t[1:] == t[:-1]))  # unequal hashes: unequal bytes
        same = same[equal_stretches(flat, p[same], p[same + 1], window)]
        hit = np.zeros(len(o), bool)
        hit[o[same + 1]] = True
        hit[o[same]] = True
        edge = np.cumsum(k) - k
        for i, c in enumerate(own.tolist()):
            hit_of[c] = hit[edge[i] : edge[i] + k[i]]
    # what holds for a sub-context holds for its equals
    flags = np.concatenate(hit_of)
    width = (y - x + 1)[use]
    flag_at = np.cumsum(width) - width
    slot = np.full(len(rep), -1, np.int64)
    slot[ready] = np.arange(len(use))
    mine = slot[copies]
    some = mine >= 0
    to, mine = order[some], mine[some]
    dest = blocks.spans(out_at[ctx[to]] + off[ctx[to]] - y[to], (y - x + 1)[to])
    found[dest] |= flags[blocks.spans(flag_at[mine], width[mine])]


def _found_again(window: int, parts: int):
    def decide(asked):
        base = np.cumsum([0, *(len(b[2]) for b in asked)])
        key, ids, ths, start, off, length, known, flat = (np.concatenate([b[k] for b in asked]) for k in (0, 2, 3, 4, 5, 6, 7, 8))
        doc = np.concatenate([b[1].astype(np.int64) + base[i] for i, b in enumerate(asked)])
        asked.clear()
        start, off, length = start.astype(np.int64), off.astype(np.int64), length.astype(np.int64)
        begin = np.cumsum(length) - length
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        size = np.add.reduceat(length[order], head)
        head = np.append(head, len(order))
        a = 0
        while a < len(size):  # whole groups, about _WORK bytes of them
            z, n = a + 1, int(size[a])
            while z < len(size) and n + size[z] <= _WORK:
                n += int(size[z])
                z += 1
            own = order[head[a] : head[z]]
            a = z
            if len(own) == 1:
                continue
            part = flat[blocks.spans(begin[own], length[own])]
            at = np.cumsum(length[own]) - length[own]
            hit = repeated_in_contexts(key[own], off[own], part, at, length[own], 1 + known[own].astype(np.int64), window)
            count = length[own] - window + 1
            hit &= np.repeat(known[own] == 0, count)  # the others were answered where they were met
            on = np.flatnonzero(hit)
            if not on.size:
                continue
            owner = np.repeat(np.arange(len(own)), count)
            new = np.ones(len(on), bool)
            new[1:] = (on[1:] != on[:-1] + 1) | (owner[on][1:] != owner[on][:-1])
            first = np.flatnonzero(new)
            runs = np.diff(np.append(first, len(on)))
            w = owner[on[first]]
            o = own[w]
            yield from blocks.answers(parts, doc[o], ids, ths, start[o] + on[first] - (np.cumsum(count) - count)[w], runs)

    return blocks.judge(decide)


# --- the operator ---------------------------------------------------------------------------------------------


def _remove(window: int):
    def run(batches):
        for b in batches:
            starts, lens = b.column("starts").to_pylist(), b.column("lens").to_pylist()
            kept, total, removed, runs = [], [], [], []
            for t, s, c in zip(b.column("_t").cast(pa.binary()).to_pylist(), starts, lens, strict=True):
                gone = n = 0
                left = t
                if s:
                    a = np.frombuffer(s, "<u4").astype(np.int64)
                    _, a, c = blocks.merge(np.zeros(len(a), np.int64), a, np.frombuffer(c, "<u4").astype(np.int64) + window - 1)
                    ends = (a + c).tolist()
                    left = b"".join(t[x:y] for x, y in zip([0, *ends], [*a.tolist(), len(t)], strict=True))
                    gone, n = int(c.sum()), len(a)
                kept.append(left)
                total.append(len(t))
                removed.append(gone)
                runs.append(n)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["_row", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def repeated_strings(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _th (the text's hash), and runs of starts of strings of `window` bytes that also start anywhere else."""
    n = partitions(docs.sparkSession)
    rows = framed(docs, [], id_col, text_col).select("_id", "_th", "_t")
    asked = blocks.exchange(rows.mapInArrow(_anchors(window, n), blocks.BLOCKS), n)
    hits = blocks.exchange(asked.mapInArrow(_shared(n), blocks.BLOCKS), n).mapInArrow(blocks.gather, blocks.FOUND)
    del asked
    hits = durable(hits)
    cand = rows.hint("merge").join(hits, ["_id", "_th"])
    asked = blocks.exchange(cand.mapInArrow(_contexts(window, n), blocks.BLOCKS), n)
    return blocks.exchange(asked.mapInArrow(_found_again(window, n), blocks.BLOCKS), n).mapInArrow(blocks.gather, blocks.FOUND)


def suffix_dedup(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less their text, plus n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left, binary:
    a run may end inside a character).

    Texts are UTF-8 bytes; null is empty. A byte goes if a string of `window` bytes that covers it also starts anywhere
    else, in another row or at another place of the same one, overlaps included; strings never cross rows and are
    judged on the input. Rows that repeat an id count as rows of their own; rows that are equal in id and text get equal
    results. A null id is an id like others. Other columns pass through; the new names replace columns so called.

    The suffix array of all bytes is built in parts that need not meet: every window has an anchor, a stretch of half its
    length chosen by its bytes alone, and windows of one anchor lie in one context around it. Contexts of anchors
    that occur once are left out; those of one anchor are sorted by suffixes together (lyndon_groups, suffix_ranks).
    What a flush of a task knows to be repeated it answers at once and asks only once, so a passage in a third of all
    rows reaches its part a few times a task.
    """
    flags = durable(repeated_strings(docs, window, id_col, text_col))
    names = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_removed", "n_spans", "kept")]
    rows = framed(docs, names, id_col, text_col)
    schema = rows.select("_row").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return rows.hint("merge").join(flags, ["_id", "_th"], "left").select("_row", "_t", "starts", "lens").mapInArrow(_remove(window), schema).select(*carried_out(names), "n_bytes", "n_removed", "n_spans", "kept")


def op2_suffix_dedup(spark, sf_dir) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
