"""Substring deduplication with compact windows.

For each of k hash functions over a text's five-word shingles, all subsequences of a least length fall into few compact
windows (l, c, r): every subsequence that begins in [l, c] and ends in [c, r] has its smallest hash at c. These are the
nodes of the Cartesian tree over the hashes whose interval is long enough. Windows with equal smallest shingles are
joined across documents; a document whose windows meet those of an earlier one under enough hash functions, in
overlapping intervals, is held against that document word by word.

What the earliest document of a window's key does not hold may still repeat in two later ones. Passages whose smallest
shingles are shared under enough functions, and that are not found yet, are therefore grouped by their own hashes, which
finds every exact one. For near ones they are grouped by two smallest shingles at once, and held against the first
document of the group. No group is expanded into pairs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Staged, cut, few, lean, mix64, numbered, shingles, slices, small_batches, tidy, word_hashes

WIDTH, WORDS, HASHES, HITS = 5, 50, 4, 2
_LOW = np.uint64(0xFFFFFF)


def packed(text: str) -> bytes:
    """A text as it goes through shuffles and files: its size in bytes, and it compressed; equal texts give equal bytes."""
    data = text.encode()
    return len(data).to_bytes(4, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)


def _sliding_min(v: np.ndarray, t: int) -> np.ndarray:
    """Minima of all windows of ``t`` values, by prefix and suffix minima of blocks."""
    n = len(v)
    m = -(-n // t) * t
    padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, t)
    prefix = np.minimum.accumulate(blocks, 1).reshape(-1)
    suffix = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(suffix[: n - t + 1], prefix[t - 1 : n])


def compact_windows(h: np.ndarray, t: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (l, c, r), ends included, of all subsequences of ``t`` or more hashes; ties go to the left.

    ``of`` tells the text of each hash, where several texts lie one after the other; no window crosses from one to the
    next. A node of the Cartesian tree has a long enough interval if it is the minimum of some window of ``t``; its
    ancestors then have too, so intervals reach to the nearest smaller ones among these nodes alone, which all nodes
    find at once by following what larger neighbours have found.
    """
    n = len(h)
    of = np.zeros(n, np.int64) if of is None else of
    if n < t:
        return (np.zeros(0, np.int64),) * 3
    top = h & ~_LOW  # the order is by these bits, then by place
    if n < 1 << 24:
        v = top | np.arange(n, dtype=np.uint64)
        at = (_sliding_min(v, t) & _LOW).astype(np.int64)
    else:
        order = np.argsort(top, kind="stable")
        v = np.empty(n, np.uint64)
        v[order] = np.arange(n, dtype=np.uint64)
        at = order[_sliding_min(v, t).astype(np.int64)]
    at = at[of[: n - t + 1] == of[t - 1 :]]
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]  # smallest places never go back
    m, x, text = len(at), np.append(v[at], np.uint64(0)), of[at]
    edge = np.flatnonzero(np.diff(text, prepend=-1))

    def nearest(smaller: np.ndarray, ends: np.ndarray) -> np.ndarray:
        smaller[ends] = m  # the end of a text is smaller than all
        smaller = np.append(smaller, m)
        todo = np.flatnonzero(x[smaller] > x)
        while len(todo):
            smaller[todo] = smaller[smaller[todo]]
            todo = todo[x[smaller[todo]] > x[todo]]
        return smaller[:m]

    before, after = nearest(np.arange(m) - 1, edge), nearest(np.arange(m) + 1, np.append(edge[1:] - 1, m - 1) if m else edge)
    first, past = np.searchsorted(of, text), np.searchsorted(of, text, "right")
    place = np.append(at, 0)
    return np.where(before == m, first, place[before] + 1), at, np.where(after == m, past - 1, place[after] - 1)


def _windows(df: DataFrame, key: str, text: str, words: int, hashes: int) -> DataFrame:
    """Rows (id, f, key, place, c): f numbers the hash function, the key is the smallest shingle's hash, c its position."""
    t = words - WIDTH + 1

    small_batches(df)

    def run(batches):
        lean()
        for b in slices(batches):
            split = [(row, (body or "").encode().split()) for row, body in enumerate(b.column(1).to_pylist())]
            split = [(row, w) for row, w in split if len(w) >= words]
            rows = np.repeat(np.array([r for r, _ in split], np.int64), [len(w) for _, w in split])
            s = shingles(word_hashes([x for _, w in split for x in w]), WIDTH)
            inside = rows[: len(s)] == rows[WIDTH - 1 :] if len(s) else np.zeros(0, bool)
            s, of = s[inside], rows[: len(s)][inside]
            parts = []
            for f in range(hashes):
                h = mix64(s, f + 1)
                left, c, right = compact_windows(h, t, of)
                base = np.searchsorted(of, of[c])
                parts.append((of[c], np.full(len(c), f, np.int32), h[c].view(np.int64), (left - base) << 32 | (right - base), (c - base).astype(np.int32)))
            rows, *flat = (pa.array(np.concatenate(x)) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), *flat], ["id", "f", "key", "place", "c"])

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {df.schema[key].dataType.simpleString()}, f int, key long, place long, c int")


def overlapping(places: list[int], functions: list[int], t: int, hits: int) -> bool:
    """Whether windows of ``hits`` hash functions share an interval of ``t`` shingles."""
    windows = sorted((p >> 32, p & 0xFFFFFFFF, f) for p, f in zip(places, functions, strict=True))
    live: list[tuple[int, int]] = []
    for start, end, f in windows:
        live = [(e, g) for e, g in live if e - start + 1 >= t]
        live.append((end, f))
        if len({g for _, g in live}) >= hits:
            return True
    return False


def _window_sums(flags: np.ndarray, t: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[t:] - total[:-t]


class Held:
    """A text's shingles, sorted once for all texts that are held against it."""

    def __init__(self, words: list[bytes], t: int):
        self.y = shingles(word_hashes(words), WIDTH)
        self.order = np.argsort(self.y, kind="stable")
        self.sorted = self.y[self.order]
        self.passages = np.sort(shingles(self.y, t))


def _found(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value would be in the sorted ``among``, and whether it is there."""
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return at, among[at] == values


def repeated_spans(a: list[bytes], b: list[bytes] | Held, words: int = WORDS, least: float = 0.8) -> list[tuple[int, int]]:
    """Word spans of ``a`` that ``b`` repeats: runs of ``words`` equal words or more, and passages of ``words`` words
    whose five-word shingles have a Jaccard similarity of ``least`` or more with a passage of ``b``."""
    t = words - WIDTH + 1
    held = b if isinstance(b, Held) else Held(b, t)
    x, y = shingles(word_hashes(a), WIDTH), held.y
    if len(x) < t or len(y) < t:
        return []
    starts = _found(shingles(x, t), held.passages)[1]
    if starts.all():
        return [(0, len(a))]
    # Near matches: shingles of a found in b densely enough, on a common diagonal.
    at, found = _found(x, held.sorted)
    where = held.order[at] - np.arange(len(x))
    need = 2 * least / (1 + least) * t - 1e-9  # common shingles of two passages of t at the least similarity
    rest = (_window_sums(found, t) >= need) & ~starts
    same = np.flatnonzero(starts)
    first, last = [same], [same + words]
    if rest.any():
        # Most near matches lie on one diagonal: enough matches at one offset decide without looking at sets.
        offsets, counts = np.unique(where[found], return_counts=True)
        for offset in offsets[counts >= need].tolist():
            on = found & (where == offset)
            near = np.flatnonzero(rest & (_window_sums(on, t) >= need))
            hits = np.flatnonzero(on)
            first.append(hits[np.searchsorted(hits, near)])
            last.append(hits[np.searchsorted(hits, near + t) - 1] + WIDTH)
            rest[near] = False
        for i in np.flatnonzero(rest).tolist():
            hit = np.flatnonzero(found[i : i + t])
            j = min(max(0, i + int(np.median(where[i : i + t][hit]))), len(y) - t)
            p, q = set(x[i : i + t].tolist()), set(y[j : j + t].tolist())
            both = len(p & q)
            if both >= least * (len(p) + len(q) - both):  # words before the first and after the last common shingle stay
                first.append(np.array([i + hit[0]]))
                last.append(np.array([i + hit[-1] + WIDTH]))
    return _union(np.concatenate(first), np.concatenate(last), len(a))


def _union(first: np.ndarray, last: np.ndarray, n: int) -> list[tuple[int, int]]:
    """``merge_spans`` of the spans [first, last) of a text of ``n`` words, given as arrays."""
    steps = np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1)
    edges = np.flatnonzero(np.diff(np.cumsum(steps) > 0, prepend=False))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _shared(df: DataFrame, key: str, text: str, words: int, hashes: int) -> Staged:
    """Windows (id, lead, f, key, place, c) whose key several documents have; the lead is the smallest of them."""
    staged = Staged(_windows(df, key, text, words, hashes), by="f")
    met = None
    for f in range(hashes):  # one function at a time: disk holds one function's join
        w = staged.df.where(F.col("f") == f)
        shared = Staged(w.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").drop("last"))
        part = w.join(few(shared.df), "key").select("id", "lead", "f", "key", "place", "c")
        met = met.add(part) if met else Staged(part)
        shared.drop()
        tidy(df.sparkSession)
    staged.drop()
    return met


def _pairs(met: DataFrame, words: int, hits: int) -> DataFrame:
    """Pairs (id, lead): documents whose windows meet under ``hits`` hash functions; the lead has the smaller key."""
    grouped = met.where("id > lead").groupBy("id", "lead").agg(
        F.bit_or(F.expr("shiftleft(1, f)")).alias("functions"),
        F.collect_list(F.struct("place", "f")).alias("at"),
    )
    t = words - WIDTH + 1

    def run(batches):
        for b in slices(batches):
            at = b.column("at")
            edges = (at.offsets.to_numpy() - at.offsets[0].as_py()).tolist()
            places, functions = (x.to_numpy(zero_copy_only=False).tolist() for x in at.flatten().flatten())
            good = [overlapping(places[a:e], functions[a:e], t, hits) for a, e in zip(edges, edges[1:], strict=False)]
            yield b.select(["id", "lead"]).filter(pa.array(good, pa.bool_()))

    kind = met.schema["id"].dataType.simpleString()
    return cut(grouped.where(F.bit_count("functions") >= hits).select("id", "lead", "at").mapInArrow(run, f"id {kind}, lead {kind}"))


def covered(n: int, spans: list[tuple[int, int]], words: int) -> np.ndarray:
    """Which passages of ``words`` of ``n`` words, by their first word, lie inside one of ``spans``."""
    out = np.zeros(max(0, n - words + 1), bool)
    for a, e in spans:
        out[a : max(a, e - words + 1)] = True
    return out


class Windows:
    """A document's windows as arrays: function, key, place (left end and right end, 32 bits each) and centre."""

    def __init__(self, f: np.ndarray, key: np.ndarray, place: np.ndarray, c: np.ndarray, t: int):
        self.f, self.key = f, key
        self.first = np.maximum(place >> 32, c - t + 1)
        self.last = np.minimum(c, (place & 0xFFFFFFFF) - t + 1)


def windows_of(batch, t: int):
    """The windows of each row of an Arrow batch."""
    columns = [batch.column(n) for n in ("f", "key", "place", "c")]
    at = columns[0].offsets.to_numpy()
    flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    for a, e in zip((at - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=False):
        yield Windows(*(x[a:e] for x in flat), t)


def shared_passages(n: int, windows: Windows, words: int, hashes: int) -> np.ndarray:
    """Per hash function and passage of ``words`` of ``n`` words: whether the smallest shingle is one that another
    document's window has too. Windows give it: a passage belongs to the one window that it begins and ends in."""
    steps = np.zeros((hashes, max(0, n - words + 1) + 1), np.int32)
    if n >= words:
        np.add.at(steps, (windows.f, windows.first), 1)
        np.add.at(steps, (windows.f, windows.last + 1), -1)
    return np.cumsum(steps, 1)[:, :-1] > 0


def _open(windows: Windows, spans: list | None, n: int, words: int, hashes: int, hits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a text of ``n`` words, the passages, by their first word, that are shared under ``hits`` functions or more and
    that no span holds but for a few words; and the shingles that no span holds."""
    merged = merge_spans([(s["start"], s["end"]) for s in spans or []])
    core = covered(n, merged, words - 2 * WIDTH)
    ask = (shared_passages(n, windows, words, hashes).sum(0) >= hits) & ~core[WIDTH : WIDTH + n - words + 1]
    return ask, ~covered(n, merged, WIDTH)


#: Cells that a task gathers before it deals them out, and known ones of a row.
STRIP, KNOWN = 1 << 19, 1 << 14


def _coded(*columns: np.ndarray) -> bytes:
    """Numbers by their bytes, all first ones first, compressed: high bytes take next to nothing."""
    data = b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return pa.Codec("zstd", 1).compress(data, asbytes=True)


def _decoded(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw, out, at = np.frombuffer(pa.decompress(data, n * sum(sizes), codec="zstd", asbytes=True), np.uint8), [], 0
    for k, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).reshape(-1))
        at += n * size
    return out


def _several(u: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted hashes: which are the first of their value, and which are in two documents or more."""
    first = np.concatenate([[True], u[1:] != u[:-1]])
    at = np.flatnonzero(first)
    return first, (np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at))[np.cumsum(first) - 1]


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """Rows of strips, whose ids are of ``kind``."""
    kinds = {"strip": kind, "part": pa.int32(), "known": pa.bool_(), "ids": pa.list_(kind), "n": pa.int32(), "cells": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def strip(ids: pa.Array, docs: np.ndarray, places: np.ndarray, u: np.ndarray, parts: int) -> pa.RecordBatch:
    """Cells (a document's number in ``ids``, a shingle's place and hash) as rows that go to parts by ranges of the hash.

    Place 0 stands for a hash that several of these documents have: one such row tells other strips. Their own cells are
    known to be shared; they go anywhere, so that a hash that very many have is no more rows to its part than strips.
    One row has the ids, whatever the number of parts, and tells how many rows there are beside it. A strip holds its
    documents whole and goes by the first one's id.
    """
    order = np.argsort(u, kind="stable")
    u, docs, places = u[order], docs[order], places[order]
    first, known = _several(u, docs)
    name, out = ids[0].as_py(), []
    sent = np.flatnonzero(~known | first)
    edges = np.searchsorted(((u[sent] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
    for part, (a, e) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < e:
            at = sent[a:e]
            place = np.where(known[at], 0, places[at] + 1).astype(np.uint32)
            out.append((name, part, False, None, len(at), _coded(np.diff(u[at], prepend=np.uint64(0)), docs[at], place)))
    held = np.flatnonzero(known)
    held = held[np.argsort(docs[held], kind="stable")]
    for k, start in enumerate(range(0, len(held), KNOWN)):
        at = held[start : start + KNOWN]
        out.append((name, (int(u[0]) + k) % parts, True, None, len(at), _coded(docs[at], places[at] + np.uint32(1))))
    out.append((name, int(u[-1]) % parts, True, ids.to_pylist(), len(out), None))
    return _rows(out, ids.type)


def answered(batches):
    """Rows of strips in order of parts, with the cells alone whose hash another document has too: as many rows as come."""
    part, names, cells = None, [], []

    def answers() -> pa.RecordBatch:
        u, docs, places = map(np.concatenate, zip(*cells, strict=True))
        sizes = [len(c[0]) for c in cells]
        order = np.argsort(u, kind="stable")
        good = np.zeros(len(u), bool)  # a strip has a hash for one document here, or for several with place 0
        good[order] = _several(u[order], np.repeat(np.arange(len(cells), dtype=np.uint32), sizes)[order])[1]
        good &= places > 0
        out, edges = [], np.cumsum([0, *sizes])
        for name, a, e in zip(names, edges, edges[1:], strict=False):
            at = a + np.flatnonzero(good[a:e])
            at = at[np.lexsort((places[at], docs[at]))]
            out.append((name, part, True, None, len(at), _coded(docs[at], places[at])))
        return _rows(out, kind)

    for b in slices(batches, 16):
        kind, known = b.schema.field("strip").type, b.column("known")
        yield b.filter(known)
        asked = b.filter(pc.invert(known))
        for name, to, n, data in zip(*(asked.column(c).to_pylist() for c in ("strip", "part", "n", "cells")), strict=True):
            if to != part and cells:
                yield answers()
                names, cells = [], []
            part = to
            names.append(name)
            u, *more = _decoded(data, n, np.uint64, np.uint32, np.uint32)
            cells.append((np.cumsum(u, dtype=np.uint64), *more))
    if cells:
        yield answers()


def shared_cells(batches):
    """Rows (id, marks): the places of cells whose hash another document has too, of rows of strips, ``answered`` or in
    order of parts. A document is one row: a strip gives its documents when the last of its rows has come."""
    ids, left, cells = {}, Counter(), defaultdict(list)

    def rows(own: list, docs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(docs, kind="stable")
        which, at = np.unique(docs[order], return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)).astype(np.int32)), pa.array((places[order] - 1).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(own, kind).take(pa.array(which)), lists], ["id", "marks"])

    for b in slices(answered(batches), 16):
        kind = b.schema.field("strip").type
        for name, own, n, data in zip(*(b.column(c).to_pylist() for c in ("strip", "ids", "n", "cells")), strict=True):
            if own is not None:
                ids[name] = own
                left[name] += n
            else:
                left[name] -= 1
                cells[name].append(_decoded(data, n, np.uint32, np.uint32))
            if name in ids and not left[name]:
                del left[name]
                yield rows(ids.pop(name), *map(np.concatenate, zip(*cells.pop(name), strict=True)))
    if left:
        raise ValueError(f"rows of {len(left)} strips are missing")


def _rest(own: DataFrame, found: DataFrame, words: int, least: float, hashes: int, hits: int) -> DataFrame:
    """Spans (id, lead, spans) of passages of documents of which neither is the first of its windows' keys.

    Passages that no span of ``found`` holds and whose smallest shingles are shared under ``hits`` functions or more
    come into question, if enough of their shingles are in such a passage of another document or in a span. Those with
    all of them are grouped by their own hashes: equal passages, whatever else their documents share. For near ones
    they are grouped by two such shingles of overlapping windows, and held against the first of the group, which is
    the first document where no span holds the passage.
    """
    kind = own.schema["id"].dataType.simpleString()
    t = words - WIDTH + 1
    need = 2 * least / (1 + least) * t - 1e-6

    def texts(b):
        return zip(windows_of(b, t), b.column("spans").to_pylist(), b.column("text").to_pylist(), strict=True)

    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cells(batches):
        ids, docs, places, keys, n = [], [], [], [], 0
        for b in slices(batches, 64):
            for i, (windows, spans, body) in zip(b.column("id").to_pylist(), texts(b), strict=True):
                w = unpacked(body).split()
                if len(w) < words:
                    continue
                ask, free = _open(windows, spans, len(w), words, hashes, hits)
                if not ask.any():
                    continue
                steps = np.zeros(len(free) + 1, np.int32)
                steps[: len(ask)] += ask
                steps[t : t + len(ask)] -= ask
                some = np.flatnonzero((np.cumsum(steps)[:-1] > 0) & free)
                if len(some):
                    docs.append(np.full(len(some), len(ids), np.uint32))
                    ids.append(i)
                    places.append(some.astype(np.uint32))
                    keys.append(shingles(word_hashes(w), WIDTH)[some])
                    n += len(some)
            if n >= STRIP:
                yield strip(pa.array(ids, b.schema.field("id").type), *map(np.concatenate, (docs, places, keys)), parts)
                ids, docs, places, keys, n = [], [], [], [], 0
        if n:
            yield strip(pa.array(ids, b.schema.field("id").type), *map(np.concatenate, (docs, places, keys)), parts)

    own = own.join(few(found), "id", "left")
    strips = f"strip {kind}, part int, known boolean, ids array<{kind}>, n int, cells binary"
    dealt = own.mapInArrow(cells, strips).repartition(parts, "part").sortWithinPartitions("part")
    back = dealt.mapInArrow(answered, strips).repartition(parts, "strip").sortWithinPartitions("strip")
    marks = cut(back.mapInArrow(shared_cells, f"id {kind}, marks array<int>").where(F.size("marks") > WIDTH))
    tidy(own.sparkSession)

    def excerpts(batches):
        """Passages to be grouped: by themselves (text null), and with the words that two windows have in common."""
        for b in slices(batches, 64):
            out = {"node": [], "bucket": [], "begin": [], "text": []}
            for i, marks, (windows, spans, body) in zip(b.column("id").to_pylist(), b.column("marks").to_pylist(), texts(b), strict=True):
                w = unpacked(body).split()
                ask, free = _open(windows, spans, len(w), words, hashes, hits)
                held = ~free
                held[marks] = True
                dense = _window_sums(held, t)
                same = np.flatnonzero(ask & (dense == t))
                own = shingles(shingles(word_hashes(w), WIDTH), t)[same].view(np.int64).tolist()
                found = [(h, p, None) for h, p in zip(own, same.tolist(), strict=True)]
                found += [(g, a, b" ".join(w[a:e]).decode()) for g, a, e in _meetings(windows, ask & (dense >= need), words)]
                for values in found:
                    for name, v in zip(out, (i, *values), strict=True):
                        out[name].append(v)
            kinds = (b.schema.field("id").type, pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    rows = cut(own.join(few(marks), "id").mapInArrow(excerpts, f"node {kind}, bucket long, begin int, text string"))
    by_itself = rows.where("text is null")
    firsts = by_itself.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").drop("last")
    span = F.struct(F.col("begin").alias("start"), (F.col("begin") + words).alias("end"))
    exact = by_itself.join(few(cut(firsts)), "bucket").where("node > lead").groupBy(F.col("node").alias("id"), "lead").agg(F.collect_list(span).alias("spans"))
    rows = rows.where("text is not null")
    first = F.min(F.struct("node", "text"))
    groups = rows.groupBy("bucket").agg(first.alias("first"), F.max("node").alias("last")).where("first.node < last")
    groups = groups.select("bucket", F.col("first.node").alias("lead"), F.col("first.text").alias("held"))
    near = rows.join(few(cut(groups)), "bucket").where("node > lead")
    near = near.groupBy(F.col("node").alias("id"), "lead", "begin", "text", "held").agg(F.count("*")).select("id", "lead", "begin", "text", "held")

    def compare(batches):
        held = lru_cache(4096)(lambda y: Held(y.encode().split(), t))

        @lru_cache(4096)
        def spans_in(x: str, y: str):
            w = x.encode().split()
            return [(0, len(w))] if x == y else repeated_spans(w, held(y), words, least)

        for b in slices(batches):
            out = []
            for begin, x, y in zip(*(b.column(n).to_pylist() for n in ("begin", "text", "held")), strict=True):
                out.append([{"start": a + begin, "end": e + begin} for a, e in spans_in(x, y)])
            lists = pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            batch = pa.RecordBatch.from_arrays([b.column("id"), b.column("lead"), lists], ["id", "lead", "spans"])
            yield batch.filter(pa.array([bool(x) for x in out], pa.bool_()))

    return exact.unionByName(near.mapInArrow(compare, f"id {kind}, lead {kind}, spans array<struct<start:int,end:int>>"))


def _meetings(windows: Windows, ask: np.ndarray, words: int) -> list[tuple[int, int, int]]:
    """(group, first word, last word) for each two windows of different functions that share a passage of ``ask``."""
    out, live = [], []
    some = np.concatenate([[0], np.cumsum(ask)])
    good = np.flatnonzero(some[windows.last + 1] > some[windows.first])
    good = good[np.argsort(windows.first[good], kind="stable")]
    columns = (windows.first, windows.last, windows.f, windows.key)
    for first, last, f, key in zip(*(x[good].tolist() for x in columns), strict=True):
        live = [x for x in live if x[0] >= first]
        for e, g, other in live:
            high = min(last, e)
            if g != f and some[high + 1] > some[first]:
                two = sorted(((f, key), (g, other)))
                bucket = xxhash.xxh3_64_intdigest(repr(two).encode()) - (1 << 63)
                out.append((bucket, first, high + words))
        live.append((last, f, key))
    return out


def _passages(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: float = 0.8,
    hashes: int = HASHES, hits: int = HITS,
) -> DataFrame:
    """``repeated_passages`` of rows with a key of their own. Texts go through shuffles and files compressed (``packed``)."""
    kind = df.schema[key].dataType.simpleString()
    shared = _shared(df, key, text, words, hashes)
    met = shared.df
    pairs = _pairs(met, words, hits)
    tidy(df.sparkSession)
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    windows = met.groupBy("id").agg(F.collect_list(F.struct("f", "key", "place", "c")).alias("windows"))

    def pack(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(map(packed, b.column("text").to_pylist())), pa.binary())], ["id", "text"])

    whole = docs.join(few(met.select("id").distinct()), "id", "left_semi").mapInArrow(pack, f"id {kind}, text binary")
    windows = windows.select("id", *(F.col(f"windows.{n}").alias(n) for n in ("f", "key", "place", "c")))
    staged = Staged(whole.join(windows, "id"), bucket="id")  # what joins it later comes to its buckets, no text moves for that
    shared.drop()
    texts = staged.df.select("id", "text")
    tidy(df.sparkSession)

    def run(batches):
        last, own = None, None
        for b in slices(batches):
            out = []
            for n, x, y in zip(b.column("lead").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                w = unpacked(x).split()
                if x == y:
                    out.append([(0, len(w))])
                    continue
                if n != last:
                    last, own = n, Held(unpacked(y).split(), words - WIDTH + 1)
                out.append(repeated_spans(w, own, words, least))
            rows = [{"start": a, "end": e} for spans in out for a, e in spans]
            offsets = np.zeros(len(out) + 1, np.int32)
            np.cumsum([len(s) for s in out], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows, pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            batch = pa.RecordBatch.from_arrays([b.column("id"), b.column("lead"), lists], ["id", "lead", "spans"])
            yield batch.filter(pa.array([bool(s) for s in out], pa.bool_()))

    later, earlier = (texts.join(few(pairs.select(F.col(n).alias("id")).distinct()), "id", "left_semi") for n in ("id", "lead"))
    both = pairs.join(later.withColumnRenamed("text", "x"), "id").join(earlier.select(F.col("id").alias("lead"), F.col("text").alias("y")), "lead")
    found = both.select("id", "lead", "x", "y").mapInArrow(run, f"id {kind}, lead {kind}, spans array<struct<start:int,end:int>>")
    first = cut(found)
    spans_of = lambda rows: rows.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = cut(spans_of(first))
    del found
    tidy(df.sparkSession)  # the texts of pairs are not needed beside the cells of passages
    found = first.unionByName(cut(_rest(staged.df, spans, words, least, hashes, hits)))
    found = found.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.sort_array(F.collect_set("lead")).alias("sources"))

    def merge(batches):
        for b in slices(batches):
            merged = [merge_spans([(s["start"], s["end"]) for s in spans or []]) for spans in b.column("spans").to_pylist()]
            lists = pa.array([[{"start": a, "end": e} for a, e in m] for m in merged], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            total = pa.array([sum(e - a for a, e in m) for m in merged], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), lists, total, b.column("sources")], ["id", "spans", "n_repeated", "sources"])

    found = found.mapInArrow(merge, f"id {kind}, spans array<struct<start:int,end:int>>, n_repeated long, sources array<{kind}>")

    def count(batches):
        for b in slices(batches):
            n = [len((body or "").encode().split()) for body in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64())], ["id", "n_words"])

    counts = docs.mapInArrow(count, f"id {kind}, n_words long")
    found = cut(found)
    staged.drop()
    out = counts.join(found, "id", "left")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(
        "id", "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"),
        F.coalesce("sources", F.array().cast(f"array<{kind}>")).alias("sources"),
    )


def repeated_passages(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: float = 0.8,
    hashes: int = HASHES, hits: int = HITS,
) -> DataFrame:
    """Per row of ``df``: id, n_words, spans, n_repeated, sources.

    ``spans`` are the word ranges [start, end) that an earlier document holds too, exactly or nearly
    (``repeated_spans``); n_repeated is their length, ``sources`` the keys of such documents. The first holder of a
    passage keeps it. Passages that only one document repeats in itself stay. Null, empty and short texts and rows with
    a null key have no spans. Documents are in order of their keys; different texts of one key are documents of their
    own, in order of text, and equal rows are one document, whose result each of them has.
    """
    args = (words, least, hashes, hits)
    known = df.where(F.col(key).isNotNull())
    if known.groupBy(key).count().where("count > 1").isEmpty():
        return _passages(df, key, text, *args)
    kind = df.schema[key].dataType.simpleString()
    rows = Staged(df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"))).df
    one, _ = numbered(rows.where("id is not null").groupBy("id", "digest").agg(F.min("text").alias("text")), "id", "text", "digest", name="document")
    one = Staged(one).df
    found = cut(_passages(one, "document", "text", *args).withColumnRenamed("id", "document"))
    at = one.select("document", "id", "digest")
    held = found.select("document", F.explode("sources").alias("of")).join(at.select(F.col("document").alias("of"), F.col("id").alias("source")), "of")
    held = held.groupBy("document").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    found = at.join(found.drop("sources"), "document").join(held, "document", "left").drop("document")
    found = rows.drop("text").join(found, ["id", "digest"], "left").drop("digest")
    counted = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    loose = rows.where("id is null").select("id", counted.alias("n_words"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    out = found.where("id is not null").select("id", "n_words", "spans", "n_repeated", F.coalesce("sources", F.array().cast(f"array<{kind}>")).alias("sources"))
    return out.unionByName(loose.select("id", "n_words", empty.alias("spans"), F.lit(0).cast("long").alias("n_repeated"), F.array().cast(f"array<{kind}>").alias("sources")))


def without_spans(df: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the words of each row's spans (``repeated_passages``) cut from its text, with the white space before
    them; columns and other rows stay as they are."""
    import re

    word = re.compile(rb"[^\x20\x09-\x0D]+").finditer
    names = df.columns
    found = spans.where("n_repeated > 0").select(F.col("id").alias(key), F.col("spans").alias("__spans")).dropDuplicates([key])

    def run(batches):
        for b in slices(batches):
            out = []
            for t, cuts in zip(b.column(text).to_pylist(), b.column("__spans").to_pylist(), strict=True):
                if t and cuts:
                    data = t.encode()
                    at = [m.span() for m in word(data)]
                    parts, done = [], 0
                    for s in cuts:
                        first = at[s["start"] - 1][1] if s["start"] else 0
                        parts.append(data[done:first])
                        done = at[min(s["end"], len(at)) - 1][1]
                    t = b"".join([*parts, data[done:]]).decode()
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text else b.column(n) for n in names], names)

    return df.join(found, key, "left").select(*names, "__spans").mapInArrow(run, df.schema)
