"""Benchmark decontamination: q-gram lemma filter and banded alignment.

Each benchmark item is cut into overlapping segments of ``segment`` characters, one every
half segment and one at the end.  A place in a document that holds a segment of n characters
with at most e edits shares at least ``n - q + 1 - q * e`` of its q-grams (the q-gram lemma),
and all of them lie within e diagonals; a segment may have as many edits as leave the lemma a
bound.  Shared q-grams are counted in overlapping bands of diagonals; bands that meet the
bound become candidate regions, and a banded alignment decides whether the segment is there.
A document is contaminated by an item if its found segments cover at least ``coverage`` of
the item's characters: a sentence that an item merely shares with other texts is no leak,
while a replaced word costs only the segments that hold it.

Texts are compared lower-cased character by character, white space as a blank, so places
are code points of the original text.

The benchmark is a stated query set: its index goes to the executors in blocks of at most
``block_chars`` characters (a checked size), so a large benchmark means more passes, never
a larger broadcast.  The documents are not shuffled.  Shared q-grams are counted in parts
of at most ``PAIRS`` places, so texts of repeated q-grams take time but not memory.

Defined results: null and empty texts and items match nothing; an item shorter than q
characters must occur exactly and not inside a word; equal items each report; repeated rows
each report; empty tables give no rows; other columns are ignored, and in
:func:`without_leaks` pass through, whatever their names.  There every row is judged by its own
text, also if another row has its ``doc_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

Q = 10
SEGMENT = 32
COVERAGE = 0.5
BLOCK_CHARS = 4_000_000
#: Shared q-grams and candidates that are held at a time.
PAIRS = 1_000_000
CANDIDATES = 20_000
MULT = np.uint64(0x9E3779B97F4A7C15)

_lower = np.arange(0x110000, dtype=np.uint32)
for _c in range(0x2FFF):
    if len(chr(_c).lower()) == 1:
        _lower[_c] = ord(chr(_c).lower())
    if chr(_c).isspace():
        _lower[_c] = 32


def codes(text: str | None) -> np.ndarray:
    """Normalised code points, one for each code point of the text."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    return _lower[raw]


def qgram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams, put together from those of powers of two."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    h, size, factor = x.astype(np.uint64), 1, MULT  # hashes of ``size`` characters, and what moves them on by as many
    out, done = None, 0
    while size <= q:
        if q & size:
            n = len(x) - done - size + 1
            out, done = (h if out is None else out[:n] * factor + h[done : done + n]), done + size
        if 2 * size <= q:
            h = h[: len(h) - size] * factor + h[size:]
        factor, size = np.uint64(int(factor) ** 2 % (1 << 64)), 2 * size
    return out[: len(x) - q + 1]


def cuts(n: int, segment: int = SEGMENT) -> list[tuple[int, int]]:
    """Begins and ends of the segments of an item of ``n`` characters."""
    if n <= segment:
        return [(0, n)] if n else []
    begins = [*range(0, n - segment, segment // 2), n - segment]
    return [(b, b + segment) for b in begins]


@dataclass
class Index:
    """Segments of a block of items, and the q-grams of all their characters."""

    items: np.ndarray  # item row of each segment
    begins: np.ndarray  # place of each segment in ``text``
    sizes: np.ndarray
    item_ids: list
    item_begins: np.ndarray
    item_sizes: np.ndarray
    text: np.ndarray
    grams: np.ndarray  # sorted hashes
    places: np.ndarray  # their places in ``text``
    owner: np.ndarray  # segment of each place
    bits: np.ndarray  # membership filter
    short: dict  # by length: sorted hashes of items shorter than q, and their rows
    q: int

    @cached_property
    def allowed(self) -> np.ndarray:
        """Edits of each segment: as many as leave the lemma a bound."""
        return np.maximum((self.sizes - self.q) // self.q, 0)

    @cached_property
    def edits(self) -> int:
        return int(self.allowed.max()) if len(self.sizes) else 0

    @cached_property
    def need(self) -> np.ndarray:
        """Shared q-grams that a segment with ``allowed`` edits must have."""
        return self.sizes - self.q + 1 - self.q * self.allowed

    @cached_property
    def least(self) -> int:
        return int(self.need.min())

    @cached_property
    def longest(self) -> int:
        return int(self.sizes.max()) if len(self.sizes) else 0


def build_index(items: list[tuple], q: int = Q, segment: int = SEGMENT) -> Index:
    ids, begins, sizes, owners, texts, item_begins, item_sizes, at = [], [], [], [], [], [], [], 0
    short: dict[int, list[tuple[int, int]]] = {}
    for row, (item_id, text) in enumerate(items):
        x = codes(text)
        ids.append(item_id)
        item_begins.append(at)
        item_sizes.append(len(x))
        if 0 < len(x) < q:
            short.setdefault(len(x), []).append((int(qgram_hashes(x, len(x))[0]), row))
        for a, b in cuts(len(x), segment) if len(x) >= q else ():
            owners.append(row)
            begins.append(at + a)
            sizes.append(b - a)
        texts.append(x)
        at += len(x)
    text = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    sizes_, begins_ = np.array(sizes, np.int64), np.array(begins, np.int64)
    each = np.maximum(sizes_ - q + 1, 0)
    o = np.repeat(np.arange(len(sizes_)), each)
    p = np.arange(len(o)) - np.repeat(np.cumsum(each) - each, each) + begins_[o]
    g = qgram_hashes(text, q)[p] if len(p) else np.zeros(0, np.uint64)
    order = np.argsort(g, kind="stable")
    bits = np.zeros(1 << 20 if len(g) < 1 << 17 else 1 << 24, bool)
    bits[g >> np.uint64(64 - int(np.log2(len(bits))))] = True
    few = {n: tuple(np.array(v) for v in zip(*sorted(pairs))) for n, pairs in short.items()}
    few = {n: (h.astype(np.uint64), r) for n, (h, r) in few.items()}
    return Index(np.array(owners, np.int64), begins_, sizes_, ids, np.array(item_begins, np.int64), np.array(item_sizes, np.int64), text, g[order], p[order], o[order], bits, few, q)


def shared(x: np.ndarray, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(place in x, place in the index text, segment)`` of all shared q-grams, in parts of about ``PAIRS``."""
    h = qgram_hashes(x, index.q)
    shift = np.uint64(64 - int(np.log2(len(index.bits))))
    at = np.flatnonzero(index.bits[h >> shift])
    if not len(at) or not len(index.grams):
        return
    lo = np.searchsorted(index.grams, h[at])
    real = index.grams[np.minimum(lo, len(index.grams) - 1)] == h[at]
    at, lo = at[real], lo[real]
    # a q-gram needs enough others near it, whatever the diagonal
    if len(at) < index.least:
        return
    if index.least > 1:
        reach = index.longest + 2 * index.edits
        busy = np.searchsorted(at, at + reach) - np.searchsorted(at, at - reach) >= index.least
        at, lo = at[busy], lo[busy]
    if not len(at):
        return
    n = np.searchsorted(index.grams, h[at], side="right") - lo
    through = np.cumsum(n)
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(through, (through[begin - 1] if begin else 0) + PAIRS, side="right")))
        m = n[begin:end]
        k = np.repeat(lo[begin:end], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(at[begin:end], m), index.places[k], index.owner[k]
        begin = end


def candidates(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """``(segment, lowest diagonal)`` of the bands whose shared q-grams meet the bound.

    Diagonals are dealt into bands of ``2 * width`` that overlap by ``width``, so the
    ``edits + 1`` diagonals of a match lie whole in one band.
    """
    width = index.edits + 1
    shift, most = index.edits + index.longest, (len(x) + 4 * width) // width + 200
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for place, own, seg in shared(x, index):
        band = (place - (own - index.begins[seg]) + shift) // width
        key, count = np.unique(np.concatenate([seg * most + band, seg * most + band - 1]), return_counts=True)
        keys.append(key)
        counts.append(count)
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, key
    if len(keys) > 2:
        key, back = np.unique(key, return_inverse=True)
        count = np.bincount(back, count, len(key))
    seg, band = key // most, key % most
    good = count >= index.need[seg]
    return seg[good], band[good] * width - shift


def aligned(x: np.ndarray, index: Index, seg: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits and place ``[start, end)`` of each candidate in ``x``, by banded alignment.

    All candidates go through one table at once: row r is segment character r, column c is
    diagonal ``low - edits + c``.  The start travels with the cost.
    """
    m = len(seg)
    if m > CANDIDATES:
        some = [aligned(x, index, seg[k : k + CANDIDATES], low[k : k + CANDIDATES]) for k in range(0, m, CANDIDATES)]
        return tuple(np.concatenate(c) for c in zip(*some))
    width = 2 * (index.edits + 1) + 2 * index.edits
    base = low - index.edits
    big = np.int64(1 << 30)
    size = index.sizes[seg]
    pad = width + int(size.max()) + 2 if m else 0
    padded = np.concatenate([np.full(pad, 0xFFFFFFFF, np.uint32), x, np.full(pad, 0xFFFFFFFF, np.uint32)])
    cols = np.arange(width)
    start = base[:, None] + cols
    cost = np.where((start >= 0) & (start <= len(x)), 0, big)
    best, best_a, best_b = np.full(m, big), np.zeros(m, np.int64), np.zeros(m, np.int64)
    # what lies beyond the text is padding that no character equals, and costs too much to be entered
    diagonal = start + pad
    ended = np.unique(size).tolist()
    for r in range(ended[-1] if m else 0):
        ch = index.text[np.minimum(index.begins[seg] + r, len(index.text) - 1)]
        at = base[:, None] + cols + r  # place of the document character of a diagonal step
        new = cost + (padded[np.clip(diagonal + r, 0, len(padded) - 1)] != ch[:, None])
        beyond = at >= len(x)
        new[beyond | (at < 0)] = big
        # a segment character without a partner: from the diagonal to the right
        less = cost[:, 1:] + 1 < new[:, :-1]
        np.copyto(new[:, :-1], cost[:, 1:] + 1, where=less)
        np.copyto(start[:, :-1], start[:, 1:].copy(), where=less)
        # a document character without a partner: from the left, of equal ways the nearest
        way = np.minimum.accumulate((new - cols) * width + (width - 1 - cols), axis=1)
        cost = np.where(beyond, new, np.minimum(way // width + cols, big))
        start = np.take_along_axis(start, width - 1 - way % width, 1)
        if r + 1 in ended:
            done = np.flatnonzero(size == r + 1)
            c = cost[done].argmin(1)
            best[done] = cost[done, c]
            best_a[done], best_b[done] = start[done, c], base[done] + c + r + 1
    return best, best_a, best_b


def short_matches(x: np.ndarray, index: Index) -> Iterator[tuple]:
    """Items shorter than q characters that occur exactly and not inside a word."""
    for n, (hashes, rows) in index.short.items():
        h = qgram_hashes(x, n)
        at = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h)
        seen = set()
        for k in at.tolist():
            if (k and chr(x[k - 1]).isalnum()) or (k + n < len(x) and chr(x[k + n]).isalnum()):
                continue
            lo, hi = np.searchsorted(hashes, h[k]), np.searchsorted(hashes, h[k], side="right")
            for row in rows[lo:hi].tolist():
                begin = index.item_begins[row]
                if row not in seen and (index.text[begin : begin + n] == x[k : k + n]).all():
                    seen.add(row)
                    yield index.item_ids[row], k, k + n, n, 0


def matches(text: str | None, index: Index, coverage: float = COVERAGE) -> list[tuple]:
    """``(item_id, start, end, covered, edits)`` of each item that contaminates the text."""
    x = codes(text)
    out = list(short_matches(x, index)) if index.short else []
    seg, low = candidates(x, index)
    if not len(seg):
        return out
    # cheap: an item whose candidate segments cannot reach the coverage is out
    once = np.unique(seg)
    may = np.bincount(index.items[once], index.sizes[once], len(index.item_ids)) >= coverage * index.item_sizes
    use = may[index.items[seg]]
    seg, low = seg[use], low[use]
    if not len(seg):
        return out
    edits, a, b = aligned(x, index, seg, low)
    ok = edits <= index.allowed[seg]
    seg, edits, a, b = seg[ok], edits[ok], a[ok], b[ok]
    order = np.lexsort((a, edits, seg))
    seg, edits, a, b = seg[order], edits[order], a[order], b[order]
    _, one = np.unique(seg, return_index=True)
    seg, edits, a, b = seg[one], edits[one], a[one], b[one]
    for row in np.unique(index.items[seg]).tolist():
        mine = np.flatnonzero(index.items[seg] == row)
        begins, ends = index.begins[seg[mine]], index.begins[seg[mine]] + index.sizes[seg[mine]]
        covered = int((ends - np.maximum(begins, np.concatenate(([0], ends[:-1])))).sum())  # segments go by place
        if covered >= coverage * index.item_sizes[row]:
            out.append((index.item_ids[row], int(a[mine].min()), int(b[mine].max()), covered, int(edits[mine].sum())))
    return out


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """Rows of the query set in lists of at most ``block_chars`` characters (a longer item alone)."""
    part, size = [], 0
    rows = benchmark.select("item_id", "text").where(F.length("text") > 0).orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        if part and size + len(r.text) > block_chars:
            yield part
            part, size = [], 0
        part.append((r.item_id, r.text))
        size += len(r.text)
    if part:
        yield part


def _indexes(docs: DataFrame, benchmark: DataFrame, q: int, segment: int) -> Iterator:
    """The benchmark's index, block by block, as broadcasts."""
    for part in blocks(benchmark):
        yield docs.sparkSession.sparkContext.broadcast(build_index(part, q, segment))


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, segment: int = SEGMENT, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, start, end, covered, edits``: a row for each document and item found in it."""
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start long, end long, covered long, edits long"
    found = docs.sparkSession.createDataFrame([], schema)
    for shared_index in _indexes(docs, benchmark, q, segment):

        def run(batches: Iterator[pa.RecordBatch], shared_index=shared_index) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in matches(t, shared_index.value, coverage)]
                cols = list(zip(*rows)) if rows else [[]] * 6
                item = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()
                types = [batch.schema.field(0).type, item, *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "item_id", "start", "end", "covered", "edits"])

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, segment: int = SEGMENT, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns."""
    at, schema = docs.columns.index("text"), docs.schema
    for shared_index in _indexes(docs, benchmark, q, segment):

        def run(batches: Iterator[pa.RecordBatch], shared_index=shared_index) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                yield batch.filter(pa.array([not matches(t, shared_index.value, coverage) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
