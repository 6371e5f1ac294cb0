"""Best-fit packing of tokenised documents into sequences of at most ``capacity`` tokens.

Best-fit decreasing looks only at lengths.  There are at most ``capacity`` distinct
lengths, so the exact plan for the whole corpus is made from the histogram of piece
lengths: longest first, each group of equal pieces goes to the tightest open bins that
hold it, found in a segment tree over remaining capacities.  Bins of one remaining
capacity are kept as ranges of bin numbers; a step places a whole range at once, so the
plan has a size that ``capacity`` bounds, not the corpus.  The pieces themselves never
leave the executors: each gets its rank among the pieces of its length (salted, so a
length that a third of all pieces share is spread) and looks its place up in the plan.

Defined results: null text counts as empty; an empty document is one piece (its end id);
a document above ``capacity`` is cut into full pieces and a rest; repeated rows are packed
each on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parts
from .tokens import default_tokenizer, encoder

CAPACITY = 4096
#: Pieces of one salt of a length; more salts are used as the table grows.
PIECES_PER_SALT = 50_000
MIN_SALTS = 64


class TightestBin:
    """Segment tree over remaining capacities: how many open bins have each."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, count: int) -> None:
        i = remaining + self.size
        while i:
            self.tree[i] += count
            i //= 2

    def find(self, need: int) -> int:
        """The least remaining capacity of at least ``need`` with an open bin, or -1."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Best-fit decreasing over a histogram of lengths.

    One row per step: pieces ``rank .. rank + n - 1`` of ``length`` go to bins
    ``bin .. bin + n - 1`` at ``offset``.  The bins are those that placing the pieces one
    by one would give: equal pieces fill the tightest class of bins before the next.
    """
    tree, ranges, steps, opened = TightestBin(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.find(length)
            if room < 0:
                room, first, n = capacity, opened, left
            else:
                first, n = ranges[room].pop()
                tree.add(room, -n)
            # no other open bin is as tight as one just begun, so each takes all it holds
            per = room // length
            full = min(n, left // per)
            for k in range(per if full else 0):
                steps.append((length, rank, full, first, capacity - room + k * length))
                rank += full
            left -= full * per
            _open(tree, ranges, room - per * length, first, full)
            used = full
            if left and full < n:
                for k in range(left):  # fewer than ``per``: the last bin of this length
                    steps.append((length, rank, 1, first + full, capacity - room + k * length))
                    rank += 1
                _open(tree, ranges, room - left * length, first + full, 1)
                used, left = full + 1, 0
            if first == opened and room == capacity:
                opened += used
            else:
                _open(tree, ranges, room, first + used, n - used)
    return pd.DataFrame(steps, columns=["length", "rank", "n", "bin", "offset"], dtype="int64")


def _open(tree: TightestBin, ranges: dict, room: int, first: int, n: int) -> None:
    if room and n:
        tree.add(room, n)
        ranges.setdefault(room, []).append((first, n))


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` as bytes) of every document."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        wide, cut = enc.dtype.itemsize, capacity * enc.dtype.itemsize
        for batch in parts(batches, 2000):
            rows: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                for k in range(0, len(raw), cut):
                    part = raw[k : k + cut]
                    ids = np.frombuffer(part, enc.dtype).astype("<u4").tobytes()
                    rows.append((doc, k // cut, k // wide, len(part) // wide, zlib.crc32(ids), ids if with_ids else None))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            k = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], kinds)], names[:k])
        enc.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, pieces_per_salt: int = PIECES_PER_SALT) -> DataFrame:
    """Adds ``sequence_id, offset`` to ``pieces`` (columns ``doc_id, piece, length`` at least)."""
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    by_length = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    total = sum(r["n"] for r in by_length)
    salts = max(MIN_SALTS, total // pieces_per_salt)
    salt: Column = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    pieces = pieces.withColumn("_salt", salt)

    per_salt = pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = per_salt.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_rank", F.row_number().over(own) - 1).join(base, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_base", "_salt")

    plan = plan_bins({r["length"]: r["n"] for r in by_length}, capacity).sort_values(["length", "rank"])
    steps = spark.sparkContext.broadcast(plan.to_numpy(np.int64).T.copy())  # its size is bounded by ``capacity``
    out = ranked.schema.names

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, first, offset = steps.value
        edges = np.searchsorted(length, np.arange(capacity + 2))
        width = int(rank.max()) + 1 if len(rank) else 1
        key = length * width + rank
        assert capacity * width < 1 << 62 and len(edges)
        for batch in batches:
            n = batch.column(out.index("length")).to_numpy(zero_copy_only=False)
            r = batch.column(out.index("_rank")).to_numpy(zero_copy_only=False)
            # a rank above the last step's start still belongs to that step of its length
            at = np.searchsorted(key, n * width + np.minimum(r, width - 1), side="right") - 1
            added = [pa.array(first[at] + r - rank[at]), pa.array(offset[at])]
            keep = [batch.column(c) for c in range(len(out)) if out[c] != "_rank"]
            yield pa.RecordBatch.from_arrays(keep + added, [c for c in out if c != "_rank"] + ["sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Tokenise and pack: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pack(tokenised_pieces(docs, capacity, tokenizer), capacity).select(*cols)


def sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, n_tokens, ids`` (each at most ``capacity`` ids)."""
    packed = pack(tokenised_pieces(docs, capacity, tokenizer, with_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), ""))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
