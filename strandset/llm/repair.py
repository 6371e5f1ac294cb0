"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are range-partitioned by ``doc_id``; each partition writes shards of about
``shard_tokens`` ids, each with a grammar of its own.  In a shard, Re-Pair replaces
frequent id pairs by new symbols (nonterminals) until no pair is frequent.  A shard
stores its rules, the expansion length of each rule, the compressed sequence, and for
each document where it begins; the stored lengths tell which symbols hold a wanted place,
and only these are expanded.

The file format is Parquet with one row a shard (binary columns), so Spark's committer
makes a rewritten shard replace a lost one.  Nothing but one shard is held by a task.

Defined results: null text counts as empty; every document ends with id 1; rows with the
same ``doc_id`` are kept in the order of their text; an empty table gives no shard; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, parts
from .tokens import default_tokenizer, encoder

SHARD_TOKENS = 1 << 20
#: A pair is frequent, and becomes a rule, if a shard holds it so often (its rule costs three numbers).
MIN_PAIR = 16
SLOT_BITS = 20
SHARD_SCHEMA = "part int, shard int, doc_ids array<{kind}>, doc_tokens binary, doc_symbols binary, first_new int, rules binary, lengths binary, sequence binary"


def _numbered(key: np.ndarray, slot: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The place of each key in the sorted ``pair``, or -1: by a table of slots, by search where slots are shared."""
    own = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
    table = np.zeros(1 << SLOT_BITS, np.int32)
    table[own] = np.arange(len(pair))
    group = table[slot]
    group[pair[group] != key] = -1
    twice = np.zeros(1 << SLOT_BITS, bool)
    twice[own[table[own] != np.arange(len(pair))]] = True
    again = np.flatnonzero((group < 0) & twice[slot])
    at = np.minimum(np.searchsorted(pair, key[again]), len(pair) - 1)
    group[again] = np.where(pair[at] == key[again], at, -1)
    return group


def _odd_in_run(key: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Every other place, from the second, of neighbouring places with one key (they overlap)."""
    same = np.zeros(len(key), bool)
    same[1:] = follows[1:] & (key[1:] == key[:-1])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
    return (np.arange(len(key)) - start) % 2 == 1


def compress(ids: np.ndarray, first_new: int, min_pair: int = MIN_PAIR, fence: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: ``(sequence, rules, lengths, starts)``; rule k is a pair of symbols named ``first_new + k``.

    ``fence`` marks places whose symbol must not become the right half of a pair (the
    first id of each document), so a document is a whole run of symbols.  A round replaces
    every place of a frequent pair that is more frequent than the pairs it overlaps, so
    the most frequent pair always goes; rounds end when no pair is frequent.  Symbols
    are linked by place, and only places whose pair may be frequent are looked at again.
    """
    n = len(ids)
    seq = ids.astype(np.uint32)
    fence = np.zeros(n, bool) if fence is None else fence
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    gone = np.zeros(n, bool)
    live = np.flatnonzero(~fence[1:]).astype(np.int32) if n else np.zeros(0, np.int32)
    rules, sizes, made = [np.zeros((0, 2), np.uint32)], np.ones(0, np.int64), 0
    while len(live):
        right = after[live]
        key = (seq[live].astype(np.uint64) << np.uint64(32)) | seq[right]
        # what shares a hash with too few others cannot be frequent; the rest is counted exactly
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        may = np.flatnonzero(np.bincount(slot, minlength=1 << SLOT_BITS)[slot] >= min_pair)
        live, right, key, slot = live[may], right[may], key[may], slot[may]
        ordered = np.sort(key)
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
        pair = ordered[edge][np.diff(np.append(edge, len(ordered))) >= min_pair]
        if not len(pair):
            break
        group = _numbered(key, slot, pair)
        may = np.flatnonzero(group >= 0)
        live, right, group = live[may], right[may], group[may]
        follows = np.zeros(len(live), bool)
        follows[1:] = right[:-1] == live[1:]
        odd = _odd_in_run(group, follows)
        count = np.bincount(group[~odd], minlength=len(pair))
        often = count >= min_pair
        rank = np.zeros(len(pair), np.int32)
        rank[np.argsort(count, kind="stable")] = np.arange(1, len(pair) + 1)
        rank[~often] = 0
        power = np.where(odd, 0, rank[group])
        take = power > 0
        touch = np.flatnonzero(follows)
        take[touch] &= power[touch] > power[touch - 1]
        take[touch - 1] &= power[touch - 1] > power[touch]
        enough = np.bincount(group[take], minlength=len(pair)) >= min_pair
        if not enough.any():
            break
        take &= enough[group]
        name = np.cumsum(enough) - 1 + first_new + made
        best = pair[enough]
        halves = np.stack([best >> np.uint64(32), best & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        inner = halves.astype(np.int64) - first_new
        sizes = np.append(sizes, np.where(inner < 0, 1, sizes[np.maximum(inner, 0)] if made else 1).sum(1))
        rules.append(halves)
        made += len(best)
        left, cut = live[take], right[take]
        seq[left] = name[group[take]]
        gone[cut] = True
        after[left] = after[cut]
        inside = after[left] < n
        before[after[left[inside]]] = left[inside]
        # again: frequent pairs that are still whole, and what a new symbol is part of
        rest = live[often[group] & ~take]
        led = before[left]
        look = np.zeros(n, bool)
        look[rest], look[left], look[led[led >= 0]] = True, True, True
        again = np.flatnonzero(look & ~gone)
        again = again[after[again] < n]
        live = again[~fence[after[again]]].astype(np.int32)
    kept = ~gone
    return seq[kept], np.concatenate(rules), sizes, fence[kept]


def _levels(rules: np.ndarray, first_new: int) -> Iterator[np.ndarray]:
    """Rules in groups whose parts are ids or rules of earlier groups."""
    inner = rules.astype(np.int64) - first_new
    done = np.zeros(len(rules), bool)
    left = np.arange(len(rules))
    while len(left):
        ready = ((inner[left] < 0) | done[np.maximum(inner[left], 0)]).all(1)
        if not ready.any():
            raise ValueError("rules that name one another in a circle")
        yield left[ready]
        done[left[ready]] = True
        left = left[~ready]


def _spread(seq: np.ndarray, first_new: int, lengths: np.ndarray, begin: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The ids of a run of symbols; rule k stands for ``flat[begin[k]:][:lengths[k]]``."""
    big = seq >= first_new
    if not big.any():
        return seq
    rule = np.where(big, seq, first_new) - first_new
    size = np.where(big, lengths[rule], 1)
    ends = np.cumsum(size)
    out = np.repeat(seq, size)
    at = np.arange(len(out), dtype=np.int64) + np.repeat(np.where(big, begin[rule], 0) - (ends - size), size)
    inside = np.repeat(big, size)
    out[inside] = flat[at[inside]]
    return out


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_new: int) -> np.ndarray:
    """The ids that a run of symbols stands for, by expanding every rule once."""
    begin = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), np.uint32)
    for level in _levels(rules, first_new):
        got = _spread(rules[level].ravel(), first_new, lengths, begin, flat)
        size = lengths[level]
        flat[np.arange(len(got)) + np.repeat(begin[level] - (np.cumsum(size) - size), size)] = got
    return _spread(seq.astype(np.uint32), first_new, lengths, begin, flat)


def expand_only(seq: np.ndarray, rules: np.ndarray, first_new: int) -> np.ndarray:
    """The ids that a few symbols stand for: only rules met on the way are read."""
    seq = seq.astype(np.uint32)
    while (big := seq >= first_new).any():
        out = np.repeat(seq, 1 + big)
        at = np.flatnonzero(big) + np.arange(int(big.sum()))
        out[at], out[at + 1] = rules[seq[big] - first_new].T
        seq = out
    return seq


def _shard(part: int, number: int, docs: list, raws: list[bytes], dtype: np.dtype, first_new: int) -> tuple:
    ids = np.frombuffer(b"".join(raws), dtype)
    tokens = np.fromiter((len(r) // dtype.itemsize for r in raws), np.int64, len(raws))
    fence = np.zeros(len(ids), bool)
    fence[np.cumsum(tokens) - tokens] = True
    seq, rules, lengths, starts = compress(ids, first_new, fence=fence)
    begin = np.flatnonzero(starts)
    symbols = np.diff(np.append(begin, len(seq)))
    wide = _symbol_type(first_new, len(rules))
    return (part, number, docs, tokens.astype("<u4").tobytes(), symbols.astype("<u4").tobytes(), first_new, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype(wide).tobytes())


def _symbol_type(first_new: int, rules: int) -> str:
    return "<u2" if first_new + rules <= 1 << 16 else "<u4"


def write_shards(docs: DataFrame, path: str, partitions: int | None = None, shard_tokens: int = SHARD_TOKENS, tokenizer: str | None = None) -> None:
    """Tokenise ``documents`` and write their shards in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    names = tokenizer or default_tokenizer()
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = SHARD_SCHEMA.format(kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(names)
        first_new = enc.tokenizer.get_vocab_size()
        part, number = TaskContext.get().partitionId(), 0
        ids, raws, size = [], [], 0

        def out() -> pa.RecordBatch:
            row = _shard(part, number, ids, raws, enc.dtype, first_new)
            kinds = [pa.int32(), pa.int32(), pa.list_(key), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [c.split(" ")[0] for c in schema.split(", ")])

        for batch in parts(batches, 1000):
            key = batch.schema.field(0).type
            for doc, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                ids.append(doc)
                raws.append(raw)
                size += len(raw) // enc.dtype.itemsize
                if size >= shard_tokens:
                    yield out()
                    ids, raws, size, number = [], [], 0, number + 1
        if ids:
            yield out()

    ordered = docs.select("doc_id", "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, schema).write.parquet(path)


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules, their expansion lengths and the sequence of a shard, as stored."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    return rules, np.frombuffer(row["lengths"], "<u4").astype(np.int64), np.frombuffer(row["sequence"], _symbol_type(row["first_new"], len(rules)))


def decode_shard(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a shard, and how many each has."""
    rules, lengths, seq = _arrays(row)
    return expand(seq, rules, lengths, row["first_new"]), np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)


def decode_document(row: dict, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Random access: ids ``start .. stop`` of document ``k`` of a shard, expanding only the symbols that hold them."""
    rules, lengths, seq = _arrays(row)
    symbols = np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64)
    total = int(np.frombuffer(row["doc_tokens"], "<u4")[k])
    start, stop, _ = slice(start, stop).indices(total)
    if start >= stop:
        return np.zeros(0, np.uint32)
    at = int(symbols[:k].sum())
    own = seq[at : at + int(symbols[k])].astype(np.int64) - row["first_new"]
    ends = np.cumsum(np.where(own < 0, 1, lengths[np.maximum(own, 0)] if len(lengths) else 1))
    a, b = np.searchsorted(ends, [start, stop - 1], side="right").tolist()
    skip = start - (int(ends[a - 1]) if a else 0)
    return expand_only(seq[at + a : at + b + 1], rules, row["first_new"])[skip : skip + stop - start]


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from its shard.

    ``start`` counts the ids of all documents before it: sums over shards, then partitions.
    """
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            names = batch.column(batch.schema.get_field_index("doc_ids"))
            row = {f.name: batch.column(i)[0].as_py() for i, f in enumerate(batch.schema) if f.name != "doc_ids"}
            ids, tokens = decode_shard(row)
            wide, ends = ids.astype("<u4", copy=False), np.cumsum(tokens)
            starts = ends - tokens
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(tokens)
            cols = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), names.flatten(), pa.array(starts), pa.array(tokens), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = shards.select("part", "shard", "doc_ids", "doc_tokens", "first_new", "rules", "lengths", "sequence").mapInArrow(run, f"part int, shard int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    docs = materialize(docs, "decoded")
    per_shard = docs.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    per_part = per_shard.groupBy("part").agg(F.sum("n").alias("n"))
    # one row a partition: the only window without a key
    all_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    part_base = per_part.select("part", F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("_part"))
    shard_base = per_shard.select("part", "shard", F.coalesce(F.sum("n").over(in_part), F.lit(0)).alias("_shard"))
    base = shard_base.join(part_base, "part").select("part", "shard", (F.col("_shard") + F.col("_part")).alias("_base"))
    joined = docs.join(base, ["part", "shard"])
    return joined.select("doc_id", (F.col("_base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write ``documents`` in the shard format to the shared folder and read them back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "shards")
    write_shards(docs, path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read_documents(spark.read.schema(SHARD_SCHEMA.format(kind=kind)).parquet(path))
