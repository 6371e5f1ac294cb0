"""Scans of block-compressed files through their indexes: only the wanted blocks are read.

Files are opened where they lie (a local or mounted path, or any store that pyarrow reads:
``hdfs://``, ``s3://``, ``gs://``) and read by offset, so no file is ever one value of a row
and none has a size limit.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.columns import bare_chrom
from .readers import SchemaError

#: Compressed bytes of a partition, lines of a batch, bytes asked for at a time.
PARTITION_BYTES = 16 << 20
BATCH_LINES = 5000
READ_BYTES = 1 << 18
LAST = (1 << 31) - 1
PUSHDOWN_CONF = "spark.sql.python.filterPushdown.enabled"


class Ranges:
    """A file read by offset; counts the bytes."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))
        self.file, self.bytes_read = system.open_input_file(name), 0
        self.size = self.file.size()

    def at(self, offset: int, size: int) -> bytes:
        size = max(0, min(size, self.size - offset))
        self.bytes_read += size
        return self.file.read_at(size, offset)


# --- lines of bgzip files by region -------------------------------------------------------

#: Marks of the block format and its index, bits of the index's format field.  Fixed values.
BLOCK_MARK, INDEX_MARK = b"\x1f\x8b\x08\x04", b"TBI\x01"
VARIANTS, ZERO_BASED = 2, 0x10000
#: Bins of the index by level: first number and width as a power of two.
BIN_LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))


def block_size(header: bytes) -> int:
    """Compressed size of the block that begins with ``header``."""
    if not header.startswith(BLOCK_MARK):
        raise SchemaError("not a bgzip block")
    extra, at = struct.unpack_from("<H", header, 10)[0], 12
    while at < 12 + extra:
        tag, size = header[at : at + 2], struct.unpack_from("<H", header, at + 2)[0]
        if tag == b"BC":
            return struct.unpack_from("<H", header, at + 4)[0] + 1
        at += 4 + size
    raise SchemaError("a gzip file without block sizes")


class Blocks:
    """Inflated blocks of a bgzip file, one after the other from an offset."""

    def __init__(self, file: Ranges, offset: int) -> None:
        self.file, self.offset, self.held, self.held_at = file, offset, b"", offset

    def _bytes(self, offset: int, size: int) -> bytes:
        if offset + size > self.held_at + len(self.held):
            self.held, self.held_at = self.file.at(offset, max(size, READ_BYTES)), offset
        return self.held[offset - self.held_at : offset - self.held_at + size]

    def next(self) -> tuple[int, bytes] | None:
        """Offset of a block and its content; None at the end of the file."""
        head = self._bytes(self.offset, 64)
        if not head:
            return None
        size, offset = block_size(head), self.offset
        raw = self._bytes(offset, size)
        self.offset += size
        return offset, zlib.decompress(raw, 31)


class RegionIndex:
    """The index of a sorted bgzip file: which stretches of it can hold lines of a region."""

    def __init__(self, path: str) -> None:
        data = zlib_members(Ranges(path))
        if data[:4] != INDEX_MARK:
            raise SchemaError(f"{path} is not an index")
        n_names, self.format, *self.columns, meta, self.skip, size = struct.unpack_from("<8i", data, 4)
        self.comment = chr(meta)
        self.names = data[36 : 36 + size].decode().split("\0")[:n_names]
        at, self.bins, self.linear = 36 + size, [], []
        for _ in self.names:
            bins: dict[int, list[tuple[int, int]]] = {}
            n = struct.unpack_from("<i", data, at)[0]
            at += 4
            for _ in range(n):
                number, chunks = struct.unpack_from("<Ii", data, at)
                flat = struct.unpack_from(f"<{2 * chunks}Q", data, at + 8)
                bins[number] = list(zip(flat[::2], flat[1::2]))
                at += 8 + 16 * chunks
            n = struct.unpack_from("<i", data, at)[0]
            self.linear.append(struct.unpack_from(f"<{n}Q", data, at + 4))
            self.bins.append(bins)
            at += 4 + 8 * n

    def number(self, chrom: str) -> int | None:
        """A sequence by its name, with or without ``chr``."""
        bare = chrom.removeprefix("chr")
        return next((k for k, name in enumerate(self.names) if name.removeprefix("chr") == bare), None)

    def stretches(self, chrom: str, low: int, high: int) -> list[tuple[int, int]]:
        """Places ``(from, to)`` in the file, cut at known line starts, that can hold lines over ``low .. high`` (1-based, closed)."""
        k = self.number(chrom)
        if k is None:
            return []
        low, high = max(0, low - 1), min(high, 1 << 29)
        bins = self.bins[k]
        found = [c for first, shift in BIN_LEVELS for b in range(first + (low >> shift), first + ((high - 1) >> shift) + 1) for c in bins.get(b, ())]
        linear = self.linear[k]
        least = linear[min(low >> 14, len(linear) - 1)] if linear else 0
        cuts = sorted({x for x in linear if x} | {a for own in bins.values() for a, _ in own})
        out: list[tuple[int, int]] = []
        for begin, end in sorted(found):
            begin = max(begin, least, out[-1][1] if out else 0)
            while begin < end:
                after = cuts[bisect_right(cuts, begin)] if bisect_right(cuts, begin) < len(cuts) else end
                out.append((begin, min(after, end)))
                begin = out[-1][1]
        return out


def zlib_members(file: Ranges) -> bytes:
    """The whole content of a (small) file of gzip members."""
    raw, out = file.at(0, file.size), []
    while raw:
        one = zlib.decompressobj(31)
        out.append(one.decompress(raw))
        raw = one.unused_data
    return b"".join(out)


class _Stretches(InputPartition):
    """Places to read, the regions wanted, and the layout of the lines."""

    def __init__(self, places: list[tuple[int, int]], wanted: dict[str, list[tuple[int, int]]], layout: tuple) -> None:
        super().__init__((places, wanted, layout))


def _merged(regions: list[tuple[str, int, int]]) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for chrom, low, high in sorted((c.removeprefix("chr"), a, b) for c, a, b in regions):
        own = out.setdefault(chrom, [])
        if own and low <= own[-1][1] + 1:
            own[-1] = own[-1][0], max(own[-1][1], high)
        elif low <= high:
            own.append((low, high))
    return {c: own for c, own in out.items() if own}


class RegionReader(DataSourceReader):
    """One partition for each run of wanted stretches; a line comes once, whatever regions it overlaps."""

    def __init__(self, path: str, index: str, regions: list[tuple[str, int, int]] | None, partition_bytes: int) -> None:
        self.path, self.index_path, self.partition_bytes = path, index, partition_bytes
        self.regions = regions
        self.bytes_read = 0

    def partitions(self) -> list[InputPartition]:
        index = RegionIndex(self.index_path)
        wanted = _merged([(name, 1, LAST) for name in index.names] if self.regions is None else self.regions)
        layout = (index.format, tuple(index.columns), index.comment)
        places = sorted({s for c, own in wanted.items() for low, high in own for s in index.stretches(c, low, high)})
        out: list[list[tuple[int, int]]] = []
        for begin, end in places:
            begin = max(begin, out[-1][-1][1] if out else 0)
            if begin >= end:
                continue
            if out and (end >> 16) - (out[-1][0][0] >> 16) <= self.partition_bytes and begin >> 16 <= (out[-1][-1][1] >> 16) + READ_BYTES:
                last = out[-1][-1]
                if last[1] == begin:
                    out[-1][-1] = (last[0], end)
                else:
                    out[-1].append((begin, end))
            else:
                out.append([(begin, end)])
        return [_Stretches(p, wanted, layout) for p in out or [[]]]

    def _lines(self, file: Ranges, begin: int, end: int) -> Iterator[str]:
        """Lines that start from ``begin`` on and before ``end``."""
        blocks, rest = Blocks(file, begin >> 16), b""
        skip = begin & 0xFFFF
        while (block := blocks.next()) is not None:
            offset, content = block
            at, skip = skip, 0
            while at < len(content):
                if not rest and ((offset << 16) | at) >= end:
                    return
                stop = content.find(b"\n", at)
                if stop < 0:
                    rest += content[at:]
                    break
                yield (rest + content[at:stop]).decode()
                rest, at = b"", stop + 1
        if rest:
            yield rest.decode()

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        file = Ranges(self.path)
        places, wanted, (kind, (seq, beg, fin), comment) = partition.value
        zero = bool(kind & ZERO_BASED)
        rows: list[tuple[str, int, int, str]] = []
        starts = {c: [a for a, _ in own] for c, own in wanted.items()}

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows))
            self.bytes_read = file.bytes_read
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["chrom", "start", "end", "value"])

        for begin, end in places:
            for line in self._lines(file, begin, end):
                if not line or line.startswith(comment):
                    continue
                part = line.split("\t", max(seq, beg, fin, 4) + 1)
                chrom = part[seq - 1].removeprefix("chr")
                start = int(part[beg - 1]) + zero
                last = start + len(part[3]) - 1 if kind & 0xFFFF == VARIANTS else int(part[fin - 1]) if fin and fin != beg else start
                own = starts.get(chrom)
                k = bisect_right(own, last) - 1 if own else -1
                if k >= 0 and wanted[chrom][k][1] >= start:
                    rows.append((chrom, start, last, line))
                    if len(rows) >= BATCH_LINES:
                        yield batch()
                        rows = []
        if rows:
            yield batch()
        self.bytes_read = file.bytes_read


class NarrowingReader(RegionReader):
    """A reader that conditions narrow; Spark takes it only where pushed filters are enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on ``chrom``, ``start`` and ``end`` narrow the regions; Spark checks all of them again."""
        chroms: set[str] | None = None
        low, high = 1, LAST
        for f in filters:
            name = getattr(f, "attribute", None)
            if isinstance(f, (EqualTo, In)) and name == ("chrom",):
                own = {str(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                chroms = own if chroms is None else chroms & own
            elif name in (("start",), ("end",)) and isinstance(getattr(f, "value", None), int):
                # a line ends where it starts or later: either bound holds for a line over low .. high
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = max(low, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = min(high, f.value)
            yield f
        if chroms is not None:
            pushed = [(c, low, high) for c in chroms]
            self.regions = pushed if self.regions is None else [(c, max(a, low), min(b, high)) for c, a, b in self.regions if c.removeprefix("chr") in {x.removeprefix("chr") for x in chroms}]


class RegionSource(DataSource):
    """``chrom, start, end, value`` of the lines of a bgzip file by its index (``.tbi`` beside it).

    Options: ``path``; ``index`` (default: path and ``.tbi``); ``regions``, as
    ``chrom:low-high`` parted by commas; ``partitionBytes``; ``pushdown`` (true or false).
    """

    @classmethod
    def name(cls) -> str:
        return "indexed_lines"

    def schema(self) -> str:
        return "chrom string, start long, end long, value string"

    def reader(self, schema) -> RegionReader:
        path = self.options["path"]
        regions = parse_regions(self.options["regions"].split(",")) if self.options.get("regions") else None
        kind = NarrowingReader if self.options.get("pushdown") == "true" else RegionReader
        return kind(path, self.options.get("index", path + ".tbi"), regions, int(self.options.get("partitionBytes", PARTITION_BYTES)))


def parse_regions(texts: list[str]) -> list[tuple[str, int, int]]:
    """``chrom``, ``chrom:at`` or ``chrom:low-high`` (1-based, closed)."""
    out = []
    for text in texts:
        chrom, _, span = text.strip().replace(",", "").partition(":")
        low, dash, high = span.partition("-")
        out.append((chrom, int(low or 1), int(high) if high else LAST if dash or not low else int(low)))
    return out


def indexed_lines(spark: SparkSession, path: str, regions: list[str] | DataFrame | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Lines of a sorted bgzip file over any of ``regions``: texts, or a table ``chrom, start, end`` as :func:`readers.bed`
    gives it (0-based, half-open).  Without regions, conditions on the columns narrow the scan where the session's
    ``spark.sql.python.filterPushdown.enabled`` is true."""
    spark.dataSource.register(RegionSource)
    source = spark.read.format("indexed_lines").option("partitionBytes", partition_bytes).option("pushdown", spark.conf.get(PUSHDOWN_CONF, "false"))
    if isinstance(regions, DataFrame):  # a list of regions to read, not data
        regions = [f"{r.chrom}:{r.start + 1}-{r.end}" for r in regions.select("chrom", "start", "end").collect()]
    if regions is not None:
        if not regions:
            return spark.createDataFrame([], "chrom string, start long, end long, value string")
        source = source.option("regions", ",".join(regions))
    return source.load(path)


# --- signal of bigWig files by place ------------------------------------------------------

#: Marks of the format: the file, its chromosome tree, its region index.  Fixed values.
BIGWIG_MARK, CHROM_TREE_MARK, SIGNAL_INDEX_MARK = 0x888FFC26, 0x78CA8C91, 0x2468ACE0


def _unpack(file: Ranges, form: str, at: int) -> tuple:
    return struct.unpack(form, file.at(at, struct.calcsize(form)))


def signal_heads(file: Ranges) -> tuple[dict[int, str], int, bool]:
    """Chromosome names by number, place of the region index, and whether blocks are compressed."""
    if file.size < 64 or _unpack(file, "<I", 0)[0] != BIGWIG_MARK:
        raise SchemaError("not a little-endian bigWig file")
    tree, _, index = _unpack(file, "<QQQ", 8)
    packed = _unpack(file, "<I", 52)[0] > 0
    mark, _, key_size = _unpack(file, "<III", tree)
    if mark != CHROM_TREE_MARK or _unpack(file, "<I", index)[0] != SIGNAL_INDEX_MARK:
        raise SchemaError("broken bigWig index")
    names, todo = {}, [tree + 32]
    while todo:
        at = todo.pop()
        leaf, _, n = _unpack(file, "<BBH", at)
        node = file.at(at + 4, n * (key_size + 8))
        for k in range(n):
            entry = k * (key_size + 8)
            if leaf:
                names[struct.unpack_from("<I", node, entry + key_size)[0]] = node[entry : entry + key_size].rstrip(b"\0").decode()
            else:
                todo.append(struct.unpack_from("<Q", node, entry + key_size)[0])
    return names, index, packed


def signal_index(file: Ranges, index: int, wanted: dict[int, list[tuple[int, int]]] | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """``(chrom, start, end, offset, size)`` of data blocks; with ``wanted`` (ascending half-open ranges by chromosome),
    branches that reach none of them are not read."""

    def reaches(first: tuple[int, int], last: tuple[int, int]) -> bool:
        if wanted is None:
            return True
        for chrom, ranges in wanted.items():
            if first[0] <= chrom <= last[0]:
                low, high = first[1] if chrom == first[0] else 0, last[1] if chrom == last[0] else LAST
                k = bisect_right(ranges, (high - 1, LAST)) - 1
                if k >= 0 and ranges[k][1] > low:
                    return True
        return False

    todo = [index + 48]
    while todo:
        at = todo.pop()
        leaf, _, n = _unpack(file, "<BBH", at)
        width = 32 if leaf else 24
        node = file.at(at + 4, n * width)
        below = []
        for k in range(n):
            a, start, b, end = struct.unpack_from("<IIII", node, k * width)
            if not reaches((a, start), (b, end)):
                continue
            if leaf:
                for chrom in range(a, b + 1):  # a block holds one chromosome; writers say so with a == b
                    yield chrom, start if chrom == a else 0, end if chrom == b else LAST, *struct.unpack_from("<QQ", node, k * width + 16)
            else:
                below.append(struct.unpack_from("<Q", node, k * width + 16)[0])
        todo += reversed(below)


def signal_block(raw: bytes, packed: bool) -> tuple[int, list[tuple[int, int, float]]]:
    """Chromosome number and ``start, end, value`` of a block: free, stepped or fixed-step records."""
    raw = zlib.decompress(raw) if packed else raw
    chrom, start, _, step, span, kind, _, n = struct.unpack_from("<IIIIIBBH", raw)
    if kind == 1:
        return chrom, [struct.unpack_from("<IIf", raw, 24 + 12 * k) for k in range(n)]
    if kind == 2:
        return chrom, [(a, a + span, v) for a, v in (struct.unpack_from("<If", raw, 24 + 8 * k) for k in range(n))]
    return chrom, [(start + k * step, start + k * step + span, v) for k, v in enumerate(struct.unpack_from(f"<{n}f", raw, 24))]


def signal_blocks(spark: SparkSession, path: str, regions: list[str] | None = None) -> DataFrame:
    """``path, chrom, start, end, offset, size`` of the data blocks of bigWig files (0-based, half-open), from the index alone.

    ``regions`` (:func:`parse_regions`) prune the tree as it is read.  Files go to tasks each by itself.
    """
    wanted = _merged(parse_regions(regions)) if regions is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0).to_pylist():
                file = Ranges(one)
                names, index, _ = signal_heads(file)
                own = None if wanted is None else {k: [(a - 1, b) for a, b in wanted[n.removeprefix("chr")]] for k, n in names.items() if n.removeprefix("chr") in wanted}
                rows: list[tuple] = []
                for chrom, *place in signal_index(file, index, own):
                    rows.append((one, names[chrom].removeprefix("chr"), *place))
                    if len(rows) >= BATCH_LINES:
                        yield _record(rows, BLOCK_FIELDS)
                        rows = []
                if rows:
                    yield _record(rows, BLOCK_FIELDS)

    return _file_names(spark, path).mapInArrow(run, "path string, chrom string, start long, end long, offset long, size long")


BLOCK_FIELDS = (("path", pa.string()), ("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()))
SIGNAL_FIELDS = (("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.float64()))


def _record(rows: list[tuple], fields: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _file_names(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the files that Spark finds there, each in a partition of its own."""
    names = [r.path for r in spark.read.format("binaryFile").load(path).select("path").distinct().collect()]  # names only
    return spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, len(names)))


def read_signal(blocks: DataFrame, per_task: int = 2000) -> DataFrame:
    """``chrom, start, end, value`` of the blocks, read by offset; neighbours in a file go to the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, heads = None, None, None
        for batch in batches:
            for path, offset, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if path != name:
                    name, file = path, Ranges(path)
                    heads = signal_heads(file)
                chrom, rows = signal_block(file.at(offset, size), heads[2])
                if rows:
                    own = heads[0][chrom].removeprefix("chr")
                    yield _record([(own, *r) for r in rows], SIGNAL_FIELDS)

    once = blocks.select("path", "offset", "size").distinct()
    tasks = max(1, -(-once.count() // per_task))
    return once.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(run, "chrom string, start long, end long, value double")


def signal_at(spark: SparkSession, path: str, points: DataFrame, pos: str = "pos", width: float = 1 << 16) -> DataFrame:
    """``points`` (columns ``chrom`` and 1-based ``pos``) with the ``value`` there, NULL outside the signal.

    Points meet the blocks of the index first; only blocks that hold one are read and
    unpacked, then points meet their records.  Both joins are by bins of ``width``.
    """
    from ..operators.intervals import point_in_interval

    at = points.withColumn("chrom", bare_chrom(F.col("chrom")))
    wanted = at.select("chrom", (F.col(pos) - 1).alias("_at")).distinct()
    blocks = signal_blocks(spark, path)
    hit = point_in_interval(wanted, blocks, ["chrom"], "_at", "start", "end", float(width), "left")
    return point_in_interval(at, read_signal(hit), ["chrom"], pos, "start", "end", float(width), how="left")
