"""Indexed scans: the rows, and that blocks outside the wanted places are never read."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandset.sources import indexed as ix
from strandset.sources import readers as rd


def bgzip_block(content):
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    raw = body.compress(content) + body.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(content), len(content))


def bin_of(low, high):
    high -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if low >> shift == high >> shift:
            return first + (low >> shift)
    return 0


def write_indexed(path, rows, header="##x\n#CHROM\n", per_block=700):
    """Lines ``(chrom, start, end, text)`` in blocks of ``per_block`` bytes, and the index beside them."""
    text = header.encode() + b"".join(t.encode() + b"\n" for *_, t in rows)
    blocks, offsets = [], [0]
    for at in range(0, len(text), per_block):
        blocks.append(bgzip_block(text[at : at + per_block]))
        offsets.append(offsets[-1] + len(blocks[-1]))
    virtual = lambda at: (offsets[at // per_block] << 16) | (at % per_block)
    path.write_bytes(b"".join(blocks) + bgzip_block(b""))
    names = list(dict.fromkeys(r[0] for r in rows))
    bins, linear, at = {n: {} for n in names}, {n: {} for n in names}, len(header)
    for chrom, start, end, t in rows:
        begin, after = virtual(at), virtual(at + len(t) + 1)
        chunks = bins[chrom].setdefault(bin_of(start - 1, end), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = after
        else:
            chunks.append([begin, after])
        for w in range((start - 1) >> 14, ((end - 1) >> 14) + 1):
            linear[chrom].setdefault(w, begin)
        at += len(t) + 1
    joined = b"".join(n.encode() + b"\0" for n in names)
    out = b"TBI\x01" + struct.pack("<8i", len(names), 2, 1, 2, 0, ord("#"), 0, len(joined)) + joined
    for n in names:
        out += struct.pack("<i", len(bins[n]))
        for number, chunks in sorted(bins[n].items()):
            out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        windows, last = [], 0
        for w in range(max(linear[n]) + 1):
            last = linear[n].get(w, last)
            windows.append(last)
        out += struct.pack("<i", len(windows)) + struct.pack(f"<{len(windows)}Q", *windows)
    (path.parent / (path.name + ".tbi")).write_bytes(bgzip_block(out))
    return offsets


def variants(n=4000, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for chrom in ("chr1", "chr2"):
        for k, start in enumerate(np.sort(rng.integers(1, 5_000_000, n)).tolist()):
            ref = "A" * (60_000 if k % 500 == 7 else int(rng.integers(1, 4)))
            if len(ref) > 10:
                ref = "A" * 900
            rows.append((chrom, start, start + len(ref) - 1, f"{chrom}\t{start}\t.\t{ref}\tC\t.\tPASS\tN={k}"))
    return rows


@pytest.fixture(scope="module")
def packed(tmp_path_factory):
    path = tmp_path_factory.mktemp("packed") / "v.vcf.gz"
    rows = variants()
    return path, rows, write_indexed(path, rows)


def over(rows, *regions):
    return sorted((c.removeprefix("chr"), a, b, t) for c, a, b, t in rows if any(c.removeprefix("chr") == k.removeprefix("chr") and a <= high and b >= low for k, low, high in regions))


@pytest.mark.parametrize("regions", [["1:1000000-1020000"], ["chr2:2500000"], ["2"], ["1:1-3000", "chr1:2000-90000", "2:4999000-"], ["3:5-9"], ["1:4999999-5100000"]])
def test_regions(spark, packed, regions):
    path, rows, _ = packed
    got = sorted(map(tuple, ix.indexed_lines(spark, str(path), regions, partition_bytes=20_000).collect()))
    assert got == over(rows, *ix.parse_regions(regions))


def test_whole_file_tables_of_regions_and_parsers(spark, packed):
    path, rows, _ = packed
    whole = ix.indexed_lines(spark, f"file://{path}", partition_bytes=20_000)
    assert whole.rdd.getNumPartitions() >= 4
    assert sorted(map(tuple, whole.collect())) == over(rows, ("1", 1, 10**9), ("2", 1, 10**9))
    bed = spark.createDataFrame([("1", 99, 200_000), ("2", 0, 5000)], "chrom string, start long, end long")
    some = ix.indexed_lines(spark, str(path), bed)
    assert sorted(map(tuple, some.collect())) == over(rows, ("1", 100, 200_000), ("2", 1, 5000))
    assert ix.indexed_lines(spark, str(path), bed.limit(0)).count() == 0
    assert rd.vcf_sites(spark, some).count() == some.count()


def test_a_narrow_region_reads_few_bytes(packed):
    path, rows, _ = packed
    reader = ix.RegionReader(str(path), str(path) + ".tbi", [("1", 2_000_000, 2_004_000)], ix.PARTITION_BYTES)
    ix_read, ix.READ_BYTES = ix.READ_BYTES, 1024
    try:
        got = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    finally:
        ix.READ_BYTES = ix_read
    assert got == len(over(rows, ("1", 2_000_000, 2_004_000))) > 0
    assert 0 < reader.bytes_read < path.stat().st_size / 25


def test_blocks_of_other_regions_are_never_read(spark, packed, tmp_path):
    path, rows, offsets = packed
    raw = bytearray(path.read_bytes())
    wanted = [("2", 3_000_000, 3_050_000)]
    places = ix.RegionIndex(str(path) + ".tbi").stretches(*wanted[0])
    first, last = places[0][0] >> 16, places[-1][1] >> 16
    for k, at in enumerate(offsets[:-1]):
        if at + 4 < first - 5000 or at > last + 5000:
            raw[at : at + 4] = b"dead"
    broken = tmp_path / "broken.vcf.gz"
    broken.write_bytes(raw)
    (tmp_path / "broken.vcf.gz.tbi").write_bytes((path.parent / (path.name + ".tbi")).read_bytes())
    assert sorted(map(tuple, ix.indexed_lines(spark, str(broken), ["2:3000000-3050000"]).collect())) == over(rows, *wanted)
    with pytest.raises(Exception):
        ix.indexed_lines(spark, str(broken)).count()


def test_conditions_are_pushed_to_the_scan(spark, packed):
    path, rows, _ = packed
    conf = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "true")
    try:
        df = ix.indexed_lines(spark, str(path)).where((F.col("chrom") == "1") & (F.col("start") > 400_000) & (F.col("start") <= 500_000))
        want = [r for r in over(rows, ("1", 1, 10**9)) if 400_000 < r[1] <= 500_000]
        assert sorted(map(tuple, df.collect())) == want and want
    finally:
        spark.conf.set(conf, before)
    reader = ix.NarrowingReader(str(path), str(path) + ".tbi", None, ix.PARTITION_BYTES)
    kept = list(reader.pushFilters([ix.EqualTo(("chrom",), "1"), ix.GreaterThan(("start",), 400_000), ix.LessThanOrEqual(("start",), 500_000)]))
    assert len(kept) == 3 and reader.regions == [("1", 400_000, 500_000)]


def signal_file(path, blocks, names, fan=3, pad=0, packed=True):
    """A bigWig file with a tree of ``fan`` entries a node over ``blocks`` of ``(chrom, [(start, end, value)])``; ``pad`` empty bytes (a hole) in front of each block."""
    key = max(map(len, names))
    tree = struct.pack("<IIIIQQ", ix.CHROM_TREE_MARK, len(names), key, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names))
    tree += b"".join(n.encode().ljust(key, b"\0") + struct.pack("<II", k, 1000) for k, n in enumerate(names))
    places = []
    with open(path, "wb") as f:
        f.seek(64 + len(tree))
        for chrom, records in blocks:
            body = struct.pack("<IIIIIBBH", chrom, records[0][0], records[-1][1], 0, 0, 1, 0, len(records)) + b"".join(struct.pack("<IIf", *r) for r in records)
            body = zlib.compress(body) if packed else body
            f.seek(f.tell() + pad)
            places.append((chrom, records[0][0], chrom, records[-1][1], f.tell(), len(body)))
            f.write(body)
        index = f.tell()
        levels = [[places[k : k + fan] for k in range(0, len(places), fan)]]
        while len(levels[-1]) > 1:
            spans = [(min(e[0:2] for e in node), max(e[2:4] for e in node)) for node in levels[-1]]
            entries = [(*a, *b, k) for k, (a, b) in enumerate(spans)]
            levels.append([entries[k : k + fan] for k in range(0, len(entries), fan)])
        f.write(struct.pack("<IIQIIIIQII", ix.SIGNAL_INDEX_MARK, fan, len(places), 0, 0, 0, 0, 0, 1, 0))
        at, starts = index + 48, {}
        for depth in range(len(levels) - 1, -1, -1):
            for k, node in enumerate(levels[depth]):
                starts[depth, k] = at
                at += 4 + len(node) * (24 if depth else 32)
        for depth in range(len(levels) - 1, -1, -1):
            for node in levels[depth]:
                f.write(struct.pack("<BBH", depth == 0, 0, len(node)))
                for e in node:
                    f.write(struct.pack("<IIIIQQ", *e) if depth == 0 else struct.pack("<IIIIQ", *e[:4], starts[depth - 1, e[4]]))
        f.seek(0)
        f.write(struct.pack("<IHHQQQHHQQIQ", ix.BIGWIG_MARK, 4, 0, 64, 64 + len(tree), index, 0, 0, 0, 0, 4096 if packed else 0, 0) + tree)
    return places


def signal(n=120):
    rng = np.random.default_rng(5)
    blocks = []
    for chrom in (0, 1):
        at = 10
        for _ in range(n):
            records = []
            for _ in range(4):
                records.append((at, at + int(rng.integers(1, 30)), float(np.float32(rng.random()))))
                at = records[-1][1] + int(rng.integers(0, 50))
            blocks.append((chrom, records))
    return blocks


NAMES = ["chr1", "chrX"]


def value_at(blocks, chrom, pos):
    return next((v for c, records in blocks if NAMES[c] == f"chr{chrom}" for a, b, v in records if a <= pos - 1 < b), None)


def test_points_read_only_their_blocks(spark, tmp_path):
    blocks = signal()
    path = tmp_path / "s.bw"
    places = signal_file(path, blocks, NAMES)
    inside = [("1", blocks[3][1][1][0] + 1), ("1", blocks[3][1][2][1]), ("1", blocks[70][1][3][1] + 1), ("X", blocks[150][1][0][1])]
    points = [*inside, ("1", 3000), ("X", 9), ("2", 5), ("X", 5000)]
    used = {p[4] for p in places for c, at in points if NAMES[p[0]] == f"chr{c}" and p[1] <= at - 1 < p[3]}
    raw = bytearray(path.read_bytes())
    for *_, offset, size in places:
        if offset not in used:
            raw[offset : offset + size] = b"?" * size
    path.write_bytes(raw)
    df = spark.createDataFrame([(f"chr{c}", p, "k") for c, p in points], "chrom string, pos long, tag string")
    got = {(r.chrom, r.pos): r.value for r in ix.signal_at(spark, f"file://{path}", df).collect()}
    assert got == {(c, p): value_at(blocks, c, p) for c, p in points} and sum(v is not None for v in got.values()) >= 3
    with pytest.raises(Exception):
        rd.bigwig(spark, f"file://{path}").collect()


def test_the_tree_is_pruned_by_regions(spark, tmp_path):
    blocks = signal()
    path = tmp_path / "s.bw"
    signal_file(path, blocks, NAMES, packed=False)
    want = sorted((NAMES[c][3:], a, b, v) for c, rs in blocks if c == 1 and rs[0][0] < 2000 and rs[-1][1] > 1499 for a, b, v in rs)
    assert sorted(map(tuple, rd.bigwig(spark, f"file://{path}", ["X:1500-2000"]).collect())) == want
    whole = sorted((NAMES[c][3:], a, b, v) for c, rs in blocks for a, b, v in rs)
    assert sorted(map(tuple, rd.bigwig(spark, f"file://{path}").collect())) == whole
    narrow, wide = ix.Ranges(str(path)), ix.Ranges(str(path))
    index = ix.signal_heads(narrow)[1]
    before = narrow.bytes_read
    assert len(list(ix.signal_index(narrow, index, {1: [(1500, 1520)]}))) <= 2
    list(ix.signal_index(wide, index))
    assert narrow.bytes_read - before < wide.bytes_read / 5


def test_files_beyond_two_gigabytes(spark, tmp_path):
    blocks = [(0, [(5, 10, 1.0)]), (0, [(2000, 2010, 2.0)]), (1, [(7, 9, 3.0)])]
    path = tmp_path / "big.bw"
    signal_file(path, blocks, NAMES, pad=1 << 30)  # holes take no disk
    assert path.stat().st_size > 3 << 30
    df = spark.createDataFrame([("1", 2005), ("X", 8), ("X", 10)], "chrom string, pos long")
    assert sorted((r.chrom, r.pos, r.value) for r in ix.signal_at(spark, f"file://{path}", df).where("value is not null").collect()) == [("1", 2005, 2.0), ("X", 8, 3.0)]


def test_matrices_by_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rd, "STRETCH_CELLS", 20)
    monkeypatch.setattr(rd, "BATCH_CELLS", 8)
    x = np.arange(60, dtype=np.int32).reshape(12, 5)
    for k, y in enumerate((x, np.asfortranarray(x), x[:, 0].copy())):
        np.save(tmp_path / f"{k}.npy", y)
        got = {(r.i, r.j): r.value for r in rd.array_file(spark, str(tmp_path / f"{k}.npy")).collect()}
        y = y.reshape(len(y), -1)
        assert got == {(i, j): float(y[i, j]) for i in range(len(y)) for j in range(y.shape[1])}
    np.arange(49, dtype="<f4").tofile(tmp_path / "m.bin")
    assert sorted(map(tuple, rd.square_matrix(spark, f"file://{tmp_path}/m.bin", 7).collect())) == [(i, j, float(7 * i + j)) for i in range(7) for j in range(7)]
    with pytest.raises(Exception):
        rd.square_matrix(spark, f"file://{tmp_path}/m.bin", 8).collect()
    np.save(tmp_path / "s.npy", np.array(["a"]))
    with pytest.raises(rd.SchemaError):
        rd.array_file(spark, str(tmp_path / "s.npy"))
