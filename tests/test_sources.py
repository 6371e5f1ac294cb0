"""Readers and writers on small files, and streams against the same batch."""

import gzip
import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandset.operators.intervals import point_in_interval
from strandset.sources import indexed as ix
from strandset.sources import readers as rd
from strandset.sources import sinks as sk
from strandset.streaming import events as ev

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
chr1\t100\trs1\tA\tC\t.\tPASS\tAF=0.1;R2=0.9;IMP\tGT:DS\t0|1:0.98\t1|1:1.9
1\t200\t.\tg\tT,C\t.\tPASS\tAF=0.2\tGT:DS\t0|0:0\t.:.
"""
GTF = 'chr1\tx\tgene\t10\t90\t.\t-\t.\tgene_id "G1.2"; gene_name "AB"; gene_type "protein_coding";\nchr1\tx\texon\t10\t20\t.\t-\t.\tgene_id "G1.2";\nchr2\tx\tgene\t5\t7\t.\t+\t.\tgene_id "G2"; gene_type "lncRNA";\n'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "a.tsv").write_text("id\tx\n1\t2.5\n2\tNA\n3\t.\n")
    with gzip.open(d / "b.tsv.gz", "wt") as f:
        f.write("id\tx\n4\t1\n")
    (d / "v.vcf").write_text(VCF)
    (d / "g.gtf").write_text(GTF)
    (d / "b.bed").write_text("track x\nchr1\t5\t10\tn1\n2\t1\t3\tn2\n")
    (d / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n3 3 2\n3 3 2\n1 2 0.5\n")
    (d / "group.txt").write_text("G1 var 1:1:A:C 1:2:A:C\nG1 anno lof mis\nG1 weight 1 0.5\n")
    (d / "bad.txt").write_text("G1 var k1 k2\nG1 anno lof\n")
    np.arange(9, dtype="<f4").tofile(d / "square.bin")
    (d / "n.json").write_text(json.dumps({"r": {"a": {"b": {"m": 1.5, "n": 2}}}}))
    with zipfile.ZipFile(d / "z.zip", "w") as z:
        z.writestr("in/one.txt", "l1\nl2\n")
        z.writestr("two.gz", gzip.compress(b"g1\ng2\n"))
    return f"file://{d}"


def test_delimited_text(spark, folder):
    got = [tuple(r) for r in rd.delimited(spark, f"{folder}/a.tsv", "id long, x double").orderBy("id").collect()]
    assert got == [(1, 2.5), (2, None), (3, None)]
    assert [tuple(r) for r in rd.delimited(spark, f"{folder}/b.tsv.gz", "id long, x double").collect()] == [(4, 1.0)]
    with pytest.raises(Exception):
        rd.delimited(spark, f"{folder}/a.tsv", "id long, other double").collect()
    df, failed = rd.coerced(spark.createDataFrame([("1",), ("x",), (None,)], "v string"), "v", "int")
    assert failed.first()[0] == 1 and sorted(str(r.v) for r in df.collect()) == ["1", "None", "None"]


def test_variant_text(spark, folder):
    sites = [(r.chrom, r.pos, r.ref, r.alt) for r in rd.vcf_sites(spark, f"{folder}/v.vcf").orderBy("pos", "alt").collect()]
    assert sites == [("1", 100, "A", "C"), ("1", 200, "G", "C"), ("1", 200, "G", "T")]
    assert rd.vcf_samples(spark, f"{folder}/v.vcf") == ["s1", "s2"]
    cells = {(r.pos, r.sample_idx): (r.gt, r.ds) for r in rd.vcf_cells(spark, f"{folder}/v.vcf", ["GT", "DS"]).collect()}
    assert cells == {(100, 0): ("0|1", "0.98"), (100, 1): ("1|1", "1.9")}
    af = rd.vcf_sites(spark, f"{folder}/v.vcf").select("pos", rd.info_number("AF").alias("af"), rd.info_number("R2").alias("r2")).where("pos = 100").first()
    assert (af.af, af.r2) == (0.1, 0.9)
    assert rd.region(rd.vcf_sites(spark, f"{folder}/v.vcf"), "1", 150, 250).count() == 2


def test_annotation_text(spark, folder):
    genes = [(r.chrom, r.gene_id, r.gene_name, r.tss) for r in rd.gtf_genes(spark, f"{folder}/g.gtf").collect()]
    assert genes == [("1", "G1.2", "AB", 90)] and rd.gtf_genes(spark, f"{folder}/g.gtf", None).count() == 2
    assert sorted(tuple(r) for r in rd.bed(spark, f"{folder}/b.bed", {"name": 3}).collect()) == [("1", 5, 10, "n1"), ("2", 1, 3, "n2")]
    assert rd.bed(spark, f"{folder}/b.bed", chroms=["2"]).count() == 1


def test_group_files_round_trip(spark, folder, tmp_path):
    got = rd.group_file(spark, f"{folder}/group.txt").orderBy("ord")
    assert [tuple(r) for r in got.collect()] == [("G1", 0, "1:1:A:C", "lof", 1.0), ("G1", 1, "1:2:A:C", "mis", 0.5)]
    with pytest.raises(Exception):
        rd.group_file(spark, f"{folder}/bad.txt").collect()
    sk.write_group_file(got, f"file://{tmp_path}/g", "gene", "key", "anno", "weight", ["ord"])
    assert sorted(map(tuple, rd.group_file(spark, f"file://{tmp_path}/g").collect())) == sorted(map(tuple, got.collect()))


def test_matrices_archives_and_documents(spark, folder):
    # only the first line that is no comment is the size line, whatever follows it
    assert sorted(tuple(r) for r in rd.matrix_market(spark, f"{folder}/m.mtx").collect()) == [(1, 2, 0.5), (3, 3, 2.0)]
    square = {(r.i, r.j): r.r for r in rd.square_matrix(spark, f"{folder}/square.bin", 3).collect()}
    assert square[2, 1] == 7.0 and len(square) == 9
    lines = sorted((r.member, r.line_number, r.line) for r in rd.zip_member(spark, f"{folder}/z.zip").collect())
    assert lines == [("in/one.txt", 1, "l1"), ("in/one.txt", 2, "l2"), ("two.gz", 1, "g1"), ("two.gz", 2, "g2")]
    assert sorted((r.run, r.axis, r.band, r.model, r.value) for r in rd.nested_json(spark, f"{folder}/n.json").collect()) == [("r", "a", "b", "m", 1.5), ("r", "a", "b", "n", 2.0)]
    assert any(r.path.endswith("a.tsv") and r.size > 10 for r in rd.files(spark, folder).collect())


def test_arrays(spark, tmp_path):
    x, y = np.arange(6, dtype=np.float32).reshape(2, 3), np.array([5, 7])
    np.savez(tmp_path / "c.npz", x=x, y=y)
    np.save(tmp_path / "d.npy", x)
    got = {(r.array, r.i, r.j): r.value for r in rd.arrays(spark, f"file://{tmp_path}/c.npz").collect()}
    assert got == {**{("x", i, j): float(x[i, j]) for i in range(2) for j in range(3)}, ("y", 0, 0): 5.0, ("y", 1, 0): 7.0}
    assert rd.arrays(spark, f"file://{tmp_path}/d.npy").where("array = 'd'").count() == 6
    buffer = io.BytesIO()
    np.save(buffer, np.array(["s"]))
    (tmp_path / "bad.npy").write_bytes(buffer.getvalue())
    with pytest.raises(Exception):
        rd.arrays(spark, f"file://{tmp_path}/bad.npy").collect()


def test_headers_and_schemas(spark, folder, tmp_path):
    (tmp_path / "p.tsv").write_text("ID\tVAL\n1\t2\n")
    (tmp_path / "q.tsv").write_text("name\tvalue\n3\t4\n")
    known = {"p": {"ID": "id", "VAL": "v"}, "q": {"name": "id", "value": "v"}}
    got = rd.header_dispatched(spark, [f"file://{tmp_path}/p.tsv", f"file://{tmp_path}/q.tsv"], known, "id long, v double")
    assert sorted(map(tuple, got.collect())) == [(1, 2.0), (3, 4.0)]
    with pytest.raises(rd.SchemaError):
        rd.header_dispatched(spark, [f"{folder}/a.tsv"], known, "id long")
    with pytest.raises(rd.SchemaError):
        rd.require_columns(got, ["id", "w"])


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(10)], "k long, c string")
    path = f"file://{tmp_path}/out"
    assert not sk.is_complete(spark, path)
    sk.write_once(df, path, ["c"])
    assert sk.is_complete(spark, path)
    with pytest.raises(Exception):
        sk.write_once(df, path)
    assert sk.write_or_resume(df.limit(0), path).count() == 10
    assert sk.fingerprint(df).first() == sk.fingerprint(df.repartition(3)).first() != sk.fingerprint(df.where("k > 0")).first()
    assert [r.chunk for r in sk.chunk_number(df, ["c"], ["k"], 2).orderBy("c", "k").collect()] == [1, 1, 2, 2, 3] * 2
    assert {r["check"]: r.n for r in sk.ledger(df, {"even": F.col("k") % 2 == 0}).collect()} == {"rows": 10, "even": 5}


def test_streams_equal_the_batch(spark, tmp_path):
    rows = spark.range(300).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97)).alias("ts"), (F.col("id") % 4).alias("user_id"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/in")
    for k, f in enumerate((ev.tumbling_counts, ev.gap_sessions)):
        stream = f(ev.read_events(spark, f"{tmp_path}/in", 10))
        q = stream.writeStream.format("memory").queryName(f"s{k}").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c{k}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(f"s{k}").collect())) == sorted(map(tuple, f(rows).collect()))


def bigwig_file(names, blocks, packed):
    """A file with one chromosome leaf and one index leaf over blocks ``(chrom, kind, start, step, span, records)``."""
    key = max(map(len, names))
    tree = struct.pack("<IIIIQQ", ix.CHROM_TREE_MARK, len(names), key, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names))
    tree += b"".join(n.encode().ljust(key, b"\0") + struct.pack("<II", k, 1000) for k, n in enumerate(names))
    data, places = b"", []
    begin = 64 + len(tree)
    for chrom, kind, start, step, span, records in blocks:
        body = struct.pack("<IIIIIBBH", chrom, start, 0, step, span, kind, 0, len(records))
        body += b"".join(struct.pack({1: "<IIf", 2: "<If", 3: "<f"}[kind], *r) for r in records)
        body = zlib.compress(body) if packed else body
        places.append((chrom, begin + len(data), len(body)))
        data += body
    index = struct.pack("<IIQIIIIQII", ix.SIGNAL_INDEX_MARK, 4, len(places), 0, 0, 0, 0, 0, 1, 0) + struct.pack("<BBH", 1, 0, len(places))
    index += b"".join(struct.pack("<IIIIQQ", c, 0, c, 0, at, size) for c, at, size in places)
    head = struct.pack("<IHHQQQHHQQIQ", ix.BIGWIG_MARK, 4, 0, 64, begin, begin + len(data), 0, 0, 0, 0, 4096 if packed else 0, 0)
    return head + tree + data + index


def test_signal_lookup(spark, tmp_path):
    blocks = [(0, 1, 0, 0, 0, [(5, 10, 1.5), (20, 21, 2.0)]), (1, 2, 0, 0, 3, [(7, 4.0), (100, 5.0)]), (1, 3, 200, 10, 5, [(6.0,), (7.0,)])]
    want = [("1", 5, 10, 1.5), ("1", 20, 21, 2.0), ("X", 7, 10, 4.0), ("X", 100, 103, 5.0), ("X", 200, 205, 6.0), ("X", 210, 215, 7.0)]
    for packed in (True, False):
        path = tmp_path / f"{packed}.bw"
        path.write_bytes(bigwig_file(["chr1", "chrX"], blocks, packed))
        signal = rd.bigwig(spark, f"file://{path}")
        assert sorted(map(tuple, signal.collect())) == want
    points = spark.createDataFrame([("1", 5), ("1", 6), ("1", 10), ("1", 11), ("X", 202), ("X", 206)], "chrom string, pos long")
    got = {(r.chrom, r.pos): r.value for r in point_in_interval(points, signal, ["chrom"], "pos", "start", "end", 64.0, how="left").collect()}
    assert got == {("1", 5): None, ("1", 6): 1.5, ("1", 10): 1.5, ("1", 11): None, ("X", 202): 6.0, ("X", 206): None}
    (tmp_path / "no.bw").write_bytes(b"x" * 100)
    with pytest.raises(Exception):
        rd.bigwig(spark, f"file://{tmp_path}/no.bw").collect()
