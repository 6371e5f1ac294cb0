"""Token ids, Re-Pair shards and best-fit packing against plain versions."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandset.llm import packing, repair
from strandset.llm.tokens import default_tokenizer, encoder

ODD = ["", None, "a b c", "x​y", "İstanbul 'S don't, it's.", "é é ́x", "\x1c\x1d a\x85b", "<|endoftext|> <|startoftext|>hi", "ﬁ Ａ", "a b", "Word, Word. WORD,. word ...", "w" * 3000, "the end " * 5000]


def docs(spark, texts, first=0):
    rows = [(first + i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, offset int").repartition(5)


def plain(texts):
    tok = Tokenizer.from_file(default_tokenizer())
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_chunked_ids_equal_whole_text_ids():
    enc = encoder(default_tokenizer())
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(ODD)] == plain(ODD)


def most_frequent(seq, starts):
    """The most disjoint places of one pair inside documents."""
    last, count = {}, {}
    for at, pair in enumerate(zip(seq, seq[1:])):
        if not starts[at + 1] and last.get(pair, -2) < at - 1:
            last[pair], count[pair] = at, count.get(pair, 0) + 1
    return max(count.values(), default=0)


def check_grammar(ids, fence, first_new, min_pair):
    seq, rules, lengths, starts = repair.compress(ids, first_new, min_pair, fence)
    assert (repair.expand(seq, rules, lengths, first_new) == ids).all()
    assert (repair.expand_only(seq, rules, first_new) == ids).all()
    assert lengths.tolist() == [len(repair.expand_only(np.array([first_new + k]), rules, first_new)) for k in range(len(rules))]
    assert starts.sum() == fence.sum()
    assert most_frequent(seq.tolist(), starts.tolist()) < min_pair
    return seq, rules, lengths, starts


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(5)
    for size, letters, min_pair in ((4000, 6, 16), (3000, 2, 2), (500, 1, 3), (1, 1, 2), (0, 1, 2), (5000, 500, 4)):
        ids = rng.integers(0, letters, size).astype(np.uint16)
        fence = np.zeros(size, bool)
        fence[::100] = True
        check_grammar(ids, fence, 1000, min_pair)


def test_long_repeats_shrink_to_few_symbols():
    ids = np.tile(np.arange(1000, dtype=np.uint16), 128)
    seq, rules, _, _ = check_grammar(ids, np.arange(len(ids)) == 0, 60_000, 16)
    assert len(seq) <= 256


def test_wide_vocabulary_compresses_too():
    ids = np.tile(np.arange(70_000, 70_020, dtype=np.uint32), 50)
    seq, _, _, _ = check_grammar(ids, np.arange(len(ids)) == 0, 100_000, 4)
    assert len(seq) < 100


def test_one_document_reads_only_its_rules():
    rng = np.random.default_rng(1)
    docs_ = [np.tile(rng.permutation(6), 20) + 10 * k for k in range(4)]
    raws = [d.astype("<u2").tobytes() for d in docs_]
    part = repair._shard(0, 0, [0, 1, 2, 3], raws, np.dtype("<u2"), 100)
    row = dict(zip([c.split(" ")[0] for c in repair.SHARD_SCHEMA.split(", ")], part))
    rules, lengths, seq = repair._arrays(row)
    used, todo = set(), [s - 100 for s in seq[: int(np.frombuffer(row["doc_symbols"], "<u4")[0])].tolist() if s >= 100]
    while todo:
        k = todo.pop()
        used.add(k)
        todo += [s - 100 for s in rules[k].tolist() if s >= 100 and s - 100 not in used]
    assert used and len(used) < len(rules)
    broken = rules.copy()
    broken[[k for k in range(len(rules)) if k not in used]] = 2**32 - 1
    row["rules"] = broken.tobytes()
    assert repair.decode_document(row, 0).tolist() == docs_[0].tolist()
    for a, b in ((0, 1), (5, 5), (17, 60), (119, 120), (-7, None)):
        assert repair.decode_document(row, 0, a, b).tolist() == docs_[0][a:b].tolist()


def test_stored_lengths_place_the_symbols():
    raws = [np.tile(np.arange(8), 30).astype("<u2").tobytes()]
    row = dict(zip([c.split(" ")[0] for c in repair.SHARD_SCHEMA.split(", ")], repair._shard(0, 0, [0], raws, np.dtype("<u2"), 100)))
    want = repair.decode_document(row, 0, 100, 108).tolist()
    lengths = np.frombuffer(row["lengths"], "<u4").copy()
    row["lengths"] = (lengths + 1).tobytes()
    assert repair.decode_document(row, 0, 100, 108).tolist() != want or len(lengths) == 0


def test_written_blocks_read_back(spark):
    texts = ODD * 3
    want, at = {}, 0
    for i, ids in enumerate(plain(texts)):
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in repair.round_trip(docs(spark, texts)).collect()}
    assert got == want


def test_one_document_of_a_block(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    repair.write_shards(docs(spark, ODD), path, partitions=1, shard_tokens=500)
    rows = [r.asDict() for r in spark.read.parquet(path).orderBy("part", "shard").collect()]
    want = plain(ODD)
    assert len(rows) > 1
    for row in rows:
        for k, doc in enumerate(row["doc_ids"]):
            assert repair.decode_document(row, k).tolist() == want[doc]


def test_empty_table(spark):
    none = docs(spark, ["x"]).where("doc_id < 0")
    assert repair.round_trip(none).count() == 0
    assert packing.pack_documents(none).count() == 0


def naive(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [(b, i) for i, b in enumerate(bins) if b >= x]
        if fits:
            bins[min(fits)[1]] -= x
        else:
            bins.append(capacity - x)
    return sorted(bins)


def test_plan_equals_one_by_one():
    rng = random.Random(1)
    for capacity in (10, 17, 64):
        for _ in range(100):
            items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 60))]
            plan = packing.plan_bins({x: items.count(x) for x in items}, capacity)
            space = {}
            for length, rank, n, first, offset in plan.itertuples(index=False):
                for k in range(n):
                    space.setdefault(first + k, []).append((offset, length))
            for parts in space.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
            assert sorted(capacity - sum(x for _, x in v) for v in space.values()) == naive(items, capacity)


def check_packed(rows, want, capacity):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, ids in enumerate(want):
        cut = [ids[k : k + capacity] for k in range(0, len(ids), capacity)]
        assert sorted(by_doc[doc]) == [(k, k * capacity, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    return len(by_seq)


def test_packing_of_documents(spark):
    texts = ODD + [f"w{i} " * (i % 40) for i in range(300)] + ["same"] * 200
    want = plain(texts)
    n = check_packed(packing.pack_documents(docs(spark, texts), 64).collect(), want, 64)
    lengths = [len(x[k : k + 64]) for x in want for k in range(0, len(x), 64)]
    assert n == len(naive(lengths, 64))


def test_sequences_hold_the_ids(spark):
    texts = ODD + ["one two three"] * 30
    rows = packing.sequences(docs(spark, texts), 32).collect()
    width = encoder(default_tokenizer()).dtype
    assert all(r.n_tokens <= 32 and len(r.ids) == 4 * r.n_tokens for r in rows)
    got = sorted(i for r in rows for i in np.frombuffer(r.ids, "<u4").tolist())
    assert got == sorted(i for ids in plain(texts) for i in ids) and width.itemsize == 2


def test_duplicate_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b"), (3, "b")], "doc_id long, text string")
    assert packing.pack_documents(df, 8).agg(F.count("*")).first()[0] == 4
    assert repair.round_trip(df).count() == 4
