"""Benchmark decontamination against unbanded alignment of every segment."""

import random
import re

import numpy as np

from strandset.llm import decontam as d


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        s[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [s[k], rng.choice("xyz")]])
    return "".join(s)


def least_edits(segment, x):
    """Fewest edits of a segment against any part of x (whole table)."""
    row = np.zeros(len(x) + 1, int)
    for ch in segment:
        diag = row[:-1] + (x != ch)
        new = np.concatenate(([row[0] + 1], np.minimum(diag, row[1:] + 1)))
        new = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        row = new
    return int(row.min())


def plain(docs, items):
    out = {}
    for doc, t in docs:
        x = d.codes(t)
        for item, body in items:
            y = d.codes(body)
            if len(y) < d.Q:
                whole, part = "".join(map(chr, x)), "".join(map(chr, y))
                if part and re.search(r"(?<![^\W_])" + re.escape(part) + r"(?![^\W_])", whole):
                    out[doc, item] = len(y)
                continue
            size = min(len(y), d.SEGMENT)
            hit = np.zeros(len(y), bool)
            for k in sorted({*range(0, len(y) - size + 1, d.SEGMENT // 2), len(y) - size}):
                if len(x) and least_edits(y[k : k + size], x) <= max(0, (size - d.Q) // d.Q):
                    hit[k : k + size] = True
            covered = int(hit.sum())
            if covered >= d.COVERAGE * len(y):
                out[doc, item] = covered
    return out


def fixture():
    rng = random.Random(8)
    items = [(i, text(rng, rng.choice([3, 8, 14, 40, 70]))) for i in range(24)] + [(90, None), (91, ""), (92, "tiny"), (94, "hello"), (93, items0(rng))]
    docs = []
    for k in range(80):
        body = text(rng, rng.choice([0, 5, 60, 200]))
        item = items[rng.randrange(24)][1]
        how = k % 8
        if how == 1:
            body += "\n" + item.upper() + " " + text(rng, 4)
        elif how == 2:
            body = edit(rng, item, rng.randint(1, 5)) + body
        elif how == 3:
            body += item[: len(item) * 2 // 3]
        elif how == 4:
            body += item[: len(item) // 5] + body
        elif how == 5:
            body = item.replace(" ", "\n\t", 3) + item
        docs.append((k, body))
    return docs + [(500, None), (501, ""), (502, "z " * 3000), (504, "xx Hello, yy"), (505, "xx othello yy"), (503, items[3][1])], items


def items0(rng):
    return "same words " * 30


def test_equals_whole_alignment(spark):
    docs, items = fixture()
    a = spark.createDataFrame([(i, t, "e", 0) for i, t in docs], "doc_id long, text string, item_id string, start int").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered for r in d.contaminated(a, b).collect()}
    want = plain(docs, items)
    assert got == want and len(want) > 25


def test_span_is_where_the_item_is(spark):
    rng = random.Random(1)
    item = text(rng, 30)
    head = text(rng, 50) + "\n"
    row = d.matches(head + item + " tail", d.build_index([(7, item)]))
    assert [(r[0], r[1], r[2], r[4]) for r in row] == [(7, len(head), len(head) + len(item), 0)]


def test_blocks_of_the_query_set(spark):
    b = spark.createDataFrame([(i, "x" * 30) for i in range(10)] + [(11, "y" * 500), (12, None)], "item_id long, text string")
    parts = list(d.blocks(b, 100))
    assert sum(map(len, parts)) == 11 and all(sum(len(t) for _, t in p) <= 100 or len(p) == 1 for p in parts)


def test_empty_tables_and_stage(spark):
    docs, items = fixture()
    a = spark.createDataFrame([*docs, docs[1], (None, docs[1][1])], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert d.contaminated(a.where("doc_id < 0"), b).count() == 0 and d.contaminated(a, b.where("item_id < 0")).count() == 0
    dirty = {k for k, _ in plain(docs, items)}
    kept = d.without_leaks(a, b).collect()
    assert {r.doc_id for r in kept} == {k for k, _ in docs} - dirty
    one = d.contaminated(a.where("doc_id = 1"), b).count()
    assert one in (0, 2 * len([k for k in plain(docs, items) if k[0] == 1]))


def plain_hash(x, q):
    out = []
    for i in range(len(x) - q + 1):
        h = 0
        for v in x[i : i + q]:
            h = (h * int(d.MULT) + int(v)) % 2**64
        out.append(h)
    return out


def test_qgram_hashes_are_polynomials():
    x = np.random.default_rng(1).integers(0, 1000, 60).astype(np.uint32)
    for q in range(1, 12):
        assert d.qgram_hashes(x, q).tolist() == plain_hash(x, q)
        assert len(d.qgram_hashes(x[: q - 1], q)) == 0 and len(d.qgram_hashes(x[:q], q)) == 1


def test_lightly_changed_items_are_found():
    rng = random.Random(12)
    item = text(rng, 18)[:100]
    index = d.build_index([(1, item)])
    words = item.split(" ")
    for k in range(len(words)):
        changed = " ".join(words[:k] + ["somethingelse"] + words[k + 1 :])
        assert d.matches("before " + changed + " after", index), changed
    assert d.matches(item[:-10], index) and d.matches(item[12:], index) and not d.matches(item[:30], index)
    long = text(rng, 120)
    index = d.build_index([(2, long)])
    for at in range(0, len(long) // 3, 7):  # an excerpt counts wherever it starts
        assert d.matches(long[at : at + len(long) // 2 + d.SEGMENT], index)


def test_repeated_grams_take_no_memory():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert d.matches("a" * 50_000, d.build_index([(1, "a" * 200)]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_rows_are_judged_by_their_own_text(spark):
    rng = random.Random(2)
    item = text(rng, 30)
    df = spark.createDataFrame([(1, item, "a", 1), (1, "clean words", "b", 2), (None, item, "c", 3), (None, None, "d", 4)], "doc_id long, text string, _leak string, _text int")
    out = d.without_leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == df.columns and sorted(map(str, (tuple(r) for r in out.collect()))) == ["(1, 'clean words', 'b', 2)", "(None, None, 'd', 4)"]


def cheapest_ways(segment, x, low, width):
    """Least cost of a band's cells after the whole segment, one cell after the other."""
    cost = {c: 0 if 0 <= low + c <= len(x) else 10**9 for c in range(width)}
    for r, ch in enumerate(segment):
        new = {}
        for c in range(width):
            at = low + c + r
            ways = [10**9, cost.get(c + 1, 10**9) + 1]
            if 0 <= at < len(x):
                ways += [cost[c] + int(x[at] != ch), new.get(c - 1, 10**9) + 1]
            new[c] = min(ways)
        cost = new
    return min(cost.values())


def test_alignment_equals_cell_by_cell_and_bounds_are_made_once():
    rng = random.Random(6)
    index = d.build_index([(i, "".join(rng.choice("abc ") for _ in range(n))) for i, n in enumerate((12, 32, 45, 90))])
    assert index.need is index.need and index.allowed is index.allowed  # each text asks for them several times
    x = d.codes(edit(rng, "".join(map(chr, index.text)), 12))
    seg = np.repeat(np.arange(len(index.sizes)), 30)
    low = np.array([rng.randint(-40, len(x) + 5) for _ in seg])
    edits, a, b = d.aligned(x, index, seg, low)
    width = 4 * index.edits + 2
    for k, s in enumerate(seg):
        segment = index.text[index.begins[s] : index.begins[s] + index.sizes[s]]
        want = cheapest_ways(segment, x, int(low[k]) - index.edits, width)
        assert edits[k] == want or min(edits[k], want) > 10**8
        if edits[k] <= index.allowed[s]:
            assert least_edits(segment, x[a[k] : b[k]]) <= edits[k] and 0 <= a[k] <= b[k] <= len(x)
