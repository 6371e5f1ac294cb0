"""Base rules against plain counts; the language model against textbook formulas."""

import math
import random
import re
from collections import Counter

import numpy as np

from strandset.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts():
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "a a a a a a", "x\nx\n\n\nx y\nx", "é # *** é\x0b\x0cb\r\nb\r", " nbsp inside", "a b c d e\n" * 3000]
    for _ in range(200):
        texts.append("".join(rng.choice(["a", "b", "ü", " ", " ", "\n", "#", "\t"]) for _ in range(rng.randint(0, 120))))
    for t in texts:
        assert quality.base_counts(t) == plain_base(t)


def plain_kn(texts):
    """Modified Kneser-Ney by its definition, from one list of texts."""
    full = Counter(int(g) for t in texts for g in quality.gram_ids(t))
    A, N = quality.VOCABULARY, quality.ORDER
    levels = {N: full}
    for n in range(N - 1, 0, -1):
        levels[n] = Counter(g % A**n for g in levels[n + 1])
    ds = {}
    for n, c in levels.items():
        m = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1]) if m[0] + 2 * m[1] else 0
        ds[n] = {}
        for k, default in ((1, 0.5), (2, 1.0), (3, 1.5)):
            r = k - (k + 1) * y * m[k] / m[k - 1] if min(m[:3]) > 0 else -1
            ds[n][k] = r if 0 <= r <= k else default

    def p(n, gram):
        if n == 0:
            return 1 / A
        c, ctx = levels[n], gram // A
        own = {g: v for g, v in c.items() if g // A == ctx}
        if not own:
            return p(n - 1, gram % A ** (n - 1))
        total = sum(own.values())
        d = {g: min(ds[n][min(v, 3)], v) for g, v in own.items()}
        here = (own.get(gram, 0) - d.get(gram, 0)) / total
        return here + sum(d.values()) / total * p(n - 1, gram % A ** (n - 1))

    return lambda gram: math.log(p(N, gram))


def test_model_is_modified_kneser_ney(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log.", "A cat, a dog!", None]
    df = spark.createDataFrame([(i, t, "en" if i else None, 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, c int")
    counts = quality.count_grams(df.where("doc_id > 0"))
    model = quality.load_model(quality.kneser_ney(counts))
    want = plain_kn(texts[1:3])
    seen = np.unique(np.concatenate([quality.gram_ids(t) for t in texts[1:3]]))
    unseen = quality.gram_ids("the zebra sat; 99 mats")
    for grams in (seen, unseen):
        got = model.log_probability("en", grams)
        assert np.allclose(got, [want(int(g)) for g in grams], atol=1e-5)
    # probabilities after a context add up to one
    ctx = int(seen[len(seen) // 2]) >> quality.BITS << quality.BITS
    assert abs(np.exp(model.log_probability("en", np.arange(ctx, ctx + quality.VOCABULARY, dtype=np.uint64))).sum() - 1) < 1e-4


def test_scripts_and_letters_differ():
    grams = [set(quality.gram_ids(t)[3:].tolist()) for t in ("река", "рекЕ", "長い川辺", "αβγδ", "abcd", "abcD", "ab😀😁")]
    assert len(set.union(*grams)) == sum(map(len, grams))
    many = "".join(chr(0x4E00 + k) for k in range(600)) * 2
    for text in (many, "plain text, plain text"):
        ids, counts = quality.distinct_grams([quality.characters(text), quality.characters("x")])
        assert dict(zip(ids.tolist(), counts.tolist())) == Counter(quality.gram_ids(text).tolist() + quality.gram_ids("x").tolist())


def plain_judge(rows):
    """Kept documents by the definition: own model and band for each language."""
    out = {}
    for lang in {x for _, _, x in rows}:
        own = [(i, t or "") for i, t, x in rows if x == lang]
        prob = plain_kn([t for _, t in own if t])
        known = {}
        ppl = {}
        for i, t in own:
            logs = [known.setdefault(int(g), prob(int(g))) for g in quality.gram_ids(t)]
            cuts = [*range(0, max(1, len(logs) // quality.WINDOW) * quality.WINDOW, quality.WINDOW)]
            ends = [*cuts[1:], len(logs)]
            ppl[i] = -float(np.median([np.mean(logs[a:b]) for a, b in zip(cuts, ends)])) if logs else 0.0
        v = sorted(round(ppl[i] * 1000) for i, t in own if t)
        mid = v[(len(v) + 1) // 2 - 1] if v else 0
        off = sorted(abs(x - mid) for x in v)
        dev = max(1.4826 * off[(len(off) + 1) // 2 - 1] / 1000, quality.LEAST_DEVIATION) if v else 0
        for i, t in own:
            n = plain_base(t)
            failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
            edge = abs(ppl[i] - mid / 1000) - 3 * dev - quality.MARGIN / math.sqrt(max(len(t), 1))
            out[i] = (failed, not failed and edge <= 0, edge)
    return out


def test_judge_equals_the_definition_in_one_block_and_many(spark):
    rng = random.Random(2)
    words = {"en": "the of river stone walks under bright morning old trees birds".split(), "ru": "река дом утро туман лодка мост старый".split(), None: "zu ab ko mi".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(8, 40))), x) for i, x in enumerate(["en"] * 12 + ["ru"] * 8 + [None] * 4)]
    rows += [(90, "река 9 x # old @ zz 7 q w e r t y", "en"), (91, "w" + " w" * 60, "ru"), (92, None, "en"), (93, "only one of its kind in this tongue, with ten words", "xx"), (94, "", None)]
    df = spark.createDataFrame([(*r, "b") for r in rows + rows[:1]], "doc_id long, text string, lang string, sums string").repartition(3)
    want = plain_judge(rows + [(900, *rows[0][1:])])
    for size in (quality.BLOCK_GRAMS, 150):
        got = quality.judge(df, size).collect()
        assert len(got) == len(rows) + 1
        for r in got:
            assert r.base_failed == want[r.doc_id][0] and (r.kept == want[r.doc_id][1] or abs(want[r.doc_id][2]) < 2e-3)


def test_bands_reject_both_ways(spark):
    rng = random.Random(9)
    words = "the of and river stone walks under bright morning quietly among old trees with little birds".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(120)), "en") for i in range(300)]
    rows += [(1000, "".join(rng.choice("qzxjkvw ") for _ in range(900)), "en"), (1001, " ".join(rng.choice(["aaaa", "aaab", "aaaab", "aabaa"]) for _ in range(300)), "en"), (1002, None, None), (1003, "short text", "en"), (1004, "one two three four five " * 30, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, n_words int").repartition(7)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    kept = sum(got[i].kept for i in range(300))
    assert kept >= 290
    assert not got[1000].kept and not got[1000].base_failed
    assert not got[1002].kept and got[1002].base_failed and got[1003].base_failed and got[1004].base_failed
    for i, t, _ in rows:
        r = got[i]
        n = plain_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b", None), (1, "a b", None)], "doc_id long, text string, lang string")
    assert quality.judge(df).count() == 2
    assert quality.judge(df.where("doc_id = 9")).count() == 0
