"""Personal data: high-recall generators, boosted trees over their spans, calibrated thresholds.

Generators propose spans by pattern; spans of different generators may overlap.  Those
that meet the base rules (email, ip, card, phone) always stay.  For the rest, boosted trees
score each span by its format (length, share of digits, kinds of characters, separators,
equal groups) and context (the characters beside it, digits just before it).

The trees learn from evidence that is neither the pattern nor a feature: a word before the
span that says what it is ("tel", "password =", a country code) or that it is something
else ("ISBN", "pages", a currency sign), a checksum, the make-up of an assigned value.  A
span with evidence for it is a 1, with evidence against it a 0, and most have none and are
only scored.  All features are small whole numbers, so the trees are fitted on counts by
feature cell over *all* documents: at most ``CELLS`` rows for each of two folds reach the
driver, whatever the corpus.  One document in ``FOLDS`` (by hash) is held out of the trees;
for each generator the threshold is the least score at which the share of 1s among what
its held-out labelled spans have above it is ``PRECISION`` (among all labelled spans where
fewer than ``LEAST_HELD_OUT`` are held out; without labelled spans it takes none).

A span above its threshold and without evidence against it is added unless it meets a
base span; of added spans that meet, going by place, the one with the higher score stays.

All of it is DataFrame functions; the trees are CASE expressions.  Rows are independent
but for the counts, which are partly aggregated before their small shuffle.

Defined results: null text counts as empty; a text without spans gives zero counts and empty
strings; repeated rows are searched each; an empty table gives no rows; other columns are
ignored.  Places are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ["email", "ip", "card", "phone", "secret"]
WORDY = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\x20]*[=:][\x20]*\"?[A-Za-z0-9+/_-]{6,}={0,2}\"?"
#: kind, pattern, and what a text must contain for the pattern to be tried; repeated groups
#: are possessive, which Java matches in a loop where it would otherwise recurse
GENERATORS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "@"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    ("secret", WORDY, r"[=:]"),
    ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}", r"[0-9]"),
    ("email", r"[A-Za-z0-9._%+-]+[\x20]?[(\[]at[)\]][\x20]?[A-Za-z0-9-]+(?:[\x20]?(?:[(\[]dot[)\]]|\.)[\x20]?[A-Za-z0-9-]+)++", r"[(\[]at[)\]]"),
    ("phone", r"(?<![0-9.+])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9.])", r"[0-9][\x20./-][0-9]"),
]
BASE = 4
FEATURES = ["gen", "length", "digits", "mix", "left", "right", "sep", "groups", "near"]
LEVELS = [len(GENERATORS), 4, 4, 4, 3, 3, 4, 2, 2]
CELLS = math.prod(LEVELS)
#: Words right before a span that say what it is, or that it is no personal data.
PHONE_CUE = r"(?i)(?:\b(?:tel|telephone|telefon|phone|call|mobile|cell|fax|whatsapp)\b[^\w+]*|\+[0-9]{1,3}[\x20]?)$"
SECRET_CUE = r"(?i)(?:password|passwd|pwd|secret|token|bearer|authorization|key)[\x20]*[=:]?[\x20]*\"?$"
NO_PHONE_CUE = r"(?i)(?:\b(?:isbn|issn|doi|pages?|pp|seiten?|no|nr|num|order|invoice|serial|version|dates?|years?|usd|eur|chf)\b[^\w]*|[€$£]\x20?)$"
PRECISION = 0.95
FOLDS, LEAST_HELD_OUT = 5, 20
TREES, DEPTH, RATE = 20, 3, 0.3


#: Rows that are folded together; an array that grows by one is copied no longer than this.
FOLD_ROWS = 64
#: Characters before a span that count as its context.
CONTEXT = 24


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(rows: Column) -> Column:
    """An array in runs of ``FOLD_ROWS``."""
    last = F.floor((F.size(rows) - 1) / FOLD_ROWS).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(rows, k * FOLD_ROWS + 1, F.lit(FOLD_ROWS)))
    return F.when(F.size(rows) > 0, runs).otherwise(F.slice(runs, F.lit(1), F.lit(0)))


def fold_rows(rows: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """``state, out`` after all rows of an array: ``step`` of a state and a row gives the next state and an array of what it puts out.

    Long arrays are folded run by run, so the time is near linear where one growing result
    would be copied for every row.
    """

    def run(acc: Column, block: Column) -> Column:
        def one(a: Column, row: Column) -> Column:
            new, out = step(a["state"], row)
            return F.struct(new.alias("state"), F.concat(a["out"], out).alias("out"))

        begin = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        # what an aggregate ends with is not copied, unlike what a transform gives
        return F.aggregate(block, begin, one, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    begin = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return _let(rows, lambda held: F.aggregate(_blocks(held), begin, run, lambda r: F.struct(r["state"].alias("state"), F.flatten(r["out"]).alias("out"))))


SPAN = "struct<start:int,end:int,m:string,before:string,after:string>"


def _spans(text: Column, gen: int) -> Column:
    """Leftmost non-overlapping matches of a generator with their places and the characters beside them."""
    kind, pattern, guard = GENERATORS[gen]

    def placed(found: Column) -> Column:
        return _let(F.split(text, pattern, -1), lambda between: F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("b"), found.alias("m"), F.slice(between, F.lit(2), F.size(found)).alias("n"), F.slice(F.concat(found, F.array(F.lit(""))), F.lit(2), F.size(found)).alias("o")))

    def step(state: Column, p: Column) -> tuple[Column, Column]:
        begin = state["at"] + F.length(p["b"])
        end = begin + F.length(p["m"])
        before = F.right(F.concat(state["tail"], F.right(p["b"], F.lit(CONTEXT))), F.lit(CONTEXT))
        span = F.struct(begin.alias("start"), end.alias("end"), p["m"].alias("m"), before.alias("before"), F.left(F.concat(F.left(p["n"], F.lit(1)), F.left(p["o"], F.lit(1))), F.lit(1)).alias("after"))
        tail = F.right(F.concat(before, F.right(p["m"], F.lit(CONTEXT))), F.lit(CONTEXT))
        return F.struct(end.alias("at"), tail.alias("tail")), F.array(span)

    pairs = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    found = fold_rows(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), SPAN, step)["out"]
    return F.when(text.rlike(guard), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _luhn(number: Column) -> Column:
    digits = F.split(F.reverse(number), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, 2 * d.try_cast("int") - F.when(d.try_cast("int") > 4, 9).otherwise(0)).otherwise(d.try_cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _base_rule(gen: int, m: Column) -> Column:
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    if gen == 1:
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).try_cast("int") <= 255))
    if gen == 2:
        return n.between(12, 19) & _luhn(F.regexp_replace(m, "[^0-9]", ""))
    return n.between(9, 15) if gen == 3 else F.lit(True)


def _evidence(gen: int, m: Column, before: Column) -> Column:
    """1: evidence that the span is what its generator proposes; 0: that it is not; -1: neither."""
    if gen < BASE:
        return F.when(_base_rule(gen, m), 1).otherwise(0)
    if gen == 4:
        value = F.regexp_replace(m, r"^[^=:]*[=:][\x20]*\"?|\"$", "")
        return F.when(~value.rlike("[0-9]"), 0).when(value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 6), 1).otherwise(-1)
    if gen == 5:
        worded = m.rlike(r"^(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/+]+(?:[A-Za-z]+|[0-9]{1,4}))*+$") & m.rlike("[-_/+]")
        return F.when(m.rlike("^[0-9]+$") | worded | before.rlike(r"(?i)(?:/|https?:|www\.)$"), 0).when(before.rlike(SECRET_CUE), 1).otherwise(-1)
    if gen == 6:
        return F.when(m.rlike(r"(?:\.|[)\]])[\x20]?[A-Za-z]{2,6}$"), 1).otherwise(0)
    years = m.rlike(r"^(?:1[5-9]|20)[0-9]{2}[^0-9]+(?:1[5-9]|20)[0-9]{2}[^0-9]+(?:1[5-9]|20)[0-9]{2}$")
    return F.when(before.rlike(NO_PHONE_CUE) | years, 0).when(before.rlike(PHONE_CUE), 1).when(m.rlike(GROUPED), 0).otherwise(-1)


#: A number in groups of three with one separator.
GROUPED = r"^[0-9]{1,3}([.\x20/-])[0-9]{3}\1[0-9]{3}$"


def _beside(c: Column) -> Column:
    return F.when(c.rlike(r"^[\p{L}\p{N}]$"), 1).when((c == "") | c.rlike(r"^\s$"), 0).otherwise(2)


def _features(gen: int, m: Column, before: Column, after: Column) -> list[Column]:
    n = F.length(m)
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    mix = sum((m.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]")), F.lit(0))
    kinds = F.size(F.array_distinct(F.split(F.regexp_replace(m, "[A-Za-z0-9]", ""), "")))
    sep = F.when(m.rlike(r"^[A-Za-z0-9]*$"), 0).when(m.rlike(r"[()]"), 3).when(kinds > 1, 2).otherwise(1)
    length = F.when(n < 8, 0).when(n < 16, 1).when(n < 32, 2).otherwise(3)
    return [F.lit(gen), length, F.least(F.floor(4 * digits / n), F.lit(3)), F.greatest(mix, F.lit(1)) - 1, _beside(F.right(before, F.lit(1))), _beside(after), sep, m.rlike(GROUPED).cast("int"), before.rlike("[0-9]").cast("int")]


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: every proposed span with its features; small numbers only, no text."""
    text = F.coalesce("text", F.lit(""))

    def described(gen: int) -> Column:
        def one(s: Column) -> Column:
            m, before = s["m"], s["before"]
            values = _features(gen, m, before, s["after"])
            return F.struct(F.lit(KINDS.index(GENERATORS[gen][0])).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _evidence(gen, m, before).alias("label"), *[v.cast("int").alias(f) for v, f in zip(values, FEATURES)])

        return F.transform(_spans(text, gen), one)

    return docs.select("doc_id", F.concat(*[described(g) for g in range(len(GENERATORS))]).alias("spans"))


# --- boosted trees over counted cells --------------------------------------------------


def _leaf(rows: list[tuple], grad: list[float], hess: list[float]) -> float:
    return -sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + 1.0)


def _grow(x: list[tuple], rows: list[int], grad: list[float], hess: list[float], depth: int):
    """A leaf value, or ``(feature, level, left, right)``: left where the feature is at most the level."""
    g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    best = (1e-6, None)
    if depth:
        for f in range(len(FEATURES)):
            sums: dict[int, list[float]] = {}
            for i in rows:
                s = sums.setdefault(x[i][f], [0.0, 0.0])
                s[0] += grad[i]
                s[1] += hess[i]
            gl = hl = 0.0
            for level in sorted(sums)[:-1]:
                gl, hl = gl + sums[level][0], hl + sums[level][1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                if gain > best[0]:
                    best = (gain, (f, level))
    if best[1] is None:
        return _leaf(rows, grad, hess)
    f, level = best[1]
    left, right = [i for i in rows if x[i][f] <= level], [i for i in rows if x[i][f] > level]
    return (f, level, _grow(x, left, grad, hess, depth - 1), _grow(x, right, grad, hess, depth - 1))


def _apply(tree, x: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def fit_trees(cells: list[tuple[tuple, int, int]], held_out: list[tuple[tuple, int, int]] | None = None) -> tuple[list, list[float]]:
    """Trees from ``(features, n, n of label 1)`` cells, and the score threshold of each generator from held-out cells."""
    cells = sorted(cells)
    x = [c[0] for c in cells]
    score = [0.0] * len(x)
    trees = []
    for _ in range(TREES if cells else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [n * pi - k for pi, (_, n, k) in zip(p, cells)]
        hess = [max(n * pi * (1 - pi), 1e-9) for pi, (_, n, _) in zip(p, cells)]
        tree = _grow(x, list(range(len(x))), grad, hess, DEPTH)
        trees.append(tree)
        score = [s + RATE * _apply(tree, xi) for s, xi in zip(score, x)]
    thresholds = []
    for gen in range(len(GENERATORS)):
        own = [c for c in held_out or [] if c[0][0] == gen]
        if sum(n for _, n, _ in own) < LEAST_HELD_OUT:
            own = own + [c for c in cells if c[0][0] == gen]
        own = sorted(((total_score(trees, xi), n, k) for xi, n, k in own), reverse=True)
        total = good = 0
        least = math.inf
        for i, (s, n, k) in enumerate(own):
            total, good = total + n, good + k
            if good >= PRECISION * total and (i + 1 == len(own) or own[i + 1][0] < s):
                least = s
        thresholds.append(least)
    return trees, thresholds


def total_score(trees: list, x: tuple) -> float:
    return RATE * sum(_apply(t, x) for t in trees)


def _case(tree, span: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(span[FEATURES[tree[0]]] <= tree[1], _case(tree[2], span)).otherwise(_case(tree[3], span))


def fit(found: DataFrame) -> tuple[list, list[float]]:
    """Trees and thresholds from all labelled spans of ``found`` (as :func:`candidates` gives them)."""
    fold = (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0).alias("held")
    each = found.select(fold, F.explode(F.filter("spans", lambda s: s["label"] >= 0)).alias("s")).select("held", "s.*")
    counted = each.groupBy("held", *FEATURES).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("k"))
    rows = counted.collect()  # at most 2 * CELLS rows
    cells = {held: [(tuple(r[f] for f in FEATURES), r.n, r.k) for r in rows if r.held == held] for held in (False, True)}
    return fit_trees(cells[False] or cells[True], cells[True])


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans``: the base spans and all selected spans, each ``start, kind, end``."""
    found = materialize(candidates(docs), "spans")
    trees, thresholds = fit(found)

    def scored(s: Column) -> Column:
        total = sum((_case(t, s) for t in trees), F.lit(0.0)) * RATE
        least = F.lit(math.inf)
        for gen, value in enumerate(thresholds):
            least = F.when(s["gen"] == gen, F.lit(float(value))).otherwise(least)
        base = (s["gen"] < BASE) & (s["label"] == 1)
        # sums of the same trees are compared with a hair's tolerance
        take = (s["gen"] >= BASE) & (s["label"] != 0) & (total + 1e-9 >= least)
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), base.alias("base"), take.alias("take"), F.round(total * 1e6).cast("long").alias("score"))

    def plain(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))

    rows = found.select("doc_id", F.sort_array(F.filter(F.transform("spans", scored), lambda s: s["base"] | s["take"])).alias("s"))
    span = "struct<start:int,kind:int,end:int>"
    nothing = F.lit(None).cast("struct<start:int,kind:int,end:int,base:boolean,take:boolean,score:bigint>")

    def step(state: Column, s: Column) -> tuple[Column, Column]:
        cur = state["cur"]
        meets = F.coalesce(s["start"] < cur["end"], F.lit(False))
        done = F.when(cur.isNotNull() & ~meets, F.array(plain(cur))).otherwise(F.array().cast(f"array<{span}>"))
        new = F.when(s["base"], nothing).when(s["start"] < state["reach"], F.when(meets, cur).otherwise(nothing)).when(meets & (s["score"] <= cur["score"]), cur).otherwise(s)
        return F.struct(new.alias("cur"), F.when(s["base"], F.greatest(state["reach"], s["end"])).otherwise(state["reach"]).alias("reach")), done

    folded = fold_rows(F.col("s"), F.struct(nothing.alias("cur"), F.lit(0).alias("reach")), span, step)
    more = _let(folded, lambda r: F.when(r["state"]["cur"].isNull(), r["out"]).otherwise(F.concat(r["out"], F.array(plain(r["state"]["cur"])))))
    base = F.transform(F.filter("s", lambda s: s["base"]), plain)
    return rows.select("doc_id", base.alias("base"), F.sort_array(F.concat(base, more)).alias("spans"))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text."""
    def of_kind(k: int):
        return lambda s: s["kind"] == k

    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return find(docs).select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with each selected span replaced by its kind in brackets."""
    own = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
    spans = find(own.dropDuplicates(["doc_id", "_h"]).select(F.struct("doc_id", "_h").alias("doc_id"), "text"))
    spans = spans.select(F.col("doc_id.doc_id").alias("_d"), F.col("doc_id._h").alias("_t"), "spans")
    joined = own.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_h").eqNullSafe(F.col("_t")))
    names = F.array(*[F.lit(k) for k in KINDS])

    def pieces(state: Column, block: Column) -> tuple[Column, Column]:
        # one stretch of text for a run of spans, so that places are counted from near by
        end = F.greatest(state, F.array_max(F.transform(block, lambda s: s["end"])))

        def cut(stretch: Column) -> Column:
            def one(at: Column, s: Column) -> tuple[Column, Column]:
                kept = F.substring(stretch, at - state + 1, F.greatest(s["start"] - at, F.lit(0)))
                return F.greatest(at, s["end"]), F.array(F.concat(kept, F.lit("["), F.get(names, s["kind"]), F.lit("]")))

            return fold_rows(block, state, "string", one)["out"]

        return end, _let(F.substring(F.col("text"), state + 1, end - state), cut)

    def whole(spans: Column) -> Column:
        return _let(fold_rows(_blocks(spans), F.lit(0), "string", pieces), lambda r: F.concat(F.array_join(r["out"], ""), F.substring(F.col("text"), r["state"] + 1, F.length("text"))))

    return joined.select("doc_id", _let(F.col("spans"), whole).alias("text"))
