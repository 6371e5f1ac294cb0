"""Structure repair against listing all edits, and against a plain recursion."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest

from strandset.llm import queries, structure

BLANK = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def text_of(v):
    return " " if v is None else str(v)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = text_of(role), text_of(text)
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    """Per row: must go, what staying costs."""
    seen, marks, counts = set(), [], [0, 0, 0]
    for _, _, role, text in rows:
        stay = None
        if not BLANK.search(text):
            counts[0] += 1
        elif (role, text) in seen:
            counts[1] += 1
        else:
            cut = text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
            counts[2] += cut
            stay = 3 * cut
        seen.add((role, text))
        marks.append(stay)
    return marks, counts


def listed(rows, marks):
    """Every way with at most two insertions in a gap."""
    inserts = [()] + [(a,) for a in "ua"] + [(a, b) for a in "ua" for b in "ua"]
    choices = []
    for row, stay in zip(rows, marks):
        choices.append([("D", "", None)] + ([("K", row[2][:1], row[2]), ("R", "u", "user"), ("R", "a", "assistant")] if stay is not None else []))
    best = None
    names = {"u": "user", "a": "assistant"}
    for gaps in product(inserts, repeat=len(rows) + 1):
        for picked in product(*choices):
            cost, audit, written, lines = 0, "", "", []
            for k, gap in enumerate(gaps):
                for g in gap:
                    cost, audit, written = cost + 3, audit + "I", written + g
                    lines.append(names[g] + ":")
                if k < len(rows):
                    label, made, role = picked[k]
                    audit += label
                    cost += {"D": 4, "K": 0, "R": 3}[label] + (marks[k] if label != "D" else 0)
                    written += made if label != "D" else ""
                    if label != "D":
                        lines.append(f"{role}:{rows[k][3]}")
                        if len(made) != 1:
                            written += "?"
            if GRAMMAR.match(written) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(lines)
    return best


def recursive(rows, marks):
    """The best way from each place on, by what is still to come."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, room):
        ways = [(0, "", ())] if i == len(rows) and state in "0a" else []
        if room:
            ways += [(c + 3, "I" + a, (names[m] + ":", *ls)) for m in "ua" if (state, m) in step for c, a, ls in [best(i, step[state, m], room - 1)] if c is not None]
        if i < len(rows):
            c, a, ls = best(i + 1, state, 2)
            ways += [(c + 4, "D" + a, ls)] if c is not None else []
            if marks[i] is not None:
                for label, made, role in [("K", rows[i][2][:1], rows[i][2]), ("R", "u", "user"), ("R", "a", "assistant")]:
                    if (state, made) in step:
                        c, a, ls = best(i + 1, step[state, made], 2)
                        if c is not None:
                            ways.append((c + 3 * (label == "R") + marks[i], label + a, (f"{role}:{rows[i][3]}", *ls)))
        return min(ways, key=lambda w: w[:2]) if ways else (None, "", ())

    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for state in "0sua":
            best(i, state, 2)
    cost, audit, lines = best(0, "0", 2)
    return cost, audit, "\n".join(lines)


def plain(rows, solve=recursive):
    damaged = plain_damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        marks, (blank, duplicate, truncated) = faults(own)
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = solve(own, marks)
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def corpus(seed, convs, most, roles=("user", "assistant", "system", "user", "assistant", "tool", None, "")):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            turn = rng.choice([t, t, t, t + 3, None]) if rng.random() < 0.3 else t
            role = ["user", "assistant"][t % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = rng.choice(["Yes.", "No!\n", "cut off", "a. b", "Why? ", " \t", None, "", f"n{t}.", "é。", "dots. . ."])
            rows.append((c, turn, role, text))
    return rows


KIND = "conv_id long, turn long, role string, text string, number int, copies long"


def got(spark, rows, kind=KIND):
    df = spark.createDataFrame([(*r, 1, 9) for r in rows], kind).repartition(5)
    return {r[0]: tuple(r[1:]) for r in structure.audit_damaged(df).collect()}


def test_listing_equals_recursion():
    for seed in range(12):
        for conv in range(4):
            rows = [r for r in corpus(seed * 10 + conv, 1, 3)]
            damaged = plain_damage(rows)[:3]
            marks, _ = faults(damaged)
            assert listed(damaged, marks) == recursive(damaged, marks)


def test_conversations_equal_plain(spark):
    rows = corpus(1, 120, 9) + [(None, 0, "user", "null id."), (None, 1, "assistant", "yes."), (None, None, None, None), (500, 4, "user", "x.")] + corpus(2, 3, 3)
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("segment", [1, 3, 7])
def test_segments_make_no_difference(spark, monkeypatch, segment):
    monkeypatch.setattr(structure, "SEGMENT", segment)
    rows = corpus(3, 4, 60) + corpus(4, 20, 4)
    assert got(spark, rows) == plain(rows)


def test_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(structure, "SEGMENT", 64)
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["ok.", "go on", f"say {t}."])) for t in range(700)]
    rows += [(2, 0, "user", "same.")] * 300 + [(2, 1, "assistant", "fine.")]
    assert got(spark, rows) == plain(rows)


def test_repaired_turns_have_the_grammar(spark):
    rows = [r for r in corpus(5, 60, 8) if r[1] is not None]
    df = spark.createDataFrame([r for r in rows], "conv_id long, turn long, role string, text string")
    turns, repairs = structure.repair(df)
    by = {}
    for r in sorted(turns.collect()):
        by.setdefault(r.conv_id, []).append(r)
    for r in repairs.collect():
        own = by.get(r.conv_id, [])
        assert GRAMMAR.match("".join(x.role[:1] for x in own))
        assert len(own) == len(r.audit) - r.audit.count("D")
        assert sum(x.text == "" for x in own) == r.audit.count("I")


def test_empty_table(spark):
    assert got(spark, []) == {}


def test_query_on_the_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.QUERIES["op11_structure_repair"](spark, sf_dir)
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == plain(rows)
