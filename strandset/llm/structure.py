"""Repair of conversation structure by weighted finite-state composition.

Three machines are composed lazily: an acceptor of the rows of a conversation, an edit
transducer (Keep, Rerole, Delete, Insert, each with its cost), and an acceptor of the role
grammar ``(s?(ua)+)?``.  The repair is the shortest path from start to end under the
lexicographic weights (cost, labels): the cheapest edits, of equal ones the least string of
their initials.  The transducer inserts at most two turns before a row, which is all that a
shortest path can use, so the composition has no cycles and is relaxed in topological order.

A conversation is never one task's load.  Rows are counted with their copies and numbered
over ranges by Spark, then taken in segments of ``SEGMENT`` numbers.  For a segment, the
composition is solved from each grammar state to each other one, which gives a small matrix
of weights; multiplying the matrices of a conversation (one row a segment) yields the path,
and the labels go back to the rows by number.  Only what is one value by nature, the edit
string and the digest of a whole repaired conversation, is made in one place: the digest by
reading the rows in order, one batch at a time.

A row's first fault counts: *blank* (no character but white space), *duplicate* (role and
text occurred earlier in the conversation), *truncated* (the last character that is not
white space does not end a sentence).  Blank rows and duplicates must go; a truncated row
costs more if it stays.

Defined results: null roles and texts are one blank; a role without characters fits
no place of the grammar; rows go by ``turn`` (nulls first), then
role, then text, so repeated rows stand together; rows with a null ``conv_id`` are one
conversation; a conversation without rows has zeros, no edits and the digest of the empty
string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, parts

SPACE = r"\x20\x09-\x0D"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: What a truncated row costs if it stays.
TRUNCATED_COST = 3
#: Inserted turns before one row at most.
MOST_INSERTED = 2
#: Rows whose edits are solved together.
SEGMENT = 512

#: The role grammar: states and, by role initial, the next state.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = {START, ASSISTANT}
MADE = "ua"
ROLES = {"u": "user", "a": "assistant"}

Weight = tuple[int, str]
#: A symbol of the input acceptor: the initial of a row that may stay and what staying costs, or how many rows must go.
Symbol = tuple[str, int] | int


def edits(symbol: Symbol) -> Iterator[tuple[str, str | None, int]]:
    """Arcs of the edit transducer that read a symbol: (label, role initial written or None, cost)."""
    if isinstance(symbol, int):
        yield DELETE * symbol, None, COST[DELETE] * symbol
    else:
        initial, stay = symbol
        yield DELETE, None, COST[DELETE]
        yield KEEP, initial, COST[KEEP] + stay
        for made in MADE:
            yield REROLE, made, COST[REROLE] + stay


def _relax(table: dict[int, Weight], state: int, weight: Weight) -> None:
    if state not in table or weight < table[state]:
        table[state] = weight


def inserted(reached: dict[int, Weight]) -> dict[int, Weight]:
    """Best weights after up to ``MOST_INSERTED`` insertions."""
    best, layer = dict(reached), reached
    for _ in range(MOST_INSERTED):
        onward: dict[int, Weight] = {}
        for state, (cost, labels) in layer.items():
            for made in MADE:
                if (state, made) in GRAMMAR:
                    _relax(onward, GRAMMAR[state, made], (cost + COST[INSERT], labels + INSERT))
        for state, weight in onward.items():
            _relax(best, state, weight)
        layer = onward
    return best


def paths(symbols: Iterable[Symbol], start: int) -> dict[int, Weight]:
    """Best weights from a grammar state to each that a segment's symbols can end in."""
    reached: dict[int, Weight] = {start: (0, "")}
    for symbol in symbols:
        onward: dict[int, Weight] = {}
        # an insertion before rows that must go costs as much after them, and its labels come later there
        for state, (cost, labels) in (reached if isinstance(symbol, int) else inserted(reached)).items():
            for label, written, price in edits(symbol):
                after = state if written is None else GRAMMAR.get((state, written))
                if after is not None:
                    _relax(onward, after, (cost + price, labels + label))
        reached = onward
    return reached


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows damaged by the hash of conversation and turn."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    words = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), words.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``number``, from 0 in the given order: partitions by range, then each one's rows after those before."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialize(spread.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.spark_partition_id().cast("long") * (1 << 33)), "turns")
    before, total = {}, 0
    for r in sorted(written.groupBy("part").count().collect()):  # one row a partition
        before[r["part"]], total = total, total + r["count"]
    starts = written.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    out = written.join(F.broadcast(starts), "part").withColumn("number", F.col("before") + F.col("at")).drop("part", "before", "at")
    out.written_path = written.written_path
    return out


def faulty_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies, number, blank, seen, truncated`` of the distinct rows of all conversations.

    ``seen`` tells whether role and text occurred at an earlier turn; the first of
    ``copies`` equal rows is a duplicate only then, the others always are.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long")
    distinct = rows.select("conv_id", "turn", *texts, copies.alias("copies")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    key = F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)
    marked = distinct.withColumn("key", key).withColumn("place", F.struct(F.col("turn").isNotNull(), F.col("turn")))
    number = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    numbered = _numbered(marked, number)
    first = numbered.groupBy(F.col("conv_id").alias("_conv"), F.col("key").alias("_key")).agg(F.min("place").alias("first"))
    same = F.expr("conv_id <=> _conv AND key = _key")
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    out = numbered.join(first, same).select("conv_id", "turn", "role", "text", "copies", "number", blank.alias("blank"), (~F.col("place").eqNullSafe(F.col("first"))).alias("seen"), cut.alias("truncated"))
    out = materialize(out, "faulty-turns")
    discard(numbered)
    return out


def _symbols(turn: dict) -> Iterator[Symbol]:
    free = not (turn["blank"] or turn["seen"])
    if free:
        yield turn["initial"], TRUNCATED_COST * turn["truncated"]
    if turn["copies"] > free:
        yield turn["copies"] - free


_ARC = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())])
_TURN = "struct<number:long,initial:string,copies:long,blank:boolean,seen:boolean,truncated:boolean>"
#: Initials that may follow each other.
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def segment_weights(rows: DataFrame) -> DataFrame:
    """``conv_id, segment, numbers, copies, initials, illegal, arcs`` of each segment: its rows, and its composition
    solved from every grammar state to every other."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = F.struct("number", F.substring("role", 1, 1).alias("initial"), "copies", "blank", "seen", "truncated").cast(_TURN)
    segment = F.expr(f"number div {SEGMENT}").alias("segment")
    grouped = rows.groupBy("conv_id", segment).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            illegal, arcs = [], []
            for turns in batch.column(2).to_pylist():
                symbols = [s for t in turns for s in _symbols(t)]
                arcs.append([{"start": p, "end": q, "cost": c, "labels": w} for p in range(4) for q, (c, w) in paths(symbols, p).items()])
                initials = [t["initial"] for t in turns]
                illegal.append(sum(t["copies"] - 1 for t in turns) + sum(pair not in LEGAL for pair in zip(initials, initials[1:])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(illegal, pa.int64()), pa.array(arcs, pa.list_(_ARC))], ["conv_id", "segment", "turns", "illegal", "arcs"])

    solved = grouped.mapInArrow(run, f"conv_id {kind}, segment long, turns array<{_TURN}>, illegal long, arcs array<struct<start:int,end:int,cost:long,labels:string>>")
    return solved.select("conv_id", "segment", *[F.col(f"turns.{c}").alias(f"{c}s") for c in ("number", "initial")], F.col("turns.copies").alias("copies"), "illegal", "arcs")


class _Fold:
    """Product of the weight matrices of one conversation's segments, with the way back."""

    def __init__(self) -> None:
        self.cost = {START: 0}
        #: Order of the label strings that lead to each state; no two are equal, none begins with another.
        self.rank = {START: 0}
        self.back: list[tuple[int, dict[int, tuple[int, str]]]] = []
        self.illegal, self.last = 0, None

    def add(self, segment: int, initials: list[str], illegal: int, arcs: list[dict]) -> None:
        self.illegal += illegal + (self.last is not None and (self.last, initials[0]) not in LEGAL)
        self.last = initials[-1]
        best: dict[int, tuple] = {}
        for arc in arcs:
            p, q = arc["start"], arc["end"]
            if p in self.cost:
                way = (self.cost[p] + arc["cost"], self.rank[p], arc["labels"], p)
                if q not in best or way < best[q]:
                    best[q] = way
        self.back.append((segment, {q: (way[3], way[2]) for q, way in best.items()}))
        self.cost = {q: way[0] for q, way in best.items()}
        self.rank = {q: k for k, q in enumerate(sorted(best, key=lambda q: best[q][1:3]))}

    def end(self) -> tuple[int, list[tuple[int, int, str]]]:
        """Cost of the repair, and ``(segment, state before, labels)`` of each segment."""
        ways = []
        for state, cost in self.cost.items():
            for after, (more, labels) in inserted({state: (0, "")}).items():
                if after in FINAL:
                    ways.append((cost + more, self.rank[state], labels, state))
        cost, _, tail, state = min(ways)
        out = []
        for segment, back in reversed(self.back):
            state, labels = back[state]
            out.append((segment, state, labels + tail))
            tail = ""
        return cost, out[::-1]


def best_paths(segments: DataFrame) -> DataFrame:
    """``conv_id, segment, state, labels, cost, illegal``: each segment's part of its conversation's shortest path;
    cost and illegal neighbours of the whole conversation stand in its last segment, others have null."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    ends = F.array(F.element_at("initials", 1), F.element_at("initials", -1)).alias("ends")
    rows = segments.select("conv_id", "segment", ends, "illegal", "arcs").repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, conv, type_ = None, None, None

        def finished() -> Iterator[pa.RecordBatch]:
            cost, labels = fold.end()
            segment, state, own = zip(*labels)
            once = [None] * (len(labels) - 1)
            cols = [pa.array([conv] * len(labels), type_), pa.array(segment, pa.int64()), pa.array(state, pa.int32()), pa.array(own, pa.string()), pa.array([*once, cost], pa.int64()), pa.array([*once, fold.illegal], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["conv_id", "segment", "state", "labels", "cost", "illegal"])

        for batch in parts(batches, 2000):
            type_ = batch.schema.field(0).type
            for own, *row in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if fold is not None and own != conv:
                    yield finished()
                    fold = None
                if fold is None:
                    fold, conv = _Fold(), own
                fold.add(*row)
        if fold is not None:
            yield finished()

    return rows.mapInArrow(run, f"conv_id {kind}, segment long, state int, labels string, cost long, illegal long")


def written(labels: str, initials: list[str], copies: list[int], state: int) -> list[str]:
    """What each row of a segment writes: ``k`` itself, ``U`` or ``A`` itself in another role, ``u`` or ``a`` an inserted turn."""
    out, at = [], 0
    for k, (initial, n) in enumerate(zip(initials, copies)):
        own, read = "", 0
        while at < len(labels) and (read < n or k == len(copies) - 1):
            label = labels[at]
            at += 1
            read += label != INSERT
            if label != DELETE:
                made = initial if label == KEEP else "a" if state == USER else "u"
                state = GRAMMAR[state, made]
                own += "k" if label == KEEP else made.upper() if label == REROLE else made
        out.append(own)
    return out


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired turns and the repairs of conversations with ``conv_id, turn, role, text`` (and ``copies``).

    Turns: ``conv_id, number, place, role, text`` in order of number and place.  Repairs:
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.
    """
    faulty = faulty_rows(rows)
    segments = materialize(segment_weights(faulty), "turn-segments")
    ways = materialize(best_paths(segments), "turn-paths")
    free = ~(F.col("blank") | F.col("seen"))
    count = {
        "gaps": F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)),
        "blank": F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)),
        "duplicate": F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.when(F.col("seen"), 0).otherwise(1))),
        "truncated": F.sum(F.when(free & F.col("truncated"), 1).otherwise(0)),
    }
    counted = faulty.groupBy("conv_id").agg(*[c.cast("long").alias(n) for n, c in count.items()])
    labels = F.array_sort(F.collect_list(F.struct("segment", "labels")))
    audits = ways.groupBy("conv_id").agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"), F.array_join(F.transform(labels, lambda x: x["labels"]), "").alias("audit"))
    repairs = counted.join(audits.withColumnRenamed("conv_id", "_conv"), F.expr("conv_id <=> _conv")).drop("_conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out = [written(*row) for row in zip(*(batch.column(c).to_pylist() for c in range(1, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["numbers", "written"])

    both = segments.alias("s").join(ways.alias("w"), F.expr("s.conv_id <=> w.conv_id AND s.segment = w.segment"))
    lists = both.select("numbers", "labels", "initials", "copies", "state").mapInArrow(run, "numbers array<long>, written array<string>")
    row = lists.select(F.explode(F.arrays_zip("numbers", "written")).alias("r")).select(F.col("r.numbers").alias("number"), F.col("r.written").alias("written")).where("written <> ''")
    signs = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("written")), lambda k: F.substring("written", k, F.lit(1)))).alias("place", "sign")
    turns = faulty.join(row, "number").select("conv_id", "number", F.col("role").alias("_role"), F.col("text").alias("_text"), signs)
    role = F.when(F.col("sign") == "k", F.col("_role")).when(F.lower("sign") == "u", ROLES["u"]).otherwise(ROLES["a"])
    text = F.when(F.col("sign").isin("u", "a"), "").otherwise(F.col("_text"))
    return turns.select("conv_id", "number", "place", role.alias("role"), text.alias("text")), repairs


def turn_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of ``role:text`` of the repaired turns, newline-joined."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    line = F.concat_ws(":", "role", "text").cast("binary").alias("line")
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "number", "place").select("conv_id", line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, conv, type_ = None, None, None
        for batch in parts(batches):
            type_ = batch.schema.field(0).type
            convs, digests = [], []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest is not None and own != conv:
                    convs.append(conv)
                    digests.append(digest.hexdigest())
                    digest = None
                if digest is None:
                    digest, conv = hashlib.sha256(), own
                else:
                    digest.update(b"\n")
                digest.update(text.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(convs, type_), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], type_), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    return rows.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def audit_damaged(conversations: DataFrame) -> DataFrame:
    """Damage the conversations, repair them, and describe each: ``conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256``."""
    turns, repairs = repair(damage(conversations))
    digests = turn_digests(turns)
    out = conversations.select("conv_id").distinct()
    for other in (repairs, digests):
        out = out.join(other.withColumnRenamed("conv_id", "_conv"), F.expr("conv_id <=> _conv"), "left").drop("_conv")
    longs = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
