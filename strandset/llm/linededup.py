"""Deletion of repeated runs of lines by winnowing, in DataFrame functions only.

A window is a run of consecutive non-blank lines with at least ``min_words`` words and
none to spare: forward windows start at a line, backward windows end at one.  Each window
selects the place of the least of its line hashes (the first of equal ones) as its
fingerprint; windows that overlap mostly select the same place, so far fewer places than
lines are left, and any repeated run of ``min_words`` words has one of them at the same
line as its copy.  Only these places are joined by hash, and only documents with a place
whose hash another place has go on.  There each match is extended both ways, from the place to
the left and to the right border of the windows that selected it; places meet where
fingerprint, left and right extension are equal.  The first (by ``doc_id``, then place)
stays, at later ones the lines of the window are deleted.  Forward and backward windows of
a run overlap and together cover it, so all of a run of ``min_words`` words or more that
occurred earlier goes.

Hot lines are safe: places are counted, and first places found, before the shuffle, and
every later place meets that one row only.

Defined results: a line is what ``\\n`` separates; lines without words never match and stay
unless they lie inside a deleted run; null text stays null; a text that is all deleted
becomes empty, its row stays; rows equal in ``doc_id`` and text count as one document and
are all returned; null ids come first; a run may overlap its earlier copy in the same
document; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _lines(docs: DataFrame) -> DataFrame:
    """``_doc, _text, pos, words, h1, h2`` of every line with words, together by document."""
    line = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    hashed = line.select("_doc", "_text", "pos", F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))
    return hashed.where("words > 0").repartition("_doc", "_text").dropDuplicates(["_doc", "_text", "pos"])


def _windows(lines: DataFrame, min_words: int, hashes: bool) -> DataFrame:
    """``_doc, _text, start, end, at, fingerprint`` of every window, ``at`` being the place it selects;
    with ``hashes`` also ``left`` and ``right``, hashes of its lines up to and from there."""
    doc = Window.partitionBy("_doc", "_text")
    through = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = lines.withColumn("c", F.sum("words").over(through)).withColumn("b", F.col("c") - F.col("words"))
    counted = counted.withColumn("n", F.count("*").over(through))
    forward = doc.orderBy("b").rangeBetween(0, min_words - 1)
    backward = doc.orderBy("c").rangeBetween(-(min_words - 1), 0)

    def window(frame) -> Column:
        least = F.min(F.struct("h1", "n", "pos")).over(frame)
        own = [F.sum("words").over(frame).alias("words"), F.min("pos").over(frame).alias("start"), F.max("pos").over(frame).alias("end"), least.alias("least")]
        more = [F.min("n").over(frame).alias("first"), F.collect_list(F.struct("h1", "h2")).over(frame).alias("lines")] if hashes else []
        return F.struct(*own, *more)

    both = counted.select("_doc", "_text", window(forward).alias("f"), window(backward).alias("r"))
    once = (F.col("f.start") == F.col("r.start")) & (F.col("f.end") == F.col("r.end"))
    flat = both.select("_doc", "_text", F.explode(F.when(once, F.array("f")).otherwise(F.array("f", "r"))).alias("w")).where(F.col("w.words") >= min_words)
    at = (F.col("w.least.n") - F.col("w.first") + 1).cast("int") if hashes else None
    sides = [F.xxhash64(F.slice("w.lines", F.lit(1), at)).alias("left"), F.xxhash64(F.slice("w.lines", at, F.size("w.lines"))).alias("right")] if hashes else []
    return flat.select("_doc", "_text", "w.start", "w.end", F.col("w.least.pos").alias("at"), F.col("w.least.h1").alias("fingerprint"), *sides)


def selected_places(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``_doc, _text, at, fingerprint``: the places that windows select, each once."""
    return _windows(_lines(docs), min_words, False).select("_doc", "_text", "at", "fingerprint").distinct()


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``_doc, _text, deleted``: ascending places of the lines to delete, for documents that have any."""
    places = materialize(selected_places(docs, min_words), "places")
    shared = places.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    shared = materialize(places.join(shared, "fingerprint", "left_semi").select("_doc", "_text", "at"), "shared")
    doc = ["_doc", "_text"]
    lines = _lines(docs).alias("l").join(shared.select(*doc).distinct().alias("s"), F.expr("l._doc <=> s._doc AND l._text = s._text"), "left_semi")
    windows = _windows(lines, min_words, True).alias("w")
    windows = materialize(windows.join(shared.alias("s"), F.expr("w._doc <=> s._doc AND w._text = s._text AND w.at = s.at"), "left_semi"), "windows")
    key = ["fingerprint", "left", "right"]
    place = F.struct("_doc", "_text", "start")
    first = windows.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, key).where(~place.eqNullSafe(F.col("first")))
    gone = later.select("_doc", "_text", F.explode(F.sequence("start", "end")).alias("pos"))
    return gone.groupBy("_doc", "_text").agg(F.array_sort(F.collect_set("pos")).alias("deleted"))


def _without(docs: DataFrame, min_words: int) -> DataFrame:
    """``row, text, n_lines, n_deleted``: each row as it was, its text without repeated runs, and counts of lines."""
    gone = repeated_lines(docs, min_words)
    # ``lines`` is made below the join so that the lambda reads a column, not a split per line
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    split = docs.select(rest, F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.split("text", "\n", -1).alias("lines"))
    joined = split.join(gone, F.col("id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_text")), "left")
    n = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("deleted"))
    text = F.when(F.col("deleted").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    return joined.select("row", text.alias("text"), F.coalesce(F.when(F.col("lines").isNull(), 0).otherwise(n), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.array_size("deleted"), F.lit(0)).cast("long").alias("n_deleted"))


def delete_repeated(docs: DataFrame, min_words: int = MIN_WORDS, chars: str | None = None) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``; where any was, a column ``chars`` gets the new length."""

    def column(name: str) -> Column:
        own = F.col("row").getField(name) if name != "text" else F.col("text")
        if name != chars:
            return own.alias(name)
        return F.when(F.col("n_deleted") > 0, F.length("text").cast(docs.schema[name].dataType)).otherwise(own).alias(name)

    return _without(docs, min_words).select(*[column(c) for c in docs.columns])


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_deleted, kept_sha256`` of every document."""
    out = _without(docs.select("doc_id", "text"), min_words)
    return out.select("row.doc_id", "n_lines", "n_deleted", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH line AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
counted AS (
  SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id, text ORDER BY pos) AS BIGINT) AS c
  FROM (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM line) WHERE words > 0),
windows AS (
  SELECT doc_id, text, pos AS first_pos, max(pos) OVER f AS last_pos, list(line) OVER f AS key, sum(words) OVER f AS n
  FROM (SELECT *, c - words AS b FROM counted)
  WINDOW f AS (PARTITION BY doc_id, text ORDER BY b RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, text, min(pos) OVER r, pos, list(line) OVER r, sum(words) OVER r
  FROM counted
  WINDOW r AS (PARTITION BY doc_id, text ORDER BY c RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
firsts AS (
  SELECT key, min({'d': doc_id, 'p': first_pos}) AS place FROM windows WHERE n >= 50 GROUP BY key),
gone AS (
  SELECT DISTINCT doc_id, text, unnest(generate_series(first_pos, last_pos)) AS pos
  FROM windows JOIN firsts USING (key) WHERE n >= 50 AND {'d': doc_id, 'p': first_pos} <> place),
kept AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(g.pos) AS n_deleted,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.text = g.text AND l.pos = g.pos
  GROUP BY l.doc_id, l.text)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted, sha256(k.kept) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""
