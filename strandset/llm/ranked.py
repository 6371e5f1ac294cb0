"""Ranked lexical search: the best documents of each item of a stated query set.

A threshold-seeded join in four steps, all but the bounded query set held by Spark:

1. *Index.*  One pass over the texts writes, for every document with a term, its length and
   the frequencies of the terms that any item holds (one row a document, no text).
2. *Stored impacts.*  From the index come, for each term, its document frequency, its
   largest impact and its kth largest impact.  A term's kth impact times its weight bounds
   the kth score of each item that holds the term from below, so the largest of them is the
   item's threshold.
3. *Pruning.*  An item's terms go by their largest possible contribution.  The longest run of
   the smallest ones whose sum stays under the threshold cannot make a result alone; these
   terms make no candidates, and their sum is the item's suffix bound.
4. *Candidates and exact scores.*  Index rows meet the other (essential) terms of every
   item; a pair stays where its part of the score plus the suffix bound reaches the
   threshold, or the kth exact score that the task has found so far.  Only such pairs get
   exact scores.  Each task hands on at most k rows an item, and a window keeps the k best.

All comparisons keep ties, so the result is the exact one.  A frequent term is never
gathered: its largest impacts are cut to k in each task before the shuffle, and its postings
stay in the rows of their documents.  The query set is taken in blocks of about
``MAX_ITEM_TERMS`` pairs of item and term (an item is never split); a block is broadcast.

Defined results: null or empty texts have no terms; a document without terms counts nowhere;
rows equal in ``doc_id`` are documents of their own; null ids come first; rows of one
``item_id`` are one item with the terms of all; an item without terms, without a scoring
document, or an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, parts

K = 10
#: Pairs of item and term in a block (about 60 bytes each on the driver and in a worker).
MAX_ITEM_TERMS = 250_000
#: Cells of (document, item) held at a time, pairs of posting and item expanded at a time, bytes of a text split at a time.
CELLS = 1_000_000
EXPANDED = 1_000_000
PIECE_BYTES = 4_000_000

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _term_byte(b: int) -> int:
    """Letters of ASCII in lower case, digits and all bytes above ASCII as they are, a blank for the rest."""
    if 0x41 <= b <= 0x5A:
        return b + 32
    return b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20


TERM_BYTES = bytes(map(_term_byte, range(256)))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in UTF-8, in lists of a bounded piece of it."""
    text = text.translate(TERM_BYTES)
    at = 0
    while at < len(text):
        end = len(text) if at + PIECE_BYTES >= len(text) else text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term`` of every item, each once."""
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({TERM})"), 1)
    return items.select("item_id", F.explode(terms).alias("term")).distinct()


def index(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term; ``terms`` are ascending numbers."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(numbers)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known.value
        for batch in parts(batches):
            keep, sizes, terms, tfs, ends = [], [], [], [], [0]
            for row, text in enumerate(batch.column(1)):
                n, found = 0, Counter()
                for piece in terms_of(text.as_buffer().to_pybytes() if text.is_valid else b""):
                    n += len(piece)
                    found.update([of[t] for t in piece if t in of])
                if n:
                    own = sorted(found)
                    keep.append(row)
                    sizes.append(n)
                    terms.extend(own)
                    tfs.extend(found[t] for t in own)
                    ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            cols = [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def term_impacts(indexed: DataFrame, n_docs: int, n_terms: int, k: int = K) -> DataFrame:
    """``term, df, top, kth``: document frequency, largest and kth largest impact (0 where fewer documents hold the term)."""
    m = F.expr(f"100 - 90 + ((90 * n * {n_docs}L) div {n_terms}L)")
    postings = indexed.select(m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), F.expr("(1000000000L * p.tfs) div (1000 * p.tfs + 8 * m)").alias("impact"))
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    # the filter on the row number lets Spark cut each term to k rows in every task before the shuffle
    best = postings.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))).where(F.col("r") <= k)
    stored = best.groupBy("term").agg(F.max("impact").alias("top"), F.coalesce(F.min(F.when(F.col("r") == k, F.col("impact"))), F.lit(0)).alias("kth"))
    return frequency.join(stored, "term")


def pruned_terms(pairs: DataFrame, impacts: DataFrame, n_docs: int) -> DataFrame:
    """``item, term, weight, essential, threshold, suffix`` of every term of an item that some document holds."""
    weight = F.floor(1000.0 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    rows = pairs.join(impacts, "term").withColumn("weight", weight)
    rows = rows.withColumn("bound", F.col("weight") * F.col("top"))
    item = Window.partitionBy("item")
    rows = rows.withColumn("threshold", F.max(F.col("weight") * F.col("kth")).over(item))
    rows = rows.withColumn("through", F.sum("bound").over(item.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("essential", F.col("through") >= F.col("threshold"))
    suffix = F.coalesce(F.max(F.when(~F.col("essential"), F.col("through"))).over(item), F.lit(0))
    return rows.select("item", "term", "weight", "essential", "threshold", suffix.alias("suffix"))


class _Queries:
    """The terms of a block's items as arrays: essential ones by term, the others by item."""

    def __init__(self, rows: pa.Table, n_terms: int, n_items: int) -> None:
        item, term, weight, essential, threshold, suffix = (rows.column(c).to_numpy() for c in ("item", "term", "weight", "essential", "threshold", "suffix"))
        self.n_terms, self.n_items = n_terms, n_items
        self.threshold, self.suffix = np.zeros(n_items, np.int64), np.zeros(n_items, np.int64)
        self.threshold[item], self.suffix[item] = threshold, suffix
        essential = essential.astype(bool)
        self.by_term = self._grouped(term[essential], item[essential], weight[essential], n_terms)
        self.by_item = self._grouped(item[~essential], term[~essential], weight[~essential], n_items)

    @staticmethod
    def _grouped(key: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n))]).astype(np.int64), value[order].astype(np.int64), weight[order].astype(np.int64)

    @staticmethod
    def expand(grouped: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(place in keys, value, weight)`` of all members of the groups ``keys``, some keys at a time."""
        starts, values, weights = grouped
        ends = np.cumsum(starts[keys + 1] - starts[keys])
        at = 0
        while at < len(keys):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, "right")))
            size = starts[keys[at:stop] + 1] - starts[keys[at:stop]]
            place = np.repeat(np.arange(at, stop), size)
            within = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
            member = starts[keys[place]] + within
            yield place, values[member], weights[member]
            at = stop

    def survivors(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(doc, item, exact score)`` of the pairs whose bound reaches ``least``; postings go by document, then term."""
        score = np.zeros(n * self.n_items, np.int64)
        for place, item, weight in self.expand(self.by_term, term):
            np.add.at(score, doc[place] * self.n_items + item, weight * impact[place])
        pair = np.flatnonzero(score)
        item = pair % self.n_items
        pair = pair[score[pair] + self.suffix[item] >= least[item]]
        score, item, row = score[pair], pair % self.n_items, pair // self.n_items
        posting = doc * self.n_terms + term
        for place, other, weight in self.expand(self.by_item, item):
            wanted = row[place] * self.n_terms + other
            found = np.minimum(np.searchsorted(posting, wanted), len(posting) - 1)
            hit = posting[found] == wanted
            np.add.at(score, place[hit], weight[hit] * impact[found[hit]])
        keep = score >= least[item]
        return row[keep], item[keep], score[keep]


def _best(found: pa.Table, k: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The k best rows of each item, and the items that have k with their least scores."""
    order = [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]
    found = found.take(pc.sort_indices(found, sort_keys=order, null_placement="at_start"))
    item = found.column("item").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    last = rank == k - 1
    return found.filter(pa.array(rank < k)), item[last], found.column("score").to_numpy()[last]


def candidates(indexed: DataFrame, queries: _Queries, n_docs: int, n_terms: int, k: int = K) -> DataFrame:
    """``item, doc_id, score``: the exact scores of at most k documents an item and task, all of the best among them."""
    sent = indexed.sparkSession.sparkContext.broadcast(queries)
    kind = indexed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        least = np.maximum(q.threshold, 1)
        best = None
        for batch in parts(batches, max(1, min(500, CELLS // q.n_items))):
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            term, tf = lists.flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), size)
            m = 100 - 90 + (90 * batch.column(1).to_numpy() * n_docs) // n_terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
            row, item, score = q.survivors(doc, term, impact, batch.num_rows, least)
            if not len(row):
                continue
            rows = pa.table({"item": pa.array(item, pa.int32()), "doc_id": batch.column(0).take(pa.array(row)), "score": pa.array(score, pa.int64())})
            best, full, kth = _best(rows if best is None else pa.concat_tables([best, rows]), k)
            least[full] = np.maximum(least[full], kth)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return indexed.mapInArrow(run, f"item int, doc_id {kind}, score long")


def _search_block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` of one block of the query set."""
    spark = docs.sparkSession
    held = pairs.toArrow()
    ids, terms = held.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode"), held.column("term").combine_chunks().dictionary_encode()
    numbered = pa.table({"item": ids.indices, "term": terms.indices})
    names = pa.table({"item": pa.array(range(len(ids.dictionary)), pa.int32()), "item_id": ids.dictionary})
    indexed = materialize(index(docs, {t.encode(): i for i, t in enumerate(terms.dictionary.to_pylist())}), "ranked-index")
    n_docs, n_terms = indexed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    impacts = term_impacts(indexed, n_docs, max(1, n_terms), k)
    rows = pruned_terms(spark.createDataFrame(numbered), impacts, n_docs).toArrow()
    queries = _Queries(rows, len(terms.dictionary), len(ids.dictionary))
    found = candidates(indexed, queries, n_docs, max(1, n_terms), k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = materialize(ranked.join(F.broadcast(spark.createDataFrame(names)), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    discard(indexed)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = MAX_ITEM_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents with a score above 0."""
    pairs = materialize(item_terms(items), "ranked-items")
    blocks = -(-pairs.count() // block)
    kind = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    out = docs.sparkSession.createDataFrame([], kind)
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        out = out.unionByName(_search_block(docs, own, k)) if b else _search_block(docs, own, k)
    discard(pairs)
    return out


ORACLE = """
WITH term AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
doc AS (SELECT row, count(*) AS n FROM term GROUP BY row),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM doc),
posting AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM term GROUP BY row, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM posting, total GROUP BY term, docs),
item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM item JOIN posting USING (term) JOIN weight USING (term) JOIN doc USING (row), total
  GROUP BY item_id, row, doc_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
