"""Quality rules: base rules of a text, and bands of its n-gram perplexity in its language.

The language model is an order-4 model of characters (code points) with modified
Kneser-Ney smoothing, one for every language that occurs.  Tasks count grams of all texts
and Spark adds them up; discounts, continuation counts and smoothed probabilities are Spark
aggregates and joins, so what is gathered grows with the corpus.  For scoring the model is
kept as sorted arrays of 64-bit gram hashes with their log probabilities.  A text of the
corpus only has grams that were counted, so its scores need the highest order alone; the
back-off weights stay in the model's table for other texts (:class:`HashModel`).  The arrays
go to the executors in blocks of at most ``block_grams`` grams (a checked size): a larger model
means more passes over the texts, each adding its part to the sums of every window, never
a larger broadcast.

A text's log perplexity must lie within its language's band: the median over all texts of
the language, plus and minus ``WIDTH`` robust deviations and a margin that shrinks with
the square root of the text's length.  Too high is what the model does not know (lists,
strewn signs), too low is monotony.

Defined results: null text has no words and fails the base rules; a null language counts
as the empty name, a language of its own; an empty table gives no rows; repeated rows are
judged each; other columns are ignored.  Word and line repeats within one text are found
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parts

ORDER = 4
#: Bits of a character: code points above them share one with the private-use area.
BITS = 16
VOCABULARY = 1 << BITS
#: Grams of the model that are sent to the executors at a time (16 bytes each).
BLOCK_GRAMS = 2_000_000
#: Rows of a few numbers, one for each language, that may be broadcast.
FEW_LANGS = 10_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Characters of a window; a text's log perplexity is the median of its windows, so that a
#: quoted passage in another language does not decide.
WINDOW = 128
WIDTH_LOW, WIDTH_HIGH = 3.0, 3.0
MARGIN = 1.0
LEAST_DEVIATION = 0.01
SYMBOLS = b"#*$%&|<>"


def characters(text: str | None) -> np.ndarray:
    """The characters of a text, led in by line ends."""
    x = np.frombuffer(("\n" * (ORDER - 1) + (text or "")).encode("utf-32-le", "surrogatepass"), "<u4")
    return ((x ^ (x >> np.uint32(16))) & np.uint32(0xFFFF)).astype(np.uint16)


def gram_ids(text: str | None) -> np.ndarray:
    """Ids of all grams of ``ORDER`` characters, the last character in the lowest bits."""
    x = characters(text).astype(np.uint64)
    n = len(x) - ORDER + 1
    ids = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER):
        ids = (ids << np.uint64(BITS)) | x[k : k + n]
    return ids


def lang_seed(lang: str | None) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest((lang or "").encode("utf-8", "replace"), 42))


def gram_hash(seed: np.ndarray | np.uint64, order: np.ndarray | int, gram: np.ndarray) -> np.ndarray:
    """64-bit hash of a gram of a language's model (one-to-one for a language and order)."""
    h = np.asarray(gram).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed + np.asarray(order).astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


# --- base rules ------------------------------------------------------------------------


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return 0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0
    blanks = len(raw) - sum(map(len, words))
    lines, seen, dup = raw.split(b"\n"), set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeat = 0
    if len(words) >= 6:
        ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        n = len(ids) - 4
        h = ids[:n].copy()
        for k in range(1, 5):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        s = np.sort(h)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
            cover = np.zeros(len(ids) + 1, np.int64)
            hit = np.flatnonzero(twice[at] == h)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + 5, -1)
            repeat = int((np.cumsum(cover)[:-1] > 0).sum())
    return len(words), len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeat


# --- the language model ----------------------------------------------------------------


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often (or with what sum of ``counts``) each occurs."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.diff(np.append(edge, len(keys))) if counts is None else np.add.reduceat(counts, edge) if len(edge) else counts


def distinct_grams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of several texts' characters with their counts; few characters make short keys, which sort faster."""
    used = np.flatnonzero(np.bincount(np.concatenate(texts), minlength=VOCABULARY))
    wide = np.uint32 if len(used) <= 256 else np.uint64
    width = wide(8 if len(used) <= 256 else BITS)
    code = np.zeros(VOCABULARY, wide)
    code[used] = np.arange(len(used)) if len(used) <= 256 else used
    parts_ = []
    for x in texts:
        n = len(x) - ORDER + 1
        y = code[x]
        key = y[:n]
        for k in range(1, ORDER):
            key = (key << width) | y[k : k + n]
        parts_.append(key)
    keys, counts = _counted(np.concatenate(parts_))
    if wide is np.uint64:
        return keys, counts
    grams = np.zeros(len(keys), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        grams = (grams << np.uint64(BITS)) | used[(keys >> np.uint32(8 * k)) & np.uint32(255)].astype(np.uint64)
    return grams, counts


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, gram, c``: grams of every language over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in parts(batches, 1000):
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    texts.setdefault(lang, []).append(characters(text))
            for lang, own in texts.items():
                grams, counts = distinct_grams(own)
                if lang in totals:
                    grams, counts = (np.concatenate(p) for p in zip(totals[lang], (grams, counts)))
                    grams, counts = _counted(grams, counts)
                totals[lang] = grams, counts
        for lang, (grams, counts) in totals.items():
            name = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(grams), np.int8)))
            yield pa.RecordBatch.from_arrays([name, pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "c"])

    counted = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInArrow(run, "lang string, gram long, c long")
    return counted.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _few(by_lang: DataFrame) -> DataFrame:
    """One row a language, by broadcast unless there are more than ``FEW_LANGS``: a frequent language stays spread."""
    rows = materialize(by_lang, "langs")
    return F.broadcast(rows) if rows.count() <= FEW_LANGS else rows


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``lang, order, gram, logp, backoff`` of modified Kneser-Ney smoothing.

    The highest order uses counts, the lower ones the number of distinct grams that
    extend them to the left.  ``backoff`` belongs to a gram as a context.
    """
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("gram")
        levels[order] = materialize(levels[order + 1].select("lang", shorter).groupBy("lang", "gram").agg(F.count("*").alias("c")), f"grams{order}")
    lower = None
    out = []
    for order in range(1, ORDER + 1):
        grams = levels[order]
        n = grams.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
        known = F.least("n1", "n2", "n3") > 0
        raw = [k - F.try_divide((k + 1) * y * F.col(f"n{k + 1}"), F.col(f"n{k}")) for k in (1, 2, 3)]
        # small or full tables can give no sound estimate: then fixed discounts
        discounts = [F.when(known & r.between(0.0, float(k)), r).otherwise(d).alias(f"d{k}") for k, r, d in zip((1, 2, 3), raw, (0.5, 1.0, 1.5))]
        n = n.select("lang", *discounts)
        context = F.shiftrightunsigned("gram", BITS).alias("context")
        rows = grams.select("lang", "gram", "c", context).join(_few(n), "lang")
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.withColumn("d", F.least(d, F.col("c")))
        of_context = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("mass"))
        rows = rows.join(of_context, ["lang", "context"])
        own = (F.col("c") - F.col("d")) / F.col("total")
        weight = F.col("mass") / F.col("total")
        if lower is None:
            p = rows.select("lang", "gram", "context", (own + weight / VOCABULARY).alias("p"))
        else:
            suffix = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)))
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            p = suffix.join(below, ["lang", "suffix"]).select("lang", "gram", "context", (own + weight * F.col("below")).alias("p"))
        lower = materialize(p, f"model{order}")
        out.append(lower.select("lang", F.lit(order).alias("order"), "gram", F.log("p").alias("logp")))
        weights = of_context.select("lang", F.lit(order - 1).alias("order"), F.col("context").alias("gram"), F.log(weight).alias("backoff"))
        out.append(weights)
    probabilities = reduce(DataFrame.unionByName, out[0::2])
    weights = reduce(DataFrame.unionByName, out[1::2])
    return probabilities.join(weights, ["lang", "order", "gram"], "full").select("lang", "order", "gram", F.col("logp").cast("float"), F.coalesce("backoff", F.lit(0.0)).cast("float").alias("backoff"))


class HashModel:
    """Sorted arrays of gram hashes, their log probabilities and back-off weights, for any text."""

    def __init__(self, lang: np.ndarray, order: np.ndarray, gram: np.ndarray, logp: np.ndarray, backoff: np.ndarray):
        h = gram_hash(np.array([lang_seed(x) for x in lang], np.uint64), order, np.asarray(gram).view(np.uint64))
        at = np.argsort(h)
        self.hashes, self.logp, self.backoff = h[at], logp[at], backoff[at]

    def _find(self, seed: np.uint64, order: int, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = gram_hash(seed, order, gram)
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        return at, self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)

    def log_probability(self, lang: str | None, gram: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each gram's last character after the others."""
        seed = lang_seed(lang)
        out = np.zeros(len(gram))
        left, weight, order = np.arange(len(gram)), np.zeros(len(gram)), ORDER
        while len(left) and order:
            g = gram[left] & np.uint64((1 << BITS * order) - 1)
            at, there = self._find(seed, order, g)
            there &= ~np.isnan(self.logp[at]) if len(self.logp) else there
            out[left[there]] = weight[left[there]] + self.logp[at[there]]
            left = left[~there]
            at, known = self._find(seed, order - 1, g[~there] >> np.uint64(BITS))
            weight[left[known]] += self.backoff[at[known]]
            order -= 1
        out[left] = weight[left] - np.log(VOCABULARY)
        return out


def load_model(model: DataFrame) -> HashModel:
    """A whole model in memory: for small corpora."""
    pdf = model.toPandas()
    return HashModel(*(pdf[c].to_numpy() for c in ("lang", "order", "gram", "logp", "backoff")))


def model_blocks(model: DataFrame, block_grams: int = BLOCK_GRAMS) -> list[DataFrame]:
    """The grams of the highest order in blocks of about ``block_grams`` by hash."""
    top = model.where(F.col("order") == ORDER).select(F.xxhash64("lang").alias("seed"), "gram", "logp")
    blocks = max(1, -(-top.count() // block_grams))
    return [top.where(F.pmod(F.xxhash64("seed", "gram"), F.lit(blocks)) == k) for k in range(blocks)]


def load_block(block: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log probabilities of a block of the model (``model_blocks`` bounds its size)."""
    got = block.toArrow()
    seed, gram, logp = (got.column(c).to_numpy() for c in range(3))
    h = gram_hash(seed.view(np.uint64), ORDER, gram.view(np.uint64))
    at = np.argsort(h)
    return h[at], logp[at].astype(np.float32)


def looked_up(h: np.ndarray, hashes: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log probability of each hash, 0 where another block has it; each distinct one is looked up once."""
    if not len(h) or not len(hashes):
        return np.zeros(len(h), np.float32)
    own, _ = _counted(h)
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    value = np.where(hashes[at] == own, logp[at], np.float32(0))
    # a table of slots leads back from places to distinct hashes; shared slots are searched
    slot = (own >> np.uint64(44)).astype(np.int64)
    table = np.zeros(1 << 20, np.int32)
    table[slot] = np.arange(len(own))
    which = table[h >> np.uint64(44)]
    wrong = np.flatnonzero(own[which] != h)
    which[wrong] = np.searchsorted(own, h[wrong])
    return value[which]


def window_bounds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and sizes of a text's windows of ``WINDOW`` characters (the last takes the rest)."""
    begin = np.arange(max(1, n // WINDOW)) * WINDOW
    return begin, np.diff(np.append(begin, n))


def window_sums(logp: np.ndarray) -> np.ndarray:
    return np.add.reduceat(logp.astype(np.float64), window_bounds(len(logp))[0]) if len(logp) else np.zeros(0)


def text_log_perplexity(sums: np.ndarray, n: int) -> float:
    """Median over the windows of the mean negative log probability; 0 for an empty text."""
    return -float(np.median(sums / window_bounds(n)[1])) if n else 0.0


def scores(docs: DataFrame, model: DataFrame, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``doc_id, lang``, the base counts, ``n_chars`` and ``log_ppl`` (per character) of every text of the model's corpus."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars"]
    schema = f"doc_id {kind}, lang string, text_hash long, {', '.join(c + ' long' for c in counts)}, sums binary, log_ppl double"
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64("text").alias("text_hash"), "text")

    def of_block(k: int, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, logp = shared.value
            for batch in parts(batches):
                langs, own = batch.column(1).to_pylist(), batch.column(3).to_pylist()
                base = np.array([base_counts(t) if not k else (0,) * 5 for t in own], np.int64).reshape(-1, 5)
                seeds = {lang: lang_seed(lang) for lang in set(langs)}
                hashed = [gram_hash(seeds[lang], ORDER, gram_ids(t)) for lang, t in zip(langs, own)]
                n = np.array([len(h) for h in hashed], np.int64)
                values = np.split(looked_up(np.concatenate([np.zeros(0, np.uint64), *hashed]), hashes, logp), np.cumsum(n)[:-1])
                sums = [window_sums(v) for v in values]
                cols = [*batch.columns[:3], *[pa.array(base[:, c]) for c in range(5)], pa.array(n), pa.array([x.tobytes() for x in sums], pa.binary()), pa.array([text_log_perplexity(x, m) for x, m in zip(sums, n.tolist())], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, [c.split(" ")[0] for c in schema.split(", ")])

        return texts.mapInArrow(run, schema)

    shared = [spark.sparkContext.broadcast(load_block(b)) for b in model_blocks(model, block_grams)]
    of = [of_block(k, b) for k, b in enumerate(shared)]
    if len(of) == 1:
        return of[0].drop("text_hash", "sums")
    # equal rows add up together and are told apart again
    row = ["doc_id", "lang", "text_hash", "n_chars"]
    copies = (F.count("*") / len(of)).cast("int").alias("copies")
    added = reduce(DataFrame.unionByName, of).groupBy(*row).agg(copies, *[F.sum(c).alias(c) for c in counts[:5]], F.collect_list("sums").alias("sums"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            n, copies = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_chars", "copies"))
            all_sums = batch.column(batch.schema.get_field_index("sums")).to_pylist()
            ppl = [text_log_perplexity(sum(np.frombuffer(x) for x in xs) / c, m) for xs, c, m in zip(all_sums, copies, n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in out[:-1]], pa.array(ppl, pa.float64())], out)

    out = ["doc_id", "lang", "n_chars", "copies", *counts[:5], "log_ppl"]
    summed = added.mapInArrow(add, f"doc_id {kind}, lang string, n_chars long, copies int, {', '.join(c + ' long' for c in counts[:5])}, log_ppl double")
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return each.select("doc_id", "lang", *[F.floor(F.col(c) / F.col("copies")).alias(c) for c in counts[:5]], "n_chars", "log_ppl")


def bands(scored: DataFrame) -> DataFrame:
    """``lang, middle, deviation``: median and robust deviation of the log perplexity, over all texts of a language."""
    step = 1000

    def median(rows: DataFrame, value: str) -> DataFrame:
        """The least value with half of the rows at or below it, from counted values."""
        own = Window.partitionBy("lang")
        through = F.sum("n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        ranked = rows.withColumn("through", through).withColumn("all", F.sum("n").over(own))
        return ranked.where(2 * F.col("through") >= F.col("all")).groupBy("lang").agg(F.min(value).alias("middle"))

    # at most some thousand values a language, whatever the texts
    rows = scored.where("n_chars > 0").groupBy("lang", F.round(F.col("log_ppl") * step).cast("long").alias("v")).agg(F.count("*").alias("n"))
    rows = materialize(rows, "values")
    middle = materialize(median(rows, "v"), "middle")
    off = rows.join(middle, "lang").withColumn("off", F.abs(F.col("v") - F.col("middle"))).groupBy("lang", "off").agg(F.sum("n").alias("n"))
    deviation = F.greatest(F.lit(1.4826) * F.col("off") / step, F.lit(LEAST_DEVIATION)).alias("deviation")
    spread = median(off, "off").select("lang", F.col("middle").alias("off"))
    return middle.join(spread, "lang").select("lang", (F.col("middle") / step).alias("middle"), deviation)


def judge(docs: DataFrame, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Base counts, ``base_failed``, ``log_ppl`` and ``kept`` of every document."""
    model = materialize(kneser_ney(materialize(count_grams(docs), "grams")), "model")
    scored = materialize(scores(docs, model, block_grams), "scores")
    limits = bands(scored)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    margin = MARGIN / F.sqrt(F.greatest("n_chars", F.lit(1)))
    inside = F.col("log_ppl").between(F.col("middle") - WIDTH_LOW * F.col("deviation") - margin, F.col("middle") + WIDTH_HIGH * F.col("deviation") + margin)
    joined = scored.join(_few(limits), "lang", "left").withColumn("base_failed", failed)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), F.round("log_ppl", 6).alias("log_ppl"))
