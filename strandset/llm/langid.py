"""Language identification by unigram pieces with all segmentations summed.

A language is a distribution over the pieces of a fixed public vocabulary.  The probability
of a word under a language is the sum, over all ways to cut the word into pieces, of the
product of their probabilities; the forward algorithm makes that sum without listing the
ways.  A text gets the language with the highest posterior over its words.

*Words* are runs of letters in lower case with a blank in front, as bytes; the vocabulary's
single bytes let every word be cut.  ASCII signs and digits separate words, bytes above
ASCII never do.  A run longer than ``STRETCH`` bytes is taken in stretches of that size.

*Fitting* is expectation maximisation in Spark.  The words of all training texts are counted
by language (in each task first, then by one shuffle of distinct words).  Each round, tasks
run the forward and the backward algorithm over the distinct words and sum the expected
counts of pieces; a second, small shuffle adds them up.  The pieces of a language are
smoothed with those of all languages, and these with the flat distribution.  What is
gathered are the words of the corpus, so it grows with the corpus; what reaches the driver
is one number for each language and piece of the vocabulary.

*Scoring* is one pass over the texts.  A task runs the forward algorithm for all words of a
batch that it has not met, of one length at a time and for all languages at once.

Defined results: texts that are null or without a letter get ``und`` and score 0, as do all
texts when nothing was learnt; null languages teach nothing; a null ``doc_id`` hashes like
an empty text; equal posteriors go to the language that comes first; repeated rows are
scored and counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, parts

#: Bytes of a run of letters that are one word at most; keeps products of probabilities within doubles.
STRETCH = 32
ROUNDS = 2
#: Pseudo-counts of the pooled distribution in a language's, and share of the flat distribution in all.
POOLED, FLAT = 200.0, 0.001
#: Languages of a model at most (a language takes about 0.1 MB in a worker).
MAX_LANGUAGES = 2000
#: Bytes of a text that are split at a time, words counted in a task before they go to the shuffle, bytes of scores that a task remembers.
PIECE_BYTES = 4_000_000
COUNTED_WORDS = 400_000
MEMORY_BYTES = 48_000_000
#: Words of texts that are looked up together.
BATCH_WORDS = 100_000
#: Words of one length in a call of the forward algorithm.
WORDS = 4096

HELD_OUT = 2
UNKNOWN = "und"


def _letter_byte(b: int) -> int:
    return b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20


LETTER_BYTES = bytes(map(_letter_byte, range(256)))


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a whole text without their blanks, in lists of a bounded piece of it."""
    raw = text.lower().encode("utf-8", "replace").translate(LETTER_BYTES)
    at = 0
    while at < len(raw):
        end = len(raw) if at + PIECE_BYTES >= len(raw) else raw.find(b" ", at + PIECE_BYTES)
        end = len(raw) if end < 0 else end
        found = raw[at:end].split()
        if any(len(w) >= STRETCH for w in found):
            found = [w[k : k + STRETCH - 1] for w in found for k in range(0, len(w), STRETCH - 1)]
        yield found
        at = end


def vocabulary(path: str | None = None) -> list[bytes]:
    """The pieces of a sentencepiece model that words can be cut into, as bytes; all single bytes among them."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            piece = model.id_to_piece(k).replace("▁", " ").encode()
            body = piece.removeprefix(b" ")
            if len(piece) <= STRETCH and body == body.translate(LETTER_BYTES) and b" " not in body:
                pieces.add(piece)
    return sorted(pieces)


class Pieces:
    """Numbers of the pieces that begin at each place of many words of one length."""

    BASE = np.uint64(1_099_511_628_211)

    def __init__(self, pieces: list[bytes]) -> None:
        self.n = len(pieces)
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have the same hash")

    def _hash(self, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(self.BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def at(self, words: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """``(start, end)`` to ``(rows, pieces)``: the words (rows of bytes) that have a piece there."""
        found = {}
        length = words.shape[1]
        values = words.astype(np.uint64) + np.uint64(1)
        for start in range(length):
            h = np.zeros(len(words), np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                h = h * self.BASE + values[:, end - 1]
                slot = np.minimum(np.searchsorted(self.hashes, h), self.n - 1)
                rows = np.flatnonzero(self.hashes[slot] == h)
                if len(rows):
                    found[start, end] = rows, self.numbers[slot[rows]]
        return found


def _matrix(words: list[bytes]) -> np.ndarray:
    """Words of one length with their blanks as rows of bytes."""
    return np.frombuffer(b"".join(b" " + w for w in words), np.uint8).reshape(len(words), -1)


def _scaled(pieces: list[bytes], p: np.ndarray) -> np.ndarray:
    """Probabilities times 64 for each byte, so that long words stay far from the least double."""
    return p * 64.0 ** np.array([len(x) for x in pieces])[:, None]


def forward(found: dict, scaled: np.ndarray, n: int, length: int) -> np.ndarray:
    """Sums over all segmentations of each start of each word: ``length + 1`` tables of words by languages."""
    alpha = np.zeros((length + 1, n, scaled.shape[1]))
    alpha[0] = 1.0
    for end in range(1, length + 1):
        for start in range(end):
            if (start, end) in found:
                rows, piece = found[start, end]
                alpha[end][rows] += alpha[start][rows] * scaled[piece]
    return alpha


def log_probabilities(words: list[bytes], pieces: Pieces, scaled: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of words (rows) in languages (columns)."""
    out = np.empty((len(words), scaled.shape[1]))
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    wide = max(16, WORDS * 4 // scaled.shape[1])
    for length, places in by_length.items():
        for at in range(0, len(places), wide):
            some = places[at : at + wide]
            table = _matrix([words[k] for k in some])
            total = forward(pieces.at(table), scaled, len(some), length + 1)[-1]
            out[some] = np.log(total) - (length + 1) * np.log(64.0)
    return out


def expected_counts(words: list[bytes], counts: np.ndarray, pieces: Pieces, scaled: np.ndarray) -> np.ndarray:
    """Expected pieces of one language's words under its own distribution (``scaled`` has one column)."""
    out = np.zeros(pieces.n)
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for length, places in by_length.items():
        for at in range(0, len(places), WORDS):
            some = places[at : at + WORDS]
            table = _matrix([words[k] for k in some])
            found, n = pieces.at(table), length + 1
            alpha = forward(found, scaled, len(some), n)[:, :, 0]
            beta = np.zeros((n + 1, len(some)))
            beta[n] = counts[some] / alpha[n]
            for (start, end), (rows, piece) in sorted(found.items(), key=lambda x: -x[0][0]):
                onward = scaled[piece, 0] * beta[end][rows]
                beta[start][rows] += onward
                np.add.at(out, piece, alpha[start][rows] * onward)
    return out


def word_counts(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """``lang, word, n`` of all texts with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in parts(batches):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for words in words_of(text.as_py() or ""):
                    held.setdefault(name, Counter()).update(words)
            if sum(map(len, held.values())) > COUNTED_WORDS:
                yield from flush()
        yield from flush()

    texts = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col(lang).alias("lang"), "text")
    return texts.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order, their log priors, and the probabilities of pieces (rows) in them (columns)."""

    def __init__(self, languages: list[str], prior: np.ndarray, pieces: list[bytes], p: np.ndarray) -> None:
        self.languages, self.prior, self.pieces, self.p = languages, prior, pieces, p


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Distributions from counts of pieces (rows) in languages (columns)."""
    n = len(counts)
    pooled = (counts.sum(1) + 1.0 / n) / (counts.sum() + 1.0)
    return (1.0 - FLAT) * (counts + POOLED * pooled[:, None]) / (counts.sum(0) + POOLED) + FLAT / n


def fit(docs: DataFrame, lang: str = "lang", path: str | None = None, rounds: int = ROUNDS) -> Model:
    """Piece distributions of the languages of ``docs`` (columns ``text`` and ``lang``)."""
    context = docs.sparkSession.sparkContext
    sizes = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: {lang} does not name languages")
    languages = [r["lang"] for r in sizes]
    pieces = vocabulary(path)
    p = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    if not languages:
        return Model([], np.zeros(0), pieces, p)
    prior = np.log(np.array([r["count"] for r in sizes], float) / sum(r["count"] for r in sizes))
    words = materialize(word_counts(docs.withColumn(lang, F.col(lang).cast("string")), lang), "langid-words")
    for _ in range(rounds):
        sent = context.broadcast((languages, pieces, p))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, vocabulary_, now = sent.value
            known, scaled = Pieces(vocabulary_), _scaled(vocabulary_, now)
            column = {x: k for k, x in enumerate(names)}
            totals: dict[int, np.ndarray] = {}
            for batch in parts(batches, 20_000):
                by: dict[str, list[int]] = {}
                for k, name in enumerate(batch.column(0).to_pylist()):
                    by.setdefault(name, []).append(k)
                for name, rows in by.items():
                    own, j = batch.take(pa.array(rows)), column[name]
                    found = expected_counts(own.column(1).to_pylist(), own.column(2).to_numpy().astype(float), known, scaled[:, j : j + 1])
                    totals[j] = totals[j] + found if j in totals else found
            for j, total in totals.items():
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), j, np.int32)), pa.array(some.astype(np.int32)), pa.array(total[some])], ["lang", "piece", "n"])

        added = words.mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(p.shape)
        counts[added.column("piece").to_numpy(), added.column("lang").to_numpy()] = added.column("n").to_numpy()
        p = _smoothed(counts)
        sent.destroy()
    discard(words)
    return Model(languages, prior, pieces, p)


class _Scorer:
    """Scores of words in all languages; those of words that come again are remembered in bounded memory."""

    def __init__(self, model: Model) -> None:
        self.pieces, self.scaled = Pieces(model.pieces), _scaled(model.pieces, model.p)
        self.most = max(1000, MEMORY_BYTES // (100 + 8 * len(model.languages)))
        self.places: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def totals(self, texts: list[str], prior: np.ndarray) -> np.ndarray:
        """Log joint probability of each text (row) and language (column)."""
        out = np.tile(prior, (len(texts), 1))
        held: list[tuple[int, list[bytes]]] = []
        count = 0
        for k, text in enumerate(texts):
            for words in words_of(text):
                held.append((k, words))
                count += len(words)
                if count > BATCH_WORDS:
                    self.add(held, out)
                    held, count = [], 0
        self.add(held, out)
        return out

    def add(self, held: list[tuple[int, list[bytes]]], out: np.ndarray) -> None:
        new = {w for _, words in held for w in words if w not in self.places}
        if len(self.places) + len(new) > self.most:
            self.places, self.scores = {}, self.scores[:0]
            new = {w for _, words in held for w in words}
        if new:
            self.learn(sorted(new))
        for k, words in held:
            out[k] += self.scores[[self.places[w] for w in words]].sum(0)

    def learn(self, words: list[bytes]) -> None:
        start, end = len(self.places), len(self.places) + len(words)
        if end > len(self.scores):
            grown = np.zeros((max(end, 2 * len(self.scores)), self.scaled.shape[1]))
            grown[:start] = self.scores[:start]
            self.scores = grown
        self.scores[start:end] = log_probabilities(words, self.pieces, self.scaled)
        self.places.update(zip(words, range(start, end)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array(m.languages + [UNKNOWN], object)
        scorer = _Scorer(m)
        for batch in parts(batches, 200):
            best, score = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows)
            some = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False)) if m.languages else []
            if len(some):
                texts = batch.column(3).take(pa.array(some)).to_pylist()
                totals = scorer.totals(texts, m.prior)
                best[some] = totals.argmax(1)
                score[some] = 1.0 / np.exp(totals - totals.max(1, keepdims=True)).sum(1)
            cols = [batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", fold(docs).alias("held_out"), lettered.alias("lettered"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def fold(docs: DataFrame) -> Column:
    """Whether a row's fold is held out of the fit."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Fit on the rows whose fold is not held out, predict all."""
    return predict(docs, fit(docs.where(~fold(docs)).select("text", "lang"), "lang", path))
