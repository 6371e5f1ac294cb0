"""Toxicity scores of texts restored by a noisy-channel decoder.

1. A character language model (order 3) is counted over all documents in Spark.
2. Tokens that may be disguised (leetspeak inside a word, letters set apart by blanks or
   signs, long repetitions) become lattices of letters: each sign may stand for a letter,
   be a separator or a border between words, or repeat the letter before it, at a channel
   cost.  Viterbi search finds the cheapest reading under the channel and the language
   model.  Tokens and runs are read whole, whatever their length.  A reading without
   borders is also cut into words by the word counts of the labelled rows, since letters
   alone do not tell "a stupid" from "astupid"; every word of every reading counts.
3. Words and word beginnings of the restored text carry log-odds of toxicity (a lower
   confidence bound, so rare words count little), learned from labelled rows; a logistic
   model of a text's strongest words and of the sums over all its words and all their places
   gives the score.

Sizes: the language model has ``ALPHABET ** 3`` entries whatever the corpus.  Features, words
for cutting and the logistic model are counted and fitted in Spark over all labelled rows
that are not held out; each Newton step is a sum over their evidence.  What is sent to tasks
stays bounded by least shares: a feature has two toxic rows, and one in ``FEATURE_SHARE``
of them, or more, and to be scored a log-odds above ``LEAST_ODDS``, so the toxic rows are counted
first and the other rows only for what these left; a word for cutting has ``LEAST_WORDS``
places, and one in ``WORD_SHARE`` of all, or more.  Texts without a label are left out by a
bitmap of hashed ids before the join with the labels.  Scoring is one pass without a shuffle.

Defined results: null and empty texts get the score of a text without evidence; a label
row with a null ``toxic`` or ``doc_id`` is left out, of several labels of a document the
largest counts; without labels of both kinds every text gets the labels' share of toxic
rows (0 without labels); repeated rows are scored each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, parts

LEAST_ODDS = 0.5
LEAST_WORDS = 3
#: Toxic rows for each one that a feature must have, and places of words for each one that a word must have.
FEATURE_SHARE = 2_000
WORD_SHARE = 1_000_000
HELD_OUT_MOD = 5
#: Strongest words that count each by itself; all words count in the sums.
TOP = 3
EVIDENCE = TOP + 2
#: Tokens that a scorer's memory holds; half as many disguised ones in each half of a second one.
MEMO = 60_000
MEMO_CHARS = 64
ENDING_CHARS = 16
#: Entries of a task's counts before they are given on.
COUNTED = 200_000
#: Characters of the texts that are sifted together, and of the longest text that is sifted.
SIFTED_CHARS = 200_000
#: Bits of the map of labelled ids, a broadcast of at most one row for each 64 of them.
ID_BITS = 1 << 25

# letters of the language model: 0 is a word's border, 1 any letter not listed
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
ALPHABET = len(LETTERS) + 2
CODE = {c: i + 2 for i, c in enumerate(LETTERS)}

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "%": "x", "&": "e",
}
COST_SIGN, COST_DROP_SIGN, COST_SEPARATOR, COST_KEEP, COST_REPEAT, COST_BORDER = 1.0, 4.0, 0.2, 6.0, 0.3, 0.2
#: A word that was not counted: a price for itself and for each letter.
COST_UNKNOWN, COST_UNKNOWN_LETTER = 10.0, 3.0

#: Signs at the edges of words that never stand for letters.
PLAIN_EDGE = ".,;:?\"')[]"

_table = np.ones(0x110000, np.uint8)
for _c in [*range(0x250), *range(0x1E00, 0x2100)]:
    _low = chr(_c).lower()[:1]
    _table[_c] = CODE.get(_low, 1 if _low.isalpha() else 0)

# white space, signs at the edges of words, other signs, letters; letters with a lower case of several or depending on others count as signs
_kinds, _lower = np.full(0x110000, 2, np.uint8), np.arange(0x110000, dtype=np.uint32)
for _c in range(0x40000):  # no letters are known beyond
    _ch = chr(_c)
    if _ch.isspace():
        _kinds[_c] = 0
    elif _ch in PLAIN_EDGE:
        _kinds[_c] = 1
    elif _ch.isalpha() and len(_ch.lower()) == 1 and _ch != "Σ":
        _kinds[_c], _lower[_c] = 3, ord(_ch.lower())

WORDS = re.compile(r"[^\s]+")
INSIDE = re.compile(r"[^\W\d_][^\w\s]*[\d@$!|+€£¡#&*._~^=-]+[^\W_]|(?:^|(?<=\s))[\d@$!|]+[^\W\d_]|[^\W\d_][\d@$!|+€£¡#&%(]+$|(?:^|(?<=\s))[+€£¡#&%(]+[^\W\d_]|(.)\1\1")
SPACED = re.compile(r"(?<!\S)\S(?:[^\S\n]+\S){2,}(?!\S)")
#: Two single characters after blanks: any match of SPACED ends in them, and this is searched faster.
SINGLES = re.compile(r"\s\S\s+\S(?!\S)")
SEPARATOR = re.compile(r"\w[*._~^=-]+\w")
TRIPLE = re.compile(r"(.)\1\1")
DOUBLED = re.compile(r"(.)\1")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def letter_counts(docs: DataFrame) -> DataFrame:
    """``gram, n``: counts of letter triples over all texts (words set off by borders)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in parts(batches):
            grams = [np.zeros(0, np.int64)]
            for text in batch.column(0).to_pylist():
                x = _table[np.frombuffer((" " + (text or "") + " ").encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
                x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]  # one border between words
                if len(x) > 2:
                    grams.append((x[:-2] * ALPHABET + x[1:-1]) * ALPHABET + x[2:])
            total += np.bincount(np.concatenate(grams), minlength=ALPHABET**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def letter_model(docs: DataFrame) -> np.ndarray:
    """Cost (negative log probability) of the third letter of each triple; a fixed-size table."""
    counts = np.zeros((ALPHABET, ALPHABET, ALPHABET))
    for r in letter_counts(docs).collect():  # at most ALPHABET ** 3 rows
        counts.reshape(-1)[r.gram] = r.n
    one = counts.sum((0, 1)) + 0.5
    two = counts.sum(0) + 5 * (one / one.sum())
    two /= two.sum(1, keepdims=True)
    three = counts + 5 * two
    return -np.log(three / three.sum(2, keepdims=True)).astype(np.float32)


@lru_cache(4096)
def _options(ch: str, repeated: bool, borders: bool) -> list[tuple[str, float, int]]:
    """What a character may be read as: letter (or nothing, or a blank), price, code."""
    options: list[tuple[str, float]] = []
    if ch.isalpha():
        options.append((ch, 0.0))
    else:
        options += [(c, COST_SIGN) for c in LEET.get(ch, "")]
        options.append(("", COST_DROP_SIGN if ch in LEET else COST_SEPARATOR))
        if borders:
            options.append((" ", COST_DROP_SIGN if ch in LEET else COST_BORDER))
    if repeated:
        options.append(("", COST_REPEAT))
    if ch in LEET:
        options.append((ch, COST_KEEP))
    return [(letter, price, CODE.get(letter, 1)) for letter, price in options]


def restore(token: str, model: np.ndarray | list, borders: bool = False, endings: dict | None = None) -> str:
    """The cheapest reading of a disguised token (Viterbi over the last two letters), with ``borders`` perhaps of several words.

    Up to the first character that leaves a choice there is one path; what follows depends on its last two letters only and is remembered in ``endings``.
    """
    token = token.lower()
    if not borders and token.isalpha() and not DOUBLED.search(token):
        return token  # letters stand for themselves, and none can repeat the one before it
    a = b = known = 0
    before = ""
    for ch in token:
        if ch == before or not ch.isalpha():
            break
        a, b, before, known = b, CODE.get(ch, 1), ch, known + 1
    rest = token[known:]
    if not rest:
        return token
    if endings is None or len(rest) > ENDING_CHARS:
        return token[:known] + ending(rest, model, a, b, rest[0] == before, borders)
    key = (a, b, rest[0] == before, borders, rest)
    got = endings.get(key)
    if got is None:
        if len(endings) > MEMO // 2:
            endings.clear()
        got = endings[key] = ending(rest, model, a, b, rest[0] == before, borders)
    return token[:known] + got


def ending(rest: str, model: np.ndarray | list, a: int, b: int, repeated: bool, borders: bool) -> str:
    """The cheapest reading of ``rest`` after the letters ``a`` and ``b``; ``repeated`` tells that it begins with the character before it."""
    # a reading is a chain (letter, chain before), so a step costs the same at any length
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(a, b): (0.0, None)}
    before = rest[0] if repeated else ""
    for ch in rest:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        if ch != before and ch.isalpha():  # it stands for itself
            c = CODE.get(ch, 1)
            for (a, b), (cost, read) in paths.items():
                total = cost + model[a][b][c]
                if (b, c) not in new or total < new[b, c][0]:
                    new[b, c] = (total, (ch, read))
            paths, before = new, ch
            continue
        options = _options(ch, ch == before, borders)
        for (a, b), (cost, read) in paths.items():
            costs = model[a][b]
            for letter, price, c in options:
                if letter == " ":
                    if not b:
                        continue
                    state, total = (b, 0), cost + price + costs[0]
                elif letter:
                    state, total = (b, c), cost + price + costs[c]
                else:
                    state, total = (a, b), cost + price
                if state not in new or total < new[state][0]:
                    new[state] = (total, (letter, read) if letter else read)
        paths, before = new, ch
    _, read = min(((cost + (model[a][b][0] if b else 0.0), read) for (a, b), (cost, read) in paths.items()), key=lambda p: p[0])
    letters = []
    while read:
        letter, read = read
        letters.append(letter)
    return "".join(reversed(letters))


def cut_words(read: str, words: dict[str, float], sizes: list[int] | None = None) -> list[str]:
    """The cheapest cut of letters into words of any length; ``sizes`` are those of the known words."""
    sizes = sorted({len(w) for w in words}) if sizes is None else sizes
    # best: the cheapest cut up to a place; open: the same with an unknown word still going on there
    best, back = [0.0], [0]
    open_cost, open_from = float("inf"), 0
    for i in range(1, len(read) + 1):
        if best[i - 1] + COST_UNKNOWN < open_cost:
            open_cost, open_from = best[i - 1] + COST_UNKNOWN, i - 1
        open_cost += COST_UNKNOWN_LETTER
        cost, start = open_cost, open_from
        for size in sizes:
            if size > i:
                break
            known = words.get(read[i - size : i])
            if known is not None and best[i - size] + known < cost:
                cost, start = best[i - size] + known, i - size
        best.append(cost)
        back.append(start)
    out, i = [], len(read)
    while i:
        out.append(read[back[i] : i])
        i = back[i]
    return out


def readings(token: str, model: np.ndarray, words: dict[str, float] | None = None, sizes: list[int] | None = None, endings: dict | None = None) -> set[str]:
    """A token's plain word and, if it may be disguised, its restored ones and their words."""
    word = EDGE.sub("", token).lower()
    out = {word}
    if INSIDE.search(token):
        forms = {token.strip(".,;:?\"'[]*"), token.strip(".,;:?\"'()[]*"), word}
        reads = {restore(form, model, False, endings) for form in forms}
        out |= reads
        for read in reads if words else ():
            if read not in words:
                out.update(cut_words(read, words, sizes))
        for form in forms:
            if SEPARATOR.search(form):
                out.update(restore(form, model, True, endings).split())
    return {w for w in out if w}


def plain_word(token: str) -> str:
    """The word of a token without signs that could stand for letters; empty for any other."""
    word = token.strip(PLAIN_EDGE)
    return word.lower() if word.isalpha() and not TRIPLE.search(word) else ""


def features_of(word: str) -> list[str]:
    """A word and its beginnings; words of one or two letters tell nothing."""
    return [] if len(word) < 3 else ["w:" + word, *(f"p{k}:{word[:k]}" for k in (4, 5, 6) if len(word) >= k)]


def tokens_of(text: str) -> Counter[str]:
    """White-space-separated tokens with their counts, and runs of single characters joined."""
    found = Counter(text.split())
    if SINGLES.search(text):
        add_runs(found, text)
    return found


def add_runs(found: Counter[str], text: str) -> None:
    found.update("-".join(m.group().split()) for m in SPACED.finditer(text) if len(set(m.group())) > 2)


class Kept(dict):
    """What ``made`` gives for a token, remembered for at most ``most`` tokens, none of them long."""

    def __init__(self, made: Callable[[str], object], most: int):
        super().__init__()
        self.made, self.most = made, most

    def __missing__(self, token: str) -> object:
        got = self.made(token)
        if len(token) <= MEMO_CHARS:
            if len(self) > self.most:
                self.clear()
            self[token] = got
        return got


_powers = np.full(2 * SIFTED_CHARS + 2, 0x9E3779B97F4A7C15, np.uint64)
_powers = np.cumprod(_powers)  # modulo 2 ** 64, where odd numbers have inverses
_inverses = np.cumprod(np.full(len(_powers), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
_inverses = np.concatenate(([np.uint64(1)], _inverses[:-1]))  # of the power one lower


class Sieve:
    """Finds the tokens that may say something: all but plain words that are not in ``whole`` and have no beginning in ``begins``.

    Hashes of all words of several texts are taken at a time; a word of equal hash more does no harm, since what is left is looked up.
    """

    SHIFT = np.uint64(64 - 22)

    def __init__(self, whole: Iterable[str], begins: dict[int, Iterable[str]]):
        self.whole, self.begins, self.sizes = self.marks(whole), self.marks(chain.from_iterable(begins.values())), sorted(begins)

    def marks(self, words: Iterable[str]) -> np.ndarray:
        out = np.zeros(1 << 22, bool)
        for word in words:
            x = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
            if len(x) <= SIFTED_CHARS:
                out[(x * _powers[: len(x)]).sum(dtype=np.uint64) >> self.SHIFT] = True
        return out

    def tokens(self, texts: list[str | None]) -> Iterator[Counter[str]]:
        """For each text, what :func:`tokens_of` gives, without plain words that say nothing."""
        group, chars = [], 0
        for text in texts:
            text = text or ""
            if chars + len(text) > SIFTED_CHARS or len(group) == SIFTED_CHARS // 2:
                yield from self.sift(group)
                group, chars = [], 0
            if len(text) > SIFTED_CHARS:
                yield tokens_of(text)
            else:
                group.append(text)
                chars += len(text)
        yield from self.sift(group)

    def sift(self, texts: list[str]) -> Iterator[Counter[str]]:
        if not texts:
            return
        joined = "\n" + "\n".join(texts) + "\n"
        x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = _kinds[x]
        change = np.flatnonzero(np.diff(kinds != 0)) + 1
        starts, ends = change[::2], change[1::2]
        letter, inner = kinds == 3, kinds > 1
        letters, inners, places = np.concatenate(([0], np.cumsum(letter))), np.concatenate(([0], np.cumsum(inner))), np.append(np.flatnonzero(inner), 0)
        first, last = places[inners[starts]], places[inners[ends] - 1]
        size = last - first + 1
        plain = (inners[ends] > inners[starts]) & (letters[ends] - letters[starts] == size)
        triple = np.flatnonzero(letter[2:] & (x[2:] == x[1:-1]) & (x[1:-1] == x[:-2]))
        plain[np.searchsorted(starts, triple, "right") - 1] = False
        # a sum of letters times powers by place, set back to the word's own places
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_lower[x] * _powers[: len(x)], dtype=np.uint64)))
        at = np.flatnonzero(plain)
        first, size = first[at], size[at]
        before, back = sums[first], _inverses[first]
        says = self.whole[((sums[first + size] - before) * back) >> self.SHIFT]
        for k in self.sizes:
            says |= (size >= k) & self.begins[((sums[np.minimum(first + k, len(x))] - before) * back) >> self.SHIFT]
        kept = ~plain
        kept[at[says]] = True
        bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
        single = ends - starts == 1
        runs = np.searchsorted(starts[1:][single[1:] & single[:-1]], bounds)
        starts, ends = starts[kept], ends[kept]
        found = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        cuts = np.searchsorted(starts, bounds).tolist()
        for k, text in enumerate(texts):
            out = Counter(found[cuts[k] : cuts[k + 1]])
            if runs[k] < runs[k + 1]:
                add_runs(out, text)
            yield out


class Scorer:
    """Evidence of a text from the weights of all its words; the weight of a token is remembered."""

    def __init__(self, model: np.ndarray | list, weights: dict[str, float], words: dict[str, float]):
        # lists of lists are read faster than an array, one number at a time
        self.model, self.weights, self.words = model if isinstance(model, list) else model.tolist(), weights, words
        # plain words are cheap to weigh again, and disguised ones lie in the halves as well
        self.memo, self.newer, self.older = Kept(self.weight, MEMO), {}, {}
        self.endings = {}
        self.sizes = sorted({len(w) for w in words})
        # weights of whole words and of beginnings of four, five and six letters, which differ in length
        by_kind: dict[str, dict[str, float]] = {}
        for feature, w in weights.items():
            kind, _, letters = feature.partition(":")
            by_kind.setdefault(kind, {})[letters] = w
        self.whole = by_kind.get("w", {})
        self.begins = [(k, own) for k in (4, 5, 6) if (own := by_kind.get(f"p{k}"))]
        self.starts = {letters[:4] for _, own in self.begins for letters in own}
        self.sieve = Sieve(self.whole, dict(self.begins))

    def best(self, words: Iterable[str]) -> float:
        """The largest weight of words and their beginnings."""
        most, whole, starts = 0.0, self.whole, self.starts
        for word in words:
            w = whole.get(word, 0.0)
            if w > most:
                most = w
            if word[:4] in starts:
                for k, own in self.begins:
                    w = own.get(word[:k], 0.0)
                    if w > most:
                        most = w
        return most

    def weight(self, token: str) -> float:
        word = plain_word(token)
        return self.best((word,)) if word else self.disguised(token)

    def disguised(self, token: str) -> float:
        got = self.newer.get(token)
        if got is None:
            got = self.older.get(token)
            if got is None:
                got = self.best(readings(token, self.model, self.words, self.sizes, self.endings))
            if len(self.newer) > MEMO // 2:
                self.newer, self.older = {}, self.newer  # what is asked for again moves over
            if len(token) <= MEMO_CHARS:
                self.newer[token] = got
        return got

    def evidence(self, text: str | None) -> list[float]:
        """The strongest weights, and logarithms of the sums over all distinct words and over all their places."""
        return self.weighed(tokens_of(text or ""))

    def all_evidence(self, texts: list[str | None]) -> np.ndarray:
        """The evidence of each text as a row."""
        return np.array([self.weighed(found) for found in self.sieve.tokens(texts)]).reshape(-1, EVIDENCE)

    def weighed(self, found: Counter[str]) -> list[float]:
        weights = list(map(self.memo.__getitem__, found))
        strong = sorted(filter(None, weights), reverse=True)[:TOP]
        return [*strong, *[0.0] * (TOP - len(strong)), math.log1p(sum(weights)), math.log1p(sum(map(mul, weights, found.values())))]


def log_odds(n1: np.ndarray, n0: np.ndarray, rows1: int, rows0: int) -> np.ndarray:
    """Lower confidence bound of a feature's log-odds of toxicity."""
    raw = np.log((n1 + 0.5) / (rows1 + 1)) - np.log((n0 + 0.5) / (rows0 + 1))
    return np.maximum(raw - 1.64 * np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5)), 0)


def fit_logistic(rows: DataFrame, penalty: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Coefficients (intercept first) by Newton steps; ``rows`` has ``y`` and then the evidence."""
    width = len(rows.columns)  # the intercept in place of y
    beta, ridge = np.zeros(width), np.full(width, penalty)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], beta=beta) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width + 1, width))
            for batch in batches:
                y, *e = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(width))
                x = np.column_stack([np.ones(len(y)), *e])
                p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                total[0] += x.T @ (p - y)
                total[1:] += (x * (p * (1 - p))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["at", "v"])

        total = np.zeros((width + 1) * width)
        for r in rows.mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # (width + 1) * width rows
            total[r.at] = r.v
        grad, square = total[:width] + ridge * beta, total[width:].reshape(width, width)
        step = np.linalg.solve(square + np.diag(ridge + 1e-6), grad)
        beta = beta - step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT_MOD)) == 0


def may_be_marked(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``docs`` without most rows whose id is not in ``marked``, and with all whose id is.

    A bitmap of hashed ids is broadcast, of a most size that does not depend on the tables, so that
    a join that follows shuffles few texts in vain.
    """
    if docs.schema["doc_id"].dataType != marked.schema["doc_id"].dataType or docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "string"):
        return docs  # keys that are equal after a cast need not have equal hashes
    place = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    at, bit = F.floor(place / 64).cast("int"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) AS int))")
    cells = marked.select(at.alias("_at"), bit.alias("_bit")).groupBy("_at").agg(F.bit_or("_bit").alias("_bits"))
    near = docs.withColumn("_at", at).withColumn("_bit", bit).join(F.broadcast(cells), "_at")
    return near.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(docs.columns)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, toxic, text`` of all labelled documents that are not held out."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(~held_out()).where(F.col("toxic").isin(0, 1))
    docs = may_be_marked(docs.select("doc_id", "text").where(~held_out()), marked)
    return docs.join(marked, "doc_id").select("doc_id", "toxic", "text").dropDuplicates(["doc_id", "text"])


def counts_batch(count: Counter[str]) -> pa.RecordBatch:
    """Words and their counts as ``word, n``."""
    return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])


def word_costs(rows: DataFrame, least: int = LEAST_WORDS) -> dict[str, float]:
    """Costs (negative log probability) of the plain words of ``rows`` that are at ``least`` so many places and one in ``WORD_SHARE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for batch in parts(batches):
            for t, n in Counter(chain.from_iterable((text or "").split() for text in batch.column(0).to_pylist())).items():
                w = t.lower() if t.isalpha() else EDGE.sub("", t).lower()
                if w.isalpha():
                    count[w] += n
            if len(count) > COUNTED:
                yield counts_batch(count)
                count.clear()
        yield counts_batch(count)

    counted = materialize(rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    places = counted.agg(F.sum("n").alias("n")).first().n or 0
    kept = counted.where((F.col("n") >= least) & (F.col("n") * WORD_SHARE >= places)).collect()  # at most WORD_SHARE words
    discard(counted)
    total = sum(r.n for r in kept)
    return {r.word: float(np.log(total / r.n)) for r in kept}


def feature_counts(rows: DataFrame, shared: Broadcast, only: Broadcast | None = None) -> DataFrame:
    """``feature, n``: the number of ``rows`` that have a feature; with ``only``, sets of words and of beginnings by length, for these alone.

    ``shared`` holds the language model and the words for cutting.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = shared.value
        sizes = sorted({len(w) for w in words})
        endings: dict = {}
        restored = Kept(lambda token: tuple(readings(token, model, words, sizes, endings)), MEMO // 4)
        known = Kept(lambda token: (word,) if (word := plain_word(token)) else restored[token], MEMO)
        counts: dict[int, Counter[str]] = {k: Counter() for k in (0, 4, 5, 6)}
        sieve = Sieve(only.value[0], {k: only.value[k] for k in (4, 5, 6)}) if only else None
        for batch in parts(batches):
            texts = batch.column(0).to_pylist()
            for found in sieve.tokens(texts) if sieve else (tokens_of(text or "") for text in texts):
                own = set(chain.from_iterable(map(known.__getitem__, found)))
                for k, count in counts.items():
                    features = {w[:k] for w in own if len(w) >= k} if k else own
                    count.update(features & only.value[k] if only else features)
            if sum(map(len, counts.values())) > COUNTED:
                yield from given(counts)
        yield from given(counts)

    def given(counts: dict[int, Counter[str]]) -> Iterator[pa.RecordBatch]:
        for k, count in counts.items():
            # words of one or two letters tell nothing
            own = {(f"p{k}:" if k else "w:") + w: n for w, n in count.items() if len(w) > 2}
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["feature", "n"])
            count.clear()

    return rows.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, float], np.ndarray, dict[str, float]]:
    """Language model, feature weights, logistic coefficients and the costs of words."""
    spark = docs.sparkSession
    model = letter_model(docs)
    sample = materialize(training_rows(docs, labels), "labelled")
    rows = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows1, rows0 = rows.get(1, 0), rows.get(0, 0)
    if not rows1 or not rows0:
        share = rows1 / max(1, rows1 + rows0)
        return model, {}, np.array([np.log((share + 1e-9) / (1 - share + 1e-9)), *[0.0] * EVIDENCE]), {}
    words = word_costs(sample)
    lm = spark.sparkContext.broadcast((model.tolist(), words))
    # few features have toxic rows enough, so the other rows are counted for these alone
    many = feature_counts(sample.where("toxic = 1"), lm).where(f"n > 1 AND n * {FEATURE_SHARE} >= {rows1}").toArrow()  # bounded by the share of rows
    toxic = dict(zip(many["feature"].to_pylist(), many["n"].to_pylist()))
    only = {k: {f.partition(":")[2] for f in toxic if f.startswith(f"p{k}:" if k else "w:")} for k in (0, 4, 5, 6)}
    only = spark.sparkContext.broadcast(only)
    some = feature_counts(sample.where("toxic = 0"), lm, only).toArrow()
    clean = dict(zip(some["feature"].to_pylist(), some["n"].to_pylist()))
    n1, n0 = np.array(list(toxic.values()), float), np.array([clean.get(f, 0) for f in toxic], float)
    odds = log_odds(n1, n0, rows1, rows0)
    best = np.flatnonzero(odds > LEAST_ODDS)
    names, n1, n0 = list(toxic), n1[best], n0[best]
    weights = {names[k]: float(odds[k]) for k in best}
    # each row's evidence without its own counts, as an unseen text would have it
    without = [log_odds(n1, np.maximum(n0 - 1, 0), rows1, rows0), log_odds(n1 - 1, n0, rows1, rows0)]
    others = spark.sparkContext.broadcast([dict(zip(weights, w.tolist())) for w in without])

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(lm.value[0], w, lm.value[1]) for w in others.value]
        for batch in parts(batches):
            texts, ys = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int32)
            ev = np.zeros((len(ys), EVIDENCE))
            for y in (0, 1):
                ev[ys == y] = scorers[y].all_evidence([texts[k] for k in np.flatnonzero(ys == y)])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), *[pa.array(ev[:, k]) for k in range(EVIDENCE)]], ["y", *[f"e{k}" for k in range(EVIDENCE)]])

    shape = "y int, " + ", ".join(f"e{k} double" for k in range(EVIDENCE))
    evidence = materialize(sample.select("text", F.col("toxic").cast("int")).mapInArrow(left_out, shape), "evidence")
    beta = fit_logistic(evidence)
    for sent in (lm, only, others):
        sent.destroy()
    discard(sample, evidence)
    return model, weights, beta, words


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model, weights, beta, words = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model, weights, beta, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, beta, words = shared.value
        scorer = Scorer(model, weights, words)
        for batch in parts(batches):
            ev = scorer.all_evidence(batch.column(1).to_pylist())
            p = 1 / (1 + np.exp(-np.clip(beta[0] + ev @ beta[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose text is not predicted to be toxic, with all their columns."""
    model, weights, beta, words = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model, weights, beta, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, beta, words = shared.value
        scorer = Scorer(model, weights, words)
        for batch in parts(batches):
            at = batch.schema.get_field_index("text")
            ev = scorer.all_evidence(batch.column(at).to_pylist())
            yield batch.filter(pa.array(beta[0] + ev @ beta[1:] < 0))

    return docs.mapInArrow(run, docs.schema)
