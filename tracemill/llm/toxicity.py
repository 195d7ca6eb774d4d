"""Toxicity over text restored by a noisy-channel decoder.

Tokens that look disguised (figures or signs among letters, long repetitions, letters set apart) become lattices of the characters
that each sign may stand for; a Viterbi search under a character trigram model picks the likeliest reading. Words of the restored
text and their beginnings are the features: their log odds between toxic and other rows are learned from labelled rows, those that
tell clearly enough are kept, and a one-variable logistic fit turns the strongest one in a text into a score.

All labelled rows that are not held out are learned from, by counts that Spark adds up; what is broadcast are the features that tell
clearly enough, and the driver fits over the different odds, each with its number of rows. Scoring is one narrow pass over all texts.
Of the texts only those go into the shuffle to their labels whose ids a bitmap of fixed size doesn't rule out, whatever the size of the tables.

Defined results: a null or empty text has no toxic word and gets the lowest score; repeated rows each get their row; without
toxic training rows every score is 0; columns other than doc_id and text are never read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, keep, slices, table

#: One part in so many is held out.
PARTS = 5
#: A feature counts with its log odds less so many standard errors, if that is as much and it is in as many toxic texts.
ERRORS, LEAST_ODDS, LEAST_TEXTS = 2.0, 2.0, 4
PREFIXES = (4, 5, 6)
BEGIN = min(PREFIXES)  # letters that a word has in common with each of its features
REMEMBERED = 300_000
#: Bits of the bitmap of labelled ids, and those of one row of it, as ``bitmap_construct_agg`` makes them.
SLOTS, ROW_SLOTS = 1 << 26, 1 << 15

# Letters that figures and signs commonly stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: log10 costs of the channel: a sign for a letter, a letter written once more, a sign set between letters, a new word in a run of letters.
SUBSTITUTED, REPEATED, SEPARATED, PARTED = -0.3, -0.4, -0.2, -0.3
_EDGE = "".join(c for c in "!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~«»“”„…¡¿")
_SIGNS = re.escape("".join(LEET))
_DISGUISED = re.compile(rf"[^\W\d_][{_SIGNS}]+[^\W\d_]|^[{_SIGNS}]+[^\W\d_]{{2}}|[^\W\d_]{{2}}[{_SIGNS}]$|([^\W\d_])\1\1|^[^\W\d_](?:[.*_\-][^\W\d_]){{2,}}$|[^\W\d_][.*_\-]+[^\W\d_]")
_SPACED = re.compile(rf"(?<![^\W_])[^\W\d_](?:[ .*_\-]+[^\W\d_{_SIGNS}]|[ .*_\-]+[{_SIGNS}]){{2,}}(?![^\W_])")
#: What ``_DISGUISED`` can find in letters alone.
_THRICE = re.compile(r"([^\W\d_])\1\1")
#: Part of whatever ``_SPACED`` finds; begins with a sign, so it is found much sooner.
_MAYBE_SPACED = re.compile(rf"[ .*_\-](?:[^\W\d_]|[{_SIGNS}])[ .*_\-]+(?:[^\W\d_]|[{_SIGNS}])(?![^\W_])")
_BETWEEN = frozenset(".*_-~ ")


class Letters:
    """A trigram model of the letters of words, from word counts."""

    def __init__(self, words: dict[str, int]):
        self.three: Counter[str] = Counter()
        self.two: Counter[str] = Counter()
        for w, n in words.items():
            x = f"  {w} "
            for k in range(2, len(x)):
                self.three[x[k - 2 : k + 1]] += n
                self.two[x[k - 2 : k]] += n

    def cost(self, a: str, c: str) -> float:
        return float(np.log10((self.three[a + c] + 0.05) / (self.two[a] + 2.0)))


def restore(token: str, letters: Letters, beam: int = 24, words: bool = False) -> str:
    """The likeliest letters of a disguised token; without any reading by letters, the token. ``words``: it may hold several words, which are set apart."""
    paths: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}  # last two letters -> best cost and text, as (text before, letters)
    last = ""
    for c in token:
        ways = [(c, 0.0)] if c.isalpha() else [(x, SUBSTITUTED) for x in LEET.get(c, "")]
        drop = SEPARATED if c in _BETWEEN or c in _EDGE else REPEATED if c == last else None
        new: dict[str, tuple[float, tuple | None]] = {}
        for state, (cost, text) in paths.items():
            steps = [(state[1] + x, cost + extra + letters.cost(state, x), (text, x)) for x, extra in ways]
            if words and text:
                parted = cost + PARTED + letters.cost(state, " ")
                steps += [(" " + x, parted + extra + letters.cost("  ", x), (text, " " + x)) for x, extra in ways]
            if drop is not None and text:
                steps.append((state, cost + drop, text))
            for s, k, t in steps or [(state, cost + 2 * SEPARATED, text)]:
                if s not in new or k > new[s][0]:
                    new[s] = (k, t)
        paths, last = dict(sorted(new.items(), key=lambda x: -x[1][0])[:beam]), c
    _, text = max(((cost + letters.cost(s, " "), text) for s, (cost, text) in paths.items()), key=lambda x: x[0], default=(0.0, None))
    out = []
    while text:
        text, x = text
        out.append(x)
    return "".join(reversed(out)) or token


class Known(dict):
    """A function of tokens that remembers the values of ``REMEMBERED`` tokens at most."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, token: str):
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[token] = self.of(token)
        return got


class Reader:
    """Words of a text, restored where they look disguised; remembers what it restored."""

    def __init__(self, letters: Letters | None):
        self.letters, self.known = letters, Known(self.word)

    def word(self, token: str) -> str:
        bare = token.strip(_EDGE)
        if bare.isalpha() and "!" not in token and not _THRICE.search(bare):  # most words: nothing stands for a letter
            return bare
        return restore(token.rstrip(".,;:?"), self.letters) if self.letters and _DISGUISED.search(bare if bare != token.rstrip(".,;:?!") else token) else bare

    def spaced(self, low: str) -> set[str]:
        """Words whose letters are set apart."""
        out: set[str] = set()
        if self.letters and _MAYBE_SPACED.search(low):
            for m in _SPACED.finditer(low):
                out |= {restore(m[0], self.letters), *restore(m[0], self.letters, words=True).split()}
        return out

    def words(self, text: str) -> set[str]:
        low = text.lower()
        out = set(map(self.known.__getitem__, set(low.split()))) | self.spaced(low)
        out.discard("")
        return out


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) > k)]


def _likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be among ``ids``; all that are in are kept."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    marks = ids.groupBy(F.floor(slot / ROW_SLOTS).alias("_row")).agg(F.bitmap_construct_agg(F.pmod(slot, F.lit(ROW_SLOTS))).alias("_bits"))  # SLOTS / ROW_SLOTS rows at most
    at = F.pmod(slot, F.lit(ROW_SLOTS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = docs.withColumn("_row", F.floor(slot / ROW_SLOTS)).join(F.broadcast(marks), "_row")
    return marked.where(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*docs.columns)


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of all labelled rows that are not held out. The join is the same for tables of any size: labels that could be broadcast when small would be shuffled when large."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(PARTS)) != 0))
    texts = _likely(docs.select("doc_id", "text"), rows.select("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return texts.join(rows.hint("merge"), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))


def _feature_counts(rows: DataFrame, letters) -> DataFrame:
    """(feature, toxic texts, other texts)."""

    def run(batches):
        reader = Reader(letters.value)
        seen = {k: (Counter(), Counter()) for k in (None, *PREFIXES)}  # words, and beginnings by their lengths: (in other texts, in toxic ones)

        def out():
            for k, (good, bad) in seen.items():
                both = list(good.keys() | bad.keys())
                for at in range(0, len(both), 100_000):
                    some = both[at : at + 100_000]
                    yield pa.RecordBatch.from_pydict({"feature": pa.array([f"{x}~" for x in some] if k else some, pa.string()), "bad": pa.array([bad[x] for x in some], pa.int64()), "good": pa.array([good[x] for x in some], pa.int64())})
                good.clear()
                bad.clear()

        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = reader.words(text or "")
                seen[None][toxic == 1].update(words)
                for k in PREFIXES:
                    seen[k][toxic == 1].update({w[:k] for w in words if len(w) > k})
            if sum(len(c) for both in seen.values() for c in both) > 500_000:
                yield from out()
        yield from out()

    return rows.mapInArrow(run, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _letters(rows: DataFrame) -> Letters:
    """The letter model of the training words: figures aside, words of letters alone, at most 26 ** 3 trigrams of them count."""

    def run(batches):
        seen: Counter[str] = Counter()
        tokens: Counter[str] = Counter()

        def add():
            for w, n in tokens.items():
                w = w.strip(_EDGE)
                if w.isascii() and w.isalpha():
                    x = f"  {w} "
                    for k in range(2, len(x)):
                        seen[x[k - 2 : k + 1]] += n
            tokens.clear()

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                tokens.update(set((text or "").lower().split()))
            if len(tokens) > REMEMBERED:
                add()
        add()
        yield pa.RecordBatch.from_pydict({"three": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    model = Letters({})
    for three, n in rows.mapInArrow(run, "three string, n long").groupBy("three").agg(F.sum("n")).collect():  # 27 ** 3 rows at most
        model.three[three] += n
        model.two[three[:2]] += n
    return model


def evidence(words: set[str], odds: dict[str, float]) -> float:
    """The best feature of all words: long texts gather many weak ones by chance, so these don't add up."""
    return max((odds.get(f, 0.0) for w in words for f in features(w)), default=0.0)


class Strength:
    """The evidence of texts; remembers that of their tokens."""

    def __init__(self, reader: Reader, odds: dict[str, float]):
        self.reader, self.odds = reader, odds
        self.begins = {f[:BEGIN] for f in odds}
        self.known = Known(self.token)

    def token(self, token: str) -> float:
        word = self.reader.word(token)
        return evidence({word}, self.odds) if word[:BEGIN] in self.begins else 0.0

    def of(self, text: str) -> float:
        low = text.lower()
        return max(max(map(self.known.__getitem__, set(low.split())), default=0.0), evidence(self.reader.spaced(low), self.odds))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit by Newton steps, with a ridge on the slope. ``n``: how many rows each pair stands for."""
    z, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (n * (y - p)) - np.array([ridge * w[0], 1e-6 * w[1]])
        hess = (z * (n * p * (1 - p))[:, None]).T @ z + np.diag([ridge, 1e-6])
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


class Model:
    def __init__(self, letters: Letters, odds: dict[str, float], slope: float, offset: float):
        self.letters, self.odds, self.slope, self.offset = letters, odds, slope, offset

    def scores(self, found: list[float]) -> np.ndarray:
        """Scores of texts by their evidence."""
        return 1 / (1 + np.exp(-np.clip(self.slope * np.array(found, float) + self.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    spark = docs.sparkSession
    rows = keep(_training(docs, labels), "toxic-training")
    n = {r[0]: r[1] for r in rows.groupBy((F.col("toxic") == 1).alias("bad")).agg(F.count("*")).collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    if not bad:
        return None
    letters = _letters(rows)
    shared = spark.sparkContext.broadcast(letters)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0)) - ERRORS * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    found = _feature_counts(rows, shared).withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (F.col("bad") >= LEAST_TEXTS))
    table_ = {r[0]: r[1] for r in found.select("feature", "odds").toLocalIterator()}
    known = spark.sparkContext.broadcast(table_)

    def run(batches):
        strength = Strength(Reader(shared.value), known.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"x": pa.array([strength.of(t or "") for t in batch.column("text").to_pylist()], pa.float64()), "y": batch.column("toxic").cast(pa.float64())})

    pairs = rows.mapInArrow(run, "x double, y double").groupBy("x", "y").agg(F.count("*").alias("n")).orderBy("x", "y").toPandas()  # two rows for each of the odds at most
    x, y, n = (pairs[c].to_numpy(float) for c in ("x", "y", "n"))
    return Model(letters, table_, *logistic(x, (y == 1).astype(float), n))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        m = model.value
        strength = Strength(Reader(m.letters), m.odds) if m else None
        for batch in slices(batches, most=SLICE_BYTES):
            s = m.scores([strength.of(t or "") for t in batch.column("text").to_pylist()]) if m else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(s, pa.float64())})

    df = docs.select("doc_id", "text")
    out = df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(PARTS)) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
