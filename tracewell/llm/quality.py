"""Quality rules with n-gram perplexity: a Spark-counted modified Kneser-Ney model and bands per language.

The model is over character classes: ``CLASSES`` of them, n-grams of ``ORDER``, so it has at most 56**4 + 2 * 56**3 + ...
(10 million) entries whatever the corpus; that bounds what is broadcast (at most 125 MB). Letters of ASCII have a class
each; other code points share 21 classes by their number, so an alphabet of some thirty letters keeps most of them
apart. Every n-gram of every document is counted: tasks count their texts, Spark sums. The model is kept as sorted
arrays of n-gram hashes with log-probabilities and back-off weights beside them, and looked up by binary search.

Each document gets the mean negative log-probability (log-perplexity) of its whole text, summed in whole numbers of
2**-20, so equal texts have equal values wherever they stand. For each language, the
quartiles over the documents that pass the base rules give a lower and an upper fence, ``FENCE`` quartile ranges
outside; documents beyond either are rejected. A language with under ``LEAST_DOCS`` such documents has the band of the
documents of all languages together.

Null and empty texts have no words and so fail the base rules. Null languages are a language of their own. Repeated
rows and null ids give a row each; extra columns are left out; an empty table gives no rows. A text of any length is
judged whole, by the task that holds its row. A value on a fence is inside the band.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_pass, bitmap, has, join_small, materialize

ORDER = 4
CLASSES = 56
FENCE = 4.0
LEAST_DOCS = 20
MIN_WORDS = 50
#: parts of one that log-probabilities are rounded to before they are summed
PARTS = 2**20
#: bins of log-perplexity are 1/BINS wide
BINS = 1000
#: no band is narrower than this on either side of the quartiles
LEAST_FENCE = 0.04
#: n-grams that a task counts or scores at once, about; a longer text alone
COUNT_CODES = 1_000_000
SCORE_CODES = 250_000
_BLANK = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"


def _class_table() -> np.ndarray:
    """Classes of ASCII: 26 letters, then capitals, digits, blanks, line ends, marks; those from 35 are left to others."""
    table = np.full(128, 34, np.int64)
    for c in range(128):
        ch = chr(c)
        if ch.islower():
            table[c] = c - 97
        elif ch.isupper():
            table[c] = 26
        elif ch.isdigit():
            table[c] = 27
        elif ch in _BLANK:
            table[c] = 29 if ch == "\n" else 28
        elif ch in ".!?":
            table[c] = 30
        elif ch in ",;:":
            table[c] = 31
        elif ch in "'\"()[]{}-":
            table[c] = 32
        elif ch in _SYMBOLS:
            table[c] = 33
    return table


_TABLE = _class_table()


def gram_codes(text: str) -> np.ndarray:
    """The code of the n-gram that ends at each character; three line ends stand before the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.full(len(points) + ORDER - 1, 29, np.int64)
    classes[ORDER - 1 :] = np.where(points < 128, _TABLE[np.minimum(points, 127)], 35 + points % (CLASSES - 35))
    code = np.zeros(len(points), np.int64)
    for k in range(ORDER):
        code = code * CLASSES + classes[k : k + len(points)]
    return code


def _hash(order: int, codes: np.ndarray) -> np.ndarray:
    """A one-to-one 64-bit mix of (order, code)."""
    x = (codes.astype(np.uint64) * np.uint64(8) + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Model:
    """Modified Kneser-Ney over class n-grams, from counts of the highest order."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        keys, logp = [], []
        order = np.argsort(codes)
        levels = {ORDER: (codes[order].astype(np.int64), counts[order].astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct classes to the left
            codes, counts = np.unique(levels[n + 1][0] % CLASSES**n, return_counts=True)
            levels[n] = codes, counts.astype(np.float64)
        below, p = np.arange(CLASSES), np.full(CLASSES, 1 / CLASSES)
        for n in range(1, ORDER + 1):
            codes, c = levels[n]
            of = [float((c == k).sum()) for k in (1, 2, 3, 4)]
            y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.0
            cut = np.array([0.0, *(min(k, max(0.0, k - (k + 1) * y * of[k] / of[k - 1])) if of[k - 1] else 0.0 for k in (1, 2, 3))])
            taken = cut[np.minimum(c, 3).astype(int)]
            contexts, at = np.unique(codes // CLASSES, return_inverse=True)
            total = np.bincount(at, c, len(contexts))
            gamma = np.maximum(np.bincount(at, taken, len(contexts)) / total, 1e-9)
            lower = p[np.searchsorted(below, codes % CLASSES ** (n - 1))] if n > 1 else np.full(len(codes), 1 / CLASSES)
            p = (c - taken) / total[at] + gamma[at] * lower
            below = codes
            keys.append(_hash(n, codes))
            logp.append(np.log(p))
            if n > 1:  # back-off weights of contexts
                keys.append(_hash(ORDER + n - 1, contexts))
                logp.append(np.log(gamma))
            else:  # a class never seen
                self.floor = float(np.log(gamma[0] / CLASSES)) if len(gamma) else float(-np.log(CLASSES))
        order = np.argsort(np.concatenate(keys))
        self.keys = np.concatenate(keys)[order]
        self.values = np.concatenate(logp)[order].astype(np.float32)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Natural log-probability of each n-gram's last class given the ones before."""
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        for n in range(ORDER, 0, -1):
            code = codes[open_] % CLASSES**n
            at, hit = self._find(_hash(n, code))
            out[open_[hit]] += self.values[at[hit]]
            open_, code = open_[~hit], code[~hit]
            if not len(open_):
                return out
            if n > 1:
                at, hit = self._find(_hash(ORDER + n - 1, code // CLASSES))
                out[open_[hit]] += self.values[at[hit]]
        out[open_] += self.floor
        return out


def add_counts(gram: np.ndarray, n: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams and their counts, with those of ``codes`` added."""
    more, k = np.unique(codes, return_counts=True)
    at = np.searchsorted(gram, more)
    hit = at < len(gram)
    hit[hit] = gram[at[hit]] == more[hit]
    n[at[hit]] += k[hit]
    if hit.all():
        return gram, n
    gram = np.concatenate([gram, more[~hit]])
    order = np.argsort(gram, kind="stable")
    return gram[order], np.concatenate([n, k[~hit]])[order]


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, n): how often each n-gram stands in all texts. A task holds the n-grams it has met, not a place for each."""

    def run(batches):
        gram, n = np.zeros(0, np.int32), np.zeros(0, np.int64)
        held, size = [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(gram_codes(text).astype(np.int32))
                size += len(text)
                if size > COUNT_CODES:
                    gram, n = add_counts(gram, n, np.concatenate(held))
                    held, size = [], 0
        if held:
            gram, n = add_counts(gram, n, np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(n)], names=["gram", "n"])

    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    return arrow_pass(text, run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Model:
    """The model of all texts; at most ``CLASSES**ORDER`` counts reach the driver."""
    rows = count_grams(docs).toArrow()
    return Model(rows["gram"].to_numpy(), rows["n"].to_numpy())


def base_features(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    repeated = 0
    if len(ids) >= 3:
        pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1].astype(np.int64)
        _, which, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        hit = count[which] >= 2
        cover = np.zeros(len(ids), bool)
        for k in range(3):
            cover[k : k + len(hit)] |= hit
        repeated = int(cover.sum())
    return len(words), len(text) - sum(map(text.count, _BLANK)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, t (a hash of the text), the base features, base_failed, log_perplexity (null without characters).
    A written table."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for batch in batches:
            texts, out, held = batch.column("text").to_pylist(), [], []
            per = []
            for k, text in enumerate(texts):
                out.append(base_features(text))
                held.append(gram_codes(text))
                if k + 1 == len(texts) or sum(map(len, held)) > SCORE_CODES:
                    ends = np.cumsum([0, *map(len, held)])
                    sums = np.concatenate([[0], np.cumsum(np.rint(known.log_probability(np.concatenate(held)) * PARTS).astype(np.int64))]).tolist()
                    per += [(sums[a] - sums[b]) / PARTS / (b - a) if b > a else None for a, b in zip(ends.tolist(), ends[1:].tolist())]
                    held = []
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("t"), *(pa.array(x, pa.int64()) for x in zip(*out)), pa.array(per, pa.float64())], names=["doc_id", "lang", "t", *_NAMES, "log_perplexity"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    scored = arrow_pass(rows, run, f"doc_id long, lang string, t long, {', '.join(f'{n} long' for n in _NAMES)}, log_perplexity double")
    return materialize(scored.withColumn("base_failed", _base_failed()), "scores", BATCH_ROWS)


def _bins(scores: DataFrame) -> DataFrame:
    """lang, bin, n: exact counts per bin of log-perplexity of the documents that pass the base rules."""
    return scores.where(~F.col("base_failed")).groupBy("lang", F.floor(F.col("log_perplexity") * BINS).alias("bin")).agg(F.count("*").alias("n"))


def _fences(bins: DataFrame, key: str, fence: float) -> DataFrame:
    """key, low, high, docs: fences of log-perplexity of each key."""
    up = Window.partitionBy(key).orderBy("bin")
    placed = bins.withColumns({"upto": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy(key))})

    def quartile(share: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("bin"))) / BINS

    quartiles = placed.groupBy(key).agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), F.max("all").alias("docs"))
    reach = F.greatest((F.col("q3") - F.col("q1")) * fence, F.lit(LEAST_FENCE))
    return quartiles.select(key, (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"), "docs")


def bands(scores: DataFrame, fence: float = FENCE) -> DataFrame:
    """lang, low, high of the languages with at least ``LEAST_DOCS`` documents that pass the base rules."""
    return _fences(_bins(scores), "lang", fence).where(F.col("docs") >= LEAST_DOCS).select(F.col("lang").alias("band_lang"), "low", "high")


def common_band(scores: DataFrame, fence: float = FENCE) -> tuple[float | None, float | None]:
    """low, high of the documents of all languages together; None where no document passes the base rules."""
    bins = _bins(scores).groupBy("bin").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    row = _fences(bins, "one", fence).first()
    return (row.low, row.high) if row else (None, None)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base features, base_failed, kept, lang, log_perplexity, low, high, t (a hash of the text)."""
    scores = score(docs, train(docs))
    limits = bands(scores)
    judged = join_small(scores, limits, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    judged = judged.withColumns({c: F.coalesce(c, F.lit(every).cast("double")) for c, every in zip(("low", "high"), common_band(scores))})
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.select("doc_id", *_NAMES, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang", "log_perplexity", "low", "high", "t")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept. A row is its doc_id with its text and language, so rows that
    share an id, or have none, are judged each for itself. Only rows that a filter of the rejected ones lets pass are
    joined with these, so the texts of the others are not shuffled."""
    rejected = judge(docs).where(~F.col("kept")).select(F.col("doc_id").alias("of_id"), F.col("t").alias("of_t"), F.col("lang").alias("of_lang")).distinct()
    rejected = materialize(rejected, "rejected")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), F.col("lang").cast("string").alias("lang"))
    on = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("t") == F.col("of_t")) & F.col("lang").eqNullSafe(F.col("of_lang"))
    words = docs.sparkSession.sparkContext.broadcast(bitmap(rejected.select(F.xxhash64("of_id", "of_t", "of_lang").alias("key"))))

    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        return pd.Series(has(words.value, keys.to_numpy()))

    held = held.withColumn("may", may(F.xxhash64("id", "t", "lang")))
    return held.where(~F.col("may")).unionByName(join_small(held.where("may"), rejected, on, "left_anti")).select("row.*")
