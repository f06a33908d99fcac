"""Phrase collocation mining: which runs of two to five words stand together more often than their parts would.

1. Equal pieces of text become one row with its number of copies, so repeated passages are counted once.
2. Phrases of n words are counted for n = 1, 2, ... in turn. A task sums the phrases of a few megabytes of pieces and
   sends them, a row for each hash bucket, to the bucket's task, where DuckDB sums them out of core: beyond
   ``COUNT_MEMORY`` it works from a scratch folder of the task, which goes when the task ends. A phrase that occurs
   ``least`` times consists of phrases that do, so phrases of n words are only sent where both of their phrases of
   n - 1 words pass a bitmap of the frequent ones (at most 16 MB). It lets some others pass, whose counts then tell.
3. Every cut of a candidate asks for the counts of its two parts. The requests are shuffled to where the counts lie,
   and the answers back to the candidate.
4. A phrase is dropped for a longer one with the same count. If any longer one has it, so has one with a word more,
   so only those are looked at.

Null text is empty, a null language is ``und``. Rows count as often as they stand in the table, whatever their id.
Texts without words add nothing; an empty table gives no rows. A text or piece of any length is gone through in blocks
of words. Ties of a rank go by count and then by phrase (UTF-8 bytes). Columns of other names are not read.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, bitmap, has, join_small, materialize, release

#: bytes of pieces whose phrases a task sums before it sends them
CHUNK_BYTES = 12_000_000
#: words worked on at once
BLOCK_WORDS = 1_000_000
#: memory of one count in DuckDB; beyond it works out of core
COUNT_MEMORY = "256MB"
#: parts of a language that are ranked for themselves before its first rows are
RANKED_APART = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces_of(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, piece, copies): the distinct pieces of a language, words parted by one space, and how often each stands."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.explode(F.split(lower, "[.,;:!?\\n\\x0B\\x0C\\r]")).alias("piece"))
    rows = rows.select("lang", F.trim(F.regexp_replace("piece", "[ \\t]+", " ")).alias("piece")).where("piece <> ''")
    return rows.groupBy("lang", "piece").agg(F.count("*").alias("copies"))


def _hash(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _next(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one more word."""
    h = h * _MIX + word
    return h ^ (h >> np.uint64(29))


def _phrases(lang: str, piece: pa.Array, copies: np.ndarray, n: int, frequent: np.ndarray | None):
    """(phrases, counts, hashes) of a block of words at a time; each block's phrases are distinct."""
    words = pc.split_pattern(piece, " ")
    flat = words.flatten().dictionary_encode()
    names, index = flat.dictionary, np.asarray(flat.indices)
    ends = np.cumsum(np.diff(np.asarray(words.offsets)))
    hashes, seed = _hash(names), _hash(pa.array([lang]))[0]
    for begin in range(0, len(index), BLOCK_WORDS):
        code = index[begin : begin + BLOCK_WORDS + n - 1].astype(np.int64)
        at = np.arange(begin, begin + len(code))
        own = np.searchsorted(ends, at, side="right")
        start = np.flatnonzero((ends[own] - at >= n) & (at < begin + BLOCK_WORDS))
        h, word = np.full(len(start), seed, np.uint64), hashes[code]
        if frequent is not None and n > 1:
            first, second = h, h
            for j in range(n - 1):
                first, second = _next(first, word[start + j]), _next(second, word[start + j + 1])
            both = has(frequent, first.view(np.int64)) & has(frequent, second.view(np.int64))
            start, h = start[both], first[both]
            h = _next(h, word[start + n - 1])
        else:
            for j in range(n):
                h = _next(h, word[start + j])
        if not len(start):
            continue
        key = code[start]
        for j in range(1, n):
            key = pd.factorize(key)[0] * np.int64(len(names)) + code[start + j]
        which, distinct = pd.factorize(key)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, which, copies[own[start]])
        one = np.zeros(len(distinct), np.int64)
        one[which] = np.arange(len(which))
        parts = [names.take(pa.array(code[start[one] + j])) for j in range(n)]
        yield parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " "), total, h[one]


def _packed(found: list[tuple[str, pa.Array, np.ndarray, np.ndarray]], keys: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: its languages, and for each its phrases, a line each, and their counts."""
    out: dict[int, list] = {}
    for lang, phrases, counts, hashes in found:
        bucket = (hashes % np.uint64(len(keys))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, counts = bucket[order], counts[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), phrases.take(pa.array(order))), "\n").to_pylist()
        for k, text in enumerate(lines):
            out.setdefault(int(bucket[cuts[k]]), []).append((lang, text, counts[cuts[k] : cuts[k + 1]].tobytes()))
    columns = [[[x[c] for x in own] for own in out.values()] for c in range(3)]
    kinds = (pa.string(), pa.string(), pa.binary())
    return batch_of(key=pa.array(keys[list(out)]), **{name: pa.array(col, pa.list_(kind)) for name, col, kind in zip(("langs", "phrases", "counts"), columns, kinds)})


def bucket_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """An int for each of ``parts`` partitions that Spark's hash sends there, so that each partition gets one bucket."""
    rows = spark.range(40 * parts).select(F.col("id").cast("int").alias("key"))
    first = rows.groupBy(F.pmod(F.hash("key"), F.lit(parts)).alias("part")).agg(F.min("key").alias("key")).collect()  # a row for each partition
    return np.array(sorted(r.key for r in first), np.int32)


def count_phrases(pieces: DataFrame, n: int, least: int, frequent: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, a) of the phrases of ``n`` words that occur ``least`` times or more in pieces (lang, piece, copies).

    ``frequent``: bitmap of the hashes of the frequent phrases of n - 1 words.
    """
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = bucket_keys(pieces.sparkSession, parts)

    def send(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            langs = table["lang"].chunk(0).dictionary_encode()
            copies = table["copies"].to_numpy()
            of = np.asarray(langs.indices)
            found = []
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(of == k)
                for phrases, counts, hashes in _phrases(lang, table["piece"].chunk(0).take(pa.array(own)), copies[own], n, frequent):
                    found.append((lang, phrases, counts, hashes))
                    if sum(len(x[2]) for x in found) >= BLOCK_WORDS:
                        yield _packed(found, keys)
                        found = []
            if found:
                yield _packed(found, keys)

        size = 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += batch.nbytes
            if size >= CHUNK_BYTES:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def total(batches):
        import duckdb

        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("m", pa.int64())])

        def rows():
            for batch in batches:
                lists, langs = pc.split_pattern(batch.column("phrases").flatten(), "\n"), batch.column("langs").flatten()
                langs = langs.take(pa.array(np.repeat(np.arange(len(langs)), np.diff(np.asarray(lists.offsets)))))
                counts = np.frombuffer(b"".join(batch.column("counts").flatten().to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([langs, lists.flatten(), pa.array(counts)], schema=schema)

        with tempfile.TemporaryDirectory(prefix="count-") as scratch:
            db = duckdb.connect(f"{scratch}/count.db", config={"memory_limit": COUNT_MEMORY, "threads": 1, "temp_directory": scratch, "preserve_insertion_order": False})
            try:
                db.register("sent", pa.RecordBatchReader.from_batches(schema, rows()))
                yield from db.sql(f"SELECT lang, phrase, sum(m)::BIGINT AS a FROM sent GROUP BY lang, phrase HAVING sum(m) >= {least}").to_arrow_reader(50_000)
            finally:
                db.close()

    sent = pieces.select("lang", "piece", "copies").mapInArrow(send, "key int, langs array<string>, phrases array<string>, counts array<binary>")
    return sent.repartition(parts, "key").drop("key").mapInArrow(total, "lang string, phrase string, a long")


def _bitmap_of(counts: DataFrame, n: int) -> np.ndarray:
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            h = _hash(batch.column("lang"))
            words = pc.split_pattern(batch.column("phrase"), " ").flatten().dictionary_encode()
            each = _hash(words.dictionary)[np.asarray(words.indices)].reshape(-1, n)
            for j in range(n):
                h = _next(h, each[:, j])
            yield batch_of(h=pa.array(h.view(np.int64)))

    return bitmap(counts.select("lang", "phrase").mapInArrow(run, "h long"))


def frequent_phrases(pieces: DataFrame, longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, phrase, n_words, a): all phrases of one to ``longest`` words that occur ``least`` times or more."""
    out, frequent = None, None
    for n in range(1, longest + 1):
        counts = materialize(count_phrases(pieces, n, least, frequent), f"phrases-{n}")
        rows = counts.select("lang", "phrase", F.lit(n).alias("n_words"), "a")
        out = rows if out is None else out.unionByName(rows)
        if n < longest:
            frequent = _bitmap_of(counts, n)
    return out


def score_phrases(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, a, l, r, n, score) of the candidates: the cut of the lowest score, of equals the first.

    ``counts`` as of ``frequent_phrases``; ``totals`` (lang, n). Products are decimals of 38 digits, so they are exact.
    """
    words = F.split("phrase", " ")
    cuts = counts.where("n_words >= 2").select("lang", "phrase", "n_words", "a", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    head, rest = F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), F.array_join(F.slice(words, F.col("k") + 1, F.col("n_words")), " ")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), head.alias("part")), F.struct(F.lit(1).alias("side"), rest.alias("part"))))
    requests = cuts.select("lang", "phrase", "n_words", "a", "k", sides.alias("s")).select("lang", "phrase", "n_words", "a", "k", "s.side", "s.part")
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"])
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f")))
    both = answers.groupBy("lang", "phrase", "n_words", "a", "k").agg(of(0).alias("l"), of(1).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = join_small(both, totals, "lang").withColumns({"top": (wide("a") * wide("n")).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)"), "under": wide("l") * wide("r")})
    scored = scored.withColumn("score", F.expr("cast(top as decimal(38,0)) div cast(under as decimal(38,0))"))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("n_words", "a", "l", "r", "n", "score"), F.struct("score", "k")).alias("b"))
    return best.select("lang", "phrase", "b.*")


def contained(counts: DataFrame) -> DataFrame:
    """(lang, phrase): candidates inside a longer one that occurs as often."""
    longer = counts.where("n_words >= 3").withColumn("words", F.split("phrase", " "))
    inner = F.explode(F.array(*[F.array_join(F.slice("words", F.lit(at), F.col("n_words") - 1), " ") for at in (1, 2)]))
    most = longer.select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer_a"))
    return counts.where("n_words >= 2").join(most, ["lang", "phrase"]).where("longer_a >= a").select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words."""
    pieces = materialize(pieces_of(docs, lang_col, text_col), "pieces")
    totals = pieces.groupBy("lang").agg(F.sum(F.col("copies") * F.size(F.split("piece", " "))).alias("n"))
    totals = materialize(totals, "words")
    counts = frequent_phrases(pieces, longest, least)
    release(pieces)
    kept = score_phrases(counts, totals).join(contained(counts), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language may hold most candidates: its first rows are among the first of each of its parts
    apart = kept.withColumn("apart", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART)))
    near = apart.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "apart").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
