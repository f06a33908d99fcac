"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Sources in code-point order (null last) get weights ``WEIGHTS``, repeating, of ``share`` times all words; a target over
``most`` times its source's words stops there and the excess is shared again by weight. A document is then to be taken
target / source words times: the whole part surely, the fractional part as a probability.

The fractions are rounded in pairs: mass (words) moves at random from one document to the other until one of the two
probabilities is 0 or 1, with odds that keep both expectations and the sum of words. The other goes on as the
residual. Documents are dealt by hash into buckets of about ``FAN_IN`` per source; each bucket folds to one residual,
residuals are dealt again, and so on: a reduction tree of log(documents) / log(FAN_IN) levels, each a written table.
Only the last residual of a source is rounded by itself, so a source misses its target by less than one document.

Randomness is a hash of the documents' ids, texts and ``seed``, so reruns agree. Null texts have size 0 and, like all
empty documents, take 0. Repeated rows are documents of their own: they are numbered, each number in a bucket of its
own, so one row, or the rows without an id, may be any share of the table. Extra columns are left out by ``mix`` and
kept by ``take_copies``. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialize

WEIGHTS = (3, 1, 2)
FAN_IN = 48
_UNIT = "struct<h:bigint,doc_id:bigint,size:bigint,t:bigint,p:double>"
_FOLD = f"struct<cur:{_UNIT},done:array<struct<doc_id:bigint,size:bigint,t:bigint,extra:int>>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """source, source_ix, source_size, n_docs (with words), target; one row per source."""
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source only
    ranked = stats.withColumn("source_ix", F.row_number().over(order))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_ix") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumns({"cap": F.col("source_size") * F.lit(most), "whole": F.sum("source_size").over(Window.partitionBy()) * F.lit(share)})
    # filled in the order in which sources reach their caps: the level is set by the first that does not
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_ix")
    upto, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("level", (F.col("whole") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    ranked = ranked.withColumn("level", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "source_ix", "level"))).over(Window.partitionBy())["level"])
    return ranked.select("source", "source_ix", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _uniform(*of: Column) -> Column:
    return F.xxhash64(*of).bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53))


def _pair(seed: int):
    """Folds one more document into the residual of a bucket."""

    def step(acc: Column, x: Column) -> Column:
        a = acc.cur
        raise_a = F.least((1 - a.p) * a.size, x.p * x.size)
        lower_a = F.least(a.p * a.size, (1 - x.p) * x.size)
        both = raise_a + lower_a
        up = _uniform(a.h, x.h, F.lit(seed)) * both < lower_a
        moved = F.when(up, raise_a).otherwise(-lower_a)
        a_done = F.when(up, (1 - a.p) * a.size <= x.p * x.size).otherwise(a.p * a.size <= (1 - x.p) * x.size)
        # a ends at 1 when raised and at 0 when lowered; x the other way round
        done = F.struct(
            F.when(a_done, a.doc_id).otherwise(x.doc_id).alias("doc_id"), F.when(a_done, a.size).otherwise(x.size).alias("size"),
            F.when(a_done, a.t).otherwise(x.t).alias("t"), F.when(a_done == up, 1).otherwise(0).alias("extra"),
        )
        p = F.when(a_done, x.p - moved / x.size).otherwise(a.p + moved / a.size)
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        rest = F.struct(F.when(a_done, x.h).otherwise(a.h).alias("h"), F.when(a_done, x.doc_id).otherwise(a.doc_id).alias("doc_id"), F.when(a_done, x.size).otherwise(a.size).alias("size"), F.when(a_done, x.t).otherwise(a.t).alias("t"), p.alias("p"))
        first = F.struct(x.alias("cur"), acc.done.alias("done")).cast(_FOLD)
        return F.when(a.isNull(), first).otherwise(F.struct(rest.alias("cur"), F.concat(acc.done, F.array(done)).alias("done")).cast(_FOLD))

    return step


def round_fractions(units: DataFrame, n_max: int, seed: int) -> DataFrame:
    """units: source_ix, n (units of the source), h, doc_id, size, t, p. Result: source_ix, doc_id, size, t, extra (0 or 1)."""
    decided = None
    while True:
        buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / FAN_IN)).cast("long")
        dealt = units.withColumns({"buckets": buckets, "bucket": F.pmod(F.col("h"), buckets)})
        start = F.struct(F.lit(None).cast(_UNIT).alias("cur"), F.lit(None).cast("array<struct<doc_id:bigint,size:bigint,t:bigint,extra:int>>").alias("done"))
        start = F.struct(start["cur"].alias("cur"), F.array().cast("array<struct<doc_id:bigint,size:bigint,t:bigint,extra:int>>").alias("done")).cast(_FOLD)
        folded = dealt.groupBy("source_ix", "bucket").agg(F.max("buckets").alias("n"), F.array_sort(F.collect_list(F.struct("h", "doc_id", "size", "t", "p"))).alias("units"))
        folded = materialize(folded.select("source_ix", "n", F.aggregate("units", start, _pair(seed)).alias("fold")), "mix-level")
        out = folded.select("source_ix", F.explode("fold.done").alias("d")).select("source_ix", "d.doc_id", "d.size", "d.t", "d.extra")
        decided = out if decided is None else decided.unionByName(out)
        units = folded.select("source_ix", "n", F.xxhash64("fold.cur.h", F.lit(seed)).alias("h"), "fold.cur.doc_id", "fold.cur.size", "fold.cur.t", "fold.cur.p")
        n_max = max(1, math.ceil(n_max / FAN_IN))
        if n_max == 1:
            last = F.when(_uniform(F.col("h"), F.lit(seed + 1)) < F.col("p"), 1).otherwise(0)
            return decided.unionByName(units.select("source_ix", "doc_id", "size", "t", last.alias("extra")))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (source, doc_id, size, t) with k, the number of a row among its equals from 0.

    Equal rows are counted by the partition that read them, and numbered inside it from where the others before end.
    """
    key = ["source", "doc_id", "size", "t"]
    rows = materialize(rows.select(*key, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "mix-sizes")
    several = rows.groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy("part")  # a row per partition only
    several = several.withColumns({"first": F.sum("n").over(before) - F.col("n"), "all": F.sum("n").over(Window.partitionBy(*key))}).where("all > 1")
    several = materialize(several.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("part").alias("_part"), "first"), "mix-equal")
    on = [rows[c].eqNullSafe(several[f"_{c}"]) for c in key] + [rows["part"] == several["_part"]]
    inside = F.row_number().over(Window.partitionBy(*key, "part").orderBy("at"))
    repeated = join_small(rows, several, on).withColumn("k", F.col("first") + inside - 1)
    single = join_small(rows, several, on, "left_anti").withColumn("k", F.lit(0).cast("long"))
    return materialize(single.select(*key, "k").unionByName(repeated.select(*key, "k")), "mix-rows")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies, t (hash of the text); one row per document."""
    sizes = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("t"))
    sizes = _numbered(sizes)
    sources = materialize(source_targets(sizes, share, most, weights), "mix-sources")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumns({"whole": F.floor(times), "p": times - F.floor(times)})
    n_max = sources.agg(F.max("n_docs")).first()[0] or 0
    placed = join_small(sizes, sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    split = (F.col("p") > 0) & (F.col("size") > 0)
    units = placed.where(split).select("source_ix", F.col("n_docs").alias("n"), F.xxhash64("doc_id", "size", "t", "k", F.lit(seed)).alias("h"), "doc_id", "size", "t", "p")
    sure = placed.where(~split).select("source_ix", "doc_id", "size", "t", F.lit(0).alias("extra"))
    rows = round_fractions(units, n_max, seed).unionByName(sure)
    rows = join_small(rows, sources.select("source_ix", "source", "source_size", "target", "whole"), "source_ix")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"), "t")


def take_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken, all columns.

    Rows of one id, source and text are as often in the result as they are taken together; where they differ in other
    columns, any of them stands for all. Columns travel in a struct, so that none can clash with those of the mix.
    """
    key = ["doc_id", "source", "size", "t"]
    of = mix(docs, **options).groupBy(*key).agg(F.count("*").alias("rows"), F.sum("copies").alias("copies")).where("copies > 0")
    of = materialize(of.select(*[F.col(c).alias(f"of_{c}") for c in key], "rows", "copies"), "mix-copies")
    text = F.col("text")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("t"))
    on = [held[c].eqNullSafe(of[f"of_{c}"]) for c in key]
    single = held.join(of.where("rows = 1"), on).select("row", "copies")
    several = join_small(held, of.where("rows > 1"), on).dropDuplicates(key).select("row", "copies")
    taken = single.unionByName(several)
    # in two steps, so that a row that stands for very many is not repeated in one task
    steps = taken.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(1000).cast("long"))))
    many = F.sequence(F.lit(1), F.least(F.lit(1000), F.col("copies") - F.col("step")).cast("int"))
    return steps.select("row", F.explode(many).alias("n")).select("row.*")
