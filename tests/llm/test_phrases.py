import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD_ROWS, odd_documents, write
from tracewell.llm import queries as q
from tracewell.llm.phrases import collocations, count_phrases, pieces_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, least, top, longest=5):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(x) > len(p) and 100 * b >= 100 * a and any(x[i : i + len(p)] == p for i in range(len(x))) for x, b in candidates.items()):
                continue
            score, k, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed", range(3))
def test_phrases_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["a", "B", "b", "ß", "Éa", "new", "york", "x y", "0"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(60)]
    rows += rows[:7] + [("New York City hall", "en")] * 9 + [(None, "en"), ("", None), (" . ", "fr"), ("aa aa aa aa aa aa", "tie")]
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("own") for c in ("piece", "phrase", "copies", "a", "n", "rank")})
    assert rows_of(collocations(df, least=2, top=30)) == brute_phrases(rows, 2, 30)


def test_phrases_over_blocks_of_words(spark, monkeypatch):
    from tracewell.llm import phrases

    monkeypatch.setattr(phrases, "BLOCK_WORDS", 7)
    piece = " ".join(random.Random(1).choices("abc", k=100))
    batch = phrases.batch_of(piece=phrases.pa.array([piece, "a b"]))
    for n in (1, 2, 5):
        total = Counter()
        for found, counts, _ in phrases._phrases("en", batch.column("piece"), phrases.np.array([3, 1]), n, None):
            total.update(dict(zip(found.to_pylist(), counts.tolist())))
        want = Counter()
        for text, copies in ((piece, 3), ("a b", 1)):
            w = text.split()
            for i in range(len(w) - n + 1):
                want[" ".join(w[i : i + n])] += copies
        assert total == want


def test_counts_spill_and_scratch_goes(spark, tmp_path, monkeypatch):
    df = spark.range(300_000).select(F.lit("en").alias("lang"), F.concat_ws(" ", *[F.md5(F.concat(F.col("id") % 200_000, F.lit(k))) for k in range(3)]).alias("piece"), F.lit(60).cast("long").alias("copies"))
    got = count_phrases(df, 2, 100)
    assert got.count() == 200_000 and got.agg(F.min("a"), F.max("a")).first() == (120, 120)


def test_odd_and_empty_tables(spark, tmp_path):
    rows = [(r[1], r[2]) for r in ODD_ROWS]
    assert rows_of(collocations(odd_documents(spark), least=2, top=2000)) == brute_phrases(rows, 2, 2000)
    assert collocations(odd_documents(spark, [])).count() == 0
    assert pieces_of(odd_documents(spark, [])).count() == 0
    assert rows_of(q.op11_phrase_collocations(spark, write(spark, odd_documents(spark), tmp_path))) == brute_phrases(rows, 100, 2000)


def test_a_text_of_thirty_megabytes(spark):
    n = 1_700_000
    df = spark.range(1).select(F.repeat(F.lit("lorem ipsum dolor "), n).alias("text"), F.lit("la").alias("lang"))
    got = {r.phrase: r.a for r in collocations(df, least=100, top=10).collect()}
    assert got == {"lorem ipsum dolor lorem ipsum": n - 1, "ipsum dolor lorem ipsum dolor": n - 1, "dolor lorem ipsum dolor lorem": n - 2, "lorem ipsum dolor": n}


def test_sql_agrees(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert rows_of(collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=20)) == sorted(db.execute(q.ORACLE_SQL["op11_phrase_collocations"].replace(">= 100\n", ">= 20\n").replace("sum(m) >= 100", "sum(m) >= 20")).fetchall())
