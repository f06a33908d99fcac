"""Rows that every operator must bear: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import functions as F

ODD_ROWS = [
    (1, "alpha beta gamma delta", "en", "a"),
    (1, "alpha beta gamma delta", "en", "a"),
    (2, None, None, None),
    (None, "text without an id", "en", "b"),
    (3, "", "de", "b"),
    (4, "   \n\n\t ", "fr", "c"),
    (5, "word " * 20_000, "en", "c"),
    (6, "x" * 50_000, "en", "d"),
    (7, "é😀 ünï <|endoftext|> \x01   z", "es", "d"),
]


def odd_documents(spark, rows=None):
    """With columns whose names operators might use themselves."""
    df = spark.createDataFrame(ODD_ROWS if rows is None else rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("own") for c in ("size", "key", "start", "ids", "count", "digest", "part", "n", "kept")})


def write(spark, df, tmp_path, name="documents"):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
