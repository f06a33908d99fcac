"""The queries opN_<name> of the operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import decode_documents, encode_documents
from .clusters import cluster
from .common import documents
from .jaccard import jaccard_components
from .licenses import scan_licenses
from .media import media_columns
from .mixing import mix
from .packing import pack_documents
from .phrases import collocations
from .pii import find_spans
from .quality import judge
from .substrings import remove_repeats
from .token_blocks import read_token_shards, write_token_shards
from .warc import read_archives, write_archives


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(documents(spark, sf_dir), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("t")


def op3_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).drop("t")


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(documents(spark, sf_dir))


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(spark, folder).drop("payload")


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_token_shards(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_shards(shards).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = decode_documents(encode_documents(documents(spark, sf_dir), *vocabulary), *vocabulary)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10, dim=64, seed="3")


def _clusters_sql(rounds: int = 10) -> str:
    """The rounds written out: nearest centroids, sums and new centroids of each."""

    def nearest(centroids: str) -> str:
        return f"""SELECT vec_id, k, d FROM (SELECT v.vec_id, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN {centroids} c USING (j) GROUP BY v.vec_id, c.k)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1"""

    parts = [
        "kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "v AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS j, floor(1024 * unnest(embedding)::DOUBLE)::HUGEINT AS x FROM kept)",
        "seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM kept QUALIFY k < 8)",
        "c0 AS MATERIALIZED (SELECT k, j, x FROM v JOIN seeds USING (vec_id))",
    ]
    for i in range(rounds):
        parts += [
            f"a{i} AS MATERIALIZED ({nearest(f'c{i}')})",
            f"s{i} AS (SELECT k, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} JOIN v USING (vec_id) GROUP BY k, j)",
            f"c{i + 1} AS MATERIALIZED (SELECT c.k, c.j, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{i} c LEFT JOIN s{i} s ON s.k = c.k AND s.j = c.j)",
        ]
    parts += [f"a{rounds} AS MATERIALIZED ({nearest(f'c{rounds}')})", f"digest AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY k)"]
    return "WITH " + ",\n".join(parts) + f"""
        SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN digest USING (k)"""


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_pivotal_mixing": op2_pivotal_mixing,
    "op3_perplexity_rules": op3_perplexity_rules,
    "op4_vector_packing": op4_vector_packing,
    "op5_weak_supervision": op5_weak_supervision,
    "op6_warc_segments": op6_warc_segments,
    "op7_repeated_substrings": op7_repeated_substrings,
    "op8_license_scan": op8_license_scan,
    "op9_token_blocks": op9_token_blocks,
    "op10_media_columns": op10_media_columns,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op6_warc_segments": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        r AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
        m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS largest FROM r)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN largest <> page_id THEN largest END AS refers_to
        FROM m""",
    "op11_phrase_collocations": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS words
          FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents)),
        d AS (SELECT lang, words, count(*) AS m FROM pieces WHERE len(words) > 0 GROUP BY ALL),
        totals AS (SELECT lang, sum(m * len(words)) AS n FROM d GROUP BY lang),
        starts AS (SELECT lang, words, m, unnest(range(1, len(words) + 1)) AS i FROM d),
        grams AS (SELECT lang, m, k, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(words)),
        f AS MATERIALIZED (SELECT lang, phrase, k AS size, sum(m)::BIGINT AS a FROM grams GROUP BY ALL HAVING sum(m) >= 100),
        cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
        cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
        scored AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n::BIGINT AS n, (1000::HUGEINT * c.a * n::HUGEINT // (x.a::HUGEINT * y.a))::BIGINT AS score
          FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = rest JOIN totals t ON t.lang = c.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_ AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM cand))),
        drops AS (SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN inner_ i ON i.lang = c.lang AND i.phrase = c.phrase WHERE 100 * i.a >= 100 * c.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM best ANTI JOIN drops USING (lang, phrase)
        QUALIFY rank <= 2000""",
    "op13_centroid_clusters": _clusters_sql(),
}
