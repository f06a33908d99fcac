import base64
import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.helpers import ODD_ROWS, odd_documents, write
from tracewell.llm import queries as q
from tracewell.llm.byte_bpe import ByteBpe, MinimalPerfectHash, decode_documents, encode_documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@functools.cache
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def own():
    return ByteBpe(PATH, public_tokenizers.PATTERN)


def want(rows):
    out = []
    for doc_id, text, *_ in rows:
        ids = library().encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 500, 4096])
def test_hash_is_minimal_and_perfect(n):
    keys = [bytes([k % 256, k // 256]) * (1 + k % 3) for k in range(n)]
    found = MinimalPerfectHash(pa.array(keys, pa.binary()))
    assert sorted(found.slots(pa.array(keys, pa.binary())).tolist()) == list(range(n))
    other = found.slots(pa.array([b"", b"none of these", b"\xff" * 300], pa.binary()))
    assert ((other >= 0) & (other < n)).all()


def test_every_entry_is_found_whole():
    entries = list(library()._mergeable_ranks)
    slots = own().hash.slots(pa.array(entries, pa.binary()))
    assert sorted(slots.tolist()) == list(range(len(entries)))
    assert all(own().entry_ids[s] == library()._mergeable_ranks[e].to_bytes(4, "little") for e, s in zip(entries, slots.tolist()))


def test_ids_equal_the_librarys():
    rng = random.Random(7)
    near, far = "abc ABC'sst're\n\t 012,.é中ß́😀 \r　\x85", [32, 10, 0x20, 0x27]
    texts = ["", " ", "\n", "a", "  a  ", "a\n\n b", "x՘y ࢏ z𑷠 9", " <|endoftext|> ", "aaaa" * 3000, "ab" * 40_000, " " * 3000 + "x", "\x00", "it's we'LL"]
    texts += ["".join(rng.choices(near, k=rng.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF), *far])) for _ in range(rng.randint(0, 40))) for _ in range(1000)]
    got = own().encode(pa.array(texts, pa.string()))
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == library().encode_ordinary(text), text[:80]
        assert own().decode(ids) == text.encode()
    part = pa.array(["-", *texts], pa.string()).slice(1)
    assert own().encode(part) == got
    with pytest.raises(ValueError):
        own().decode(np.array([50_256 + 5], "<u4").tobytes())


def test_memo_is_bounded():
    small = ByteBpe(PATH, public_tokenizers.PATTERN, memo_bytes=20_000)
    for k in range(50):
        text = " ".join(hashlib.md5(f"{k}-{j}".encode()).hexdigest() for j in range(200))
        assert small.encode(pa.array([text])) == [np.array(library().encode_ordinary(text), np.uint32).tobytes()]
    assert small.held < 500_000


def test_query(spark, sf_dir, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, q.op12_byte_bpe(spark, sf_dir).collect()), key=str) == want(rows)
    assert sorted(map(tuple, q.op12_byte_bpe(spark, write(spark, odd_documents(spark), tmp_path / "odd")).collect()), key=str) == want(ODD_ROWS)
    assert q.op12_byte_bpe(spark, write(spark, odd_documents(spark, []), tmp_path / "none")).count() == 0


def test_a_text_of_thirty_megabytes(spark):
    for piece, n in (("Zwölf laxe Typen. ", 1_700_000), ("x", 3_000_000)):
        df = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(piece), n).alias("text"))
        row = decode_documents(encode_documents(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).select(F.sha2("decoded", 256).alias("d"), F.length("ids").alias("n")).first()
        assert row.d == hashlib.sha256(piece.encode() * n).hexdigest()
        assert row.n < 4 * len(piece.encode()) * n
