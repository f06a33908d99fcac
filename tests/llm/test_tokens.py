import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import ODD_ROWS, odd_documents, write
from tracewell.llm import queries as q
from tracewell.llm.packing import Packer, pack_conversations, pack_documents
from tracewell.llm.token_blocks import document_ids, pack, read_shard, unpack, write_shard


@functools.cache
def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(name, text, end):
    return [*tokenizer(name).encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 50_000, n).astype(np.uint32)
    ids[rng.random(n) < 0.05] = 2**32 - 1
    assert (unpack(*pack(ids)) == ids).all()


def test_block_index_opens_one_document():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 700, 40)
    ids = rng.integers(0, 49_000, sizes.sum()).astype(np.uint32)
    raw = write_shard(np.arange(40), sizes, ids)
    assert (read_shard(raw)[2] == ids).all()
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k in (0, 7, 39):
        assert (document_ids(raw, k) == ids[at[k] : at[k + 1]]).all()


def brute_token_rows(rows):
    start, out = 0, []
    for doc_id, text, *_ in rows:
        ids = ids_of("word_bpe_49k.json", text, 2)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_blocks_odd_rows(spark, tmp_path):
    got = q.op9_token_blocks(spark, write(spark, odd_documents(spark), tmp_path)).collect()
    want = brute_token_rows(sorted(ODD_ROWS, key=lambda r: (r[0] is not None, r[0], r[1] or "")))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_blocks_whole_table(spark, sf_dir):
    rows = sorted((r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, q.op9_token_blocks(spark, sf_dir).collect())) == brute_token_rows(rows)


def check_pieces(rows, got):
    want = sorted(((r[0] is None, r[0], tuple(ids_of("byte_bpe_50k.json", r[1], 1))) for r in rows), key=str)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and len(pieces) <= 8
    total = sum(r.length for r in got)
    assert total == sum(len(x[2]) for x in want)
    padded = sum(n if (n := sum(p[1] for p in s)) & (n - 1) == 0 else 2048 for s in by_seq.values())
    assert padded <= 1.02 * total
    docs = {}
    for r in got:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for doc_id, text, *_ in rows:
        ids = ids_of("byte_bpe_50k.json", text, 1)
        own = docs[doc_id, len(ids)]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
        copies = sum(1 for x in rows if x[0] == doc_id)
        got_ids = sorted(i for r in own for i in range(r.start, r.start + r.length))
        assert got_ids == sorted([*range(len(ids))] * copies)


def test_packing(spark, sf_dir, tmp_path):
    check_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect(), q.op4_vector_packing(spark, sf_dir).collect())
    check_pieces(ODD_ROWS, q.op4_vector_packing(spark, write(spark, odd_documents(spark), tmp_path)).collect())


def test_packer_holds_every_limit():
    rng = np.random.default_rng(3)
    packer = Packer(100, 4, 60, 0)
    sizes = rng.integers(1, 250, 3000).tolist()
    for k, n in enumerate(sizes):
        packer.add((k,), n, ((10, n),) if k % 3 else ((0, n // 4), (n // 2, n)))
    packer.finish()
    seqs, covered, bearing = {}, {}, {}
    for (k,), start, length, seq, offset in packer.out:
        loss = [i for i in range(start, start + length) if (i >= 10 if k % 3 else i < sizes[k] // 4 or i >= sizes[k] // 2)]
        bearing.setdefault(seq, {})[k, start] = len(loss)
        seqs.setdefault(seq, []).append((start, length))
        covered.setdefault(k, []).extend(range(start, start + length))
    assert all(sorted(covered[k]) == list(range(n)) for k, n in enumerate(sizes))
    for seq, pieces in seqs.items():
        assert sum(n for _, n in pieces) <= 100 and len(pieces) <= 4
        assert sum(n for n in bearing[seq].values()) <= 60


def test_limits_bind_on_the_whole_table(spark, sf_dir):
    rows = q.op4_vector_packing(spark, sf_dir).collect()
    segments, loss = {}, {}
    for r in rows:
        segments[r.sequence_id] = segments.get(r.sequence_id, 0) + 1
        loss[r.sequence_id] = loss.get(r.sequence_id, 0) + r.loss_tokens
        first = r.doc_tokens // 4
        assert r.loss_tokens == max(0, r.start + r.length - max(first, r.start))
    assert max(segments.values()) == 8 and max(loss.values()) == 1792


def test_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = rows.collect() + [(10**6, t, "assistant" if t % 2 else "user", "word " * (t % 50)) for t in range(400)]
    docs = spark.createDataFrame(turns, rows.schema)
    got = pack_conversations(docs, public_tokenizers.path("byte_bpe_50k.json"), 1).collect()
    want, found = {}, {}
    for conv, turn, role, text in sorted(map(tuple, turns), key=str):
        ids = ids_of("byte_bpe_50k.json", text, 1)
        n, loss = want.get(conv, (0, 0))
        want[conv] = n + len(ids), loss + len(ids) * (role == "assistant")
    seqs = {}
    for r in got:
        n, loss = found.get(r.doc_id, (0, 0))
        found[r.doc_id] = n + r.length, loss + r.loss_tokens
        seqs.setdefault(r.sequence_id, []).append((r.length, r.loss_tokens))
    assert found == want
    assert all(sum(n for n, _ in s) <= 2048 and len(s) <= 8 and sum(x for _, x in s) <= 1792 for s in seqs.values())


def test_empty_tables(spark, tmp_path):
    d = write(spark, odd_documents(spark, []), tmp_path)
    assert q.op9_token_blocks(spark, d).count() == 0
    assert pack_documents(spark.read.parquet(f"{d}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 1).count() == 0
