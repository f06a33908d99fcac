"""Vector bin packing of examples into training sequences, by the dot-product heuristic.

A sequence is limited in three ways at once: tokens, segments (pieces), and loss-bearing tokens. Whole sequences are
cut off long examples; what is left goes into a pool. A sequence takes, again and again, the pool's piece with the
largest dot product of its demand with what the sequence has left, both as shares of the limits. When no piece fits as
a whole and a segment is free, one is cut to fill the sequence: the longest head that fits. The pool is bounded
(``POOL`` pieces), so the work is one pass over each partition with no shuffle; sequences that cannot be filled are
cut at powers of two, which need no padding.

Which tokens bear loss comes with the example, as spans. In a conversation the assistant's turns do and those of the
user and of the system do not (``pack_conversations``). A document is trained on behind a prefix: its first ``prefix``
share of tokens is context and bears none (``pack_documents``). With ``prefix`` a quarter and ``loss_tokens`` seven
eighths of the tokens, the loss limit binds in sequences cut from the inside of long documents, and the dot product has
to bring prefixes of others to them; ``segments`` binds where short pieces come together.

Null text is an empty document. Each row is a document of its own, also with a repeated or null id. Examples without
tokens take no part. Texts are encoded in slices of bytes, a longer one alone, and cut wherever a sequence ends. Of
pieces with equal products the first in the pool is taken. Columns of other names are not read, so none can clash. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, batch_of, texts
from .tokens import encoder, sliced

POOL = 1024
#: bytes of what a worker keeps of pieces of text; packing holds little else
MEMO_BYTES = 400_000_000
#: bytes of text that are encoded at once, about
SLICE_BYTES = 16_000_000
#: share of the tokens from which on a sequence is padded rather than cut
WASTE = 0.99
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


class Packer:
    """Packs pieces (example, start, length) as they come; ``out`` gets (ref, start, length, sequence, offset).

    An example is a ref and the spans (from, to) of its loss-bearing tokens, in order.
    """

    def __init__(self, tokens: int, segments: int, loss: int, first_sequence: int):
        self.limit = np.array([tokens, segments, loss], np.float64)
        self.sequence = first_sequence
        self.refs: list = [None] * (2 * POOL)
        self.start = np.zeros(2 * POOL, np.int64)
        self.need = np.zeros((2 * POOL, 3))
        self.n = 0
        self.out: list[tuple] = []

    @staticmethod
    def loss(spans, start: int, length: int) -> int:
        """Loss-bearing tokens of a piece."""
        end = start + length
        return sum(min(b, end) - max(a, start) for a, b in spans if a < end and b > start)

    @staticmethod
    def fits(spans, start: int, length: int, tokens: int, loss: int) -> int:
        """The longest head of a piece within both limits."""
        most = min(length, tokens)
        for a, b in spans:
            a, b = max(a, start), min(b, start + most)
            if a < b:
                if b - a > loss:
                    return a + loss - start
                loss -= b - a
        return most

    def add(self, ref, length: int, spans) -> None:
        """An example of ``length`` tokens."""
        start, tokens, loss = 0, int(self.limit[0]), int(self.limit[2])
        while length - start >= tokens:
            size = self.fits(spans, start, length - start, tokens, loss)
            if size == tokens:
                self.out.append((ref, start, size, self.sequence, 0))
                self.sequence += 1
            else:  # full of loss, not of tokens: others may fill it up
                self._put(ref, spans, start, size)
            start += size
        while start < length:
            size = self.fits(spans, start, length - start, tokens, loss)
            self._put(ref, spans, start, size)
            start += size
        while self.n >= POOL:
            self.fill()

    def _put(self, ref, spans, start: int, length: int) -> None:
        i = self.n
        if i == len(self.refs):  # a single example may put any number of pieces
            self.refs += [None] * i
            self.start, self.need = np.concatenate([self.start, self.start]), np.concatenate([self.need, self.need])
        self.refs[i], self.start[i], self.need[i] = (ref, spans), start, (length, 1, self.loss(spans, start, length))
        self.n += 1

    def _take(self, i: int):
        piece = self.refs[i], int(self.start[i]), int(self.need[i, 0])
        self.n -= 1
        self.refs[i], self.start[i], self.need[i] = self.refs[self.n], self.start[self.n], self.need[self.n]
        self.refs[self.n] = None
        return piece

    def fill(self) -> None:
        """Fill one sequence from the pool."""
        left, chosen = self.limit.copy(), []
        while self.n and left[0] >= 1 and left[1] >= 1:
            need = self.need[: self.n]
            score = (need / self.limit) @ (left / self.limit)
            score[(need > left).any(axis=1)] = -1
            i = int(score.argmax())
            if score[i] > 0:
                (ref, spans), start, length = self._take(i)
            else:
                # the piece with the longest head that fits: one whose loss is small, or begins late
                free = np.maximum(need[:, 0] - need[:, 2], 0)
                i = int(np.minimum(need[:, 0], left[0] if left[2] >= left[0] else np.maximum(left[2], free)).argmax())
                (ref, spans), start, length = self._take(i)
                cut = self.fits(spans, start, length, int(left[0]), int(left[2]))
                if cut < length:
                    self._put(ref, spans, start + cut, length - cut)
                if not cut:
                    break
                length = cut
            chosen.append((ref, start, length))
            left -= (length, 1, self.loss(spans, start, length))
        self._close(chosen)

    def _close(self, chosen: list) -> None:
        total = sum(x[2] for x in chosen)
        # a sequence that no piece can fill any more is kept whole where that wastes little, else cut at powers of two
        whole = total == self.limit[0] or total >= WASTE * self.limit[0]
        parts = [total] if whole else [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        pieces = list(reversed(chosen))
        for size in parts:
            offset = 0
            while offset < size:
                ref, start, length = pieces.pop()
                cut = min(length, size - offset)
                self.out.append((ref, start, cut, self.sequence, offset))
                if cut < length:
                    pieces.append((ref, start + cut, length - cut))
                offset += cut
            self.sequence += 1

    def finish(self) -> None:
        while self.n:
            self.fill()


def _rows(out: list[tuple]) -> pa.RecordBatch:
    refs, start, size, seq, offset = zip(*out)
    return batch_of(
        doc_id=pa.array([r[0] for r in refs], pa.int64()), start=pa.array(start, pa.int64()), length=pa.array(size, pa.int64()),
        ids=pa.array([r[1][4 * a : 4 * (a + n)] for r, a, n in zip(refs, start, size)], pa.binary()), doc_tokens=pa.array([len(r[1]) // 4 for r in refs], pa.int64()),
        loss_tokens=pa.array([Packer.loss(r[2], a, n) for r, a, n in zip(refs, start, size)], pa.int64()), sequence_id=pa.array(seq, pa.int64()), offset=pa.array(offset, pa.int64()),
    )


def _packed(examples, packer: Packer):
    """Batches of pieces of examples (id, ids as bytes, spans)."""
    for doc_id, raw, spans in examples:
        packer.add((doc_id, raw, spans), len(raw) // 4, spans)
        if len(packer.out) >= 4096:
            out, packer.out = packer.out, []
            yield _rows(out)
    packer.finish()
    for k in range(0, len(packer.out), 4096):
        yield _rows(packer.out[k : k + 4096])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, tokens: int = 2048, segments: int = 8, loss_tokens: int = 1792, prefix: float = 0.25, memo_bytes: int = MEMO_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids (little-endian uint32), doc_tokens,
    loss_tokens, sequence_id, offset. The first ``prefix`` share of a document's ids bears no loss. ``memo_bytes``: what a
    worker keeps of pieces of text, ``slice_bytes``: what it encodes at once; less where its process or the executor has
    done other work before. The result is the same."""

    def run(batches):
        from pyspark import TaskContext

        def examples():
            enc = encoder(tokenizer, memo_bytes)
            for batch in batches:
                doc_ids, text = batch.column("doc_id").to_pylist(), batch.column("text")
                for a, b in sliced(text, slice_bytes):
                    ids, sizes = enc.encode(text[a:b])
                    raw = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4").tobytes()
                    at = 0
                    for doc_id, n in zip(doc_ids[a:b], (sizes + 1).tolist()):
                        yield doc_id, raw[4 * at : 4 * (at + n)], ((int(n * prefix), n),)
                        at += n

        yield from _packed(examples(), Packer(tokens, segments, loss_tokens, TaskContext.get().partitionId() << 40))

    return arrow_pass(texts(docs), run, SCHEMA)


def pack_conversations(turns: DataFrame, tokenizer: str, end_id: int, tokens: int = 2048, segments: int = 8, loss_tokens: int = 1792) -> DataFrame:
    """As ``pack_documents``, of conversations: turns (conv_id, turn, role, text) in order, each ended by ``end_id``.

    Only the assistant's turns bear loss. Turns are dealt by ranges of (conv_id, turn), so a conversation may be any
    share of the table: its turns become an example for each ``tokens`` ids of it, which start counts from.
    """

    def run(batches):
        from pyspark import TaskContext

        def examples():
            enc = encoder(tokenizer, MEMO_BYTES)
            conv, held, spans, n = None, [], [], 0
            for batch in batches:
                convs, roles, text = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text")
                for a, b in sliced(text):
                    ids, sizes = enc.encode(text[a:b])
                    raw = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4").tobytes()
                    at = 0
                    for c, role, size in zip(convs[a:b], roles[a:b], (sizes + 1).tolist()):
                        if n and (c != conv or n >= tokens):
                            yield conv, b"".join(held), tuple(spans)
                            held, spans, n = [], [], 0
                        conv = c
                        held.append(raw[4 * at : 4 * (at + size)])
                        if role == "assistant":
                            spans.append((n, n + size))
                        n += size
                        at += size
            if n:
                yield conv, b"".join(held), tuple(spans)

        yield from _packed(examples(), Packer(tokens, segments, loss_tokens, TaskContext.get().partitionId() << 40))

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    return arrow_pass(rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text"), run, SCHEMA)
