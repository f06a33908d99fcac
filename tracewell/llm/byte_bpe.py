"""Byte-level BPE: texts to ids and back, by the merge ranks of a public vocabulary file.

A text is cut into pre-tokens by the vocabulary's pattern; each goes through two tiers.

1. *Whole pre-tokens.* A minimal perfect hash (hash and displace) gives every byte string one slot of as many as the
   vocabulary has entries; if the entry there equals the pre-token, its id is that entry's. All new pre-tokens of a
   batch are hashed and compared at once.
2. *Misses.* The bytes form a linked list, pairs that make an entry stand in a heap by rank and place; the lowest is
   merged until none is left. n bytes take n log n steps, so one very long pre-token does no harm.

Ids are equal to those of ``tiktoken.Encoding(...).encode_ordinary``. Which characters are letters and numbers depends
on the Unicode version; what the cutting library counts otherwise than the vocabulary's own library is asked of that.

Null text is empty and has no ids. Each row is a text of its own, also with a repeated or null id; equal texts have
equal ids. Columns of other names are not read. An empty table gives no rows. Texts are worked on in slices of bytes, a
longer one alone.
"""

from __future__ import annotations

import base64
import heapq
import io
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import arrow_pass, batch_of, texts
from .files import read_all
from .tokens import sliced

#: bytes of text worked on at once
SLICE_BYTES = 4_000_000
#: estimated bytes of what a worker keeps of pieces it has seen; beyond that it starts anew
MEMO_BYTES = 160_000_000
#: bytes of an entry of that memo besides its text and ids
_ENTRY = 200
#: pre-tokens of one text that are held at once
_HELD = 500_000
#: texts that are not cut at their blanks alone: blanks at an end or together, other white space, unusual blanks
_ODD = "^[ \n]|[ \n]$|[ \n][ \n]|[\x00-\x09\x0b-\x1f\x7f-\xa0  -‏    　﻿]"
#: characters whose classes all Unicode versions agree on
_PLAIN = regex.compile("[ \n!-~À-ÖØ-öø-įı-ɏ]*")


class MinimalPerfectHash:
    """A slot below ``len(keys)`` for each of some distinct byte strings, without gaps; other strings get any slot.

    Keys are dealt to buckets by their hash; from the largest bucket on, each looks for the first displacement that
    brings its keys to free slots. Buckets of one key take the free slots that are left, one after the other.
    """

    def __init__(self, keys: pa.Array):
        self.n = len(keys)
        self.m = np.uint64(self.n // 3 + 1)
        self.displacement = np.zeros(int(self.m), np.int64)
        hashes = self._hashes(keys)
        bucket = self._buckets(hashes)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=int(self.m))
        starts = np.cumsum(sizes) - sizes
        free = np.ones(self.n, bool)
        step = np.arange(512, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())]:
            own, d = order[starts[b] : starts[b] + sizes[b]], 0
            while True:  # as many displacements at once as there are steps
                slots = self._displaced(hashes[own], (step + np.uint64(d))[:, None])
                good = np.flatnonzero(free[slots].all(axis=1))
                good = [k for k in good.tolist() if len(set(slots[k].tolist())) == len(own)][:1]
                if good:
                    free[slots[good[0]]] = False
                    self.displacement[b] = d + good[0]
                    break
                d += len(step)
        single = np.flatnonzero(sizes == 1)
        self.displacement[single] = -1 - np.flatnonzero(free)

    def _hashes(self, keys: pa.Array) -> np.ndarray:
        """A hash of each key, a byte of all keys at a time, long keys first."""
        raw = np.frombuffer(keys.buffers()[2] or b"\0", np.uint8)
        offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        at, size = offsets[:-1][order], size[order]
        h = np.full(len(keys), 0xCBF29CE484222325, np.uint64)
        for j in range(int(size[0]) if len(keys) else 0):
            live = int(np.searchsorted(-size, -j, side="left"))
            h[:live] = (h[:live] ^ raw[at[:live] + j]) * np.uint64(0x9E3779B97F4A7C15)
            h[:live] ^= h[:live] >> np.uint64(31)
        out = np.empty_like(h)
        out[order] = h
        return out

    def _buckets(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(20)) % self.m).astype(np.int64)

    def _displaced(self, hashes: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (hashes ^ (d * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: pa.Array) -> np.ndarray:
        hashes = self._hashes(keys)
        d = self.displacement[self._buckets(hashes)]
        return np.where(d < 0, -1 - d, self._displaced(hashes, d.clip(0).astype(np.uint64)))


class ByteBpe:
    """Encoder and decoder of one vocabulary file, a line for each entry: base64 of its bytes, and its rank."""

    def __init__(self, path: str, pattern: str, memo_bytes: int = MEMO_BYTES):
        lines = [line.split() for line in io.BytesIO(read_all(path)) if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        entries = pa.array(list(self.ranks), pa.binary())
        rank = np.fromiter(self.ranks.values(), np.int64, len(self.ranks))
        self.longest = max(map(len, self.ranks))
        self.pairs: list[int | None] = [self.ranks.get(bytes([a, b])) for a in range(256) for b in range(256)]
        self.hash = MinimalPerfectHash(entries)
        at = np.empty(len(entries), np.int64)
        at[self.hash.slots(entries)] = np.arange(len(entries))
        self.entries, self.entry_ids = entries.take(pa.array(at)), [int(r).to_bytes(4, "little") for r in rank[at]]
        by_rank = np.full(int(rank.max()) + 1, -1, np.int64)
        by_rank[rank] = np.arange(len(rank))
        self.by_rank = entries.take(pa.array(by_rank, mask=by_rank < 0))
        self.pattern = pattern
        self._split = regex.compile(pattern)
        self._strict: regex.Pattern | None = None
        self.memo: dict[str, bytes] = {}
        self.held, self.most = 0, memo_bytes

    def _pretokens(self, text: str) -> regex.Pattern:
        """The pattern that cuts this text as the vocabulary's library would."""
        if text.isascii() or _PLAIN.fullmatch(text):
            return self._split
        if self._strict is None:
            self._strict = regex.compile(_with_classes(self.pattern))
        return self._strict

    def _merge(self, piece: bytes) -> bytes:
        """Ids of a byte string that is no entry: lowest rank first, leftmost among equals.

        ``stop[i]`` ends the part that begins at i (-1: none begins there), ``before[i]`` begins the part to its left.
        A heap entry holds rank, begin and end of a pair in one number.
        """
        n, get, push = len(piece), self.ranks.get, heapq.heappush
        bits = 16 if n < 1 << 16 else 32
        mask, high = (1 << bits) - 1, 2 * bits
        stop, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        first, i = piece[0], 0
        for second in piece[1:]:
            r = self.pairs[first << 8 | second]
            if r is not None:
                heap.append(r << high | i << bits | i + 2)
            first, i = second, i + 1
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            i, end = x >> bits & mask, x & mask
            middle = stop[i]
            if middle < 0 or middle >= n or stop[middle] != end:
                continue  # one of the two has merged with another meanwhile
            stop[i], stop[middle] = end, -1
            if end < n:
                before[end] = i
                far = stop[end]
                if (r := get(piece[i:far])) is not None:
                    push(heap, r << high | i << bits | far)
            left = before[i]
            if left >= 0 and (r := get(piece[left:end])) is not None:
                push(heap, r << high | left << bits | end)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : stop[i]]])
            i = stop[i]
        return array("I", out).tobytes()

    def _resolve(self, new: list[str]) -> None:
        """Ids of pre-tokens not met before: all through the hash at once, the misses one by one."""
        raw = [t.encode() for t in new]
        keys = pa.array([x if len(x) <= self.longest else b"" for x in raw], pa.binary())
        slots = self.hash.slots(keys)
        same = np.asarray(pc.equal(keys, self.entries.take(pa.array(slots)))).tolist()
        for t, x, is_entry, slot in zip(new, raw, same, slots.tolist()):
            ids = self.memo[t] = self.entry_ids[slot] if is_entry else self._merge(x)
            self.held += _ENTRY + len(t) + len(ids)

    def _ids(self, words: list[str]) -> bytes:
        known = self.memo
        if new := [w for w in dict.fromkeys(words) if w not in known]:
            self._resolve(new)
        return b"".join([known[w] for w in words])

    def _whole(self, text: str) -> bytes:
        """Ids of one text, some hundred thousand pre-tokens at a time."""
        out, words = [], []
        for m in self._pretokens(text).finditer(text):
            words.append(m[0])
            if len(words) >= _HELD:
                out.append(self._ids(words))
                words = []
                self._forget()
        out.append(self._ids(words))
        return b"".join(out)

    def _forget(self) -> None:
        if self.held > self.most:
            self.memo, self.held = {}, 0

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; no text may be null.

        Where single blanks part visible characters, every blank begins a pre-token, so repeated pieces are cut once.
        """
        self._forget()
        odd = np.asarray(pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(pc.binary_length(texts), 0)))
        plain = texts.filter(pa.array(~odd))
        pieces = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        flat = pieces.flatten().dictionary_encode()
        offsets = np.asarray(pieces.offsets) - (pieces.offsets[0].as_py() if len(pieces.offsets) else 0)
        # the first piece of a text has no blank before it; all others have, or begin with a line's end
        index = np.asarray(flat.indices).astype(np.int64) * 2
        index[offsets[:-1]] += 1
        there = np.zeros(2 * len(flat.dictionary), bool)
        there[index] = True
        used = np.flatnonzero(there)
        names = flat.dictionary.to_pylist()
        cut = [(names[k >> 1] if k & 1 or names[k >> 1][0] == "\n" else " " + names[k >> 1]) for k in used.tolist()]
        memo, parted, new = self.memo, [], {}
        for piece in cut:
            if piece not in memo:
                words = self._pretokens(piece).findall(piece)
                if len(words) > 1:
                    parted.append((piece, words))
                new.update(dict.fromkeys(w for w in words if w not in memo))
        if new:
            self._resolve(list(new))
        for piece, words in parted:
            ids = memo[piece] = b"".join([memo[w] for w in words])
            self.held += _ENTRY + len(piece) + len(ids)
        each = [memo[piece] for piece in cut]
        place = (np.cumsum(there) - 1)[index].tolist()
        out, k = [], 0
        for i, is_odd in enumerate(odd.tolist()):
            if is_odd:
                out.append(self._whole(texts[i].as_py()))
            else:
                out.append(b"".join([each[p] for p in place[offsets[k] : offsets[k + 1]]]))
                k += 1
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; ids that the vocabulary lacks raise."""
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and numbers.max() >= len(self.by_rank):
            raise ValueError("an id that the vocabulary lacks")
        out = []
        for k in range(0, len(numbers), 4_000_000):
            part = self.by_rank.take(pa.array(numbers[k : k + 4_000_000]))
            if part.null_count:
                raise ValueError("an id that the vocabulary lacks")
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), pa.scalar(b"", pa.binary()))[0].as_py())
        return b"".join(out)


def _with_classes(pattern: str) -> str:
    """``pattern`` with letters and numbers written out as the vocabulary's own library counts them."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name in (r"\p{L}", r"\p{N}"):
        of_class = bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        codes = np.fromiter(map(ord, of_class), np.int64)
        cuts = np.flatnonzero(np.diff(codes) > 1)
        first, last = codes[np.concatenate([[0], cuts + 1])], codes[np.concatenate([cuts, [len(codes) - 1]])]
        ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist()))
        pattern = regex.sub(r"\[\^([^\]]*)" + regex.escape(name), lambda m: "[^" + m[1] + ranges, pattern)  # noqa: B023
        pattern = pattern.replace(name, f"[{ranges}]")
    return pattern


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One per worker and vocabulary, so that what it has seen serves later batches."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(path, pattern)
    return _CODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers. No shuffle; a row's memory is that of its text."""

    def run(batches):
        bpe = coder(path, pattern)
        for batch in batches:
            whole = batch.column("text")
            for a, b in sliced(whole, SLICE_BYTES):
                yield batch_of(doc_id=batch.column("doc_id").slice(a, b - a), ids=pa.array(bpe.encode(whole.slice(a, b - a)), pa.binary()))

    return arrow_pass(texts(docs, id_col, text_col), run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of the text that each row's ids stand for."""

    def run(batches):
        bpe = coder(path, pattern)
        for batch in batches:
            yield batch_of(doc_id=batch.column("doc_id"), ids=batch.column("ids"), decoded=pa.array([bpe.decode(x) for x in batch.column("ids").to_pylist()], pa.binary()))

    return arrow_pass(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary", rows=200)
