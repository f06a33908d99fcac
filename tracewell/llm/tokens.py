"""Exact token ids at corpus speed: the library encodes each distinct piece of text once per worker.

Both vocabularies split a text at every change from a visible character to a space or newline before they merge
anything, so the ids of a text are those of its pieces, each with the blank before it. Pieces come from Arrow
kernels, repeated ones are looked up, new ones go to the library. A text with any other blank, or with two blanks
together, goes to the library whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: starts the first piece of a text, so that it is told from pieces with a space before them
_FIRST = "\x01"
_ODD = "^[ \n]|[ \n]$|[ \n][ \n]|[\x00-\x09\x0b-\x1f\x7f-\xa0  -‏    　﻿]|<\\|"
#: bytes of what a worker keeps of pieces and words, as estimated; beyond that its memo starts anew
MEMO_BYTES = 224_000_000
#: bytes of an entry besides those of the piece and its ids: two objects and a place in the table
_ENTRY = 200
#: characters whose classes all Unicode versions agree on
_PLAIN = regex.compile("[ \n!-~À-ÖØ-öø-įı-ɏ]*")


def _byte_letters() -> list[str]:
    """The printable stand-ins of byte-level BPE: visible Latin-1 bytes stand for themselves, others follow from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in visible else next(others)) for b in range(256)]


class PieceEncoder:
    """Encodes lists of texts with one tokenizer file; equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        self.most = memo_bytes
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0
        self._letters = _byte_letters()
        # the two kinds of file: with a normalizer (lower case, blanks dropped) or without
        self._lower = self.tokenizer.normalizer is not None
        self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+" if self._lower else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            self.held += _ENTRY + 6 * len(word)
            letters = word.replace(" ", "\u0120") if word.isascii() and "\n" not in word else "".join([self._letters[b] for b in word.encode()])
            ids = self.words[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        return ids

    def _new(self, piece: str) -> bytes:
        """The ids of one piece: the library's merge model on each of its words."""
        if not piece.isascii() and not _PLAIN.fullmatch(piece):
            return self._whole(piece)
        if self._lower:
            piece = piece.strip(" \n").lower()
        if piece[1:].isalpha() and piece[0] != "\n" and piece[0] != "'":
            head = piece[0]
            if head == " " or head.isalpha():
                return self._word(piece)
        return b"".join([self._word(w) for w in self._split.findall(piece)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text; no text may be null."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = np.asarray(pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(pc.binary_length(texts), 0)))
        plain = texts.filter(pa.array(~odd))
        pieces = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar(_FIRST), plain, ""), "\n", " \n"), " ")
        flat = pieces.flatten().dictionary_encode()
        if self.held > self.most:
            self.memo, self.words, self.held = {}, {}, 0
        memo, each = self.memo, []
        for p in flat.dictionary.to_pylist():
            ids = memo.get(p)
            if ids is None:
                ids = memo[p] = self._new(p[1:] if p[0] == _FIRST else p if p[0] == "\n" else " " + p)
                self.held += _ENTRY + len(p) + len(ids)
            each.append(ids)
        size = np.array([len(x) // 4 for x in each], np.int64)
        pool = np.frombuffer(b"".join(each), np.uint32)
        index = np.asarray(flat.indices)
        count = size[index] if len(index) else np.zeros(0, np.int64)
        ends = np.cumsum(count)
        first = (np.cumsum(size) - size)[index] if len(index) else count
        ids = pool[np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = np.asarray(pieces.offsets) - (pieces.offsets[0].as_py() if len(pieces.offsets) else 0)
        at = np.concatenate([[0], ends])
        sizes = np.diff(at[offsets]) if len(plain) else np.zeros(0, np.int64)
        if not odd.any():
            return ids, sizes
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = sizes
        starts, out = np.concatenate([[0], np.cumsum(sizes)]), []
        k = 0
        for i, is_odd in enumerate(odd):
            if is_odd:
                own = np.frombuffer(self._whole(texts[i].as_py()), np.uint32)
                counts[i] = len(own)
                out.append(own)
            else:
                out.append(ids[starts[k] : starts[k + 1]])
                k += 1
        return np.concatenate(out), counts


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str, memo_bytes: int = MEMO_BYTES) -> PieceEncoder:
    """One encoder per worker and file, so that what it has seen serves later batches."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    _ENCODERS[path].most = memo_bytes
    return _ENCODERS[path]


def sliced(texts: pa.Array, most: int = 16_000_000):
    """(from, to) of runs of texts of about ``most`` bytes."""
    sizes = np.cumsum(np.asarray(pc.binary_length(texts)))
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield start, end
        start = end
