"""Whole-text encoding with public tokenizer libraries, one library call per distinct unit.

Both vocabularies never merge across white space, so a text's ids are the ids of its units in
order.  Units repeat a lot: each Arrow slice is dictionary-encoded, the library sees every distinct
unit not in the bounded cache, and ids are gathered with numpy.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from veilgraph.llm.textbatch import LOWER, SPACE_WORDS, byte_class

CACHE_UNITS = 200_000  # in each of two generations
CACHE_UNIT_BYTES = 64

#: piece models: a unit ends before each single blank between two characters that are not blanks
_BLANK = byte_class((0x20, 0x20))


#: 1 for ASCII letters, 2 for ASCII digits and punctuation except the apostrophe (it joins contractions)
_KIND = (~byte_class((0x41, 0x5A), (0x61, 0x7A))).astype(np.uint8) + 2 * (~byte_class((0x21, 0x26), (0x28, 0x40), (0x5B, 0x60), (0x7B, 0x7E))).astype(np.uint8)
#: lower-case letters that the file's normaliser leaves alone and its splitter keeps together
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def units_by_space(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Units of lower-cased texts, and each text's first unit.

    Units end at ASCII white space, and between a letter (ASCII, or one of Latin-1) and an ASCII
    digit or mark: the file's splitter always cuts there.  Where "<|" occurs, the slice is cut at
    white space only and not lower-cased, so that strings of special tokens stay as the library sees them.
    """
    special = b"<|" in data.tobytes()
    data = data if special else LOWER[data]
    inside = SPACE_WORDS[data]
    edge = np.zeros(len(data), dtype=bool)
    if len(data):
        texts = offsets[:-1][offsets[:-1] < len(data)]
        if not special:
            kind = _KIND[data]
            lead = np.flatnonzero(data[:-1] == 0xC3)
            lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
            kind[lead] = kind[lead + 1] = 1
            edge[1:] = kind[1:] ^ kind[:-1] == 3
            edge[texts] = False  # a text's first unit starts at its first word
        edge[1:] |= inside[1:] & ~inside[:-1]
        edge[texts] |= inside[texts]
    starts = np.flatnonzero(edge)
    before = np.cumsum(inside, dtype=np.int32) - inside  # word bytes before each byte
    kept = data[inside]
    bounds = np.concatenate((before[starts], [len(kept)]))
    return _strings(kept, bounds), np.searchsorted(starts, offsets)


def units_by_blank(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Units separated by one blank; blanks in runs or at a text's ends stay in the units around them."""
    n = len(data)
    blank = ~_BLANK[data]
    cutter = blank.copy()
    if n:
        cutter[0] = cutter[-1] = False
        cutter[1:] &= ~blank[:-1]
        cutter[:-1] &= ~blank[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        cutter[inner] = False
        cutter[inner - 1] = False
    at = np.flatnonzero(cutter)
    texts = np.flatnonzero(np.diff(offsets))
    # a unit starts at each non-empty text and after each cutter
    starts = np.sort(np.concatenate((offsets[:-1][texts], at + 1)))
    gone = np.searchsorted(at, starts)  # cutters before the start
    bounds = np.concatenate((starts - gone, [n - len(at)]))
    return _strings(data[~cutter], bounds), np.searchsorted(starts, offsets)


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


class UnitEncoder:
    """Encodes slices of texts through `encode_many(list of units) -> list of id lists`; ids are below 65536."""

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], split: Callable) -> None:
        self.encode_many, self.split = encode_many, split
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def distinct(self, units: pa.Array) -> tuple[np.ndarray, list[str]]:
        coded = units.dictionary_encode()
        return np.asarray(coded.indices), coded.dictionary.to_pylist()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text into them)."""
        units, first = self.split(data, offsets)
        index, names = self.distinct(units)
        have = list(map(self.cache.get, names))
        absent = [i for i, x in enumerate(have) if x is None]
        if absent:
            missing = []
            for i in absent:
                have[i] = self.older.get(names[i])
                if have[i] is None:
                    missing.append(i)
            for i, ids in zip(missing, self.encode_many([names[i] for i in missing]), strict=True):
                have[i] = array("H", ids).tobytes()
            if len(self.cache) + len(absent) > CACHE_UNITS:
                self.older, self.cache = self.cache, {}
            self.cache.update((names[i], have[i]) for i in absent if len(names[i]) <= CACHE_UNIT_BYTES)
        sizes = np.fromiter(map(len, have), np.int32, len(have)) // 2
        flat = np.frombuffer(b"".join(have), dtype=np.uint16)
        begins = (np.cumsum(sizes) - sizes).astype(np.int32)
        each = sizes[index]
        ends = np.cumsum(each, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        gather = np.arange(total, dtype=np.int32) + np.repeat(begins[index] - (ends - each), each)
        return flat[gather], np.concatenate(([0], ends))[first].astype(np.int64)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> UnitEncoder:
    """One for all tasks of a worker process: the tokenizers library with a word-end BPE file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    byte_mark = {chr(b): pre for b, pre in zip(range(256), _byte_marks(), strict=True)}
    latin = str.maketrans({c: "".join(byte_mark[chr(b)] for b in c.encode()) for c in map(chr, range(0xDF, 0x100))})
    merge = model.model.tokenize

    def many(units: list[str]) -> list[list[int]]:
        # plain lower-case words skip the library's normaliser and splitter, which leave them as they are
        out: list = [[x.id for x in merge(u if u.isascii() else u.translate(latin))] if _PLAIN.fullmatch(u) else None for u in units]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, found in zip(rest, model.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    return UnitEncoder(many, units_by_space)


def _byte_marks() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@lru_cache(maxsize=2)
def piece_bpe(path: str) -> UnitEncoder:
    """One for all tasks of a worker process: the sentencepiece library with a BPE model whose pieces hold the blank mark only at their start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return UnitEncoder(lambda units: model.encode(units, num_threads=1), units_by_blank)
