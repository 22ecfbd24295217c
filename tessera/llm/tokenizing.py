"""Token ids of whole texts, exactly as the tokenizers library gives them, with a bounded table of the pieces seen.

A text is cut only where the tokenizer's own rules always cut, so the ids of its pieces in a row are the ids of the text.
Texts with anything that such a cut could not be sure about (a special token's opening, control characters that
libraries disagree about) go to the library as they are. Every id comes from the library; a piece is encoded once and then
looked up, and texts are put together from the table by array operations.

Nulls: a null text is empty and has no ids. Texts of any length are taken whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import HELD

WORD, BYTE = "word", "byte"  # word: white space is dropped; byte: it is part of the pieces
_SPACE = "\t\n\r\x0b\x0c \x85\xa0  -     　"
_PIECES = re.compile(f"[ \n]?[^{_SPACE}]+|[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])|[{_SPACE}]+")
_UNSURE = "[\x1c-\x1f᠎﻿]|<\\|"
_RUN = f"[{_SPACE}]{{3}}|[{_SPACE}]{{2}}\\z"  # white space whose pieces aren't single characters
_LOWER = "a-z\xdf-\xf6\xf8-\xffа-џ"  # composed letters of which the upper case is one letter
_UPPER = "A-Z\xc0-\xd6\xd8-\xdeЀ-Я"
_MARKS = "[!-/:-@\\[-`{-~]"
_LETTER, _MARK, _SPLIT, _SOLID = 1, 2, 4, 8  # kinds of bytes: ASCII letters, ASCII marks, those that start a piece, those that never go on after a line's end
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER | _SOLID
_KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK | _SOLID
_KINDS[[*range(48, 58), *range(0xC3, 0xE0)]] = _SOLID
_KINDS[[10, 32]] = _SPLIT
_TWO = np.array([re.fullmatch(f"[{_LOWER}{_UPPER}]", chr(c)) is not None for c in range(1 << 11)])  # letters of two bytes
_SIMPLE = {WORD: re.compile(f"()([{_LOWER}{_UPPER}]+)({_MARKS}*)"), BYTE: re.compile(f"(\n?)( ?[{_LOWER}{_UPPER}]+)({_MARKS}*)")}
_ALONE = re.compile(f" ?[{_LOWER}{_UPPER}]+")
_OWN: dict[tuple[str, str], "Cached"] = {}
HELD.append(_OWN)  # other operators' tasks drop it

# the alphabet of byte-level vocabularies: printable bytes stand for themselves, others for characters from U+0100
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_CODES = np.array([ord(_BYTES[b]) for b in range(256)], "<u4")


class Cached:
    """A tokenizer with a table of the ids of up to `most` pieces; a full table is emptied between calls (WORD), or keeps the half that most calls asked for again (BYTE)."""

    def __init__(self, path: str, kind: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kind, self.most = Tokenizer.from_file(path), kind, most
        self.plain = Tokenizer(self.tokenizer.model)  # the model alone, on words with line ends between them
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_BYTES[10])
        vocabulary = self.tokenizer.get_vocab()
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)  # of a token, in bytes (for BYTE)
        self.length[list(vocabulary.values())] = list(map(len, vocabulary))
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {"": 0}  # a piece's row
        self.begin, self.size, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.asked = np.zeros(1 << 12, np.int32)  # calls that found a row
        self.rows, self.used = 1, 0

    def _shrink(self) -> None:
        words, asked = list(self.place), self.asked[1 : self.rows]  # a dict's order is that of the rows
        keep = np.flatnonzero(asked) + 1
        if len(keep) > self.most // 2:
            keep = np.sort(keep[np.argsort(-asked[keep - 1], kind="stable")[: self.most // 2]])
        ids, sizes = self._gathered(keep)
        self._clear()
        if len(ids) <= 4 * self.most:
            self._append([words[i] for i in keep.tolist()], ids, sizes)

    @classmethod
    def of(cls, path: str, kind: str, most: int = 250_000) -> "Cached":
        """This process's own, which stays between tasks."""
        if (path, kind) not in _OWN:
            _OWN[path, kind] = cls(path, kind, most)
        return _OWN[path, kind]

    def _append(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New rows: the ids of all words in a row and how many each has."""
        n, m = self.rows + len(words), self.used + len(ids)
        if n > len(self.begin):
            self.begin, self.size, self.asked = (np.concatenate([x, np.zeros(max(n, len(x)), x.dtype)]) for x in (self.begin, self.size, self.asked))
        if m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(m, len(self.flat)), np.uint32)])
        self.flat[self.used : m] = ids
        self.size[self.rows : n] = sizes
        self.begin[self.rows : n] = self.used + np.cumsum(sizes) - sizes
        self.place.update(zip(words, range(self.rows, n), strict=True))
        self.rows, self.used = n, m

    def _gathered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows in a row, and how many each has."""
        sizes = self.size[rows]
        shift = self.begin[rows] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._flat([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that are one word each (for BYTE behind a space or not): these need the library's model only, no other rule."""
        if self.kind == WORD:
            tokenize = self.tokenizer.model.tokenize
            mapped = "\n".join(words).encode("utf-8").decode("latin-1").translate(_BYTES).split(_BYTES[10])
            return self._flat([[x.id for x in tokenize(w)] for w in mapped])
        out, each = [], []
        for lo, hi in in_parts(words, 1 << 15):
            data = np.frombuffer("\n".join(words[lo:hi]).encode("utf-8"), np.uint8)
            ids = np.array(self.plain.encode_batch_fast([_CODES[data].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(data == 10), len(data)) - np.arange(hi - lo)  # of words, without line ends
            after = np.cumsum(self.length[ids])
            last = np.searchsorted(after, ends)
            if not np.isin(ends, after).all():
                raise ValueError("ids that don't end where words do")
            out.append(ids)
            each.append(np.diff(last, prepend=-1))
        return np.concatenate(out), np.concatenate(each)

    @staticmethod
    def _flat(own: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        return np.fromiter(chain.from_iterable(own), np.uint32, int(sizes.sum())), sizes

    def _add(self, missing: list[str]) -> None:
        """Encode pieces that the table lacks: words at once, others by the library, and a word with marks around it from its parts."""
        simple, place, lower = _SIMPLE[self.kind].fullmatch, self.place, self.kind == WORD
        made: list[str] = []
        parts: list[tuple[str, str, str]] = []
        words, others = set(), set()
        if self.kind == BYTE:  # nearly all are words alone
            words.update(filter(_ALONE.fullmatch, missing))
            missing = [p for p in missing if p not in words]
        for piece in missing:
            m = simple(piece)
            if m is None:
                others.add(piece)
                continue
            before, word, after = m.groups()
            if lower:
                word = word.lower()
            if word not in place:
                words.add(word)
            if len(word) != len(piece) or (lower and word != piece):
                made.append(piece)
                parts.append((before, word, after))
                if after not in place:
                    others.add(after)
                if before not in place:
                    others.add(before)
        for own, encode in ((list(words), self._words), (list(others), self._library)):
            if own:
                self._append(own, *encode(own))
        if made:
            rows = np.fromiter(map(place.__getitem__, chain.from_iterable(parts)), np.int64, 3 * len(parts))
            ids, sizes = self._gathered(rows)
            self._append(made, ids, sizes.reshape(-1, 3).sum(axis=1))

    def _pieces(self, texts: pa.Array, long: bool = False) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts in a row, and how many each has; long: white space may be of any length."""
        if self.kind == WORD:
            lists = pc.ascii_split_whitespace(texts)
            return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        if long:
            own = [_PIECES.findall(t) for t in texts.to_pylist()]
            return pa.array([p for o in own for p in o], pa.large_string()), np.fromiter(map(len, own), np.int64, len(own))
        return _split(texts)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (uint32), and how many each has."""
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()), "")
        way = pc.match_substring_regex(texts, _UNSURE).to_numpy(zero_copy_only=False) * 2
        if self.kind == BYTE:
            way = np.maximum(way, pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False))
        if not way.any():
            return self._sure(texts)
        sizes, parts = np.zeros(len(texts), np.int64), []
        for k, encode in enumerate((self._sure, lambda x: self._sure(x, True), lambda x: self._library(x.to_pylist()))):
            ids, sizes[way == k] = encode(texts.filter(pa.array(way == k)))
            parts.append(ids)
        out, of = np.empty(sum(map(len, parts)), np.uint32), np.repeat(way, sizes)
        for k, ids in enumerate(parts):
            out[of == k] = ids
        return out, sizes

    def _sure(self, texts: pa.Array, long: bool = False) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > self.most or self.used > 8 * self.most:
            self._shrink() if self.kind == BYTE else self._clear()
        pieces, each = self._pieces(texts, long)
        found = pieces.dictionary_encode()
        kinds = found.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
        rows = np.fromiter(map(self.place.get, kinds, [-1] * len(kinds)), np.int64, len(kinds))
        self.asked[rows[rows >= 0]] += 1
        lacking = np.flatnonzero(rows < 0).tolist()
        if lacking:
            missing = [kinds[i] for i in lacking]
            self._add(missing)
            rows[lacking] = np.fromiter(map(self.place.__getitem__, missing), np.int64, len(missing))
        ids, sizes = self._gathered(rows[found.indices.to_numpy()]) if len(pieces) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(each)]
        return ids, np.diff(ends, prepend=0)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of large strings for BYTE, where white space is never longer than two characters, and how many each has.

    A piece starts at a space or a line's end, after a line's end, and at a mark behind a letter.
    """
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if bounds[0] == bounds[-1]:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    held = texts.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
    data, bounds = np.frombuffer(held, np.uint8), bounds - bounds[0]
    kinds = _KINDS[data]
    letter = kinds & _LETTER != 0
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xDF))
    letter[lead + 1] = _TWO[(data[lead] & 0x1F).astype(np.int64) << 6 | data[lead + 1] & 0x3F]
    cut = kinds & _SPLIT != 0
    cut[1:] |= letter[:-1] & (kinds[1:] & _MARK != 0)
    cut[1:] |= (data[:-1] == 10) & (kinds[1:] & _SOLID != 0)
    cut[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    at = np.append(np.flatnonzero(cut), len(data))
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), held), np.diff(np.searchsorted(at, bounds))


def in_ranges(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a string array with about `most` bytes together; a longer text is a range of its own or ends one."""
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    yield from zip(cuts, [*cuts[1:], len(texts)], strict=True)


def in_parts(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
