"""Token ids of whole texts by a public tokenizer, with a bounded cache of the words already encoded.

The tokenizers library gives every id. A text is first cut at places where no token can cross (single spaces and
line breaks between visible characters, or any white space where the vocabulary drops it), so that a word that
comes again is looked up and not encoded again. Texts with other white space or with one of the vocabulary's added
tokens go to the library whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from strandline.llm.common import row_chunks

END_ID = 2
_CACHES: dict[tuple, "_Words"] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> str:
    """The printable letter that a byte-level vocabulary writes for each byte: itself, or the next one from 256 up."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return "".join(out)


_LETTERS = _byte_letters()
_SPACE = _LETTERS[32]
_TAIL = frozenset(".,;:!?")
_LAST_PLAIN = "ɏ"  # Latin letters up to here are letters in every Unicode version and need no normal form
_WRITTEN = {chr(c): "".join(_LETTERS[b] for b in chr(c).encode()) for c in range(ord(_LAST_PLAIN) + 1)}
_DOTTED_I = "İ"
# How the two vocabularies split a text, for text of plain Latin letters, digits and marks (fixed values of their files).
_KEEPING = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+")
_DROPPING = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class _Words(dict):
    """word -> row of the id table; a word that is not there yet is encoded and added.

    A table of over MOST rows keeps the words that came twice or more since the last time, the most frequent half of
    MOST at most. What goes is only encoded again when it comes again.
    """

    MOST = 700_000

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]  # matched in the raw text
        self.merge = self.library.model.tokenize
        self.drops_space = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)" not in str(self.library.pre_tokenizer)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.start, self.size = array("I"), array("q"), array("q")
        self.views = None
        self.uses = np.zeros(0, np.int32)
        self.single: dict[str, list[int]] = {}
        self.end = self._add([END_ID])

    def trim(self) -> None:
        """Drop the rows that came once, and all but the most frequent if very many came more often."""
        flat, start, size = self.tables()
        uses = self.uses
        least = max(2, int(np.partition(uses, -(self.MOST // 2))[-(self.MOST // 2)]) + 1) if len(uses) > self.MOST // 2 else 2
        kept = [(word, row) for word, row in self.items() if row >= 0 and row < len(uses) and uses[row] >= least]
        self.forget()
        if kept:
            rows = np.array([row for _, row in kept], np.int64)
            take = np.arange(size[rows].sum()) + np.repeat(start[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows])
            begin = len(self.flat) + np.cumsum(size[rows]) - size[rows]
            first = len(self.start)
            self.flat.frombytes(flat[take].tobytes())
            self.start.frombytes(begin.astype(np.int64).tobytes())
            self.size.frombytes(size[rows].astype(np.int64).tobytes())
            self.update((word, first + i) for i, (word, _) in enumerate(kept))

    def count(self, rows: np.ndarray) -> None:
        got = np.bincount(rows, minlength=len(self.uses)).astype(np.int32)
        got[: len(self.uses)] += self.uses
        self.uses = got

    def _add(self, ids: list[int]) -> int:
        self.start.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        return len(self.start) - 1

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.views is None or len(self.views[1]) != len(self.start):
            self.views = np.array(self.flat, np.uint32), np.array(self.start, np.int64), np.array(self.size, np.int64)
        return self.views

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _one(self, unit: str) -> list[int]:
        """Ids of one unit that the library's splitter leaves whole; a leading space may stand before a word."""
        if unit.isascii() and unit.isalnum():
            return [t.id for t in self.merge(unit)]
        return [t.id for t in self.merge("".join(map(_WRITTEN.__getitem__, unit)))]

    def _known(self, word: str) -> list[int] | None:
        """Ids of a word that the table has."""
        row = self.get(word, -1)
        return None if row < 0 else self.flat[self.start[row] : self.start[row] + self.size[row]].tolist()

    def _parts(self, units: list[str]) -> list[int]:
        ids: list[int] = []
        for unit in units:
            ids += self._one(unit) if unit.isalpha() else self._tail(unit)
        return ids

    def _tail(self, mark: str) -> list[int]:
        if mark not in self.single:
            if len(self.single) > 50_000:
                self.single.clear()
            self.single[mark] = self._one(mark)
        return self.single[mark]

    def __missing__(self, piece: str) -> int:
        ids = self._dropping(piece) if self.drops_space else self._keeping(piece)
        if ids is None:
            row = -1
        else:
            row = len(self.start)
            self.start.append(len(self.flat))
            self.size.append(len(ids))
            self.flat.extend(ids)
        self[piece] = row
        return row

    def _dropping(self, piece: str) -> list[int]:
        if not piece:
            return []
        plain = piece.isascii()
        mark = piece[-1]
        word = piece[:-1] if mark in _TAIL else piece
        if word.isalpha() and (plain or (max(word) <= _LAST_PLAIN and _DOTTED_I not in word)):
            low = word.lower()
            ids = self._known(low) if low != piece else None
            if ids is None:
                ids = self._one(low)
            return ids + self._tail(mark) if mark in _TAIL else ids
        if piece.isprintable() and max(piece) <= _LAST_PLAIN and _DOTTED_I not in piece:
            return self._parts(_DROPPING.findall(piece.lower()))
        return self.whole(piece)

    def _keeping(self, piece: str) -> list[int] | None:
        """None where the cut may not be a token border; a piece after a line break or at the start begins with NUL."""
        if piece == "\n":
            return self._tail("\n")
        begin = " "
        if piece[:1] == "\0":
            begin, piece = "", piece[1:]
        if not piece:
            return None
        mark = piece[-1]
        word = piece[:-1] if mark in _TAIL else piece
        if word.isalpha() and (word.isascii() or max(word) <= _LAST_PLAIN):
            ids = self._known(word) if begin and mark in _TAIL else None
            if ids is None:
                ids = self._one(begin + word) if not word.isascii() or not begin else [t.id for t in self.merge(_SPACE + word)]
            return ids + self._tail(mark) if mark in _TAIL else ids
        if not (mark.isalnum() or "!" <= mark <= "~") or (not begin and piece[0].isspace()):
            return None
        if piece.isprintable() and max(piece) <= _LAST_PLAIN:
            return self._parts(_KEEPING.findall(begin + piece))
        return self.whole(begin + piece)

    def rows(self, text: str) -> np.ndarray | None:
        """Table rows of the text's pieces; None if it must be encoded whole, as with the vocabulary's added tokens."""
        if any(token in text for token in self.added):
            return None
        if self.drops_space:
            pieces = text.replace("\n", " ").split(" ")
        elif not text:
            return np.zeros(0, np.int32)
        elif "\0" in text:
            return None
        else:
            pieces = ("\0" + text.replace("\n", " \n \0")).split(" ")
        found = np.fromiter(map(self.__getitem__, pieces), np.int32, len(pieces))
        return None if not self.drops_space and len(found) and found.min() < 0 else found


def _words(path: str) -> _Words:
    key = (path, os.getpid())
    if key not in _CACHES:
        _CACHES[key] = _Words(path)
    return _CACHES[key]


def encode(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, each text with the end id, and the number of ids of each text."""
    words = _words(path)
    if len(words.start) > words.MOST:
        words.trim()
    rows, counts = [], np.zeros(len(texts), np.int64)
    end = np.array([words.end], np.int32)
    for i, text in enumerate(texts):
        found = words.rows(text)
        if found is None:
            found = np.array([words._add(words.whole(text))], np.int32)
        rows += [found, end]
        counts[i] = len(found) + 1
    flat, start, size = words.tables()
    every = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    words.count(every)
    sizes = size[every]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    take = np.arange(total, dtype=np.int64)
    take += np.repeat(start[every] - (ends - sizes), sizes)
    ids = flat[take]
    last = np.cumsum(counts) - 1
    n = np.diff(np.r_[0, ends[last]]) if len(texts) else counts
    return ids, n


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, text: int, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(input slice, ids, ids of each row) for slices of a few MB; `text` is the text column's place, nulls are empty."""
    for batch in row_chunks(batches, rows, 2 << 20):
        ids, n = encode([x or "" for x in batch.column(text).to_pylist()], path)
        yield batch, ids, n
