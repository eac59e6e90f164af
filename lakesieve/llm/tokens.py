"""Encoding of whole texts with tokenizers of the `tokenizers` library, each distinct word only once for a worker: words are
looked up in columns, and their ids gathered from one flat table."""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words and ids that a worker remembers; beyond, it forgets all and starts anew. Lookups take about as much again.
REMEMBERED = 24 << 20
#: Characters of the texts that are looked up together, and ids that are gathered at once.
BLOCK, GATHERED = 8 << 20, 1 << 20
#: Signs for the white space that a byte-level piece has before it: none, or a line feed alone; a plain piece has a space.
#: Texts that hold the signs themselves go through the whole tokenizer.
_BARE, _FEED = "\x00", "\x01"
#: White space besides the space and the line feed, as Unicode has it (and four separators more, which does no harm).
_OTHER_SPACE = [c for c in map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Latin letters below U+0250, on which all Unicode versions agree; normal forms and word boundaries leave them as they are (the
#: dotted capital I, which lower case parts in two, is left out).
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_LATIN, _LATIN_START = f"^[{_LETTERS}]+$", f"^[{_LETTERS}]+"
#: Marks that both kinds of pre-tokenizer keep together, apart from letters.
_MARKS = string.punctuation


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _even(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between other characters."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return text.isascii() and not any(c in text for c in _OTHER_SPACE[:8]) or not any(c in text for c in _OTHER_SPACE)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The parts of flat, one after the other."""
    upto = np.cumsum(lengths)
    return flat[np.repeat(starts - (upto - lengths), lengths) + np.arange(upto[-1] if len(upto) else 0)]


class Encoder:
    """Ids of texts, as little-endian unsigned integers of `width` bytes.

    A byte-level BPE never joins bytes over a single space or line feed between two characters that are not white space, and
    a word BPE never joins any over white space, so a text's ids are its words' ids in turn. Runs of white space stay inside
    the piece that holds them. Special tokens hold no white space; they come out as the library has them.

    A word of Latin letters, with or without punctuation marks behind it, is one piece (and the marks another) to the
    pre-tokenizer of either kind, so it goes straight to the library's model; all else goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model.tokenize
        self._bytewise = self._tokenizer.normalizer is None
        self._letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self._forget()

    def _forget(self) -> None:
        """The known words in order of first sight; word i has the ids from _ends[i] to _ends[i + 1] of _flat."""
        self._known = pa.array([], pa.string())
        self._ends, self._flat = np.zeros(1, np.int64), np.zeros(0, self.type)

    def _keys(self, text: str) -> list[str]:
        """The pieces of an uneven text, with their signs."""
        first, *rest = _SAFE.split(text)
        keys = [_BARE + first]
        for p in rest:
            keys += [p[1:]] if p[0] == " " else [_FEED, _BARE + p[1:]]
        return keys

    def _words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All words of the texts in turn, and the number of each text's words."""
        if not self._bytewise:
            parts = pc.ascii_split_whitespace(pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string()))
            return parts.flatten(), np.diff(parts.offsets.to_numpy())
        even = [not t or _BARE not in t and _FEED not in t and _even(t) for t in texts]
        if all(even):
            marked = [_BARE + t.replace("\n", f" {_FEED} {_BARE}") for t in texts]
            parts = pc.split_pattern(pa.array(marked, pa.string()), " ")
            return parts.flatten(), np.diff(parts.offsets.to_numpy())
        keys = [(_BARE + t.replace("\n", f" {_FEED} {_BARE}")).split(" ") if e else [_BARE + t] if _BARE in t or _FEED in t else self._keys(t) for t, e in zip(texts, even, strict=True)]
        return pa.array([k for own in keys for k in own], pa.string()), np.fromiter(map(len, keys), np.int64, len(keys))

    def _ids(self, key: str) -> list[int]:
        """The ids of a word that is met for the first time."""
        if self._bytewise:
            if key == _FEED:
                return self._whole("\n")
            lead, word = ("", key[1:]) if key[:1] == _BARE else (" ", key)
        else:
            lead, word = "", key
        return self._whole(lead + word)

    def _each(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and how many each has."""
        find, ids, lengths = self._model, array("I"), array("I")  # arrays: lists by the hundred thousand would keep the collector busy
        lead = "\u0120" if self._bytewise else ""
        for word, simple in zip(units.to_pylist(), pc.match_substring_regex(units, _LATIN).to_pylist(), strict=True):
            before = len(ids)
            if not simple:
                ids.extend(self._ids(word))
            else:
                if not self._bytewise:
                    word = word.lower()
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(self._letters)
                for t in find(lead + word):
                    ids.append(t.id)
            lengths.append(len(ids) - before)
        return np.array(ids, self.type), np.array(lengths, np.int64)

    def _all_ids(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, one after the other, and how many each has. Words of Latin letters with marks behind are
        two pieces to either pre-tokenizer, so the letters are encoded once, whatever the marks."""
        stems = pc.utf8_rtrim(keys, characters=_MARKS)
        plain = pc.match_substring_regex(stems, _LATIN)
        units = pc.if_else(plain, stems, keys).dictionary_encode()
        sign = _BARE if self._bytewise else ""  # no space before the marks
        tails = pc.if_else(plain, pc.replace_substring_regex(keys, _LATIN_START, sign), sign).dictionary_encode()
        (ids, n), (more, m) = self._each(units.dictionary), self._each(tails.dictionary)
        at = np.stack((units.indices.to_numpy(), len(n) + tails.indices.to_numpy()), axis=1).ravel()
        lengths = np.concatenate((n, m))
        starts = np.cumsum(lengths) - lengths
        return _gathered(np.concatenate((ids, more)), starts[at], lengths[at]), lengths[at].reshape(-1, 2).sum(axis=1)

    def _whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's first and last place in a table of ids, and the table.

        Looking up costs as much as the words and the known ones together, so a short block looks at the first known words
        alone, which are the most frequent; what it lacks is encoded for this block."""
        seen = self._known[: 4 * len(words)]
        at = pc.index_in(words, value_set=seen)
        place = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.nonzero(place < 0)[0]
        flat, ends = self._flat, self._ends[: len(seen) + 1]
        if len(missing):
            more = words.take(pa.array(missing)).dictionary_encode()
            new, lengths = self._all_ids(more.dictionary)
            place[missing] = len(seen) + more.indices.to_numpy()
            flat = np.concatenate((flat[: ends[-1]], new))
            ends = np.concatenate((ends, ends[-1] + np.cumsum(lengths)))
            if len(seen) == len(self._known):
                self._known, self._ends, self._flat = pa.concat_arrays([seen, more.dictionary]), ends, flat
                if self._known.nbytes + ends.nbytes + flat.nbytes > REMEMBERED:
                    self._forget()
        return ends[place], ends[place + 1], flat

    def _block(self, texts: list[str]) -> Iterator[np.ndarray]:
        words, counts = self._words(texts)
        first, last, flat = self._places(words)
        upto = np.concatenate(([0], np.cumsum(last - first)))  # ids before each word
        stops = np.concatenate(([0], np.cumsum(counts)))  # words before each text
        i = 0
        while i < len(texts):
            # As many texts as stay within GATHERED ids, one at least.
            j = max(i + 1, int(np.searchsorted(upto[stops], upto[stops[i]] + GATHERED, side="right")) - 1)
            a, b = stops[i], stops[j]
            got = _gathered(flat, first[a:b], last[a:b] - first[a:b])
            for k in range(i, j):
                yield got[upto[stops[k]] - upto[a] : upto[stops[k + 1]] - upto[a]]
            i = j

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn; null counts as empty."""
        held: list[str] = []
        size = 0
        for t in chain(texts, [None]):
            held.append(t or "")
            size += len(held[-1])
            if size > BLOCK:
                yield from self._block(held)
                held, size = [], 0
        yield from islice(self._block(held), len(held) - 1)  # the last one marks the end

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one for each worker process, so that its words stay known from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
