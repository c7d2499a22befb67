"""Token ids of whole texts by a tokenizers file, one library call for each distinct unit a worker meets.

The tokenizer file must split at white space and drop it (as word-level BPE does): then the ids of a text are
the ids of its words in turn. If the file also lower-cases and splits words into runs of letters, single digits and
runs of other characters, words of such ASCII and Latin characters are cut into these units, lower-cased, and the units
go to the model. Any other word (apostrophes, ``<``, other scripts and signs) is one unit for the whole tokenizer.
Units are hashed on the Arrow buffer and looked up in a bounded memo that lives as long as the Python worker.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd

from .common import Words, ragged

MEMO_WORDS = 600_000

# The normalizer and pre-tokenizer pattern that make the units below right
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

LETTER, DIGIT, SIGN = 1, 2, 3
_KIND = np.full(256, SIGN, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
_KIND[48:58] = DIGIT
#: Bytes that make a word one for the whole tokenizer: apostrophe, <, controls, and leads of characters beyond U+00C0 to U+017F.
_ODD = np.zeros(256, bool)
_ODD[[0x27, 0x3C, 0x7F, *range(0x09), *range(0x0E, 0x20), 0xC2, *range(0xC6, 0x100)]] = True
#: Characters between U+00C0 and U+017F that are no letters, or letters whose lower case is two characters.
_ODD_PAIRS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))

_encoders: dict[str, "WordEncoder"] = {}


def word_encoder(path: str) -> "WordEncoder":
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, then U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Units(Words):
    """The words of a block, those without odd bytes cut into lower-cased units; odd: which units are whole words."""

    def __init__(self, data: np.ndarray, at: np.ndarray, split: bool):
        super().__init__(data, at, hashed=False)
        odd = np.ones(len(self.start), bool)
        if split:
            odd[:] = False
            strange = [np.flatnonzero(_ODD[data])]
            for lead, tail in _ODD_PAIRS:
                place = np.flatnonzero(data[1:] == tail)
                strange.append(place[data[place] == lead])
            strange = np.concatenate(strange)
            odd[np.searchsorted(self.start, strange[self._inside(strange)], "right") - 1] = True
        size = self.end - self.start
        solid = np.zeros(len(data), bool)
        solid[ragged(self.start, size)] = True
        begin = np.zeros(len(data), bool)
        if split:
            kind = _KIND[data]
            begin = solid & (kind == DIGIT)
            begin[1:] |= solid[1:] & (kind[1:] != kind[:-1])
            begin[ragged(self.start[odd], size[odd])] = False
        begin[self.start] = True
        # the lower case of ASCII letters is taken outside odd words, whose special tokens may depend on it
        lower = np.where((data >= 65) & (data <= 90), data | 32, data)
        lower[ragged(self.start[odd], size[odd])] = data[ragged(self.start[odd], size[odd])]
        self.data = lower
        word, self.start = self.start, np.flatnonzero(begin)
        owner = np.searchsorted(word, self.start, "right") - 1
        self.end = np.minimum(np.append(self.start[1:], len(data)), self.end[owner])
        self.odd = odd[owner]
        self.first = np.searchsorted(self.start, at)
        self.hash = self._hash()

    def _inside(self, place: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.start, place, "right") - 1
        return (word >= 0) & (place < self.end[np.maximum(word, 0)]) if len(self.start) else np.zeros(len(place), bool)


class Memo:
    """Numbers of 64-bit hashes in order of arrival: open addressing in arrays, so a block's units are looked up together."""

    def __init__(self):
        self.hashes, self.numbers, self.count = np.zeros(1 << 12, np.uint64), np.full(1 << 12, -1, np.int32), 0

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(20) & np.uint64(len(self.hashes) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for an unknown one."""
        at, found = self._home(hashes), np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        while len(left):
            number = self.numbers.take(at)
            same = self.hashes.take(at) == hashes[left]
            found[left] = np.where(same, number, -1)
            on = ~same & (number >= 0)
            left, at = left[on], at[on] + 1 & len(self.hashes) - 1
        return found

    def add(self, hashes: np.ndarray) -> None:
        """Numbers new, distinct hashes."""
        if 3 * (self.count + len(hashes)) > len(self.hashes):
            used = self.numbers >= 0
            held = self.hashes[used][np.argsort(self.numbers[used])]
            size = 1 << int(4 * (self.count + len(hashes))).bit_length()
            self.hashes, self.numbers, self.count = np.zeros(size, np.uint64), np.full(size, -1, np.int32), 0
            self.add(held)
        at, left = self._home(hashes), np.arange(len(hashes))
        while len(left):
            free = self.numbers.take(at) < 0
            self.numbers[at[free]] = left[free] + self.count  # of several that want a place one gets it
            won = free & (self.numbers.take(at) == left + self.count)
            self.hashes[at[won]] = hashes[left[won]]
            left, at = left[~won], at[~won] + 1 & len(self.hashes) - 1
        self.count += len(hashes)


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        normal = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        before = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.split = (
            normal == NORMALIZERS and [x.get("type") for x in before] == ["Split", "ByteLevel"] and before[0]["pattern"] == {"Regex": SPLITS}
            and before[0]["invert"] and before[0]["behavior"] == "Removed" and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
        )
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.memo = Memo()
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, units: list[bytes], odd: list[bool]) -> None:
        tokenize, letters = self.model.tokenize, self.letters
        ids: list = [None] * len(units)
        for i, (unit, whole) in enumerate(zip(units, odd)):
            if not whole:
                text = unit.decode("ascii") if unit.isascii() else unit.decode().lower().encode().decode("latin-1").translate(letters)
                ids[i] = [t.id for t in tokenize(text)]
        rest = [i for i, whole in enumerate(odd) if whole]
        if rest:
            for i, x in zip(rest, self.tokenizer.encode_batch_fast([units[i].decode() for i in rest], add_special_tokens=False)):
                ids[i] = x.ids
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.memo.add(hashes)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter((t for x in ids for t in x), np.uint32, int(size.sum()))])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a block, and the number of ids of each row."""
        units = Units(data, at, self.split)
        codes, distinct = pd.factorize(units.hash)
        if self.memo.count + len(distinct) > MEMO_WORDS:
            self.forget()
        slots = self.memo.find(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new):
            where = np.zeros(len(distinct), np.int64)
            where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            base = len(self.size)
            raw = units.data.tobytes()
            spans = zip(units.start[where[new]].tolist(), units.end[where[new]].tolist())
            self.learn(distinct[new], [raw[a:b] for a, b in spans], units.odd[where[new]].tolist())
            slots[new] = np.arange(base, base + len(new))
        slots = slots[codes]
        size = self.size[slots]
        ids = self.flat[ragged(self.begin[slots], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(total[units.first])


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends the id end to each row; the ids and the offsets of the rows."""
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(int(offsets[-1]), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = ids
    return out, offsets
