"""Token ids of many texts with a public tokenizer: every distinct piece of text is tokenised once a worker.

The vocabulary file's splitting rule is known (fixed values below), so texts in ASCII and Latin-1 are cut into pieces with
array operations and only pieces that a worker has not met go through the tokenizer. All other texts, and texts whose
pieces could depend on their neighbours (apostrophes, special tokens), go through the tokenizer whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from .strings import span_keys
from .textblocks import U, span_hash, spread

#: The splitting rule that a file must have for the fast path.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]
END = "</w>"
#: Pieces that a worker remembers.
MOST_PIECES = 800_000

LETTER, NUMBER, OTHER, GAP = 0, 1, 2, 3


def _kind(c: int) -> int:
    if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F):
        return GAP
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)


KIND = np.array([_kind(c) for c in range(256)], np.uint8)
LOWER = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)


class Encoder:
    """Ids of blocks of texts, with the pieces that this worker has met."""

    def __init__(self, path: str):
        import json

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.fast = steps == NORMAL and split == SPLIT and spec["model"].get("end_of_word_suffix") == END
        size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.ends = np.zeros(size, bool)
        for word, i in spec["model"]["vocab"].items():
            self.ends[i] = word.endswith(END)
        self.forget()

    def forget(self) -> None:
        self.known, self.second, self.at, self.count, self.ids = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str], hashes: np.ndarray, second: np.ndarray) -> bool:
        """Remembers the pieces' ids; False if the vocabulary does not end each piece in one end-of-word token."""
        got = [np.zeros(0, self.kind)]
        for i in range(0, len(pieces), 20_000):
            lines = [" ".join(pieces[k:k + 200]) for k in range(i, min(i + 20_000, len(pieces)), 200)]
            got += [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate(got)
        stop = np.flatnonzero(self.ends[flat]) + 1
        if len(stop) != len(pieces):
            return False
        begin = np.concatenate(([0], stop[:-1])).astype(np.int64)
        into = np.searchsorted(self.known, hashes)  # both ascend
        self.known, self.second = np.insert(self.known, into, hashes), np.insert(self.second, into, second)
        self.at = np.insert(self.at, into, begin + len(self.ids))
        self.count = np.insert(self.count, into, stop - begin)
        self.ids = np.concatenate((self.ids, flat))
        return True

    def encode(self, data: np.ndarray, at: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows and where each row's begin; hash and row of each piece (rows on the slow path: of their ids).

        Pieces are the same if both of their 64-bit keys are; rows with a piece that shares only the first key with another
        one (``whole``) go through the tokenizer whole.
        """
        rows = len(at) - 1
        odd = (data >= 0xC4) | (data == 0x27)
        if len(data) > 1:
            odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        sums = np.concatenate(([0], np.cumsum(odd)))
        slow = sums[at[1:]] > sums[at[:-1]] if self.fast else np.ones(rows, bool)
        if whole is not None:
            slow = slow | whole
        lead = (data == 0xC2) | (data == 0xC3)
        chars = data.copy()
        after = np.flatnonzero(lead) + 1
        chars[after] += ((data[after - 1] == 0xC3) * 0x40).astype(np.uint8)
        keep = ~lead
        chars = LOWER[chars[keep]]
        place = np.concatenate(([0], np.cumsum(keep)))[at]
        kind = KIND[chars]
        kind[spread(place[:-1][slow], np.diff(place)[slow])] = GAP
        edge = np.ones(len(chars), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        edge[place[:-1][np.diff(place) > 0]] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(chars))
        full = kind[start] != GAP
        start, end = start[full], end[full]
        row = np.searchsorted(place, start, "right") - 1
        h, second = span_keys(chars, start, end)
        if len(self.known) > MOST_PIECES:
            self.forget()
        found, first, of = np.unique(h, return_index=True, return_inverse=True)
        where = np.searchsorted(self.known, found)
        there = np.minimum(where, max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[there] != found) if len(self.known) else np.arange(len(found))
        if len(new):
            raw = chars.tobytes()
            pieces = [raw[a:z].decode("latin-1") for a, z in zip(start[first[new]].tolist(), end[first[new]].tolist())]
            if not self.learn(pieces, found[new], second[first[new]]):
                return self.encode(data, at, np.ones(rows, bool))
        entry = np.searchsorted(self.known, found)[of]
        other = self.second[entry] != second
        if other.any():
            again = np.zeros(rows, bool) if whole is None else whole.copy()
            again[row[other]] = True
            return self.encode(data, at, again)
        count = self.count[entry]
        ids = self.ids[spread(self.at[entry], count)]
        n = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
        if slow.any():
            at_slow = np.flatnonzero(slow)
            raw = data.tobytes()
            held = self.whole([raw[at[r]:at[r + 1]].decode("utf-8") for r in at_slow])
            begin = np.concatenate(([0], np.cumsum(n)))
            parts, k = [], 0
            for r, x in zip(at_slow, held):
                parts += [ids[k:begin[r]], x]
                k = begin[r]
            ids = np.concatenate((*parts, ids[k:]))
            n[at_slow] = [len(x) for x in held]
            extra = np.concatenate(held) if held else np.zeros(0, self.kind)
            h = np.concatenate((h, span_hash(extra.view(np.uint8), np.arange(len(extra)) * self.kind().itemsize, (np.arange(len(extra)) + 1) * self.kind().itemsize)))
            row = np.concatenate((row, np.repeat(at_slow, n[at_slow])))
        return ids, np.concatenate(([0], np.cumsum(n))), h, row


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
