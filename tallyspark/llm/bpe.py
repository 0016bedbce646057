"""Byte-level BPE over many texts: pieces are cut with array operations, and each distinct piece is
encoded once per worker by the tokenizer's own model.

The cut follows the byte-level pre-tokenizer: contractions; an optional space with a run of letters,
of numbers or of other marks; white space. Texts with added tokens, or with characters whose class
might differ between Unicode versions, go to the library whole.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from tallyspark.llm.words import CODES, mix, span_hashes

#: Texts are taken together up to so many characters.
BLOCK_CHARS = 1 << 19
#: Bounds of a worker's cache: distinct pieces, and ids over all of them.
CACHE_PIECES, CACHE_IDS = 1 << 20, 1 << 23
_SLOTS = CACHE_PIECES * 4
LETTER, NUMBER, SPACE, OTHER, UNSAFE = 1, 2, 3, 4, 0
#: Ranges of code points whose classes every Unicode version since 3.0 agrees on.
_SAFE = [(0x00, 0x84), (0x86, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3CE), (0x400, 0x481), (0x48C, 0x4C0),
         (0x2010, 0x2027), (0x20AC, 0x20AC), (0x4E00, 0x9FA5)]


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    for lo, hi in _SAFE:
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            text = "".join(map(chr, range(lo, hi + 1)))
            out[[ord(c) for c in regex.findall(pattern, text)]] = kind
        run = out[lo:hi + 1]
        run[run == 0] = OTHER
    return out


@lru_cache(1)
def _char_codes() -> np.ndarray:
    return mix(np.arange(1 << 16, dtype=np.uint64) + CODES[7])


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes lists of texts exactly as the tokenizer file does, without special tokens added."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        model = spec["model"]
        self.plain = (
            spec["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout")
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        )
        self.map = {b: c for b, c in byte_alphabet().items()}
        size = max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        back = {c: b for b, c in self.map.items()}
        self.token_bytes = [b""] * size
        for token, i in model["vocab"].items():
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for t in spec["added_tokens"]:
            self.token_bytes[t["id"]] = t["content"].encode()
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.values = np.full(_SLOTS, -1, np.int32)
        self.at = np.zeros(CACHE_PIECES + 1, np.int64)
        self.size = np.zeros(CACHE_PIECES + 1, np.int32)
        self.pool = np.zeros(CACHE_IDS + 1, np.int32)
        self.pieces = self.used = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers of keys, -1 where unknown (open addressing, all keys at once)."""
        slot = (keys & np.uint64(_SLOTS - 1)).astype(np.int64)
        out = self.values[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (_SLOTS - 1)
            got = self.values[slot]
            done = (got < 0) | (self.keys[slot] == keys[todo])
            out[todo[done]] = got[done]
            todo, slot = todo[~done], slot[~done]
        return out

    def _learn(self, key: int, piece: str) -> None:
        ids = [t.id for t in self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.map))]
        n, slot = self.pieces, key & (_SLOTS - 1)
        while self.values[slot] >= 0:
            slot = (slot + 1) & (_SLOTS - 1)
        self.keys[slot], self.values[slot] = key, n
        self.at[n], self.size[n] = self.used, len(ids)
        self.pool[self.used:self.used + len(ids)] = ids
        self.pieces += 1
        self.used += len(ids)

    def _cut(self, chars: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the pieces; first marks the first character of each text."""
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        word = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:]) + 1
        start[word - 1] = True
        start[word] = chars[word - 1] != 0x20
        n = len(chars)
        for i in np.flatnonzero(chars == 0x27).tolist():
            if i + 1 >= n or first[i + 1] or (i and not first[i] and (kind[i - 1] == OTHER or chars[i - 1] == 0x20)):
                continue
            two = chr(chars[i + 1])
            pair = two + chr(chars[i + 2]) if i + 2 < n and not first[i + 2] else ""
            size = 2 if two in "stmd" else 3 if pair in ("re", "ve", "ll") else 0
            if size:
                start[i + 1:i + size] = False
                if i + size < n:
                    start[i + size] = True
        return np.flatnonzero(start)

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        big = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        if not big:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        chars = np.frombuffer(big.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(chars) + 1, bool)
        first[ends - sizes] = True
        first = first[:-1]
        starts = self._cut(chars, _classes()[chars], first)
        stops = np.append(starts[1:], len(chars))
        keys = span_hashes(chars, starts, stops, _char_codes()) ^ (stops - starts).astype(np.uint64)
        number = self._find(keys)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            where = missing[where]
            longest = int((stops[where] - starts[where]).sum()) * 4
            if self.pieces + len(new) > CACHE_PIECES or self.used + longest > CACHE_IDS:
                self._clear()
                if len(new) > CACHE_PIECES or longest > CACHE_IDS:
                    return None
                return self._block(texts)
            for key, a, b in zip(new.tolist(), starts[where].tolist(), stops[where].tolist()):
                self._learn(key, big[a:b])
            number[missing] = self._find(keys[missing])
        count = self.size[number].astype(np.int64)
        after = np.cumsum(count)
        spot = np.repeat(self.at[number] - (after - count), count) + np.arange(after[-1])
        upto = np.concatenate([[0], after])[np.searchsorted(starts, np.concatenate([[0], ends]))]
        return self.pool[spot], np.diff(upto)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for r in rows for i in r], np.int32), np.array([len(r) for r in rows], np.int64)

    def _safe(self, text: str) -> bool:
        if text.isascii():
            return not any(a in text for a in self.added)
        if max(text) > "￿" or any(a in text for a in self.added):
            return False
        return bool(_classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].all())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts one after another, and how many each text has."""
        ids, counts, i = [], [], 0
        while i < len(texts):
            fast, j, chars = self.plain and self._safe(texts[i]), i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) <= BLOCK_CHARS):
                if j > i and (self.plain and self._safe(texts[j])) != fast:
                    break
                chars += len(texts[j])
                j += 1
            got = self._block(texts[i:j]) if fast else None
            part, n = self._whole(texts[i:j]) if got is None else got
            ids.append(part)
            counts.append(n)
            i = j
        none = np.zeros(0, np.int32)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (none, none.astype(np.int64))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included."""
        n = self.lengths[ids]
        after = np.cumsum(n)
        if not len(ids):
            return ""
        spot = np.repeat(self.first[ids] - (after - n), n) + np.arange(after[-1])
        return self.flat[spot].tobytes().decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file; it lives as long as the worker."""
    return Encoder(path)
