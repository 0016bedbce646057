"""Word-end BPE over many texts: lower case, white space dropped, each distinct piece encoded once per worker.

For tokenizer files that compose, put white space together and lower-case a text, cut it into contractions,
letter runs, single digits and runs of other marks, and close each piece with a word end. Texts with added
tokens, or with characters that composition or case could change unevenly, go to the library whole.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

from tallyspark.llm.bpe import LETTER, NUMBER, OTHER, SPACE, Encoder
from tallyspark.llm.words import CODES, mix, span_hashes

#: Code points whose class, lower case (one character, itself composed) and composition are beyond doubt.
_SAFE = [(0x09, 0x0D), (0x20, 0x7E), (0xA0, 0xAC), (0xAE, 0x12F), (0x131, 0x148), (0x14A, 0x17E), (0x2010, 0x2027), (0x20AC, 0x20AC)]
_SIZE = 0x2100
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and lower case of every code point below _SIZE (class 0: not safe), and hash codes."""
    kind, lower = np.zeros(_SIZE, np.uint8), np.arange(_SIZE, dtype=np.uint32)
    for lo, hi in _SAFE:
        text = "".join(map(chr, range(lo, hi + 1)))
        kind[lo:hi + 1] = OTHER
        for k, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            kind[[ord(c) for c in regex.findall(pattern, text)]] = k
        lower[lo:hi + 1] = [ord(c.lower()) for c in text]
    return kind, lower, mix(np.arange(_SIZE, dtype=np.uint64) + CODES[11])


class WordEncoder(Encoder):
    """Encodes lists of texts exactly as the tokenizer file does, without special tokens added."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        model = spec["model"]
        self.plain = (
            [s["type"] for s in steps] == _NORMALIZER and steps[1].get("pattern") == {"Regex": "\\s+"} and steps[1].get("content") == " "
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": _PATTERN}
            and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
            and model["type"] == "BPE" and not model.get("dropout") and not any(t["normalized"] for t in spec["added_tokens"])
        )

    def _safe(self, text: str) -> bool:
        if max(text, default=" ") >= chr(_SIZE) or any(a in text for a in self.added):
            return False
        return bool(_tables()[0][np.frombuffer(text.encode("utf-32-le"), np.uint32)].all())

    def _cut(self, chars: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the pieces and of the white space between them."""
        start = first | (kind == NUMBER)
        start[1:] |= kind[1:] != kind[:-1]
        n = len(chars)
        for i in np.flatnonzero((chars == 0x27) & start).tolist():
            if i + 1 >= n or first[i + 1]:
                continue
            two = chr(chars[i + 1])
            pair = two + chr(chars[i + 2]) if i + 2 < n and not first[i + 2] else ""
            size = 2 if two in "stmd" else 3 if pair in ("re", "ve", "ll") else 0
            if size:
                start[i + 1:i + size] = False
                if i + size < n:
                    start[i + size] = True
        return np.flatnonzero(start)

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        kinds, lower, codes = _tables()
        chars = lower[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        if not len(chars):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        kind = kinds[chars]
        first = np.zeros(len(chars) + 1, bool)
        first[ends - sizes] = True
        starts = self._cut(chars, kind, first[:-1])
        stops = np.append(starts[1:], len(chars))
        solid = kind[starts] != SPACE
        starts, stops = starts[solid], stops[solid]
        keys = span_hashes(chars, starts, stops, codes) ^ (stops - starts).astype(np.uint64)
        number = self._find(keys)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            where = missing[where]
            longest = int((stops[where] - starts[where]).sum()) * 4
            if self._full(len(new), longest):
                self._clear()
                return None if self._full(len(new), longest) else self._block(texts)
            for key, a, b in zip(new.tolist(), starts[where].tolist(), stops[where].tolist()):
                self._learn(key, chars[a:b].astype("<u4").tobytes().decode("utf-32-le"))
            number[missing] = self._find(keys[missing])
        count = self.size[number].astype(np.int64)
        after = np.concatenate([[0], np.cumsum(count)])
        spot = np.repeat(self.at[number] - after[:-1], count) + np.arange(after[-1])
        return self.pool[spot], np.diff(after[np.searchsorted(starts, np.concatenate([[0], ends]))])

    def _full(self, pieces: int, ids: int) -> bool:
        return self.pieces + pieces >= len(self.at) or self.used + ids >= len(self.pool)


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file; it lives as long as the worker."""
    return WordEncoder(path)
