"""Words and rolling hashes of a batch of texts, in numpy over the Arrow buffers."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Words of a rolling-hash window.
WINDOW = 3
WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words by their lower case, others 0; bytes beyond ASCII belong to words that are in one form already.
WORD_BYTE = np.array([ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 0 for b in range(128)] + list(range(128, 256)), np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes spread over all 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    """Powers of the multiplier from 0 to n."""
    p = np.full(n + 1, MIX, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def caseless(text: str) -> list[str]:
    """Runs of letters or digits, case ignored."""
    return WORD.findall(text.upper().lower())


def word_hashes(texts: pa.Array, words: Callable[[str], list[str]] = caseless) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of every text). NULL is like an empty text.

    Texts of ASCII characters are split as bytes, all at once; `words` splits the others, and must
    give runs of letters or digits in lower case for ASCII texts.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    binary = texts.fill_null("").cast(pa.large_binary())
    _, offs, buffer = binary.buffers()
    offsets = np.frombuffer(offs, np.int64)[binary.offset : binary.offset + n + 1]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    beyond = np.concatenate(([0], np.cumsum(data >= 128)))
    other = np.flatnonzero(beyond[offsets[1:]] > beyond[offsets[:-1]])
    if len(other):
        raw, parts, at = data.tobytes(), [], 0
        size = np.diff(offsets)
        for i in other.tolist():
            parts.append(raw[at : offsets[i]])
            parts.append(" ".join(words(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "surrogatepass"))).encode("utf-8", "surrogatepass"))
            size[i], at = len(parts[-1]), offsets[i + 1]
        data = np.frombuffer(b"".join([*parts, raw[at:]]), np.uint8)
        offsets = np.concatenate(([0], np.cumsum(size)))
    low = WORD_BYTE[data]
    inner = low != 0
    start = inner.copy()
    start[1:] &= ~inner[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    start[edge] = inner[edge]
    at = np.flatnonzero(inner)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    begins = start[at]
    first = np.flatnonzero(begins)
    inside = np.arange(len(at)) - first[np.cumsum(begins) - 1]
    hashes = np.add.reduceat((low[at].astype(np.uint64) + np.uint64(1)) * powers(int(inside.max()))[inside], first)
    counts = np.bincount(np.searchsorted(offsets, at[first], side="right") - 1, minlength=n)
    return mixed(hashes + np.diff(np.append(first, len(at))).astype(np.uint64)), counts


class Rolled:
    """Rolling hashes of the windows of a batch of texts, text after text.

    `rec` and `h` are the text and the hash of every window, `place` its first word in the text;
    `words` counts the words of a text. A text's salt is hashed into its windows.
    """

    def __init__(self, hashes: np.ndarray, words: np.ndarray, salts: np.ndarray | None = None):
        self.words = words
        first = np.cumsum(words) - words
        salt = mixed((np.zeros(len(words), np.int64) if salts is None else salts).view(np.uint64))
        many = np.maximum(words - (WINDOW - 1), 0)
        self.rec = np.repeat(np.arange(len(words)), many)
        self.place = np.arange(len(self.rec)) - np.repeat(np.cumsum(many) - many, many)
        at = first[self.rec] + self.place
        h = salt[self.rec]
        for k in range(WINDOW):
            h = (h + hashes[at + k]) * MIX
            h ^= h >> np.uint64(29)
        self.h = mixed(h)
        #: Texts too short for a window: one chunk of all their words.
        self.short = np.flatnonzero((words > 0) & (many == 0))
        self.short_hash = salt[self.short] ^ mixed(np.array([sum((int(hashes[first[r] + k]) * (2 * k + 3)) for k in range(words[r])) & 0xFFFFFFFFFFFFFFFF for r in self.short], np.uint64))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rec, h, windows of the text, whether each original window is the only one of its kind in the text)."""
        order = by_record(self.rec, self.h)
        r, h = self.rec[order], self.h[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        single = new.copy()
        single[:-1] &= new[1:]
        once = np.empty(len(r), bool)
        once[order] = single
        return r[new], h[new], np.bincount(r[new], minlength=len(self.words)), once

    def chunks(self, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rec, digest, first window, windows) of chunks: one begins at every window whose hash is 0 modulo `chunk`."""
        at = np.flatnonzero((self.place == 0) | (self.h % np.uint64(chunk) == 0))
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), at, at
        size = np.diff(np.append(at, len(self.h)))
        inside = np.arange(len(self.h)) - np.repeat(at, size)
        digest = np.add.reduceat(self.h * powers(int(size.max()))[inside], at)
        return self.rec[at], mixed(digest + size.astype(np.uint64)), at, size


def by_record(rec: np.ndarray, h: np.ndarray, level: np.ndarray | None = None) -> np.ndarray:
    """Order by record, then `level` (0 to 255), then hash; records of a batch are fewer than 2^24.

    One sort of a packed key; hashes of one record that agree in the key's 32 to 40 bits follow by
    an exact sort where there are any.
    """
    bits = np.uint64(40 if level is None else 32)
    key = rec.astype(np.uint64) << np.uint64(40)
    if level is not None:
        key |= level.astype(np.uint64) << np.uint64(32)
    key |= h >> (np.uint64(64) - bits)
    order = np.argsort(key)
    sorted_key = key[order]
    if (tied := sorted_key[1:] == sorted_key[:-1]).any():
        again = np.zeros(len(key), bool)
        again[1:] |= tied
        again[:-1] |= tied
        part = np.flatnonzero(again)
        own = order[part]
        order[part] = own[np.lexsort((h[own], key[own]))]
    return order
