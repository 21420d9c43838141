"""The lexical-v1 router on bytes: which pack a byte belongs to, and where spans begin."""

from __future__ import annotations

import numpy as np

from mergeloom.artifact import NUMBER, STRUCTURE, TEXT

#: Pack of every byte. Bytes from 0x80 on belong to non-ASCII characters, which are TEXT as a whole.
PACK_OF_BYTE = np.full(256, STRUCTURE, np.int32)
PACK_OF_BYTE[[b for b in range(256) if b >= 0x80 or chr(b).isalpha()]] = TEXT
PACK_OF_BYTE[[b for b in range(0x80) if chr(b).isdigit()]] = NUMBER


def span_borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pack of every byte, and a mask of the bytes that begin a span; texts begin at `offsets`."""
    packs = PACK_OF_BYTE[data]
    border = np.zeros(len(data), bool)
    if len(data):
        border[0] = True
        border[1:] = packs[1:] != packs[:-1]
        border[offsets[(offsets >= 0) & (offsets < len(data))]] = True
    return packs, border


def whole_text(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A router with one span a text, in the pack TEXT."""
    border = np.zeros(len(data), bool)
    border[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.full(len(data), TEXT), border
