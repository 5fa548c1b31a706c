"""Hashed character n-grams of many texts at a time, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Buckets of the hashed n-grams; bucket 0 stands for no n-gram.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Characters that are worked on together.
BLOCK = 1_000_000


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Code point -> lower-case letter, or a space for all that is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            out[c] = ord(x.lower()[0])
    return out


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Blocks of (text number, piece): whole texts, or pieces of long ones that overlap by the n-grams' reach."""
    owner: list[int] = []
    block: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for a in range(0, max(len(text), 1), BLOCK):
            part = text[a : a + BLOCK + max(ORDERS) - 1]
            owner.append(i)
            block.append(part)
            size += len(part) + 3
            if size >= BLOCK:
                yield owner, block
                owner, block, size = [], [], 0
    if owner:
        yield owner, block


def indices(block: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket of the n-gram that begins at each character; the block's starts; letters in each piece.

    N-grams of two spaces or more, and those that run past their piece, are bucket 0.
    """
    reach = max(ORDERS)
    lengths = np.fromiter(map(len, block), np.int64, len(block))
    joined = ("\x00" * reach).join(block) + "\x00" * reach
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = letter_table()[codes]
    starts = np.zeros(len(block), np.int64)
    np.cumsum(lengths[:-1] + reach, out=starts[1:])
    letter = c != 32
    letters = np.add.reduceat(letter, starts, dtype=np.int64)
    inside = codes != 0
    out = []
    h = np.zeros(len(c), np.uint32)
    live = np.ones(len(c), bool)
    some = np.zeros(len(c), bool)
    for n in range(1, reach + 1):
        shifted = np.concatenate([c[n - 1 :], np.full(n - 1, 32, np.uint32)])
        there = np.concatenate([inside[n - 1 :], np.zeros(n - 1, bool)])
        h = (h ^ shifted) * np.uint32(0x9E3779B1)
        live &= there
        some |= shifted != 32
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)
            index = (mixed >> np.uint32(16)) % np.uint32(BUCKETS - 1) + np.uint32(1)
            out.append(np.where(live & some, index, 0).astype(np.int32))
    return out, starts, letters
