"""Normal forms of texts, shared by the operators of this package."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_BROKEN = re.compile(r"(?<=\w)[-‐]\s*\n\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_ASCII_KEEP = {c: None for c in range(128) if not chr(c).isalnum()}


def _folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text).casefold()
    return unicodedata.normalize("NFKC", text)


def squeezed(text: str | None) -> str:
    """Letters and digits only, in order, without case and typographic form."""
    if not text:
        return ""
    if text.isascii():
        return text.lower().translate(_ASCII_KEEP)
    return "".join(_WORD.findall(_folded(text)))


def words(text: str | None) -> list[str]:
    """Words without case and typographic form; invisible characters and hyphens at line
    ends do not part a word."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall((_BROKEN.sub("", text) if "-" in text else text).lower())
    return _WORD.findall(_folded(_BROKEN.sub("", text.translate(_INVISIBLE))))


class WordHasher:
    """64-bit hashes of words, the last ``limit`` distinct ones remembered."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.known = limit, {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[t] for t in tokens], dtype=np.uint64)
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for t in set(tokens).difference(known):
                known[t] = xxhash.xxh3_64_intdigest(t)
            return np.array([known[t] for t in tokens], dtype=np.uint64)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of a shorter text the one run that it is."""
    size = max(1, min(size, len(hashes)))
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        out = (out * _MIX) ^ (hashes[k : k + n] + np.uint64(k + 1))
        out ^= out >> np.uint64(29)
    return out


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def minhashes(flat: np.ndarray, starts: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """uint32 [count, texts] minimum hashes of the non-empty runs of ``flat`` that begin at ``starts``."""
    a, b = permutations(count, seed)
    out = np.empty((count, len(starts)), dtype=np.uint32)
    if not len(starts):
        return out
    mixed = flat ^ (flat >> np.uint64(31))
    for k in range(count):
        out[k] = np.minimum.reduceat(((mixed * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_keys(mins: np.ndarray, rows: int) -> np.ndarray:
    """int64 [bands, texts] from [bands * rows, texts] minimum hashes."""
    bands = mins.shape[0] // rows
    out = np.zeros((bands, mins.shape[1]), dtype=np.uint64)
    for r in range(rows):
        out = (out ^ mins[r : bands * rows : rows].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(32)
    out ^= (np.arange(bands, dtype=np.uint64)[:, None] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return out.view(np.int64)


def sketch_bits(mins: np.ndarray) -> np.ndarray:
    """uint64 [texts, len(mins) / 64]: the lowest bit of each minimum hash."""
    bits = (mins & np.uint32(1)).astype(np.uint8).T
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the items (with repeats) that two texts have in common, of the longer one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    values, inverse = np.unique(both, return_inverse=True)
    x = np.bincount(inverse[: len(a)], minlength=len(values))
    y = np.bincount(inverse[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum()) / max(len(a), len(b))


#: At least four fifths of the words in common, and of the neighbouring pairs of words so
#: many that no two texts reach it that share six tenths of their running text or less.
SAME_WORDS, SAME_ORDER = 0.8, 0.6


def same_up_to_edits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two texts, as hashes of their words in order, are the same up to small edits."""
    if len(a) < SAME_WORDS * len(b) or len(b) < SAME_WORDS * len(a) or overlap(a, b) < SAME_WORDS:
        return False
    return overlap(shingles(a, 2), shingles(b, 2)) >= SAME_ORDER
