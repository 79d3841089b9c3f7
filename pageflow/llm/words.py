"""Word and shingle hashes of texts in UTF-8, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SLICE = 1 << 22
SPACES = b" \t\n\x0b\x0c\r"
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of the splitmix64 generator: spreads every bit over the word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


def word_slices(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time, cut at white space."""
    at = 0
    while len(raw) - at > SLICE:
        end = max(raw.rfind(s, at, at + SLICE) for s in (b" ", b"\n"))
        if end <= at:
            ends = [e for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (e := raw.find(s, at + SLICE)) >= 0]
            end = min(ends, default=len(raw))
        yield raw[at:end].split()
        at = end
    yield raw[at:].split()


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws)) for ws in word_slices(raw)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words, in order; of the whole where there are fewer."""
    if not len(words):
        return words
    n = min(n, len(words))
    count = len(words) - n + 1
    with np.errstate(over="ignore"):
        out = np.full(count, n, np.uint64) * _A
        for k in range(n):
            out = mix(out * _C + words[k : k + count] + _A)
    return out


def shingles(raw: bytes, n: int) -> np.ndarray:
    """The sorted distinct ``n``-word shingles of a text with A-Z in lower case."""
    return np.unique(gram_hashes(word_hashes(raw.lower()), n))
