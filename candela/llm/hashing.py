"""Hashes of words and of word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser of an array: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", BASE), ("down", _INVERSE)):
            steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def portions(texts: list[str], chars: int = 1_000_000) -> list[slice]:
    """Slices of the texts with about so many characters each, which bounds what hashing holds at once."""
    out, start, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            out.append(slice(start, k + 1))
            start, size = k + 1, 0
    return [*out, slice(start, len(texts))] if start < len(texts) else out


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (between ASCII white space; A-Z lower-cased on demand) of all texts in turn, and for each text the index of
    its first word, with the total at the end."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.concatenate([[True], blank[:-1]])
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(blank & ~before)
    up, down = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up, dtype=np.uint64)])
    raw = (sums[ends] - sums[starts]) * down[starts]
    words = mixed(raw + (ends - starts).astype(np.uint64) * BASE)
    text_starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]) if parts else np.zeros(1, np.int64)
    return words, np.searchsorted(starts, text_starts)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of k words inside a text, and for each text the index of its first one, with the total at the end. A text
    with fewer words, but not none, has one: its whole sequence."""
    n, total = np.diff(firsts), len(words)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_firsts = np.concatenate([[0], np.cumsum(counts)])
    if not total:
        return np.zeros(0, np.uint64), out_firsts
    scale = np.array([pow(int(BASE), 2 * j + 3, 1 << 64) for j in range(k)], dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(k - 1, np.uint64)])
    runs = np.zeros(total, np.uint64)
    for j in range(k):
        runs += padded[j : j + total] * scale[j]
    at = np.arange(out_firsts[-1]) - np.repeat(out_firsts[:-1], counts) + np.repeat(firsts[:-1], counts)
    out = runs[at]
    for t in np.flatnonzero((n > 0) & (n < k)):
        own = words[firsts[t] : firsts[t + 1]]
        out[out_firsts[t]] = (own * scale[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mixed(out), out_firsts
