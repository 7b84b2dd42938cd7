"""Word shingles of many texts at once, as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from paymend.llm.batches import mix

_STEP = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_LETTERS = mix(np.arange(256))
_LETTERS[65:91] = _LETTERS[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SKETCH = 256
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, modulo 2**64, kept for texts of the usual size."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 20)
        for name, base in (("up", _STEP), ("down", _BACK)):
            _POWERS[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]), dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text); words lie between ASCII white space."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(t for t in texts if t), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.cumsum(sizes)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = (ends - sizes)[sizes > 0]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return hash_runs(data, starts, stops), np.diff(np.searchsorted(starts, ends), prepend=0)


def hash_runs(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; A-Z hash as a-z."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up[: len(data)], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The distinct ``width``-word shingles of each text, A-Z lower-cased.

    Fewer words than ``width`` count as one shingle; no word or no text gives the empty set.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    whole = _joined(hashes, width)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        start = end - n
        if n >= width:
            values = np.sort(whole[start : end - width + 1])
            out.append(values[np.concatenate([[True], values[1:] != values[:-1]])])
        else:
            out.append(_joined(hashes[start:end], n) if n else np.empty(0, np.uint64))
    return out


def _joined(hashes: np.ndarray, width: int) -> np.ndarray:
    n = len(hashes) - width + 1
    if n < 1 or width < 1:
        return np.empty(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for i in range(width):  # order matters: each place is mixed before the next is added
        total = mix(total * _STEP + hashes[i : i + n])
    return total


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed longs."""
    if not len(values):
        return 0, 0
    a, b = mix(values), mix(values ^ np.uint64(0xD6E8FEB86659FD93))
    return int(a.sum().astype(np.int64)), int(b.sum().astype(np.int64))


def sketch(values: np.ndarray) -> bytes:
    """How many elements fall into each of SKETCH cells. Two sets differ in as many elements at least as their sketches do."""
    cells = (mix(values ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(SKETCH)).astype(np.int64)
    return np.minimum(np.bincount(cells, minlength=SKETCH), 255).astype(np.uint8).tobytes()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
