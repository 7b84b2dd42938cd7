"""PartEnum signatures: sets of nearly equal size that differ little share one of them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np

from paymend.llm.batches import mix

#: (differences allowed inside a first-level part, sub-parts of it): subsets of the sub-parts but that many are enumerated.
#: A band of sizes takes the one with the fewest signatures.
SHAPES = ((1, 3), (1, 4), (2, 4))
#: Levels of signatures put in place of an empty subset before it is emitted plainly, and empty subsets that sets of an
#: instance have on average up to which that is done. With more, spared parts make it rare that one is emitted at all.
DEPTH, FEW = 3, 0.5
#: Chance that a set has more parts with an empty subset than an instance has spare parts.
RARE = 1e-4


@lru_cache(maxsize=16)
def subsets(slips: int, parts: int) -> np.ndarray:
    """The enumerated subsets of sub-parts."""
    return np.array(list(combinations(range(parts), parts - slips)))


@dataclass(frozen=True)
class Instance:
    """For sets of at most ``high`` elements, of which similar ones differ in ``k`` elements at most.

    ``n1`` first-level parts, of which a similar pair has at least 1 + ``spare`` with few differences.
    """

    number: int
    high: int
    k: int
    n1: int
    spare: int
    deeper: bool
    slips: int
    parts: int


def _instance(number: int, high: int, smallest: int, percent: int) -> Instance:
    k = 2 * high * (100 - percent) // (100 + percent)
    best = None
    for slips, parts in SHAPES:
        kinds = len(subsets(slips, parts))
        for spare in sorted({*range(17), *(int(1.25**i) for i in range(12, 90))}):
            n1 = k // (slips + 1) + 1 + spare
            count = n1 * kinds
            rate = count * math.exp(-smallest * (parts - slips) / (n1 * parts))
            more = spare + 1
            tail = 1.0 if more <= rate else math.exp(more - rate + more * math.log(rate / more)) if rate else 0.0
            cost = count * (1 + tail * max(1.0, rate))
            if best is None or cost < best[0]:
                best = cost, Instance(number, high, k, n1, spare, rate <= FEW, slips, parts)
            if tail < RARE or spare > k + 16:
                break
    return best[1]


@lru_cache(maxsize=16)
def bands(percent: int) -> tuple[Instance, ...]:
    """Size bands: similar sets are in the same or in neighbouring ones."""
    out, low, before = [], 1, 1
    while low < 1 << 31:
        high = 100 * low // percent
        out.append(_instance(len(out), high, before, percent))
        before, low = low, high + 1
    return tuple(out)


@lru_cache(maxsize=16)
def _tables(percent: int) -> tuple[np.ndarray, ...]:
    rows = bands(percent)
    return tuple(np.array([getattr(b, f) for b in rows], np.int64) for f in ("high", "k", "n1", "spare", "deeper", "slips", "parts"))


def signatures(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """64-bit signatures of each set; two sets with 100 * intersection >= percent * union share one.

    Sets that can only be similar to equal ones get none, nor does the empty set.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    high, k, *_ = _tables(percent)
    band = np.searchsorted(high, sizes)
    # A set signs for its own band, as the larger of a pair, and for the next, as the smaller.
    owner = np.repeat(np.arange(len(sets)), 2)
    number = np.stack([band, band + 1], axis=1).ravel()
    use = (sizes[owner] > 0) & (k[number] > 0)
    owner, number = owner[use], number[use]
    slips, parts = _tables(percent)[5:]
    pieces = []
    for form in SHAPES:
        here = np.flatnonzero((slips[number] == form[0]) & (parts[number] == form[1]))
        found, of = _level([sets[i] for i in owner[here]], number[here], np.zeros(len(here), np.uint64), percent, 0, form)
        pieces.append((found, owner[here][of]))
    found, of = map(np.concatenate, zip(*pieces))
    order = np.argsort(of, kind="stable")
    return np.split(found[order], np.searchsorted(of[order], np.arange(1, len(sets)))) if len(sets) else []


def _level(sets, number, tag, percent, depth, form):
    """Signatures of ``sets[i]`` under instance ``number[i]``, and the i of each."""
    if not len(sets):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    _, _, n1s, spares, deeper, *_ = _tables(percent)
    parts, chosen = form[1], subsets(*form)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    n1, values = n1s[number], np.concatenate(sets)
    cells = n1 * parts
    base = np.cumsum(cells) - cells
    seed = mix(number * 64 + depth + 1)
    place = mix(values ^ np.repeat(seed, sizes)) >> np.uint64(33)
    cell = (place % np.repeat(cells, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(base, sizes)
    body = mix(values ^ np.uint64(0xA0761D6478BD642F))
    width = int(cells.sum())
    # Sums of 32-bit halves are exact in doubles up to two million elements; larger sums round alike for equal parts.
    halves = (body & np.uint64(0xFFFFFFFF), body >> np.uint64(32))
    low, top = (np.bincount(cell, h.astype(float), width) for h in halves)
    count = np.bincount(cell, minlength=width)
    low, top, count = (x.reshape(-1, parts)[:, chosen].sum(axis=2) for x in (low, top, count))
    part_of = np.repeat(np.arange(len(sets)), n1)
    part_no = np.arange(len(part_of)) - np.repeat(base // parts, n1)
    where = mix((part_no[:, None] * len(chosen) + np.arange(len(chosen))).astype(np.uint64) ^ (seed ^ tag)[part_of][:, None])
    found = mix(mix(mix(low.astype(np.uint64)) + top.astype(np.uint64)) ^ where)
    of = np.repeat(part_of, len(chosen)).reshape(found.shape)
    empty = count == 0
    # A similar pair has 1 + spare parts with few differences. If a set has no more parts than that with an
    # empty subset, one of the shared parts shows filled ones, so its empty subsets need no signature.
    short = np.bincount(part_of, empty.any(axis=1), len(sets)) > spares[number]
    out, owners = [found[~empty]], [of[~empty]]
    left = empty & short[part_of][:, None]
    if left.any():
        tags, owner = found[left], of[left]
        # Sets that agree on an empty subset still agree on a signature of all their elements.
        few = deeper[number][owner].astype(bool) & (depth < DEPTH)
        out.append(tags[~few])
        owners.append(owner[~few])
        tags, owner = tags[few], owner[few]
        if len(tags):
            more, inner = _level([sets[i] for i in owner], number[owner], tags, percent, depth + 1, form)
            out.append(more)
            owners.append(owner[inner])
    return np.concatenate(out), np.concatenate(owners)
