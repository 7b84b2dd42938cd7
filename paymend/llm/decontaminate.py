"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A stretch of a document within ``e`` edits of an item of ``m`` characters keeps at least
``m - q + 1 - q * e`` of the item's q-grams, on diagonals at most ``e`` apart. Shared q-grams are
counted in overlapping bands of diagonals; only bands that reach the bound are aligned, all
candidates of a batch of documents at once. Long items are looked for as a whole and in
overlapping windows, so a document that quotes a part of one is found too. Documents are read
once per block of the benchmark and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paymend.llm.batches import emit, map_chunks

#: Characters (bytes of UTF-8) of a q-gram, edits allowed in a hundred characters, benchmark characters that are shipped at once.
Q, EDIT_PERCENT, BLOCK_CHARS = 8, 10, 2_000_000
#: Characters of a window of a long item, and from one window to the next: any 199 characters in a row hold a window.
WINDOW, STEP = 160, 40
#: Cells of the bands that are aligned at once, rows after which those beyond their budget are left.
CELLS, CHECK = 1 << 18, 16
#: Counters of shared q-grams per band of a text and an item; a prime, so that no common divisor joins bands.
SLOTS = 4_194_301
_SPREAD = 1_000_003
_UNIT = 1 << 40
_BANDS = 1 << 32
_CLEAN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("item_chars", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("item_start", pa.int64())])


def normal(text: str | None) -> bytes:
    """Lower case, everything in ASCII but letters and digits a blank, single blanks."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split())


def budget(m: int) -> int:
    """Edits allowed for an item of ``m`` characters: so many that at least one q-gram must survive."""
    return max(0, min(m * EDIT_PERCENT // 100, (m - Q) // Q))


def qgrams(data: bytes) -> np.ndarray:
    """The eight bytes from each place as a number."""
    n = len(data) - Q + 1
    out = np.empty(max(0, n), np.uint64)
    for i in range(min(Q, max(0, n))):
        part = np.frombuffer(data, "<u8", (len(data) - i) // Q, i)
        out[i::Q] = part[: len(out[i::Q])]
    return out


@dataclass
class Index:
    """q-grams of a block of items, sorted, with a bit table before the binary search.

    What is looked for are parts: of every item the whole, then the windows of a long one.
    """

    ids: list[int | None]
    items: list[bytes]
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray
    #: Per item its first part; per part its item, its place there and its length.
    first: np.ndarray
    owner: np.ndarray
    begin: np.ndarray
    length: np.ndarray

    def part(self, number: int) -> bytes:
        begin = int(self.begin[number])
        return self.items[self.owner[number]][begin : begin + int(self.length[number])]

    @property
    def shift(self) -> np.uint64:
        return np.uint64(64 - int(np.log2(len(self.bits))))


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def build(rows: Iterable[tuple[int | None, str | None]]) -> Index:
    """Items without a letter or digit are left out: there is nothing to find."""
    pairs = [(i, t) for i, t in ((i, normal(t)) for i, t in rows) if t]
    grams = [qgrams(t) for _, t in pairs]
    keys = np.concatenate([np.empty(0, np.uint64), *grams])
    item = np.repeat(np.arange(len(pairs)), [len(g) for g in grams]).astype(np.int32)
    place = np.concatenate([np.empty(0, int), *(np.arange(len(g)) for g in grams)]).astype(np.int32)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    distinct = int((keys[1:] != keys[:-1]).sum()) + 1
    bits = np.zeros(1 << max(10, (distinct * 16).bit_length()), bool)
    parts = [[(0, len(t)), *((k, WINDOW) for k in range(0, len(t) - WINDOW, STEP)), *([(len(t) - WINDOW, WINDOW)] if len(t) > WINDOW else [])] for _, t in pairs]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    begin, length = np.array([x for p in parts for x in p], np.int64).reshape(-1, 2).T
    out = Index([i for i, _ in pairs], [t for _, t in pairs], keys, item[order], place[order], bits, np.cumsum(counts) - counts, np.repeat(np.arange(len(parts)), counts), begin, length)
    bits[(out.keys * _FACTOR) >> out.shift] = True
    return out


def align(parts: np.ndarray, texts: np.ndarray, low: np.ndarray, sizes: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, stop) per candidate of the best stretch on diagonals ``low`` .. ``low + width - 1``: free ends, unit costs.

    A row of ``parts`` is what is looked for, a row of ``texts`` the text from place ``low`` on, ``sizes``
    the whole text's length. Ties go to the earliest start. Candidates that cannot stay within
    ``most`` edits are left on the way and have more than that. One vector operation handles a row of all bands.
    """
    n, m = parts.shape
    far = np.int64(_UNIT) << 20
    out = np.full(n, far), np.zeros(n, np.int64)
    alive = np.arange(n)
    climb = np.arange(width, dtype=np.int64) * _UNIT
    where = low[:, None] + np.arange(width)
    row = np.where((where >= 0) & (where <= sizes[:, None]), np.clip(where, 0, None), far)
    for i in range(1, m + 1):
        cost = row + np.where(texts[:, i - 1 : i - 1 + width] == parts[:, i - 1 : i], 0, _UNIT)
        np.minimum(cost[:, :-1], row[:, 1:] + _UNIT, out=cost[:, :-1])
        at = where + i
        cost[(at < 0) | (at > sizes[:, None])] = far
        row = np.minimum.accumulate(cost - climb, axis=1) + climb
        if i % CHECK == 0:
            good = (row.min(axis=1) >> 40) <= most
            if not good.all():
                alive, row, where, parts, texts, sizes = (x[good] for x in (alive, row, where, parts, texts, sizes))
                if not len(alive):
                    break
    if len(alive):
        k = row.argmin(axis=1)
        out[0][alive], out[1][alive] = row[np.arange(len(alive)), k], where[np.arange(len(alive)), k] + m
    return out[0] >> 40, out[0] & (_UNIT - 1), out[1]


def _align_all(index: Index, data: np.ndarray, heads: np.ndarray, sizes: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Edits, start and stop of each (text, part, lowest diagonal) row of ``found``, in batches of parts of one length."""
    out = np.empty((len(found), 3), np.int64)
    items = np.frombuffer(b"".join(index.items), np.uint8)
    places = np.cumsum([0, *map(len, index.items)])
    lengths = index.length[found[:, 1]]
    for m in np.unique(lengths).tolist():
        e = budget(m)
        width = 4 * e + 3
        rows = np.flatnonzero(lengths == m)
        step = max(1, CELLS // (m + width))
        for k in range(0, len(rows), step):
            own = rows[k : k + step]
            doc, part, low = found[own].T
            parts = items[(places[index.owner[part]] + index.begin[part])[:, None] + np.arange(m)]
            at = low[:, None] + np.arange(m + width - 1)
            texts = data[np.clip(heads[doc][:, None] + at, 0, len(data) - 1)]
            out[own] = np.stack(align(parts, texts, low, sizes[doc], width, e), axis=1)
    return out


def _parts_of(index: Index, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hit, part) of all parts that hold the q-gram at ``place`` of ``item``."""
    size = index.length[index.first[item]]
    regular = np.where(size > WINDOW, -(-(size - WINDOW) // STEP), 0)  # windows before the last one
    number = np.arange(len(item))
    hits, parts = [number], [index.first[item]]
    for back in range(-(-WINDOW // STEP)):
        k = place // STEP - back
        ok = (k >= 0) & (k < regular) & (place <= k * STEP + WINDOW - Q)
        hits.append(number[ok])
        parts.append((index.first[item] + 1 + k)[ok])
    ok = (size > WINDOW) & (place >= size - WINDOW)
    hits.append(number[ok])
    parts.append((index.first[item] + 1 + regular)[ok])
    return np.concatenate(hits), np.concatenate(parts)


def find(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, part, edits, start, stop): the best place of every part that a text holds within its budget."""
    clean = [normal(t) for t in texts]
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for item, number in zip(index.items, index.first.tolist()):
        if len(item) < Q:  # too short for a q-gram: whole words only
            for i, text in enumerate(clean):
                at = (b" " + text + b" ").find(b" " + item + b" ")
                if at >= 0:
                    out[i, number] = 0, at, at + len(item)
    data = b"\n".join(clean) + b"\n" * Q
    sizes = np.fromiter(map(len, clean), np.int64, len(clean))
    heads = np.cumsum([0, *(sizes + 1).tolist()])
    grams = qgrams(data)
    at = np.flatnonzero(index.bits[(grams * _FACTOR) >> index.shift]) if len(index.keys) else np.empty(0, int)
    left, right = (np.searchsorted(index.keys, grams[at], side=s) for s in ("left", "right"))
    hits = right - left
    at, left, hits = at[hits > 0], left[hits > 0], hits[hits > 0]
    if not len(at):
        return [(i, n, *v) for (i, n), v in sorted(out.items())]
    edits = np.fromiter(map(budget, index.length.tolist()), np.int64, len(index.length))
    bound = index.length - Q + 1 - Q * edits
    entry = np.repeat(left - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
    at = np.repeat(at, hits)
    doc = np.searchsorted(heads, at, side="right") - 1
    item, place = index.item[entry].astype(np.int64), index.place[entry].astype(np.int64)
    # What a text shares with an item in two neighbouring bands as wide as the whole item's bounds every part, and is
    # counted first. Bands that fall into one slot count together, which only lets more through.
    slot = ((doc * len(index.items) + item) * _SPREAD + (at - heads[doc] - place) // (edits[index.first[item]] + 1)) % SLOTS
    count = np.bincount(slot, minlength=SLOTS)
    keep = count[slot] + np.maximum(count[slot - 1], count[(slot + 1) % SLOTS]) >= np.minimum.reduceat(bound, index.first)[item]
    at, doc, item, place = at[keep], doc[keep], item[keep], place[keep]
    hit, part = _parts_of(index, item, place)
    at, doc, place = at[hit], doc[hit], place[hit] - index.begin[part]
    pairs, pair, count = np.unique(doc * len(bound) + part, return_inverse=True, return_counts=True)
    keep = count[pair] >= bound[part]
    at, doc, part, place, pair = at[keep], doc[keep], part[keep], place[keep], pair[keep]
    bound_of = bound[pairs % len(bound)]
    band = (at - heads[doc] - place) // (edits[part] + 1) + _BANDS
    # A hit counts for its band and the one before, which reaches a band's width further.
    key = pair * (2 * _BANDS) + band
    keys, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
    keys = keys[count >= bound_of[keys // (2 * _BANDS)]]
    # Where enough hits are, those of different places in the part are counted.
    near = [np.isin(k, keys) for k in (key, key - 1)]
    rows = np.stack([np.concatenate([key[near[0]], key[near[1]] - 1]), np.concatenate([place[near[0]], place[near[1]]])], 1)
    rows = rows[np.lexsort(rows.T[::-1])]
    rows = rows[np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]).any(axis=1)])]
    keys, count = np.unique(rows[:, 0], return_counts=True)
    keys = keys[count >= bound_of[keys // (2 * _BANDS)]]
    pair, band = pairs[keys // (2 * _BANDS)], keys % (2 * _BANDS) - _BANDS
    doc, part = pair // len(bound), pair % len(bound)
    low = band * (edits[part] + 1) - edits[part]
    high = low + 4 * edits[part] + 2
    unsure = []
    for number, (i, n, first, last) in enumerate(zip(doc.tolist(), part.tolist(), low.tolist(), high.tolist())):
        if (i, n) not in out:
            wanted = index.part(n)
            start = clean[i].find(wanted, max(0, first), max(0, last) + len(wanted))
            if start >= 0:
                out[i, n] = 0, start, start + len(wanted)
            else:
                unsure.append(number)
    found = np.stack([doc, part, low], axis=1)[[k for k in unsure if (int(doc[k]), int(part[k])) not in out]]
    best = _align_all(index, np.frombuffer(data, np.uint8), heads, sizes, found)
    for (i, n), got, most in zip(found[:, :2].tolist(), map(tuple, best.tolist()), edits[found[:, 1]].tolist()):
        if got[0] <= most and ((i, n) not in out or got < out[i, n]):
            out[i, n] = got
    return [(i, n, *v) for (i, n), v in sorted(out.items())]


def find_items(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, part, edits, start, stop) of every item that a text holds: as a whole if it does, else by
    the window with the fewest edits, the first of them."""
    best = {}
    for i, n, *place in find(index, texts):
        key = i, int(index.owner[n])
        rank = n != index.first[key[1]], place[0], n
        if key not in best or rank < best[key][0]:
            best[key] = rank, (*key, n, *place)
    return [row for _, row in best.values()]


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks of bounded size, in the order of its rows; each item is in one of them."""
    rows, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((row.item_id, row.text))
        size += len(row.text or "")
        if size >= BLOCK_CHARS:
            yield build(rows)
            rows, size = [], 0
    if rows:
        yield build(rows)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, edits, item_chars, start, stop, item_start.

    An item counts as held if some stretch of the normalised text is within a tenth of the
    item's length in edits, or of the length of a window of it (``WINDOW`` bytes, one every ``STEP``
    and one at the end); items under eight characters must stand as whole words. ``start``
    and ``stop`` are byte places in the normalised text, ``item_chars`` and ``item_start`` are
    length and place of what was found of the normalised item. Null and empty texts hold nothing,
    null and empty items are in nothing. Repeated documents and items give repeated rows.
    Other columns are ignored.
    """
    docs, context = docs.select("doc_id", "text"), docs.sparkSession.sparkContext
    schema = "doc_id long, item_id long, edits long, item_chars long, start long, stop long, item_start long"
    out = None
    for index in blocks(benchmark):
        shipped = context.broadcast(index)  # bounded by BLOCK_CHARS

        def work(batch: pa.RecordBatch, shipped=shipped) -> pa.RecordBatch:
            index, ids = shipped.value, batch.column("doc_id").to_pylist()
            found = find_items(index, batch.column("text").to_pylist())
            rows = [(ids[i], index.ids[k], e, int(index.length[n]), a, b, int(index.begin[n])) for i, k, n, e, a, b in found]
            return emit(_OUT, **dict(zip(_OUT.names, zip(*rows) if rows else [[]] * 7)))

        part = map_chunks(docs, work, schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item, nor a window of one."""
    context = docs.sparkSession.sparkContext
    for index in blocks(benchmark):
        shipped = context.broadcast(index)

        def work(batch: pa.RecordBatch, shipped=shipped) -> pa.RecordBatch:
            held = {row[0] for row in find(shipped.value, batch.column("text").to_pylist())}
            return batch.filter(pa.array([i not in held for i in range(batch.num_rows)], pa.bool_()))

        docs = map_chunks(docs, work, docs.schema)
    return docs
