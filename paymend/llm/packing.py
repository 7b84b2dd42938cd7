"""Best-fit packing by linear grouping.

Lengths are whole numbers up to the capacity, so how many pieces have each length says all
that a packing needs. That histogram - at most ``capacity`` rows, whatever the corpus - is
packed on the driver: large lengths are cut into groups of equal cardinality and rounded up to
the group's largest; sequences with few distinct sizes are filled as full as they go, largest
size first; the rounded sizes are put back to the true lengths; small lengths go where they
fit best. The plan is a table of runs (so many pieces of one length into consecutive
sequences), which tasks look up by a piece's number among the pieces of its length.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from paymend.llm.batches import chunks, emit, mix
from paymend.sources.scratch import materialise

CAPACITY, END_ID = 4096, 1
#: Lengths up to a capacity's sixteenth are small. Groups of large lengths.
SMALL_SHARE, GROUPS = 16, 160
#: Pieces numbered by one window group, places for words in a worker's memory (a power of two), and bytes of text tokenized at once.
BLOCK, WORDS, TEXT_BYTES = 500, 1 << 19, 250_000
#: Words are remembered up to so many times eight bytes, and so many ids. Words looked up at once, also of one long text.
LANES, WORD_IDS, STRETCH = 3, 8, 50_000
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
#: What the tokenizer's pattern makes of a Latin-1 character: 0 white space, 1 letter, 2 digit (each its own), 3 other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(9, 14), 32, 0x85, 0xA0]] = 0
_CLASS[[*range(65, 91), *range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = 1
_CLASS[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = 2
#: The first bytes of eight, and odd numbers that a place is worked out with.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], "<u8")
_SPREAD = mix(np.arange(LANES + 1)) | np.uint64(1)
#: Which of a place's ids count, by their number.
_UPTO = np.arange(WORD_IDS) < np.arange(WORD_IDS + 1)[:, None]
_LOWER = np.array([ord(chr(i).lower()) for i in range(256)], np.uint8)


class WordTokens:
    """Ids of texts, equal to the tokenizer's own. The tokenizer works pre-tokens out; a worker remembers them.

    The memory has ``WORDS`` places. A pre-token's bytes say its place, and are kept and compared there whole.
    A new one takes the place of one that has not come again since. Longer ones, or of many ids, are worked out in each chunk.
    Text beyond Latin-1, or with apostrophes (contractions) or special tokens, goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For lower-case Latin-1 pre-tokens the normaliser changes nothing and white space is the only border left.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # At each place: bytes of a pre-token and their number, its ids, their number, and whether it came again.
        self.known = np.zeros((WORDS, LANES + 1), "<u8")
        self.ids = np.zeros((WORDS, WORD_IDS), "<u4")
        self.sizes = np.zeros(WORDS, np.uint8)
        self.again = np.zeros(WORDS, bool)

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, number of ids of each). ``data`` goes on for ``8 * LANES`` bytes after the last."""
        length = stops - starts
        short = length <= 8 * LANES
        keys = np.empty((len(starts), LANES + 1), "<u8")
        eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        for lane in range(LANES):
            keys[:, lane] = eights[starts + 8 * lane] & _KEEP[np.clip(length - 8 * lane, 0, 8)]
        keys[:, LANES] = length
        places = (mix(keys @ _SPREAD) & np.uint64(WORDS - 1)).astype(np.int64)
        equal = self.known.take(places, 0) == keys
        hit = short
        for lane in range(LANES + 1):
            hit = hit & equal[:, lane]
        sizes = self.sizes.take(places).astype(np.int64)
        self.again[places[hit]] = True
        of_hits = np.compress(_UPTO.take(sizes[hit], 0).ravel(), self.ids.take(places[hit], 0))
        if hit.all():
            return of_hits, sizes
        miss = np.flatnonzero(~hit)
        joined = data[starts[0] : stops[-1]].tobytes()
        words = [joined[a:b] for a, b in zip((starts[miss] - starts[0]).tolist(), (stops[miss] - starts[0]).tolist())]
        fresh = self._learn(list(dict.fromkeys(words)))
        found = [fresh[w] for w in words]
        sizes[miss] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        self._keep(keys[miss], places[miss], sizes[miss], flat, short[miss])
        of_hit = np.repeat(hit, sizes)
        out = np.empty(len(of_hit), "<u4")
        out[of_hit], out[~of_hit] = of_hits, flat
        return out, sizes

    def _keep(self, keys: np.ndarray, places: np.ndarray, sizes: np.ndarray, flat: np.ndarray, short: np.ndarray) -> None:
        fits = np.flatnonzero(short & (sizes <= WORD_IDS))
        places, first = np.unique(places[fits], return_index=True)  # one word a place
        free = ~self.again[places]
        self.again[places] = False
        places, rows = places[free], fits[first][free]
        inside = _UPTO[sizes[rows]]
        taken = ((np.cumsum(sizes) - sizes)[rows, None] + np.arange(WORD_IDS))[inside]
        ids = np.zeros(inside.shape, "<u4")
        ids[inside] = flat[taken]
        self.known[places], self.ids[places], self.sizes[places] = keys[rows], ids, sizes[rows]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        lists = [words[i : i + 50] for i in range(0, len(words), 50)]
        joined = [b" ".join(part).decode("latin-1") for part in lists]
        for part, one in zip(lists, self.bare.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(one.ids, "<u4")
            stops = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(stops) == len(part):
                ids = ids.tobytes()
                out.update((w, ids[a:b]) for w, a, b in zip(part, [0, *stops], stops))
            else:  # a character the white-space border does not see as it is here
                out.update((w, self.direct(w.decode("latin-1"))) for w in part)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, places = [], []
        for i, text in enumerate(texts):
            try:
                data = (text or "").encode("latin-1")
            except UnicodeEncodeError:
                data = None
            if data is None or b"'" in data or b"<|" in data:
                out[i] = self.direct(text)
            elif data:
                plain.append(data)
                places.append(i)
        if not plain:
            return out
        # A blank after each text keeps pre-tokens inside it.
        data = _LOWER[np.frombuffer(b" ".join([*plain, b" " * 8 * LANES]), np.uint8)]
        ends = np.cumsum([len(p) + 1 for p in plain])
        kind = _CLASS[data]
        border = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)])
        starts = np.flatnonzero(border)
        stops = np.append(starts[1:], len(data))
        solid = kind[starts] > 0
        starts, stops = starts[solid], stops[solid]
        parts = [self.words(data, starts[i : i + STRETCH], stops[i : i + STRETCH]) for i in range(0, len(starts), STRETCH)]
        tokens, count = (np.concatenate(p) for p in zip(*parts or [(np.empty(0, "<u4"), np.empty(0, np.int64))]))
        cuts = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, ends)]
        for place, a, b in zip(places, [0, *cuts.tolist()], cuts.tolist()):
            out[place] = tokens[a:b].tobytes()
        return out


_TOKENS: dict[str, WordTokens] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): the tokens of each document and an end token, cut at ``capacity``.

    Only longer documents are cut. A null or empty text is one piece with the end token only.
    ``ids`` are unsigned 32-bit little-endian numbers.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TOKENS:
            _TOKENS[tokenizer] = WordTokens(tokenizer)
        for batch in chunks(batches, size=TEXT_BYTES):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), _TOKENS[tokenizer].encode(batch.column("text").to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, part))
            yield emit(_PIECE, **dict(zip(_PIECE.names, zip(*rows))))

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


@dataclass
class Bins:
    """Sequences ``first`` .. ``first + count - 1``, each filled up to ``used``."""

    first: int
    count: int
    used: int


def _fill(sizes: list[int], left: list[int], room: int) -> list[int]:
    """Which sizes (places, with repeats) fill ``room`` best, each used as often as it is left."""
    came = np.full(room + 1, -1)
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    for place, size in enumerate(sizes):
        if size > room:
            continue
        for _ in range(min(left[place], room // size)):
            new = np.flatnonzero(reach[:-size]) + size
            new = new[~reach[new]]
            if not len(new):
                break
            reach[new] = True
            came[new] = place
        if reach[room]:
            break
    out, at = [], int(np.flatnonzero(reach)[-1])
    while at:
        out.append(int(came[at]))
        at -= sizes[came[at]]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, from, number, sequence, per sequence, offset).

    Pieces ``from`` .. ``from + number - 1`` of a length go into consecutive sequences starting
    at ``sequence``, ``per sequence`` at a time, the first of them at ``offset``.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    given = dict.fromkeys(histogram, 0)
    large = sorted((n for n in histogram if n > capacity // SMALL_SHARE and histogram[n]), reverse=True)
    # Linear grouping: equal shares of all large pieces, each with the lengths it is made of.
    share = max(1, -(-sum(histogram[n] for n in large) // groups))
    stock: list[list[list[int]]] = []
    room = 0
    for n in large:
        rest = histogram[n]
        while rest:
            if not room:
                stock.append([])
                room = share
            take = min(rest, room)
            stock[-1].append([n, take])
            rest -= take
            room -= take
    sizes = [g[0][0] for g in stock]  # rounded up
    left = [sum(c for _, c in g) for g in stock]
    bins: list[Bins] = []
    total = 0
    for place, size in enumerate(sizes):
        while left[place]:
            left[place] -= 1
            pattern = [place, *_fill(sizes, left, capacity - size)]
            left[place] += 1
            need = {p: pattern.count(p) for p in pattern}
            times = min(left[p] // k for p, k in need.items())
            for p, k in need.items():
                left[p] -= k * times
            # Actual lengths take the places; a stretch of sequences is split where a length ends.
            stretch = [Bins(total, times, 0)]
            for p in pattern:
                out: list[Bins] = []
                for part in stretch:
                    while part.count:
                        length, have = stock[p][0]
                        n = min(have, part.count)
                        runs.append((length, given[length], n, part.first, 1, part.used))
                        given[length] += n
                        stock[p][0][1] -= n
                        if not stock[p][0][1]:
                            stock[p].pop(0)
                        out.append(Bins(part.first, n, part.used + length))
                        part = Bins(part.first + n, part.count - n, part.used)
                stretch = out
            bins += stretch
            total += times
    # Small lengths, longest first, into the fullest sequences that still take them.
    by_room: dict[int, list[Bins]] = {}
    for b in bins:
        by_room.setdefault(capacity - b.used, []).append(b)
    for n in sorted((n for n in histogram if n <= capacity // SMALL_SHARE and histogram[n]), reverse=True):
        rest = histogram[n]
        for space in sorted(r for r in by_room if r >= n):
            per = space // n
            while rest and by_room.get(space):
                b = by_room[space].pop()
                whole = min(b.count, rest // per)
                for count, k in ((whole, per), (1 if whole < b.count and rest - whole * per else 0, rest - whole * per)):
                    if count and k:
                        runs.append((n, given[n], count * k, b.first, k, b.used))
                        given[n] += count * k
                        rest -= count * k
                        by_room.setdefault(space - k * n, []).append(Bins(b.first, count, b.used + k * n))
                        b = Bins(b.first + count, b.count - count, b.used)
                if b.count:
                    by_room[space].append(b)
            if not rest:
                break
        while rest:
            per = capacity // n
            count, k = (rest // per, per) if rest >= per else (1, rest)
            runs.append((n, given[n], count * k, total, k, 0))
            by_room.setdefault(capacity - k * n, []).append(Bins(total, count, k * n))
            given[n] += count * k
            rest -= count * k
            total += count
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, length, ...) rows.

    Sequences are gapless from offset 0. Pieces are numbered within their length in blocks of
    some ``BLOCK`` rows, so a length that a third of all rows have is no larger group than others.
    Rows that repeat are packed each time. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = sorted(plan(histogram, capacity))
    parts = spark.createDataFrame([(n, max(1, c // BLOCK)) for n, c in histogram.items()], "length long, parts long")
    rows = pieces.join(F.broadcast(parts), "length")  # one row a length
    # The stored table is read back as it is, so a row keeps its block in every read.
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), "parts")).drop("parts")
    counts = rows.groupBy("length", "block").count()
    coarse = counts.withColumn("far", F.floor(F.col("block") / 1000))
    far = coarse.groupBy("length", "far").agg(F.sum("count").alias("n"))
    outer = Window.partitionBy("length").orderBy("far").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("length", "far").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = far.select("length", "far", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("a"))
    near = coarse.withColumn("b", F.coalesce(F.sum("count").over(inner), F.lit(0))).join(far, ["length", "far"])
    base = near.select("length", "block", (F.col("a") + F.col("b")).alias("base"))
    number = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece"))
    ranked = rows.withColumn("number", number - 1).join(base, ["length", "block"])
    ranked = ranked.withColumn("number", F.col("number") + F.col("base")).drop("base", "block")
    table = np.array(runs, np.int64).reshape(-1, 6)
    # Runs are found by (length, number) as one key; both orders agree as runs are sorted.
    step = max(1, max(histogram.values(), default=1) + 1)
    keys = table[:, 0] * step + table[:, 1]
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64())])
    names = [c for c in ranked.columns if c != "number"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = (np.asarray(batch.column(c)) for c in ("length", "number"))
            run = table[np.searchsorted(keys, length * step + at, side="right") - 1]
            inside = at - run[:, 1]
            new = emit(schema, sequence_id=run[:, 3] + inside // run[:, 4], offset=run[:, 5] + inside % run[:, 4] * length)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + new.columns, names=names + schema.names)

    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``docs``.

    The pieces' digests are derived where the ids are made; the ids themselves come from
    ``token_pieces``. Null and empty texts are one piece of one token; null doc_ids are carried.
    """
    pieces = token_pieces(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(materialise(pieces, "pieces"), capacity)
