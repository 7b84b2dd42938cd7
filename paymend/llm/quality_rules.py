"""Quality rules: counted rules, and zstandard compression bands.

Prose compresses by a factor that depends on its length and script and little else. A text is
rejected when the ratio of the whole, or of too many of its chunks, leaves the limits for its
length: above them the text repeats itself, below them it is noise. The limits are fences around
the middle half of the ratios of all given documents, per script and half octave of length; wide
fixed bands bound them, and alone hold where too few documents tell. One pass gathers them: a
hash and a cell per distinct text and chunk is shuffled, a few rows reach the driver. The second
pass works in the task that reads the rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from paymend.llm.batches import emit, map_chunks, raw

#: Longest text in bytes, smallest and largest accepted ratio (bytes before / after). Fixed limits for
#: zstandard level 3: wide of what prose reaches, so that only repetition or noise is outside.
BANDS = (
    (256, 0.70, 2.6),
    (512, 0.90, 3.2),
    (1024, 1.05, 3.8),
    (4096, 1.15, 4.5),
    (16384, 1.25, 5.5),
    (65536, 1.30, 6.5),
    (None, 1.35, 8.0),
)
#: Bytes of a chunk, its limits, and the share of chunks that may be outside them.
CHUNK, CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 2048, 1.10, 5.0, 0.25
#: Fences lie so many interquartile ranges outside the quartiles (of normal data one in some 3,000 is beyond); the least range counted, as a share of the median; pieces a cell must hold.
FENCE, LEAST_RANGE, LEAST_PIECES = 2.0, 0.02, 64
#: Shortest piece in bytes that is gathered, cells per octave of length, and steps of a ratio of 1.
LEAST_BYTES, PER_OCTAVE, STEPS = 256, 2, 200
#: Bytes per code point that part scripts: Latin, with many marks, two bytes, three bytes.
SCRIPTS = (1.15, 1.5, 2.2)
MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, odd_chunks double, base_failed boolean, kept boolean"
_OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("ratio", pa.float64()), ("odd_chunks", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window that occurs twice or more, its first place included."""
    seen: dict[tuple, int] = {}
    marks = None
    for i, gram in enumerate(zip(*(words[k:] for k in range(window)))):
        first = seen.setdefault(gram, i)
        if first != i:
            if marks is None:
                marks = np.zeros(len(words), bool)
            marks[first : first + window] = True
            marks[i : i + window] = True
    return 0 if marks is None else int(marks.sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, repeated words)."""
    words = text.split()
    # Continuation bytes are the only ones that start no code point.
    joined = np.frombuffer(b"".join(words), np.uint8)
    seen, repeats = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            repeats += line in seen
            seen.add(line)
    return len(words), int(((joined & 0xC0) != 0x80).sum()), len(_SYMBOLS.findall(text)), repeats, repeated_words(words)


def ratio(packer: zstandard.ZstdCompressor, data: bytes) -> float:
    return len(data) / len(packer.compress(data)) if data else 1.0


def pieces(text: bytes) -> list[bytes]:
    """The chunks of a text that is longer than one; the last one ends with the text and may overlap the one before."""
    if len(text) <= CHUNK:
        return []
    return [text[i : i + CHUNK] for i in (*range(0, len(text) - CHUNK, CHUNK), len(text) - CHUNK)]


def cell(data: bytes) -> tuple[int, float]:
    """(script, place on the scale of lengths) of a piece."""
    points = int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum())
    return int(np.searchsorted(SCRIPTS, len(data) / max(points, 1))), PER_OCTAVE * float(np.log2(len(data)))


#: Per script: the cells that have limits, their middles, lower and upper limits.
Limits = dict[int, tuple[frozenset[int], np.ndarray, np.ndarray, np.ndarray]]


def limits_of(docs: DataFrame) -> Limits:
    """Fences of the ratios of all distinct texts and chunks of ``docs``. Copies count once."""
    schema = pa.schema([("script", pa.int32()), ("size", pa.int32()), ("step", pa.int32()), ("id", pa.int64())])

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        packer, rows = _packer(), set()
        for text in raw(batch):
            for data in (text, *pieces(text)) if text and len(text) >= LEAST_BYTES else ():
                script, size = cell(data)
                step = min(int(ratio(packer, data) * STEPS), int(BANDS[-1][2] * STEPS))
                rows.add((script, int(size), step, int(np.int64(np.uint64(xxhash.xxh64_intdigest(data))))))
        return emit(schema, **dict(zip(schema.names, zip(*rows) if rows else [[]] * 4)))

    found = map_chunks(docs.select("text"), gather, "script int, size int, step int, id long").distinct()
    steps = found.groupBy("script", "size", "step").agg(F.count("*").alias("n"))
    quartiles = steps.groupBy("script", "size").agg(F.sum("n").alias("n"), F.expr("percentile(step, array(0.25, 0.5, 0.75), n)").alias("q"))
    limits: Limits = {}
    cells = sorted((r.script, r.size, *((q + 0.5) / STEPS for q in r.q)) for r in quartiles.where(F.col("n") >= LEAST_PIECES).collect())
    for script in {c[0] for c in cells}:
        _, size, low, middle, high = np.array([c for c in cells if c[0] == script]).T
        wide = FENCE * np.maximum(high - low, LEAST_RANGE * middle)
        limits[script] = frozenset(map(int, size)), size + 0.5, low - wide, high + wide
    return limits


def fits(data: bytes, r: float, low: float, high: float, limits: Limits) -> bool:
    """Whether a ratio is within the fixed limits, and within the fences if there are any for this length."""
    if not low <= r <= high or len(data) < LEAST_BYTES or not limits:
        return low <= r <= high
    script, size = cell(data)
    sizes, at, lows, highs = limits.get(script, (frozenset(), *[np.zeros(0)] * 3))
    return int(size) not in sizes or bool(np.interp(size, at, lows) <= r <= np.interp(size, at, highs))


def compression(packer: zstandard.ZstdCompressor, text: bytes, limits: Limits) -> tuple[float, float, bool]:
    """(ratio of the whole, share of chunks outside the limits, in the band)."""
    whole = ratio(packer, text)
    low, high = next((a, b) for most, a, b in BANDS if most is None or len(text) <= most)
    parts = pieces(text)
    odd = sum(not fits(p, ratio(packer, p), CHUNK_LOW, CHUNK_HIGH, limits) for p in parts) / len(parts) if parts else 0.0
    return whole, odd, fits(text, whole, low, high, limits) and odd <= CHUNK_SHARE


def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)


def judge(batch: pa.RecordBatch, limits: Limits) -> dict[str, list]:
    packer = _packer()
    rows = {f: [] for f in _OUT.names[1:]}
    for text in raw(batch):
        text = text or b""
        n, chars, symbols, lines, repeats = counts(text)
        whole, odd, inside = compression(packer, text, limits)
        failed = n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n
        for name, value in zip(rows, (n, chars, symbols, lines, repeats, whole, odd, failed, not failed and inside)):
            rows[name].append(value)
    return rows


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, compression figures, ``base_failed`` and ``kept``.

    Null and empty texts count as no words: base_failed, not kept, ratio 1. Rows that repeat
    get equal rows; a null doc_id is carried along. Other columns are ignored.
    """
    limits = limits_of(docs)
    return map_chunks(docs.select("doc_id", "text"), lambda b: emit(_OUT, doc_id=b.column("doc_id"), **judge(b, limits)), _SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept."""
    limits = limits_of(docs)
    return map_chunks(docs, lambda b: b.filter(pa.array(judge(b, limits)["kept"], pa.bool_())), docs.schema)
