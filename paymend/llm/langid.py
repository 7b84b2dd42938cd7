"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent character n-grams over all training
texts; a document goes to the language whose profile is nearest by the out-of-place measure.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from paymend.llm.batches import chunks, emit, map_chunks

#: Longest n-gram (three code points of 21 bits fill a long), ranks of a profile, of a document, words held by a task.
LONGEST, PROFILE, RANKS, HELD = 3, 400, 300, 200_000
#: Distinct words whose n-grams are taken in one go.
JOINED = 20_000
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    return np.array([bool(_LETTERS.fullmatch(chr(i))) for i in range(1 << 16)])


def grams_of(text: str | None) -> np.ndarray:
    """Codes of all n-grams of the words of a text, each word between blanks."""
    return grams_by_word(text)[0]


def grams_by_word(text: str | None, numbered: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The codes of ``grams_of`` and, if ``numbered``, the number of the word each is from; words stand one blank apart then."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64) if numbered else None
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if points.max() < 1 << 16:
        points[~_letter_table()[points]] = 32
    else:
        points = np.frombuffer(f" {' '.join(words_of(text))} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    blank = points == 32
    out = [points[~blank]]
    word = np.cumsum(blank) - 1 if numbered else None
    words = [word[~blank]] if numbered else []
    for n in range(2, LONGEST + 1):
        count = len(points) - n + 1
        code, inner = points[:count], np.zeros(count, bool)
        for i in range(1, n):
            code = code << 21 | points[i : count + i]
            if i < n - 1:
                inner |= blank[i : count + i]
        # A blank is only an end of a word, so two in a row are nothing.
        good = ~(inner | (blank[:-1] & blank[1:] if n == 2 else False))
        out.append(code[good])
        if numbered:
            words.append(word[:count][good])
    return np.concatenate(out), np.concatenate(words) if numbered else None


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over ``text`` and ``lang``: tasks count words first, n-grams of distinct words next."""

    def flush(lang: str, words: Counter) -> pa.RecordBatch:
        distinct = list(words)
        codes, times = [], []
        for start in range(0, len(distinct), JOINED):
            part = distinct[start : start + JOINED]
            found, word = grams_by_word(" ".join(part), numbered=True)
            codes.append(found)
            times.append(np.fromiter((words[w] for w in part), np.int64, len(part))[word])
        gram, place = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(place, np.concatenate(times).astype(float)).astype(np.int64)
        return emit(_GRAMS, lang=[lang] * len(gram), gram=gram, n=n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in chunks(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > HELD:
                yield from (flush(lang, words) for lang, words in held.items() if words)
                held = {}
        yield from (flush(lang, words) for lang, words in held.items() if words)

    rows = docs.select("text", "lang").where("text is not null and lang is not null")
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language -> its ``size`` most frequent n-grams, most frequent first. Ties go to the smaller code.

    The first cut is made in slices of a language's n-grams, so no task ranks all of them.
    """
    order = (F.desc("n"), F.asc("gram"))
    sliced = gram_counts(docs).withColumn("slice", F.pmod(F.xxhash64("gram"), F.lit(64)))
    best = sliced.withColumn("r", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("r") <= size)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= size)
    out: dict[str, list] = {}
    for row in best.orderBy("lang", "r").select("lang", "gram").collect():  # languages x size rows
        out.setdefault(row.lang, []).append(row.gram)
    return {lang: np.array(grams, np.int64) for lang, grams in out.items()}


class Ranker:
    """Out-of-place distances of a document to all profiles."""

    def __init__(self, known: dict[str, np.ndarray]):
        self.langs = sorted(known)
        self.tables = []
        for lang in self.langs:
            order = np.argsort(known[lang], kind="stable")
            self.tables.append((known[lang][order], order))

    def distances(self, text: str | None) -> np.ndarray | None:
        """Mean rank difference to each profile as a share of the worst one; None for a text without letters."""
        codes = grams_of(text)
        if not len(codes):
            return None
        codes.sort()
        heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        counts = np.diff(heads, append=len(codes))
        ranked = codes[heads][np.argsort(-counts, kind="stable")[:RANKS]]
        places = np.arange(len(ranked))
        out = []
        for grams, ranks in self.tables:
            at = np.minimum(np.searchsorted(grams, ranked), len(grams) - 1)
            away = np.where(grams[at] == ranked, np.minimum(abs(ranks[at] - places), PROFILE), PROFILE)
            out.append(away.sum() / (PROFILE * len(ranked)))
        return np.array(out)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 0..1: how much nearer than the runner-up); ties go to the first by name."""
        d = self.distances(text) if self.langs else None
        if d is None:
            return UNKNOWN, 0.0
        best = int(np.argmin(d))
        rest = np.delete(d, best)
        lead = (rest.min() - d[best]) / rest.min() if len(rest) and rest.min() > 0 else 1.0 - d[best]
        return self.langs[best], float(min(1.0, max(0.0, lead)))


def held_out(docs: DataFrame) -> DataFrame:
    """Adds ``held_out``: crc32 of the doc_id as text leaves 1 on division by 3. Null ids are not held out."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))


def detect(docs: DataFrame, known: dict[str, np.ndarray]) -> DataFrame:
    """Prediction for every row of ``docs`` (doc_id, text, held_out)."""
    ranker = Ranker(known)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [ranker.predict(t) for t in batch.column("text").to_pylist()]
        return emit(_OUT, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang_pred=[a for a, _ in found], score=[b for _, b in found])

    return map_chunks(docs.select("doc_id", "text", "held_out"), work, "doc_id long, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; profiles come from the rows that are not held out.

    A text without a letter, a null text, or no training text at all gives ``und`` with score 0.
    Training rows with null text or lang are left out; repeated rows count each time.
    """
    marked = held_out(docs.select("doc_id", "text", "lang"))
    return detect(marked, profiles(marked.where("not held_out")))
