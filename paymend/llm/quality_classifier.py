"""Quality classifier: regularised quadratic discriminant over document statistics.

Per class a mean and a covariance of transformed text statistics are gathered in one
distributed pass (sums and outer products, so no rows reach the driver). Covariances are
shrunk towards their diagonal and the pooled one; the score is the logistic of the difference
of log densities, worked out from Cholesky factors that are computed once.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paymend.llm.batches import chunks, emit, map_chunks
from paymend.sources.scratch import materialise

#: Weight of the pooled covariance, of the diagonal, smallest variance, and softening of the log-density difference.
POOLED, DIAGONAL, FLOOR, SOFT = 0.1, 0.1, 1e-3, 0.2
THRESHOLD = 0.7
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = frozenset("#*$%&|<>@^~_=+{}[]\\/")
NAMES = (
    "log_words", "log_mean_word", "log_spread_word", "log_lines", "log_words_per_line",
    "letters", "capitals", "digits", "marks", "stops",
    "exclaims", "bars", "upper_words", "capital_words",
    "marked_words", "distinct_words", "top_word", "same_as_before",
    "repeated_pairs", "distinct_lines", "short_lines",
    "open_lines", "log_words_per_sentence",
    "log_packed",
)
_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Code point -> letter 1, capital 2, digit 3, mark 4, other 0. Points past the table count as letters."""
    out = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        out[i] = 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c in _MARKS else 0
    out[-1] = 1
    return out


def _share(part: float, whole: float) -> float:
    """A share of a whole, stretched near zero and one."""
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """The features of a text, in the order of NAMES; all finite, also for null, empty and very long texts."""
    text = text or ""
    words = _WORD.findall(text)
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(NAMES)
    lengths = np.fromiter(map(len, words), float, n)
    most = max(Counter(words).values())
    lines = [x for x in text.split("\n") if not x.isspace() and x]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    _, small, upper, digits, marks = np.bincount(_kinds()[np.minimum(points, (1 << 16) - 1)], minlength=5).tolist()
    ends = text.count(".") + text.count("!") + text.count("?")
    return [
        math.log(n), math.log(lengths.mean()), math.log1p(lengths.std()), math.log(max(1, len(lines))), math.log(n / max(1, len(lines))),
        _share(small + upper, chars), _share(upper, chars), _share(digits, chars), _share(marks, chars), _share(text.count(".") + text.count(","), n),
        _share(text.count("!"), n), _share(text.count("|"), n), _share(sum(map(str.isupper, words)), n), _share(sum(w[0].isupper() for w in words), n),
        _share(sum(w[-1] in _MARKS for w in words), n), _share(len(set(words)), n), _share(most, n), _share(sum(map(operator.eq, words, words[1:])), n),
        _share(n - 1 - len(set(zip(words, words[1:]))), n), _share(len(set(lines)), len(lines)), _share(sum(len(x) < 20 for x in lines), len(lines)),
        _share(sum(x.rstrip()[-1] not in ".!?" for x in lines), len(lines)), math.log(n / max(1, ends)),
        math.log(len(text) / len(zlib.compress(text.encode("utf-8", "replace"), 1))),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
    work = lambda b: emit(schema, doc_id=b.column("doc_id"), x=[statistics(t) for t in b.column("text").to_pylist()])
    return map_chunks(docs.select("doc_id", "text"), work, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    """Per class: mean, inverse Cholesky factor and log of prior over root determinant. ``prior`` alone if a class is missing."""

    prior: float
    means: tuple
    factors: tuple
    offsets: tuple

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            z = (x - mean) @ factor.T
            logs.append(offset - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(-SOFT * (logs[1] - logs[0]), -500, 500)))


def _moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Class -> (rows, sum, sum of outer products); one row per task and class is shuffled to the driver's sum."""
    d = len(NAMES)
    schema = pa.schema([("quality", pa.int32()), ("k", pa.int32()), ("v", pa.float64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            label = np.asarray(batch.column("quality"))
            x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
            for c in (0, 1):
                own = np.hstack([np.ones((int((label == c).sum()), 1)), x[label == c]])
                if len(own):
                    sums[c] = sums.get(c, 0) + own.T @ own
        for c, m in sums.items():
            yield emit(schema, quality=[c] * m.size, k=range(m.size), v=m.ravel())

    total = rows.select(F.col("quality").cast("int").alias("quality"), "x").mapInArrow(part, "quality int, k int, v double")
    out: dict[int, np.ndarray] = {}
    for row in total.groupBy("quality", "k").agg(F.sum("v").alias("v")).collect():  # 2 x (features + 1)^2 rows
        out.setdefault(row.quality, np.zeros((d + 1) ** 2))[row.k] = row.v
    mats = {c: m.reshape(d + 1, d + 1) for c, m in out.items()}
    return {c: (m[0, 0], m[0, 1:], m[1:, 1:]) for c, m in mats.items()}


def fit(rows: DataFrame) -> Model:
    """Model from (quality, x). With one class only, its prior is the score; without any row, 0.5."""
    found = _moments(rows)
    total = sum(n for n, _, _ in found.values())
    if set(found) != {0, 1}:
        return Model(0.5 if not total else float(1 in found), (), (), ())
    covs = {c: s / n - np.outer(m / n, m / n) for c, (n, m, s) in found.items()}
    pooled = sum(found[c][0] * covs[c] for c in covs) / total
    means, factors, offsets = [], [], []
    for c in (0, 1):
        cov = (1 - POOLED) * covs[c] + POOLED * pooled
        cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(len(cov))
        root = np.linalg.cholesky(cov)
        means.append(found[c][1] / found[c][0])
        factors.append(np.linalg.inv(root))
        offsets.append(float(np.log(found[c][0] / total) - np.log(np.diag(root)).sum()))
    return Model(float(found[1][0] / total), tuple(means), tuple(factors), tuple(offsets))


def held_out(docs: DataFrame) -> DataFrame:
    """Adds ``held_out``: crc32 of the doc_id as text leaves 2 on division by 4. Null ids are not held out."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))


def train(table: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled rows of a feature table that are not held out. All of them are used.

    Labels with null doc_id or a quality other than 0 and 1 are left out. Repeated labels count each time.
    """
    known = labels.select(F.col("doc_id"), F.col("quality")).where("quality in (0, 1)")
    return fit(held_out(table).where("not held_out").join(known, "doc_id"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts are scored by their (zero) statistics. Repeated rows get equal scores.
    """
    table = materialise(features(docs), "features")
    model = train(table, labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(NAMES))
            yield emit(_OUT, doc_id=batch.column("doc_id"), score=model.score(x))

    out = held_out(table.mapInArrow(work, "doc_id long, score double"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with a score at or above the threshold."""
    model = train(materialise(features(docs), "features"), labels)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in batch.column("text").to_pylist()])
        return batch.filter(pa.array(model.score(x) >= THRESHOLD))

    return map_chunks(docs, work, docs.schema)
