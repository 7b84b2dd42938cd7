"""URL filter: a sorted array of 64-bit rule digests, probed by binary search.

A rule is a host and a path prefix, ``example.net/en/``, with a verdict. The list becomes one
file in the shared folder: sorted xxhash keys, memory-mapped by the tasks, and the rule strings,
read only to confirm a hit, so equal digests of different rules never decide. Spark ships the file
once to every executor, also to one that joins later; tasks map it instead of loading it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from paymend.llm.batches import emit
from paymend.sources.scratch import scratch_dir

#: Largest index that is shipped. It bounds the disk, not the memory, of an executor.
INDEX_BYTES = 2_000_000_000
DEFAULT_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_OUT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path); both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = rest[:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    tail = rest[end:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return host, tail[:stop]


def write_index(rules: Iterable[tuple[str, str]], folder: str) -> str:
    """Write the digest array; the last verdict of a rule that is given twice counts. Returns the file's path.

    Layout: length of the head, head (JSON: counts and the lengths of path prefixes), sorted
    keys, places of the strings in order of their keys, strings.
    """
    table = {rule: verdict for rule, verdict in rules}
    rows = sorted((xxhash.xxh64_intdigest(r.encode()), r, v) for r, v in table.items())
    texts = [json.dumps([r, v]).encode() for _, r, v in rows]
    head = json.dumps({"n": len(rows), "prefixes": sorted({len(r) - r.find("/") for _, r, _ in rows if "/" in r})}).encode()
    body = b"".join(texts)
    size = 8 + len(head) + 16 * len(rows) + 8 + len(body)
    if size > INDEX_BYTES:
        raise ValueError(f"the rule index takes {size} bytes, more than {INDEX_BYTES}")
    files, base = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    name = f"rules-{uuid.uuid4().hex}.idx"
    with files.open_output_stream(f"{base}/{name}", compression=None) as f:
        head += b" " * (-len(head) % 8)  # keeps the arrays aligned
        f.write(len(head).to_bytes(8, "little") + head)
        f.write(np.array([k for k, _, _ in rows], "<u8").tobytes())
        f.write(np.cumsum([0, *map(len, texts)], dtype="<u8").tobytes())
        f.write(body)
    return f"{folder}/{name}"


class RuleIndex:
    """The memory-mapped array."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        start = 8 + int.from_bytes(data[:8].tobytes(), "little")
        head = json.loads(data[8:start].tobytes())
        n, self.prefixes = head["n"], head["prefixes"]
        self.keys = data[start : start + 8 * n].view("<u8")
        self.places = data[start + 8 * n : start + 16 * n + 8].view("<u8")
        self.body = data[start + 16 * n + 8 :]

    def candidates(self, host: str, path: str) -> list[str]:
        """Every rule text that fits, longest first: the host or a parent of it, with a prefix of the path."""
        hosts, at = [host], host.find(".")
        while at >= 0:
            hosts.append(host[at + 1 :])
            at = host.find(".", at + 1)
        found = {h + path[:n] for h in hosts if h for n in self.prefixes if n <= len(path)}
        return sorted(found, key=lambda r: (-len(r), r))

    def match(self, urls: list[list[str]]) -> list[tuple[str, str] | None]:
        """The first candidate of each list that is a rule: one binary search for all of them."""
        flat = [c for cands in urls for c in cands]
        digests = np.fromiter((xxhash.xxh64_intdigest(c.encode()) for c in flat), np.uint64, len(flat))
        at = np.searchsorted(self.keys, digests)
        hit = np.zeros(len(flat), bool)
        if len(self.keys):
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == digests
        out, i = [], 0
        for cands in urls:
            best = None
            for c in cands:
                if best is None and hit[i]:
                    best = self.confirm(int(at[i]), c)
                i += 1
            out.append(best)
        return out

    def confirm(self, at: int, text: str) -> tuple[str, str] | None:
        """Rules with equal digests follow each other; only an equal string counts."""
        key = self.keys[at]
        while at < len(self.keys) and self.keys[at] == key:
            rule, verdict = json.loads(self.body[int(self.places[at]) : int(self.places[at + 1])].tobytes())
            if rule == text:
                return rule, verdict
            at += 1
        return None


_OPEN: dict[str, RuleIndex] = {}


def _shipped(name: str) -> RuleIndex:
    if name not in _OPEN:
        _OPEN[name] = RuleIndex(SparkFiles.get(name))
    return _OPEN[name]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = DEFAULT_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    A rule fits its host and all subdomains of it where the path starts with the rule's path;
    the longest fitting rule wins, ``default`` holds without one. A url that is null or has no
    ``://`` has an empty host and path and no rule. An empty rule list lets ``default`` decide
    all. Repeated rows get equal rows; other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    path = write_index(rules, scratch_dir(spark, "rules"))
    spark.sparkContext.addFile(path)
    name = path.rpartition("/")[2]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _shipped(name)
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            found = index.match([index.candidates(h, p) for h, p in parts])
            yield emit(
                _OUT, page_id=batch.column("page_id"), host=[h for h, _ in parts], path=[p for _, p in parts],
                rule=[f and f[0] for f in found], verdict=[f[1] if f else default for f in found],
            )

    return pages.select("page_id", "url").mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
