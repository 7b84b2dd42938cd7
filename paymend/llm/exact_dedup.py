"""Exact deduplication by Patricia tries whose terminals own their texts.

Every map task folds its rows into a trie first, so a text that a third of all rows hold leaves
a task as one row. What is left is dealt by length and content hash; each partition inserts the
full byte strings into one compressed radix trie, whose terminals keep the owner and the number
of rows. A trie that outgrows its budget gives away its largest subtrees: their strings, and all
later ones that lead there, go to the next round, where each subtree is a partition key of its
own. Rounds are tables on shared storage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paymend.llm.batches import chunks, emit, raw
from paymend.sources.scratch import materialise

#: Bytes of labels that the trie of a map task, and that of a partition, holds at most.
FOLD_BYTES, HELD_BYTES = 32_000_000, 192_000_000
#: Bytes of a node beside its label, roughly; and of the strings in one batch that is sent on.
NODE_BYTES, BATCH_BYTES = 400, 4_000_000
_FOLDED = pa.schema([("key", pa.int64()), ("length", pa.int64()), ("hash", pa.int64()), ("body", pa.binary()), ("owner", pa.int64()), ("n_rows", pa.int64()), ("n_tied", pa.int64())])
_OWNED = pa.schema([("key", pa.int64()), ("length", pa.int64()), ("sha", pa.binary()), ("body", pa.binary()), ("owner", pa.int64()), ("n_rows", pa.int64()), ("n_tied", pa.int64())])
_FOLDED_DDL = "key long, length long, hash long, body binary, owner long, n_rows long, n_tied long"
_OWNED_DDL = "key long, length long, sha binary, body binary, owner long, n_rows long, n_tied long"


class Node:
    """``kids`` by first byte: [label, node]. ``n_rows`` above 0 marks a terminal, ``away`` the key of a subtree given away."""

    __slots__ = ("kids", "owner", "n_rows", "n_tied", "mark", "away")

    def __init__(self):
        self.kids, self.owner, self.n_rows, self.n_tied, self.mark, self.away = {}, None, 0, 0, 0, None


def _agree(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``label`` and of ``text`` from ``at`` are equal."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == text[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A compressed radix trie over byte strings. Of the ids at a terminal the smallest (or largest) owns it; no id loses to any."""

    def __init__(self, largest: bool, key: int = 0):
        self.root, self.held, self.largest, self.key = Node(), 0, largest, key
        self.gone: list[bytes] = []

    def insert(self, text: bytes, owner: int | None, n_rows: int = 1, n_tied: int = 1, mark: int = 0) -> int | None:
        """Adds rows of a text. Returns the key of the subtree that it belongs to if that was given away."""
        node, at = self.root, 0
        while node.away is None:
            if at == len(text):
                self._own(node, owner, n_rows, n_tied, mark)
                return None
            edge = node.kids.get(text[at])
            if edge is None:
                leaf = Node()
                node.kids[text[at]] = [text[at:], leaf]
                self.held += len(text) - at + NODE_BYTES
                self._own(leaf, owner, n_rows, n_tied, mark)
                return None
            label, kid = edge
            if text.startswith(label, at):
                node, at = kid, at + len(label)
            else:
                n = _agree(label, text, at)
                inner = Node()
                inner.kids[label[n]] = [label[n:], kid]
                edge[0], edge[1] = label[:n], inner
                self.held += NODE_BYTES
                node, at = inner, at + n
        return node.away

    def _own(self, node: Node, owner: int | None, n_rows: int, n_tied: int, mark: int) -> None:
        if not node.n_rows or (owner is not None and (node.owner is None or (owner > node.owner) == self.largest and owner != node.owner)):
            node.owner, node.n_tied = owner, n_tied
        elif owner == node.owner:
            node.n_tied += n_tied
        node.n_rows += n_rows
        node.mark = mark

    def terminals(self, node: Node | None = None, path: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        """(text, node) below ``node``, which ``path`` leads to."""
        stack = [(path, node or self.root)]
        while stack:
            path, node = stack.pop()
            if node.n_rows:
                yield path, node
            stack.extend((path + label, kid) for label, kid in node.kids.values())

    def _size(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            for label, kid in node.kids.values():
                total += len(label) + NODE_BYTES
                stack.append(kid)
        return total

    def _ways(self) -> dict[int, tuple[Node, bytes]]:
        """Nodes whose edges may be given away, and what leads to them: those above a subtree that is gone, at first the first fork."""
        out = {}
        for gone in self.gone:
            node, at = self.root, 0
            while node.away is None:
                out[id(node)] = node, gone[:at]
                label, node = node.kids[gone[at]]
                at += len(label)
        if not self.gone:
            node, path = self.root, b""
            while not node.n_rows and len(node.kids) == 1:
                label, node = next(iter(node.kids.values()))
                path += label
            out[id(node)] = node, path
        return out

    def spill(self, limit: int) -> Iterator[tuple[int, bytes, Node]]:
        """Gives away the largest subtrees until half of ``limit`` is left: (key, text, terminal) of each string.

        A subtree is all strings with one more byte than a fork, and stays away once it is. A lone
        string never goes, so every subtree holds fewer strings than the trie it left.
        """
        ways = self._ways()
        edges = []
        for node, path in ways.values():
            for first, (label, kid) in node.kids.items():
                if kid.away is None and id(kid) not in ways:
                    edges.append((len(label) - 1 + self._size(kid), path, first, node))
        edges.sort(key=lambda e: e[:3], reverse=True)
        for size, path, first, node in edges:
            if self.held <= limit // 2:
                return
            label, kid = node.kids[first]
            name = hashlib.blake2b(path + label[:1], digest_size=8, key=self.key.to_bytes(8, "little", signed=True)).digest()
            away = int.from_bytes(name, "little", signed=True)
            for text, owned in self.terminals(kid, path + label):
                yield away, text, owned
            stub = Node()
            stub.away = away
            node.kids[first] = [label[:1], stub]
            self.gone.append(path + label[:1])
            self.held -= size


class _Rows:
    """Output rows, sent on in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, *row, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 64
        if self.size >= BATCH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield emit(self.schema, **dict(zip(self.schema.names, map(list, zip(*self.rows)))))
            self.rows, self.size = [], 0


def _folded(largest: bool, budget: int):
    """Map side: rows of equal texts become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(largest), _Rows(_FOLDED)

        def empty() -> Iterator[pa.RecordBatch]:
            for text, node in trie.terminals():
                yield from out.add(0, len(text), node.mark, text, node.owner, node.n_rows, node.n_tied, size=len(text))

        for batch in chunks(batches, "body"):
            for text, owner, mark in zip(raw(batch, "body"), batch.column("id").to_pylist(), batch.column("hash").to_pylist()):
                trie.insert(text, owner, mark=mark)
                if trie.held > budget:
                    yield from empty()
                    trie = Trie(largest)
        yield from empty()
        yield from out.flush()

    return run


def _owned(largest: bool, budget: int):
    """Reduce side: one row per text (``sha``), or (``body``) a string of a subtree that was given away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = None, _Rows(_OWNED)

        def close() -> Iterator[pa.RecordBatch]:
            names = set()
            for text, node in trie.terminals() if trie else ():
                sha = hashlib.sha256(text).digest()
                if (len(text), sha) in names:
                    raise ValueError("two different texts share their length and SHA-256")
                names.add((len(text), sha))
                yield from out.add(trie.key, len(text), sha, None, node.owner, node.n_rows, node.n_tied, size=32)

        for batch in chunks(batches, "body"):
            rows = zip(raw(batch, "body"), *(batch.column(c).to_pylist() for c in ("key", "owner", "n_rows", "n_tied")))
            for text, key, owner, n_rows, n_tied in rows:
                if trie is None or key != trie.key:
                    yield from close()
                    trie = Trie(largest, key)
                away = trie.insert(text, owner, n_rows, n_tied)
                if away is not None:
                    yield from out.add(away, len(text), None, text, owner, n_rows, n_tied, size=len(text))
                elif trie.held > budget:
                    for away, whole, node in trie.spill(budget):
                        yield from out.add(away, len(whole), None, whole, node.owner, node.n_rows, node.n_tied, size=len(whole))
        yield from close()
        yield from out.flush()

    return run


def text_owners(rows: DataFrame, largest: bool = False, fold_bytes: int = FOLD_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(id, body, length, hash) rows -> one row per distinct body: length, sha, owner, n_rows, n_tied (rows that have the owner's id)."""
    dealt = rows.mapInArrow(_folded(largest, fold_bytes), _FOLDED_DDL).repartition("length", "hash")
    found = None
    while True:
        owned = materialise(dealt.mapInArrow(_owned(largest, held_bytes), _OWNED_DDL), "owners")
        done = owned.where("body is null").select("length", "sha", "owner", "n_rows", "n_tied")
        found = done if found is None else found.unionByName(done)
        away = owned.where("body is not null")
        if away.isEmpty():
            return found
        dealt = away.repartition("key").sortWithinPartitions("key")


def exact_groups(docs: DataFrame, keep: str = "smallest", fold_bytes: int = FOLD_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are of one group if their texts are the same bytes; a null text counts as empty. keep_id
    is the smallest (``keep="largest"``: largest) doc_id of the group, null if no row has one, and
    just one row of a group is kept: the one with keep_id, one of them if rows repeat it. An empty
    table gives no rows. Other columns are ignored, whatever their names.

    A text is named by its length and SHA-256 on the way back to its rows; the tries hold whole
    texts, and fail rather than let two different ones share a name.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumns({"length": F.octet_length("body").cast("long"), "hash": F.xxhash64("body")})
    owners = text_owners(rows, keep == "largest", fold_bytes, held_bytes).where("n_rows > 1")
    names = rows.select("id", "length", F.unhex(F.sha2("body", 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    names = materialise(names, "names")
    joined = names.join(owners, ["length", "sha"], "left")
    kept = F.col("n_rows").isNull() | F.col("id").eqNullSafe(F.col("owner"))
    # Where several rows have the owner's id, the first written one stays.
    tied = owners.where("n_tied > 1")
    if not tied.isEmpty():
        first = names.join(tied.select("length", "sha", "owner"), ["length", "sha"]).where("id <=> owner")
        first = first.groupBy("length", "sha").agg(F.min("row").alias("first"))
        joined = joined.join(first, ["length", "sha"], "left")
        kept = kept & F.coalesce(F.col("row") == F.col("first"), F.lit(True))
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("n_rows").isNull(), F.col("id")).otherwise(F.col("owner")).alias("keep_id"),
        F.coalesce("n_rows", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` whose doc_id is kept, all columns. Rows that repeat a kept doc_id with the same text all stay."""
    gone = exact_groups(docs, keep).where("not doc_id <=> keep_id").select("doc_id", F.unhex("text_sha256").alias("sha")).distinct()
    named = docs.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.unhex(F.sha2(F.coalesce("d.text", F.lit("")), 256)) == F.col("g.sha")), "left_anti")
    return named.select("d.*")
