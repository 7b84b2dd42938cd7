"""N-gram Jaccard join by PartEnum signatures.

Texts become sets of word shingles. Equal sets are one class. Every set gets PartEnum
signatures (``partenum``), chosen so that two sets of the asked similarity share at least
one; sets that share one are compared exactly. Nothing is approximate: signatures only
choose what is compared.

Groups that share a signature are never expanded into pairs. Round one compares each
member with the smallest one. Where a group is in one component afterwards, its other
pairs cannot change the result. Round two compares, around hubs whose groups are still in
several components, the members outside the hub's component with those of other components,
in blocks: sketches first, then the sets themselves. Texts go only to the blocks where a sketch
leaves their members a partner. A block passes over pairs whose components it has just tied, and
emits fewer links than it has components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from paymend.llm import partenum
from paymend.llm.batches import chunks, emit, map_chunks, mix, raw
from paymend.llm.components import components
from paymend.llm.shingles import SKETCH, set_digest, shingle_sets, similar, sketch
from paymend.sources.scratch import materialise

#: Signatures that a map task gathers before it sends them on, and that a bucket should hold.
FLUSH, BUCKET = 2_000_000, 500_000
#: Signatures that are sorted and packed at once, and bytes of text that are signed at once: a worker's memory goes with these.
SLICE, SIGNED_BYTES = 125_000, 250_000
#: Members of a side of a block, and elements of their sets.
BLOCK, BLOCK_ELEMENTS = 2048, 1_000_000
#: Bits of a filter per id that it knows, and at most (16 MB). With more ids it lets more rows through to the exact join.
ID_BITS, MOST_BITS = 16, 1 << 27
_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.binary())])
_PACKED = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("tops", pa.binary()), ("lows", pa.binary()), ("which", pa.binary()), ("tied", pa.binary())])
_SENT = pa.schema([("bucket", pa.int64()), ("n_docs", pa.int64()), ("first", pa.int64()), ("gaps", pa.binary()), ("counts", pa.binary()), ("tops", pa.binary()), ("lows", pa.binary()), ("tied", pa.binary())])
_PACKED_TEXT = pa.schema([("rep", pa.int64()), ("size", pa.int64()), ("packed", pa.binary()), ("sketch", pa.binary())])
_MEMBER = pa.schema([("sig", pa.int64()), ("doc_id", pa.int64())])


def shingle_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sketch): size, 128-bit name and sketch of each document's set."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(raw(batch), width)
        names = [set_digest(s) for s in sets]
        return emit(_SETS, doc_id=batch.column("doc_id"), n_shingles=[len(s) for s in sets], d1=[a for a, _ in names], d2=[b for _, b in names], sketch=[sketch(s) for s in sets])

    return map_chunks(docs.select("doc_id", "text"), work, "doc_id long, n_shingles long, d1 long, d2 long, sketch binary")


def _pack(sig: np.ndarray, doc: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket. In a bucket each signature is there once, with its smallest document and
    whether others of this task share it; those others go along to any bucket (-1 - number)."""
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    lead = np.concatenate([[True], sig[1:] != sig[:-1]])
    tied = np.concatenate([~lead[1:], [False]])
    rows = {f: [] for f in _PACKED.names}

    def add(bucket, sig, doc, tied):
        docs, which = np.unique(doc, return_inverse=True)
        rows["bucket"].append(int(bucket))
        rows["docs"].append(docs.astype("<i8").tobytes())
        rows["tops"].append((sig >> np.uint64(32)).astype("<u4").tobytes())
        rows["lows"].append(sig.astype("<u4").tobytes() if bucket < 0 else ((sig >> np.uint64(24)) & np.uint64(255)).astype("u1").tobytes())
        rows["which"].append(which.astype("<u2" if len(docs) <= 1 << 16 else "<u4").tobytes())
        rows["tied"].append(tied.astype("u1").tobytes())

    if (~lead).any():
        more = sig[~lead]
        add(-1 - int(mix(sig[:1])[0] % np.uint64(buckets)), _cut(more) | _mark(_home(more, buckets)), doc[~lead], tied[~lead])
    sig, doc, tied = sig[lead], doc[lead], tied[lead]
    home = _home(sig, buckets)
    order = np.argsort(home, kind="stable")
    sig, doc, tied, home = sig[order], doc[order], tied[order], home[order]
    stops = np.flatnonzero(np.concatenate([home[1:] != home[:-1], [True]])) + 1
    start = 0
    for stop in stops.tolist():
        add(home[start], sig[start:stop], doc[start:stop], tied[start:stop])
        start = stop
    return emit(_PACKED, **rows)


def _packs(held: list[np.ndarray], ids: list[int], buckets: int) -> Iterator[pa.RecordBatch]:
    """``_pack`` of all of ``held``, the signatures of each of ``ids``, by ranges of buckets. Equal signatures are in one
    range, so each bucket gets the row it gets from all at once, and only a range is sorted and copied at a time."""
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    sig = np.concatenate(held)
    held.clear()
    doc = np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
    known = np.array(ids, np.int64)
    parts = min(buckets, -(-len(sig) // SLICE))
    part = np.empty(len(sig), np.uint16 if parts <= 1 << 16 else np.int64)
    for start in range(0, len(sig), SLICE):
        part[start : start + SLICE] = _home(sig[start : start + SLICE], buckets) * parts // buckets
    for i in range(parts):
        here = np.flatnonzero(part == i)
        if len(here):
            yield _pack(sig[here], known[doc[here]], buckets)


def _cut(sig: np.ndarray) -> np.ndarray:
    """The 40 bits of a signature that travel; with the bucket, whose number comes from the 32 others and lowest, they tell
    signatures apart well enough at any size, as buckets grow in number and what they bring together is compared."""
    return sig & np.uint64(0xFFFFFFFFFF000000)


def _home(sig: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(sig & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _mark(home: np.ndarray | int) -> np.ndarray:
    """The bucket in the bits of a signature that don't travel."""
    return np.asarray(home, np.uint64) & np.uint64(0xFFFFFF)


def _least(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(values.max(initial=0)).newbyteorder("<")).tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.uint64) if n else np.empty(0, np.uint64)


def _narrow(packs: pa.RecordBatch) -> pa.RecordBatch:
    """Packs as they travel, by document: gaps between ascending ids and how many signatures each has take a byte or two,
    where an id and a place in a list took ten as soon as buckets are so many that a document has few signatures in each."""
    rows = {f: [] for f in _SENT.names}
    for row in packs.to_pylist():
        docs = np.frombuffer(row["docs"], "<u8")
        which = np.frombuffer(row["which"], "<u2" if len(docs) <= 1 << 16 else "<u4")
        order = np.argsort(which, kind="stable")
        rows["bucket"].append(row["bucket"])
        rows["n_docs"].append(len(docs))
        rows["first"].append(int(docs[:1].astype(np.int64)[0]))
        rows["gaps"].append(_least(docs[1:] - docs[:-1]))
        rows["counts"].append(_least(np.bincount(which, minlength=len(docs))))
        rows["tops"].append(np.frombuffer(row["tops"], "<u4")[order].tobytes())
        rows["lows"].append(np.frombuffer(row["lows"], "<u4" if row["bucket"] < 0 else "u1")[order].tobytes())
        rows["tied"].append(np.packbits(np.frombuffer(row["tied"], "u1")[order]).tobytes())
    return emit(_SENT, **rows)


def _wide(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, document, tied) of a row of ``_narrow``; a signature is its travelling bits and its bucket."""
    own, n = row["bucket"], row["n_docs"]
    top = np.frombuffer(row["tops"], "<u4").astype(np.uint64) << np.uint64(32)
    low = np.frombuffer(row["lows"], "<u4" if own < 0 else "u1").astype(np.uint64)
    docs = np.cumsum(np.concatenate([np.array([row["first"]], np.int64).view(np.uint64), _numbers(row["gaps"], n - 1)]), dtype=np.uint64)
    tied = np.unpackbits(np.frombuffer(row["tied"], "u1"), count=len(top)).astype(bool)
    return top | (low if own < 0 else low << np.uint64(24) | _mark(own)), np.repeat(docs.view(np.int64), _numbers(row["counts"], n).astype(np.int64)), tied


def shared_signatures(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """(sig, doc_id) of every signature that two rows or more have; signatures that the same rows have may go by one name."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size, seen = [], [], 0, set()
        for batch in chunks(batches, size=SIGNED_BYTES):
            rows = []
            for s, i in zip(shingle_sets(raw(batch), width), batch.column("doc_id").to_pylist()):
                name = set_digest(s)
                if i is not None and name not in seen:  # equal sets are one class, so one of them signs
                    seen.add(name)
                    rows.append((s, i))
            for s, (_, i) in zip(partenum.signatures([s for s, _ in rows], percent), rows):
                if len(s):
                    held.append(s)
                    ids.append(i)
                    size += len(s)
            if size >= FLUSH:
                yield from map(_narrow, _packs(held, ids, buckets))
                held, ids, size, seen = [], [], 0, set()
        if held:
            yield from map(_narrow, _packs(held, ids, buckets))

    def shared(table: pa.Table) -> pa.Table:
        own = table.column("bucket")[0].as_py()
        sig, doc, tied = map(np.concatenate, zip(*map(_wide, table.to_pylist())))
        if own >= 0:
            order = np.argsort(sig, kind="stable")
            sig, doc, tied = sig[order], doc[order], tied[order]
            same = sig[1:] == sig[:-1]
            many = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | tied
            sig, doc, tied = sig[many], doc[many], tied[many]
            if len(sig):
                # Near copies share many signatures. A group that is whole here is named by its documents, so it counts once.
                first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
                size = np.diff(np.append(first, len(sig)))
                name = mix(np.add.reduceat(mix(doc), first) + size.astype(np.uint64))
                sig = np.where(np.repeat(np.logical_or.reduceat(tied, first), size), sig, np.repeat(name, size))
        return pa.Table.from_batches([emit(_MEMBER, sig=sig.astype(np.int64), doc_id=doc)])

    packed = docs.select("doc_id", "text").mapInArrow(signed, "bucket long, n_docs long, first long, gaps binary, counts binary, tops binary, lows binary, tied binary")
    return packed.groupBy("bucket").applyInArrow(shared, "sig long, doc_id long")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose sizes and sketches do not rule similarity out; exact, as sketches only bound from below."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                cells = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, SKETCH).astype(np.int16) for c in ("sketch_a", "sketch_b")]
                differ = abs(cells[0] - cells[1]).sum(axis=1)
                x, y = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
                # 100 * i >= p * u with i + u = x + y and u - i >= differ
                ok = (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (differ * (100 + percent) <= (x + y) * (100 - percent))
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    left, right = (sketches.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    joined = pairs.repartition("a", "b").join(left, "a").join(right, "b")
    return joined.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(check, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) pairs whose texts are similar. Rows of one b follow each other, so its set is kept."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in chunks(batches, "text_a"):
            left, right, ids = shingle_sets(raw(batch, "text_a"), width), raw(batch, "text_b"), batch.column("b").to_pylist()
            ok = []
            for s, text, b in zip(left, right, ids):
                if (b, text) != last:
                    last, kept = (b, text), shingle_sets([text], width)[0]
                ok.append(similar(s, kept, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.repartition("b", "a").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable by links, a document's own if there are none.
    Null and empty texts have n_shingles 0 and link with nothing. A row whose doc_id is null
    takes the component of the documents with an equal set (null if there are none) but links
    nothing itself. Rows that repeat a doc_id count as one document that has several texts: it
    links where any of them does. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sets = known = materialise(shingle_table(docs, width), "shingles")
    classes = sets.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    sets = materialise(sets.join(classes, ["d1", "d2"], "left").select("doc_id", "n_shingles", "rep"), "classes")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * groups, int(total * (100 - percent) // 14 // BUCKET))
    shared = shared_signatures(docs, width, percent, buckets)
    # Copies of one set are one member.
    rep_of = sets.where("doc_id is not null and rep is not null").select("doc_id", "rep").distinct()
    members = materialise(shared.distinct().join(rep_of, "doc_id").select("sig", "rep").distinct(), "members")
    hubs = members.groupBy("sig").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top").drop("top")
    pairs = members.join(hubs, "sig").where("rep > hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    # A document with several texts is compared by each of them.
    pairs = materialise(_possible(pairs, known, percent).distinct(), "pairs")
    links = _verified(pairs, _texts(docs, pairs), width, percent)
    # One document with several texts ties their classes.
    ties = rep_of.where("rep <> doc_id").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a <> b")
    ties = rep_of.join(ties.select("doc_id", "b"), "doc_id").select(F.col("rep").alias("a"), "b")
    links = materialise(links.unionByName(ties), "links")
    parts = components(links)
    more = materialise(_open_links(members, hubs, parts, docs, known, width, percent), "links")
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    out = sets.join(parts, sets.rep == parts.node, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def _maybe(rows: DataFrame, key: str, ids: DataFrame, flag: str) -> DataFrame:
    """``rows`` and ``flag``: false where ``key`` is surely in no row of the stored ``ids``.

    One bit for each hash of an id, in a table of fixed size at most that every task gets. Rows that are
    many and wide need no shuffle to be told apart from few ids; an exact join decides on those that pass.
    """
    cells = min(MOST_BITS, max(1 << 15, ID_BITS * ids.count()))
    place = F.pmod(F.xxhash64(key), F.lit(cells)) + 1
    bits = ids.groupBy(F.bitmap_bucket_number(place).alias(f"{flag}_no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(f"{flag}_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.col(f"{flag}_bits").substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col(f"{flag}_no"), "left")
    return found.select(*rows.columns, F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False)).alias(flag))


def _rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct rows of ``docs`` (doc_id, text) whose doc_id is in ``ids``."""
    ids = materialise(ids.select("doc_id").distinct(), "ids")
    return _maybe(docs, "doc_id", ids, "maybe").where("maybe").drop("maybe").join(ids, "doc_id", "left_semi").distinct()


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that ``pairs`` name."""
    named = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    return materialise(_rows_of(docs, named), "texts")


def _open_links(members: DataFrame, hubs: DataFrame, parts: DataFrame, docs: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) links around a hub that tie its open components; of the links between two components in a block, one.

    Groups in several components are taken by hub. Their members outside the hub's component are
    held against all others in blocks of some ``BLOCK`` rows or ``BLOCK_ELEMENTS`` set elements a side,
    so a group of any size is many small tasks. Blocks of sketches come first: they tell which members
    have anyone to be compared with, and only those are dealt again, with their texts.
    """
    part = parts.withColumnRenamed("node", "rep").withColumnRenamed("component", "part")
    known = members.join(hubs, "sig").join(part, "rep", "left").select("sig", "rep", "hub", F.coalesce("part", "rep").alias("part"))
    mixed = known.groupBy("sig").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n")).where("p < q and n > 2").select("sig")
    around = materialise(known.join(mixed, "sig").select("hub", "rep", "part").distinct(), "around")
    named = around.select(F.col("rep").alias("doc_id")).distinct()
    long = sizes.join(named, "doc_id", "left_semi").groupBy("doc_id").agg(F.sum("n_shingles").alias("n"))
    home = around.where("rep = hub").select("hub", F.col("part").alias("home"))
    rows = around.where("rep <> hub").join(home, "hub").withColumn("away", F.col("part") != F.col("home"))
    rows = rows.join(long.withColumnRenamed("doc_id", "rep"), "rep")
    about = sizes.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), "sketch")
    about = about.join(named.withColumnRenamed("doc_id", "rep"), "rep", "left_semi").distinct()
    asked = _dealt(rows).join(about, "rep").groupBy("hub", "i", "j").applyInArrow(lambda table: _partnered(table, percent), "hub long, rep long")
    asked = materialise(asked.distinct(), "asked")
    rows = materialise(rows.join(asked, ["hub", "rep"], "left_semi"), "around")

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, pack = raw(batch), zstandard.ZstdCompressor()
        sets = shingle_sets(texts, width)
        # A packed text is a third of its set, whose hashes don't compress, and few sets of a block are asked for.
        return emit(_PACKED_TEXT, rep=batch.column("doc_id"), size=[len(x) for x in sets], packed=[pack.compress(t or b"") for t in texts], sketch=[sketch(x) for x in sets])

    # A document with several texts is there once for each.
    about = materialise(map_chunks(_rows_of(docs, rows.select(F.col("rep").alias("doc_id"))), sets_of, "rep long, size long, packed binary, sketch binary"), "packed-texts")

    def compare(table: pa.Table) -> pa.Table:
        side, rep, part, away, n, cells = _sides(table)
        packed, unpack = table.column("packed").to_pylist(), zstandard.ZstdDecompressor()
        sets: list[np.ndarray | None] = [None] * len(packed)

        def own(k: int) -> np.ndarray:
            if sets[k] is None:
                sets[k] = shingle_sets([unpack.decompress(packed[k])], width)[0]
            return sets[k]

        tie = np.unique(part, return_inverse=True)[1]
        others, a, b = np.flatnonzero(~side), [], []
        for k in np.flatnonzero(side).tolist():
            at = others[_may_meet(others, k, rep, tie, away, n, percent)]
            at = at[_sketched(cells, n, at, k, percent)]
            while len(at):
                j, at = int(at[0]), at[1:]
                if similar(own(j), own(k), percent):
                    a.append(max(int(rep[j]), int(rep[k])))
                    b.append(min(int(rep[j]), int(rep[k])))
                    tie[tie == tie[j]] = tie[k]
                    at = at[tie[at] != tie[k]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _dealt(rows).join(about, "rep").groupBy("hub", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """Members around hubs (hub, rep, part, away, n), once for each block (hub, i, j) that they are a side of."""
    blocks = lambda own: F.ceil(F.greatest(F.sum(own) / BLOCK, F.sum(own * F.col("n")) / BLOCK_ELEMENTS)).cast("int")
    size = rows.groupBy("hub").agg(blocks(F.col("away").cast("int")).alias("lefts"), blocks(F.lit(1)).alias("rights"))
    rows = rows.join(size.where("lefts > 0"), "hub")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("away").select("hub", "rep", "part", "away", F.lit(True).alias("is_left"), block("lefts").alias("i"), every("rights").alias("j"))
    right = rows.select("hub", "rep", "part", "away", F.lit(False).alias("is_left"), every("lefts").alias("i"), block("rights").alias("j"))
    return left.unionByName(right)


def _sides(table: pa.Table) -> tuple[np.ndarray, ...]:
    """is_left, rep, part, away, size and sketch of the rows of a block."""
    cells = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, SKETCH).astype(np.int16)
    return *(np.asarray(table.column(c)) for c in ("is_left", "rep", "part", "away", "size")), cells


def _may_meet(others, k, rep, tie, away, n, percent) -> np.ndarray:
    """Which of ``others`` row ``k`` is compared with: rows of other components and similar sizes."""
    # Two members outside the hub's component meet twice; the larger one asks.
    return (tie[others] != tie[k]) & (~away[others] | (rep[others] < rep[k])) & (100 * np.minimum(n[others], n[k]) >= percent * np.maximum(n[others], n[k]))


def _sketched(cells, n, at, k, percent) -> np.ndarray:
    """Which of ``at`` the sketches leave similar to row ``k``."""
    differ = abs(cells[at] - cells[k]).sum(axis=1)
    # 100 * i >= p * u with i + u = x + y and u - i >= differ
    return differ * (100 + percent) <= (n[at] + n[k]) * (100 - percent)


def _partnered(table: pa.Table, percent: int) -> pa.Table:
    """(hub, rep) of the rows of a block that sizes and sketches leave anyone to be compared with; each once a side."""
    side, rep, part, away, n, cells = _sides(table)
    others, found = np.flatnonzero(~side), np.zeros(len(side), bool)
    for k in np.flatnonzero(side).tolist():
        meets = _may_meet(others, k, rep, part, away, n, percent)
        # Those already found need no second partner; they are asked only if nobody else is one for this row.
        for at in (others[meets & ~found[others]], others[meets & found[others]]):
            at = at[_sketched(cells, n, at, k, percent)]
            if len(at):
                found[at] = found[k] = True
                break
    reps = np.unique(rep[found])
    return pa.table({"hub": pa.array([table.column("hub")[0].as_py()] * len(reps), pa.int64()), "rep": pa.array(reps, pa.int64())})


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but one of each component of similar texts, all columns.

    Decided by row: one with the smallest doc_id of a component stays (null counts as largest), and
    just one if rows repeat it. So a row goes only if one that stays can be reached by links, whatever
    ids are null or repeated. Rows without words all stay.
    """
    row = "_row"
    while any(c.lower().startswith(row) for c in docs.columns):
        row += "_"
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", compression="zstd")
    groups = jaccard_components(numbered.select(F.col(row).alias("doc_id"), "text"), width, percent)
    named = numbered.select(F.col(row).alias("row"), F.col("doc_id").alias("id")).join(groups.select(F.col("doc_id").alias("row"), "component_id"), "row")
    named = materialise(named, "named")
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")
    many = named.groupBy("component_id").agg(first, F.count("*").alias("n")).where("n > 1").select("component_id", F.col("first.row").alias("stays"))
    gone = materialise(named.join(many, "component_id").where("row <> stays").select(F.col("row").alias(row)), "gone")
    told = _maybe(numbered, row, gone, flag := f"{row}_maybe")
    return told.where(~F.col(flag)).unionByName(told.where(flag).join(gone, row, "left_anti")).select(docs.columns)
