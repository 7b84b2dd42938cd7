"""Jaccard join, components, decontamination and packing against brute force."""

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from paymend.llm import decontaminate, jaccard_join, packing, partenum
from paymend.llm.components import components
from paymend.llm.jaccard_join import jaccard_components
from paymend.llm.queries import tokenizer_path
from paymend.llm.shingles import SKETCH, shingle_sets, similar, sketch


def plain_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(rows, width, percent):
    sets = {i: plain_set(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_components_match_all_pairs(messy, width, percent):
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").where("doc_id is not null").distinct().collect()]
    got = jaccard_components(messy, width, percent).collect()
    assert len(got) == messy.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == plain_components(rows, width, percent)
    assert sorted((r.n_shingles, r.component_id is None) for r in got if r.doc_id is None)[0] == (0, True)
    assert {r.component_id for r in got if r.doc_id is None and r.n_shingles} == {5}


def test_jaccard_components_in_families_near_the_threshold(spark):
    """Chains, hubs that link nothing and groups in several components."""
    pick = random.Random(8)
    rows = []
    for family in range(6):
        words = [f"w{pick.randrange(400)}" for _ in range(pick.choice([8, 20, 60, 150]))]
        for _ in range(25):
            own = list(words)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 3, 5])):
                own[pick.randrange(len(own))] = f"x{pick.randrange(50)}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 90), (3, 60), (1, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, width, percent).collect()}
        assert got == plain_components(rows, width, percent)


def test_jaccard_components_of_repeated_ids_and_nothing(spark, no_docs):
    rows = [(1, "a b c d e"), (1, "p q r s t"), (2, "p q r s t"), (3, "a b c d e"), (4, "z z z z"), (5, None)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    assert jaccard_components(no_docs).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_similar_sets_share_a_signature(percent):
    pick = np.random.default_rng(percent)
    sets = []
    for size in [1, 2, 3, 5, 6, 8, 9, 10, 11, 12, 15, 20, 30, 45, 80, 150, 400, 1500] * 3:
        base = pick.integers(0, 1 << 62, size).astype(np.uint64)
        for _ in range(4):
            change = int(pick.integers(0, max(1, size * (100 - percent) // 100) + 1))
            sets.append(np.unique(np.concatenate([base[change:], pick.integers(0, 1 << 62, int(pick.integers(0, change + 1))).astype(np.uint64)])))
    found = [set(s.tolist()) for s in partenum.signatures(sets, percent)]
    seen = 0
    for i, j in combinations(range(len(sets)), 2):
        if similar(sets[i], sets[j], percent) and len(np.setxor1d(sets[i], sets[j])):
            seen += 1
            assert found[i] & found[j], (len(sets[i]), len(sets[j]))
    assert seen > 50


def test_sketches_bound_from_below(messy):
    sets = shingle_sets([(r.text or "").encode() for r in messy.select("text").collect()], 3)
    for a, b in combinations(sets, 2):
        cells = [np.frombuffer(sketch(s), np.uint8).astype(int) for s in (a, b)]
        assert len(cells[0]) == SKETCH and abs(cells[0] - cells[1]).sum() <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 299), (299, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edits_within(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def test_decontamination_matches_full_alignment():
    pick = random.Random(2)
    letters = "abcde fgh"
    items = [(i, "".join(pick.choice(letters) for _ in range(pick.randint(1, 60)))) for i in range(20)] + [(90, None), (91, "?!"), (92, "É ü")]
    index = decontaminate.build(items)
    texts = [None, "", "?"]
    for _ in range(80):
        text = "".join(pick.choice(letters) for _ in range(pick.randint(0, 100)))
        for _ in range(pick.randint(0, 2)):
            own = list(pick.choice(items[:20])[1])
            for _ in range(pick.randint(0, 6)):
                at = pick.randrange(len(own)) if own else 0
                own[at : at + pick.randint(0, 1)] = pick.choice(["", pick.choice(letters)])
            at = pick.randint(0, len(text))
            text = f"{text[:at]} {''.join(own)} {text[at:]}"
        texts.append(text)
    got = {(i, n): e for i, n, e, _, _ in decontaminate.find(index, texts)}
    for i, text in enumerate(texts):
        clean = decontaminate.normal(text)
        for n, item in enumerate(index.items):
            if len(item) < decontaminate.Q:
                want = 0 if b" " + item + b" " in b" " + clean + b" " else None
            else:
                want = edits_within(item, clean)
                want = want if want <= decontaminate.budget(len(item)) else None
            assert got.get((i, n)) == want, (item, clean)


def test_windows_of_long_items_match_full_alignment():
    pick = random.Random(4)
    words = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 9))) for _ in range(200)]
    prose = lambda n: " ".join(pick.choice(words) for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate([60, 28, 45, 12, 90])]
    index = decontaminate.build(items)
    assert (index.length <= max(len(t) for _, t in items)).all() and len(index.first) == len(items)
    texts, quoted = [prose(50)], [None]
    for number, (_, item) in enumerate(items):
        for at, length in ((0, 230), (30, 215), (len(item) - 205, 205), (10, 120)):
            own = list(item[max(0, at) : max(0, at) + length])
            for _ in range(5):
                own[pick.randrange(len(own))] = pick.choice("xyz")
            texts.append(f"{prose(15)} {''.join(own)} {prose(15)}")
            quoted.append(number if length > 200 and len(item) > 240 else None)
    found = {(i, n): e for i, n, e, _, _ in decontaminate.find(index, texts)}
    for i, text in enumerate(texts):
        for n in range(len(index.length)):
            want = edits_within(index.part(n), decontaminate.normal(text))
            assert found.get((i, n)) == (want if want <= decontaminate.budget(int(index.length[n])) else None)
    held = decontaminate.find_items(index, texts)
    assert len({row[:2] for row in held}) == len(held)
    assert {(i, k) for i, k in enumerate(quoted) if k is not None} <= {row[:2] for row in held}


def test_many_short_items_are_aligned_together():
    import time

    pick = random.Random(6)
    words = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(3, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(pick.choice(words) for _ in range(n))
    index = decontaminate.build([(i, prose(6)) for i in range(2000)])
    texts = [prose(150) for _ in range(1000)]
    began = time.time()
    decontaminate.find(index, texts)
    assert time.time() - began < 20


def test_decontamination_over_frames(spark, messy, no_docs):
    items = spark.createDataFrame([(1, messy.where("doc_id = 17").first().text), (2, None), (3, ""), (1, messy.where("doc_id = 17").first().text), (None, "two words")], "item_id long, text string")
    got = decontaminate.contaminated(messy, items).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == {(17, 1): 2, (4, None): 1}
    decontaminate.BLOCK_CHARS, keep = 1, decontaminate.BLOCK_CHARS
    try:  # the benchmark in several blocks gives the same
        assert sorted(map(repr, decontaminate.contaminated(messy, items).collect())) == sorted(map(repr, got))
        left = decontaminate.keep_clean(messy, items)
        assert left.columns == messy.columns and left.count() == messy.count() - 2
    finally:
        decontaminate.BLOCK_CHARS = keep
    assert decontaminate.contaminated(no_docs, items).count() == 0 == decontaminate.contaminated(messy, items.limit(0)).count()
    assert decontaminate.keep_clean(messy, items.limit(0)).count() == messy.count()


def check_plan(histogram, capacity=4096):
    seqs, number = defaultdict(list), Counter()
    for length, start, n, first, per, offset in packing.plan(dict(histogram), capacity):
        assert start == number[length]
        number[length] += n
        for i in range(n):
            seqs[first + i // per].append((offset + i % per * length, length))
    assert number == Counter({k: v for k, v in histogram.items() if v})
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def best_fit(lengths, capacity):
    """Best-fit decreasing, the plain heuristic."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_packing_plan_is_gapless_and_no_worse_than_best_fit():
    assert check_plan({}) == 0 and check_plan({1: 5}) == 1 and check_plan({4096: 3, 2049: 7, 2048: 2, 100: 1}) == 11
    assert check_plan({7: 10, 3: 4}, 7) == 12
    for seed in range(6):
        pick = random.Random(seed)
        lengths = [min(4096, int(pick.lognormvariate(6.5, 1.2)) + 1) for _ in range(pick.randint(5, 1500))]
        n = check_plan(Counter(lengths))
        assert -(-sum(lengths) // 4096) <= n <= best_fit(lengths, 4096) * 1.02 + 1


def test_packing_of_documents(messy, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(messy, tokenizer_path()).collect()
    want = []
    for row in messy.select("doc_id", "text").collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((row.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


def test_packing_numbers_a_hot_length(spark):
    pieces = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "if(id % 3 = 0, 100L, id % 50 + 1) as length")
    got = packing.pack(pieces, 1000).collect()
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 5000
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1000


def test_one_of_each_is_decided_by_row(spark):
    from conftest import DOCS, document_rows, prose

    u, v, w = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = document_rows([u, v, w, u + " more", "", None, "few words"])
    rows = [(1, *rows[0][1:]), (1, *rows[1][1:]), (None, *rows[2][1:]), (None, *rows[2][1:]), (None, *rows[2][1:]), (None, *rows[3][1:]), (7, *rows[4][1:]), (7, *rows[5][1:]), (8, *rows[6][1:]), (8, *rows[6][1:])]
    docs = spark.createDataFrame(rows, DOCS)
    left = jaccard_join.one_of_each(docs.coalesce(1))
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(1, u), (1, v), (None, w), (7, ""), (7, None), (8, "few words")], key=repr)


@pytest.mark.parametrize("block", [2, 2048])
def test_open_groups_are_tied_in_blocks(spark, monkeypatch, block):
    """A chain of texts around one common passage: neighbours are similar, the ends are not."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 120])) for i in range(40)]
    rows += [(100 + i, " ".join(words[60:90] + [f"x{rng.random()}" for _ in range(40)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for width, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, width, percent).collect()}
        assert got == plain_components(rows, width, percent)


def _rows_by_bucket(batches):
    """bucket -> its (signature, document, tied) triples; what goes to any bucket counts as one."""
    out = defaultdict(Counter)
    for row in (r for b in batches for r in b.to_pylist()):
        away = row["bucket"] < 0
        known = np.frombuffer(row["docs"], "<i8")
        which = np.frombuffer(row["which"], "<u2" if len(known) <= 1 << 16 else "<u4")
        tops, lows = np.frombuffer(row["tops"], "<u4"), np.frombuffer(row["lows"], "<u4" if away else "u1")
        out[-1 if away else row["bucket"]].update(zip(tops.tolist(), lows.tolist(), known[which].tolist(), row["tied"]))
    return out


@pytest.mark.parametrize("buckets", [3, 40])
def test_signatures_are_packed_by_ranges_of_buckets(buckets):
    rng = np.random.default_rng(5)
    ids = rng.permutation(3000).tolist()
    held = [partenum.mix(rng.integers(0, 60_000, 100)) for _ in ids]
    whole = jaccard_join._pack(np.concatenate(held), np.repeat(np.array(ids), 100), buckets)
    parts = list(jaccard_join._packs(list(held), ids, buckets))
    assert 1 < len(parts) <= buckets and _rows_by_bucket(parts) == _rows_by_bucket([whole])
    assert [b for p in parts for b in p.column("bucket").to_pylist() if b >= 0] == sorted(b for b in whole.column("bucket").to_pylist() if b >= 0)


def test_signing_holds_little_beside_the_signatures(monkeypatch):
    class Texts:
        """Hands the signing function to the test instead of to Spark."""

        def select(self, *_):
            return self

        def mapInArrow(self, fn, _):
            self.sign = fn
            return self

        def groupBy(self, _):
            return self

        def applyInArrow(self, *_):
            return self

    monkeypatch.setattr(jaccard_join, "FLUSH", 500_000)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2500)), "text": [" ".join(rng.choices(words, k=400)) for _ in range(2500)]})
    docs = Texts()
    jaccard_join.shared_signatures(docs, 5, 80, 800)
    list(docs.sign(iter([batch.slice(0, 1)])))  # tables that stay
    tracemalloc.start()
    try:
        for _ in docs.sign(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # The signatures held are 4 MB; sorted and packed at once they took ten times that.
    assert peak < 30_000_000


@pytest.mark.parametrize("buckets", [40, 4000])
def test_packs_travel_by_document_in_few_bytes(buckets):
    rng = np.random.default_rng(6)
    ids = (5_000_000_000 + rng.permutation(9000)[:3000] * 3).tolist()
    held = [partenum.mix(rng.integers(0, 60_000, 100)) for _ in ids]
    packs = list(jaccard_join._packs(list(held), ids, buckets))
    sent = [jaccard_join._narrow(p) for p in packs]
    for pack, narrow in zip(packs, sent):
        for row, small in zip(pack.to_pylist(), narrow.to_pylist()):
            sig, doc, tied = jaccard_join._wide(small)
            want = _rows_by_bucket([pa.RecordBatch.from_pylist([row], jaccard_join._PACKED)])
            own = -1 if row["bucket"] < 0 else row["bucket"]
            low = sig & np.uint64(0xFFFFFFFF) if own < 0 else (sig & np.uint64(0xFFFFFFFF)) >> np.uint64(24)
            assert Counter(zip((sig >> np.uint64(32)).tolist(), low.tolist(), doc.tolist(), tied.astype(int).tolist())) == want[own]
            assert own < 0 or (sig & np.uint64(0xFFFFFF) == own).all()
    # An id and a place in a list for each took 15 bytes and more.
    assert sum(b.column(c).nbytes for b in sent for c in ("gaps", "counts", "tops", "lows", "tied")) < 11 * 300_000


def test_ids_far_apart_travel_whole():
    ids = [-(1 << 63), -5, 0, 7, (1 << 63) - 1]
    held = [np.array([i, 1 << 60], np.uint64) for i in range(5)]
    rows = [r for p in jaccard_join._packs(held, ids, 3) for r in jaccard_join._narrow(p).to_pylist()]
    assert Counter(d for r in rows for d in jaccard_join._wide(r)[1].tolist()) == Counter(ids * 2)


def test_buckets_tell_signatures_apart_that_travel_alike():
    """Of 64 bits 40 travel; with them alone the share that meets by chance would grow with the data."""
    sig = np.uint64(0x123456789A000000) | np.arange(1 << 20, dtype=np.uint64) * np.uint64(15)
    home = jaccard_join._home(sig, 12_000)
    assert len(np.unique(home)) == 12_000 and np.bincount(home).max() < 200


def test_few_ids_are_found_without_moving_all_rows(spark):
    rows = spark.range(20_000).selectExpr("if(id % 1000 = 999, null, id - 10000) doc_id", "concat('text ', id) text")
    rows = rows.unionByName(rows.where("doc_id = 17"))
    ids = jaccard_join.materialise(spark.createDataFrame([(i * 37,) for i in range(-100, 100)] + [(17,), (17,), (10**12,), (None,)], "doc_id long"), "test-ids")
    told = jaccard_join._maybe(rows, "doc_id", ids, "maybe")
    assert told.columns == ["doc_id", "text", "maybe"] and told.count() == 20_001
    known = {r.doc_id for r in ids.collect()} - {None}
    passed = [r.doc_id for r in told.where("maybe").collect()]
    assert known - {10**12} - set(passed) == known - {r.doc_id for r in rows.collect()} - {10**12} and len(passed) < 600
    got = [tuple(r) for r in jaccard_join._rows_of(rows, ids).collect()]
    assert sorted(got) == sorted({(r.doc_id, r.text) for r in rows.collect() if r.doc_id in known})
    assert not any(r.maybe for r in jaccard_join._maybe(rows, "doc_id", ids.limit(0), "maybe").collect())


def test_texts_go_only_where_sketches_leave_a_partner(spark, monkeypatch):
    """Groups around common passages: few members have anyone to be compared with."""
    seen, store = {}, jaccard_join.materialise

    def spy(df, label, **more):
        out = store(df, label, **more)
        seen.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialise", spy)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 120])) for i in range(10)]
    rows += [(100 + i, " ".join(words[: 120 + 3 * (i % 2)] + [f"x{rng.random()}" for _ in range(60 + i)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, 5, 80).collect()}
    assert got == plain_components(rows, 5, 80)
    assert seen["around"][0] > 20 > seen["packed-texts"][0]


def test_members_with_a_partner_by_sketch():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[at : at + 80] + [str(rng.random()) for _ in range(n)]).encode() for at in (0, 2, 60, 100) for n in (0, 1, 5, 30, 200)]
    sets = shingle_sets(texts, 3)
    rows = [(9, k % 2 == 0, i, i % 3, i % 3 > 0, len(sets[i]), sketch(sets[i])) for i in range(len(sets)) for k in range(2) if k % 2 or i % 3 > 0]
    table = pa.table(dict(zip(("hub", "is_left", "rep", "part", "away", "size", "sketch"), map(list, zip(*rows)))))
    want = set()
    for _, a_left, a, p, _, m, x in rows:
        for _, b_left, b, q, b_away, n, y in rows:
            differ = sum(abs(i - j) for i, j in zip(x, y))
            if a_left and not b_left and p != q and (not b_away or b < a) and 100 * min(m, n) >= 80 * max(m, n) and differ * 180 <= (m + n) * 20:
                want |= {a, b}
    found = jaccard_join._partnered(table, 80).to_pydict()
    assert set(found["rep"]) == want and set(found["hub"]) == {9} and 2 < len(want) < len(sets)
