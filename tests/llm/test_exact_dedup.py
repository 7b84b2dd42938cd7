"""Exact groups against plain grouping, and the tries themselves."""

import hashlib
import random
from collections import defaultdict

import pytest

from paymend.llm import exact_dedup as ed


def plain_groups(rows, keep):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        owner = (max if keep == "largest" else min)(known) if known else None
        stays = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            kept = i == owner and stays
            stays = stays and not kept
            out.append((i, owner, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fold, held", [(ed.FOLD_BYTES, ed.HELD_BYTES), (1500, 3000)])
def test_groups_on_messy_rows(spark, messy, keep, fold, held):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    got = ed.exact_groups(messy, keep, fold, held)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_groups(rows, keep)


def test_many_copies_and_prefixes(spark):
    """A third of the rows are one text, others are prefixes of each other; tiny budgets spill over several rounds."""
    pick = random.Random(2)
    texts = ["ab" * pick.randint(0, 40) + pick.choice(["", "a", "é", "\x00"]) for _ in range(400)] + ["hot copy"] * 200
    rows = [(pick.randint(0, 10**12), t) for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for budget in (2000, ed.HELD_BYTES):
        got = ed.exact_groups(df, "largest", budget, budget)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_groups(rows, "largest")


def test_empty_table_and_bad_argument(spark, no_docs):
    assert ed.exact_groups(no_docs).count() == 0
    with pytest.raises(ValueError):
        ed.exact_groups(no_docs, "newest")


def test_drop_copies_keeps_columns(spark, messy):
    left = ed.drop_copies(messy)
    assert left.columns == messy.columns
    texts = [r.text or "" for r in left.collect()]
    assert set(texts) == {r.text or "" for r in messy.collect()}
    # The repeated row stays twice, as its doc_id and text are those that are kept.
    assert len(texts) == len(set(texts)) + 1


def test_trie_owners_and_subtrees():
    pick = random.Random(4)
    texts = [bytes(pick.choice(b"ab") for _ in range(pick.randint(0, 12))) for _ in range(500)]
    trie, away = ed.Trie(largest=False), defaultdict(list)
    for i, text in enumerate(texts):
        key = trie.insert(text, i)
        if key is not None:
            away[key].append((text, i))
        elif trie.held > 20000:
            for key, whole, node in trie.spill(20000):
                away[key].append((whole, node.owner))
    assert away
    found = {}
    for text, node in trie.terminals():
        found[text] = node.owner
    for rows in away.values():
        for text, i in rows:
            assert text not in {t for t, _ in trie.terminals()}
            found[text] = min(i, found.get(text, i))
    assert found == {t: texts.index(t) for t in texts}
