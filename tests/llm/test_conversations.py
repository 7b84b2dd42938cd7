"""Prefix trie and structure repair of conversations against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from paymend.llm import conversation_repair as cr, prefix_trie as pt

ROWS = "conv_id long, turn long, role string, text string, depth long, at long, part long, id1 long, base long, h long, tie_break string, dup boolean"
FILL = (1, 1, 1, 1, 1, 1, "x", True)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *FILL) for r in rows], ROWS).repartition(5)


def messy_rows():
    pick = random.Random(5)
    texts = ["Yes.", "No", "", "  \n", "Why?", "ümlaut!", "a:b.", None, "x" * 300 + "."]
    rows = []
    for c in [*range(24), 9_000_000_000, -3, -5]:
        for t in range(pick.randint(0, 7)):
            rows.append((c, pick.choice([t, t, t, t, None, t + 3]), pick.choice(["user", "assistant", "system", "tool", "", None]), pick.choice(texts)))
    rows += [rows[0], rows[0], (None, 1, "user", "lost."), (None, 2, "assistant", "also."), (7, None, None, None), (70, 5, "user", None)]
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t % 7}.") for t in range(90)]  # deeper than two bands
    rows += [(c, t, ("user", "assistant")[t % 2], f"turn {t % 7}.") for c in range(101, 107) for t in range(40)]
    rows += [(c, 0, "user", "alone.") for c in (203, 208, 213, 219)]  # no 200, 205, ...: some are left without turns
    return rows


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def ordered(rows, null):
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append((turn, null if role is None else role, null if text is None else text))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, digest(*r[1:]))) for c, v in out.items()}


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, ids in members.items():
        below = [(p, m) for p, m in members.items() if p[: len(path)] == path]
        kids = [p for p, _ in below if len(p) == len(path) + 1]
        leaves = sum(1 for p, _ in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q, _ in below))
        saved = sum((len(m) - 1) * len(p[-1][1].encode()) for p, m in below if p)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(ids), len(path), parent, len(ids), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie_of_rebuilt_conversations(spark):
    rows = messy_rows()
    own = {c: [(r, t) for _, r, t in v] for c, v in ordered(rows, "").items() if c is not None}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        convs[c] = own.get(base, [])[:h] + turns[h:]
    assert any(not v for v in convs.values())  # one is turnless
    want = plain_trie(convs)
    df = frame(spark, rows)
    for height in (2, 3, 16):
        got = pt.prefix_trie(*pt.rebuilt(pt.sequences(df)), height)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_trie_of_plain_conversations(spark):
    rows = messy_rows()
    want = plain_trie({c: [(r, t) for _, r, t in v] for c, v in ordered(rows, "").items() if c is not None})
    assert {tuple(r) for r in pt.conversation_trie(frame(spark, rows)).collect()} == want


def test_one_conversation_over_many_tasks(spark):
    rows = spark.range(20000).selectExpr("if(id < 15000, 7, id) AS conv_id", "id AS turn", "'user' AS role", "cast(id % 10 as string) AS text")
    got = pt.sequences(rows).where("conv_id = 7").agg({"at": "max", "bytes": "sum", "conv_id": "count"}).first()
    assert tuple(sorted(got)) == (15000, 15000, 15000)
    parts = spark.sparkContext.defaultParallelism
    assert parts > 1
    nodes = pt.conversation_trie(rows).where("conv_id = 7")
    assert nodes.count() == 15001
    assert nodes.where("depth = 1").first().n_leaves == 1 and nodes.where("depth = 0").first().n_leaves == 10


def test_ends_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK_BITS", 2)
    rows = [(c, 0, "user", "hello") for c in (-9, -1, 0, 3, 4, 5, 1000, 31, 30)]
    got = {r.depth: r for r in pt.conversation_trie(frame(spark, rows)).collect()}
    assert got[1].ends_sha256 == hashlib.sha256(b"-9,-1,0,3,4,5,30,31,1000").hexdigest()
    assert got[1].n_convs == 9 and got[0].ends_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert pt.conversation_trie(none).count() == 0
    assert pt.prefix_trie(*pt.rebuilt(pt.sequences(none))).count() == 0
    assert cr.repair_report(none).count() == 0 and cr.repaired_turns(none).count() == 0
    assert cr.repair_report(cr.damage(none)).count() == 0


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Every choice of edits, with up to two inserted turns in each gap."""
    kinds = faults(rows)
    best = None

    def go(i, cost, audit, lines):
        nonlocal best
        shape = "".join(line[0][:1] for line in lines)
        if not re.fullmatch(r"(s?(ua)*u?)?", shape):
            return
        if i == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", shape) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
            return
        _, role, text = rows[i]
        options = [(4, "D", [])]
        if kinds[i] not in ("blank", "duplicate"):
            more = 3 * (kinds[i] == "truncated")
            options += [(more, "K", [(role, text)]), (3 + more, "R", [("user", text)]), (3 + more, "R", [("assistant", text)])]
        for extra in ([], [("user", "")], [("assistant", "")], [("user", ""), ("assistant", "")], [("assistant", ""), ("user", "")]):
            for c, letter, put in options:
                go(i + 1, cost + c + 3 * len(extra), audit + "I" * len(extra) + letter, lines + extra + put)

    go(0, 0, "", [])
    return best


def plain_report(rows):
    """The plain repair with a blank row put last, whose deletion is then taken back: so turns can be inserted at the end."""
    cost, audit, lines = plain_repair(rows + [(None, "user", "")])
    at = audit.rindex("D")
    assert audit[at + 1 :] == "" and cost >= 4
    kinds = faults(rows)
    turns = sorted({t for t, _, _ in rows if t is not None})
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (
        turns[-1] - turns[0] + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost - 4, audit[:at], hashlib.sha256(text.encode()).hexdigest(),
    )


def test_repair_against_every_choice(spark):
    pick = random.Random(11)
    rows = []
    for c in range(60):
        for t in range(pick.randint(1, 4)):
            rows.append((c, pick.choice([t, t, None]), pick.choice(["user", "assistant", "system", "tool", "", "user"]), pick.choice(["Yes.", "No", " ", "Why?", "Go on!", "so"])))
    rows += [(None, 3, "assistant", "Lost."), (99, None, None, None)]
    want = {(c, *plain_report(v)) for c, v in ordered(rows, " ").items()}
    df = frame(spark, rows)
    assert {tuple(r) for r in cr.repair_report(df).collect()} == want
    # Giant conversations: nothing is held, edits are spilled in small chunks.
    assert {tuple(r) for r in cr.repair_report(df, held_bytes=0, chunk_rows=2).collect()} == want


@pytest.mark.parametrize("held, chunk", [(8_000_000, 65_536), (500, 7)])
def test_repaired_turns_and_long_conversations(spark, held, chunk):
    rows = messy_rows()
    df = cr.damage(frame(spark, rows))
    report = {r.conv_id: r for r in cr.repair_report(df, held, chunk).collect()}
    assert set(report) == {r[0] for r in rows}
    turns = {}
    for r in sorted(cr.repaired_turns(df, held, chunk).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append(r)
    for c, r in report.items():
        own = turns.get(c, [])
        assert [t.place for t in own] == list(range(len(own)))
        assert "".join(t.edit for t in own) == r.audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in own))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest() == r.repaired_sha256
        assert r.audit.count("D") >= r.blank + r.duplicate


def test_dropped_conversation(spark):
    """A conversation of which every row is dropped still has a row."""
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = cr.repair_report(cr.damage(frame(spark, [(lost, 0, "user", "Hi.")]))).first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage_kinds(spark):
    rows = [(c, 1, "assistant", "A. B! C? d") for c in range(200)]
    got = {}
    for r in cr.damage(frame(spark, rows)).collect():
        got.setdefault(r.conv_id, []).append((r.dropped, r.role, r.text))
    for c in range(200):
        kind = zlib.crc32(f"{c}:1".encode()) % 20
        one = (kind == 0, "user" if kind == 4 else "assistant", {1: "", 2: "A B C d"}.get(kind, "A. B! C? d"))
        assert got[c] == [one] * (2 if kind == 3 else 1)


def test_step_is_cheapest():
    for after in itertools.product(range(4), repeat=4):
        best, byte = cr.step(after, b"u", cr.GOOD)
        assert best[0] <= after[2] and best[2] <= after[2] + 4 and 0 <= byte < 256
