"""Repair and prefix trie of conversations by brute force, and on awkward tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.llm import conversation_repair as repair
from larkspur.llm import conversation_trie as trie
from larkspur.llm import queries
from tests.helpers import as_counter
from tests.llm.test_llm import FOLDER

TURNS = "conv_id bigint, turn bigint, role string, text string, place int, block string, depth int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", 7) for r in rows], TURNS)


ODD = [
    (1, 0, "user", "Ask. "), (1, 1, "assistant", None), (1, 1, None, "tie."), (1, None, "user", "first"), (1, 1, None, "tie."),
    (2, 5, "user", ""), (2, 5, "user", ""), (3, 0, "system", "long " * 20_000 + "end."), (3, 9, "assistant", "x" * 50_000),
    (None, 1, "user", "whose?"), (None, None, None, None), (-7, 3, "assistant", "below zero!"), (40, 0, "Zed", "ü🎉."),
    (100, 0, "user", "shared"), (100, 1, "assistant", "shared too"), (101, 0, "user", "own"), (199, 0, "user", "own"),
    (103, None, "user", "a"), (104, None, "user", "a"), (105, 2, "us", "era"), (106, 2, "user", "a"),
]


# 12


def best_edits(initials, flags):
    """Least cost and audit of all sequences of edits, tried one after the other within a bound."""
    n = len(initials)
    best = [4 * n + 7, ""]

    def go(i, said, cost, audit):
        if cost > best[0]:
            return
        if i == n and re.fullmatch(r"(s?(ua)+)?", said) and (cost, audit) < tuple(best):
            best[:] = [cost, audit]
        if not re.fullmatch(r"s?(ua)*u?", said):
            return
        if i < n:
            go(i + 1, said, cost + 4, audit + "D")
            if flags[i] != repair.DOOMED:
                more = 3 * (flags[i] == repair.BROKEN)
                go(i + 1, said + initials[i], cost + more, audit + "K")
                for c in "ua":
                    go(i + 1, said + c, cost + more + 3, audit + "R")
        for c in "ua":
            go(i, said + c, cost + 3, audit + "I")

    go(0, "", 0, "")
    return tuple(best)


def through_blocks(initials, flags, size):
    conversation = repair._Conversation("c")
    for at in range(0, len(initials), size):
        ways = [
            [w and {"cost": w[0], "audit": w[1]} for w in repair.align_block(initials[at : at + size], flags[at : at + size], e)]
            for e in range(4)
        ]
        block = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
        conversation.add({**block, "first_turn": None, "first": "u", "last": "u", "ways": ways})
    rows = list(conversation.edits())
    return rows[0]["cost"], "".join(r["audit"] for r in rows)


@pytest.mark.parametrize("size", [1, 2, 3, 32])
def test_alignment(size):
    rng = random.Random(size)
    for _ in range(300):
        n = rng.randint(1, 5)
        initials = "".join(rng.choice("suaxua") for _ in range(n))
        flags = "".join(rng.choice("..t-") for _ in range(n))
        assert through_blocks(initials, flags, size) == best_edits(initials, flags), (initials, flags)


def test_alignment_of_long_conversations_does_not_depend_on_blocks():
    rng = random.Random(5)
    for _ in range(4):
        initials = "".join(rng.choice("uauauas") for _ in range(60))
        flags = "".join(rng.choice(".....t-") for _ in range(60))
        whole = through_blocks(initials, flags, 60)
        assert [through_blocks(initials, flags, size) for size in (7, 16, 32)] == [whole] * 3


def test_band_loses_nothing():
    rng = random.Random(6)
    for _ in range(200):
        initials = "".join(rng.choice("sua") for _ in range(rng.randint(1, 9)))
        flags = "".join(rng.choice(".t-") for _ in initials)
        for target in ("", "ua", "sua", "uauaua", "auau"):
            wide = repair.banded_alignment(initials, flags, target, 10_000)
            if wide is not None:
                assert repair.banded_alignment(initials, flags, target, wide[0]) == wide
                assert repair.banded_alignment(initials, flags, target, wide[0] - 1) is None


def spaced(value):
    return " " if value is None else str(value)


def repaired_by_hand(rows):
    out, after = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv] = (0,) * 6 + ("", repair.EMPTY_SHA256)
        fate = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        role = "user" if fate == 4 else role
        after[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    for conv, found in after.items():
        if not found:
            continue
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        flags, seen = "", set()
        for _, role, text in found:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            flags += "b" if not last else "d" if (role, text) in seen else "." if last[0] in ".!?" else "t"
            seen.add((role, text))
        raw = [r[1][:1] for r in found]
        initials = "".join(c if c in ("s", "u", "a") else "x" for c in raw)
        cost, audit = best_edits(initials, re.sub("[bd]", "-", flags))
        size = sum(c != "D" for c in audit)
        target = "s" * (size % 2) + "ua" * (size // 2)
        lines, i, j = [], 0, 0
        for edit in audit:
            name = {"u": "user", "a": "assistant"}.get(target[j]) if j < size else None
            if edit == "I":
                lines.append(f"{name}:")
            elif edit != "D":
                lines.append(f"{found[i][1] if edit == 'K' else name}:{found[i][2]}")
            i, j = i + (edit != "I"), j + (edit != "D")
        numbers = [r[0] for r in found if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(raw))
        out[conv] = (
            gaps, flags.count("b"), flags.count("d"), flags.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def as_repaired(df):
    rows = df.collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def test_repair_of_odd_rows(spark):
    df = turns(spark, ODD)
    assert as_repaired(repair.repaired_after_damage(df)) == repaired_by_hand(ODD)
    assert repair.repaired_after_damage(df.where("false")).count() == 0


@pytest.mark.parametrize("block", [2, 32])
def test_repair_in_blocks(spark, block):
    rng = random.Random(3)
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", "", "Why?", "Well"]))
        for c in range(30) for t in rng.sample(range(12), rng.randint(1, 6))
    ]
    plain = {c: v for c, v in repaired_by_hand(rows).items()}
    damaged = repair.damaged(turns(spark, rows))
    got = {int(r.conv): (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
           for r in repair.repair_conversations(damaged, block).collect()}
    assert got == {c: v for c, v in plain.items() if c in got}
    assert all(plain[c][6] == "" for c in plain if c not in got)


def test_repair_of_a_conversation_with_most_rows(spark):
    """Cut into many blocks; a faultless one costs nothing, and one fault costs what it must."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    row = repair.repair_conversations(df).first()
    assert (row.cost, row.audit, row.illegal, row.gaps) == (0, "K" * 400, 0, 0)
    assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows).encode()).hexdigest()
    row = repair.repair_conversations(df.where("turn <> 201")).first()
    assert (row.cost, row.audit, row.illegal, row.gaps) == (3, "K" * 201 + "I" + "K" * 198, 1, 1)


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_repaired(queries.QUERIES["op12_conversation_repair"](spark, FOLDER)) == repaired_by_hand(rows)


# 13


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv, ts in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - int(abs(conv) % 100 * (1 if conv > 0 else -1))
        rebuilt = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(conv)
        ends[rebuilt].append(conv)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = {m for m in below if len(m) == len(node) + 1}
        leaves = sum(not any(x[: len(m)] == m and len(x) > len(m) for x in below) for m in below)
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        parent = min(members[node[:-1]]) if node else None
        ids = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), len(children), leaves, saved, ids))
    return sorted(out, key=repr)


def as_nodes(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_trie_of_odd_rows(spark):
    df = turns(spark, ODD)
    nodes = as_nodes(trie.prefix_trie(trie.rebuilt_conversations(df)))
    assert nodes == trie_by_hand(ODD)
    assert trie.prefix_trie(trie.rebuilt_conversations(df.where("false"))).count() == 0


def test_trie_of_equal_conversations(spark):
    """Many copies, some of them cut short, and conversations that lose all their turns."""
    said = [("system", "Be brief."), ("user", "Hm?"), ("assistant", "ü🎉"), ("user", "Hm?"), ("user", "Hm?"), ("assistant", "Bye.")]
    rows = [(c, t, *said[t]) for c in range(700) for t in range(1 + c % 6) if c % 100 or c < 300]
    nodes = as_nodes(trie.prefix_trie(trie.rebuilt_conversations(turns(spark, rows))))
    assert nodes == trie_by_hand(rows)
    root = next(n for n in nodes if n[1] == 0)
    assert root[3] == len({r[0] for r in rows}) and root[7] != trie.EMPTY_SHA256


def test_trie_of_long_conversations(spark):
    """Tails that no other conversation shares take no round, and shared ones only where they part."""
    rows = [(c, t, "user", f"{t}" if t < 150 else f"{c} {t}") for c in (600, 602, 603) for t in range(200)]
    rows += [(604, t, "user", f"{t}") for t in range(170)] + [(605, t, "user", f"{t}") for t in range(150)]
    assert as_nodes(trie.prefix_trie(trie.rebuilt_conversations(turns(spark, rows)))) == trie_by_hand(rows)
    assert trie.stops_of({0: 5, **dict.fromkeys(range(1, 151), 5)}, 200) == [150]
    assert trie.stops_of({0: 9, 1: 4, 2: 4, 3: 2}, 3) == [0, 2, 3]
    assert trie.stops_of({0: 1}, 4) == []


def test_trie_of_the_table(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    df = queries.QUERIES["op13_conversation_trie"](spark, FOLDER)
    expected = connection.execute(queries.SQL["op13_conversation_trie"])
    columns = [c[0] for c in expected.description]
    assert as_counter(df.collect(), df.columns) == as_counter(expected.fetchall(), columns)
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_nodes(df) == trie_by_hand(rows)


def test_chars_are_code_points(spark):
    rows = [(200, 0, "user", "🎉é"), (200, 1, "user", "x"), (201, 0, "user", "🎉é"), (202, 0, "user", "🎉é")]
    nodes = trie.prefix_trie(trie.rebuilt_conversations(turns(spark, rows), shared=1))
    assert nodes.where("depth = 1").agg(F.sum("saved_tokens")).first()[0] == 4
