"""The prefix trie against a plain one: long, empty, repeated and odd conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from holdfast.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    rebuilt = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - c % 20, [])[:h] + mine[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in rebuilt.items():
        ends[tuple(t)].append(c)
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    inner = {p[:-1] for p in members if p}
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        if p:
            kids[p[:-1]] += 1
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in inner
            saved[p[:d]] += (len(m) - 1) * words
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    }


def result(spark, rows, width, schema=SCHEMA):
    got = prefix_trie.trie(spark.createDataFrame(rows, schema), width).collect()
    out = {tuple(r) for r in got}
    assert len(out) == len(got)
    return out


@pytest.fixture(scope="module")
def odd_conversations():
    draw = random.Random(11)
    rows = []
    for c in [*range(0, 45), 1_000_003, 1_000_000, 9_999_999]:
        for turn in range(draw.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, draw.choice(["user", "assistant", None]), draw.choice(["yes", "a b c", "no  way\n", "", None])))
    rows += [(60, None, "user", "first by null"), (60, 0, "user", "then this")]
    rows += [(None, 0, "user", "of no conversation")]
    rows += [(c, t, "user", f"same {t % 3}") for c in range(80, 100) for t in range(23)]
    rows += [(100 + c, 0, "user", "hot start") for c in range(60)]
    rows += [(200, -5_000, "user", "early"), (200, 9_000, "user", "late"), (200, 1, "user", "w " * 40_000)]
    return rows


@pytest.mark.parametrize("width", [1, 3, 8])
def test_equals_plain_trie(spark, odd_conversations, width):
    assert result(spark, odd_conversations, width) == plain_trie(odd_conversations)


def test_turnless_conversations_end_in_the_root(spark):
    alone = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(alone, 0, "user", "taken away")]
    assert result(spark, rows, 8) == plain_trie(rows) == {
        (alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())
    }


def test_repeated_turn_numbers_stay(spark):
    c = next(c for c in range(20) if zlib.crc32(str(c).encode()) % 4 == 0)
    rows = [(c, 0, "user", "x")] * 3
    assert {r[1] for r in result(spark, rows, 2)} == {0, 1, 2, 3}


def test_empty_table_and_extra_columns(spark):
    assert result(spark, [], 8) == set()
    names = "node parent at n block prior level t1 n_own base"
    frame = spark.createDataFrame([(0, 0, "user", "x y")], SCHEMA).selectExpr("*", *[f"'q' AS {n}" for n in names.split()])
    assert {tuple(r) for r in prefix_trie.trie(frame).collect()} == plain_trie([(0, 0, "user", "x y")])


def test_long_id_lists_run_through_one_hash(spark):
    rows = [(c, 0, "user", "all the same") for c in range(0, 20_000, 20)] + [(10**9 + 20 * i, 0, "user", "all the same") for i in range(300)]
    assert result(spark, rows, 8) == plain_trie(rows)


def test_rollup_is_in_the_plan(spark):
    turns = spark.createDataFrame([(0, 0, "user", "x")], SCHEMA)
    blocks = prefix_trie.blocks_of(prefix_trie.rebuilt(prefix_trie.placed_turns(turns)), 4)
    plan = prefix_trie.nodes_of(blocks, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan and "SortAggregate" not in plan and "Python" not in plan
