"""Near-dedup, mixing and sharding against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import llm_brute as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import kd_shards, mixing, near_dedup


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["given", "odd"])
def test_components(which, given, odd_rows, table):
    df = given if which == "given" else table(odd_rows)
    want = brute.components(pairs(df))
    out = near_dedup.components(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_chains_of_near_copies(table):
    """Copies drift away from each other, so heads alone do not link them all."""
    draw = random.Random(3)
    rows, words = [], [f"w{i}" for i in range(80)]
    for i in range(60):
        words = list(words)
        words[draw.randrange(80)] = f"n{i}"
        rows.append((draw.randrange(10**6), " ".join(words)))
    want = brute.components(rows)
    out = near_dedup.components(table(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_near_repeats_nulls_and_columns(table, clashing):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(3, base), (2, base + " x"), (2, "other text of the same id"), (5, "Other TEXT of the same id"),
            (None, base), (9, None), (8, "")]
    out = near_dedup.components(table(rows)).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(3, 2), (2, 2), (5, 2), (None, None), (9, 9), (8, 8)}
    wide = clashing(table(rows))
    kept = near_dedup.keep_one(wide)
    assert kept.columns == wide.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 2, 8, 9]
    assert near_dedup.components(table([])).collect() == []


def components_of_rows(rows):
    """Sorted (doc_id, n_shingles, component_id) where rows of one id with words are one document."""
    own = brute.components([(i, t) for i, (_, t) in enumerate(rows)])
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, _) in enumerate(rows):
        a, b = find(d), find(rows[own[i][1]][0])
        root[max(a, b)] = min(a, b)
    return sorted((d, own[i][0], find(d)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_small_tiles_and_repeated_ids(table, seed):
    """Several drifting chains; ids shared by texts of up to three chains; tiles of a few members."""
    draw = random.Random(seed)
    rows = []
    for chain in range(4):
        words = [f"c{chain}w{i}" for i in range(80)]
        for i in range(40):
            words = list(words)
            words[draw.randrange(80)] = f"n{chain}x{i}"
            rows.append((chain * 1000 + draw.randrange(1000), " ".join(words)))
    shared = [(7, rows[5][1]), (7, rows[45][1]), (7, rows[85][1]), (7, rows[85][1])]
    rules = near_dedup.NearRules(group=4, tile=3, sign_tile=7)
    for given_rows in (rows, rows + shared):
        out = near_dedup.components(table(given_rows), rules).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == components_of_rows(given_rows)


def test_bucket_of_unconnected_members_moves_no_texts(table, spark):
    """Members that share a band but agree nowhere else end at their signatures."""
    draw = np.random.default_rng(3)
    rules = near_dedup.NearRules(sign_tile=64)
    rows = [(9, i, i, 50, i, 300, draw.bytes(252), [9, *draw.integers(100, 1 << 60, 41).tolist()]) for i in range(298)]
    same = draw.bytes(252)
    rows += [(9, i, i, 50, i, 300, same, [9, *draw.integers(100, 1 << 60, 41).tolist()]) for i in (400, 401)]
    apart = spark.createDataFrame(
        rows, "band bigint, rep bigint, set_a bigint, n bigint, root bigint, _size bigint, places binary, bands array<bigint>")
    assert sorted(r.rep for r in near_dedup.likely_members(apart, rules).collect()) == [400, 401]


def test_hot_classes_are_joined_apart(spark):
    rows = [(i, 1, 1, 3) for i in range(3000)] + [(i, i, 2, 3) for i in range(5000, 5200)] + [(9999, 0, 0, 0), (None, 1, 1, 3)]
    sigs = spark.createDataFrame(rows, "doc_id bigint, set_a bigint, set_b bigint, n_shingles bigint")
    classes = sigs.filter("doc_id is not null and n_shingles > 0").groupBy(*near_dedup.CLASS).agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    for most in (1, 10_000):
        out = near_dedup.with_class(sigs, classes, "rep", most).collect()
        assert {(r.doc_id, r.rep) for r in out} == {(d, {1: 0, 2: d, 0: None}[b]) for d, a, b, n in rows}
        assert len(out) == len(rows)


def test_signature_agreement_follows_similarity():
    sketch = near_dedup.SuperMinHash(252)
    draw = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        errors = []
        for _ in range(20):
            both = draw.integers(0, 1 << 63, 400).astype(np.uint64)
            own = round(400 * (1 - share) / 2)
            a, b = both[: 400 - own], both[own:]
            s = sketch.signatures([a, b])
            real = (400 - 2 * own) / 400
            errors.append((s[0] == s[1]).mean() - real)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04
    one = sketch.signatures([both[:1], both[:1]])
    assert (one[0] == one[1]).all() and (one < near_dedup.UNSET).all()


def test_star_components(table, spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    root = list(range(1061))
    for _ in range(70):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(near_dedup.star_components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert all(got.get(n, n) == root[n] for ab in links for n in ab)


@pytest.mark.parametrize("which", ["given", "odd"])
def test_mixing_targets(which, given, odd_rows, table):
    df = given if which == "given" else table(odd_rows)
    text = dict(pairs(df))
    out = mixing.plan(df).collect()
    assert len(out) == len(text)
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in out:
        assert r.size == len((text[r.doc_id] or "").encode().split()) and r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    want = brute.targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= largest[s]
    again = {r.doc_id: r.taken for r in mixing.plan(df.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_flight_keeps_sums_and_decides():
    draw = np.random.default_rng(4)
    sizes, chances = draw.integers(1, 500, 2000), np.full(2000, 0.37)
    p = mixing.flight(sizes, chances, np.random.default_rng(1))
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert p.sum() == pytest.approx(chances.sum()) and (p * sizes).sum() == pytest.approx((chances * sizes).sum())
    landed = mixing.landing(sizes, p, chances)
    assert set(landed) <= {0.0, 1.0} and abs((landed * sizes).sum() - (chances * sizes).sum()) <= 1


def test_mixing_in_many_blocks(table):
    rows = [(i, "w " * (1 + i % 37), None, f"s{i % 2}") for i in range(3000)]
    out = mixing.plan(table(rows), mixing.MixRules(block=64)).collect()
    taken, target = Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(out) == 3000 and all(abs(taken[s] - target[s]) <= 37 for s in target)


def test_mix_rows(table, clashing, odd_rows):
    wide = clashing(table([*odd_rows, (None, "x y", None, None), (None, "x y", None, None)]))
    mixed = mixing.mix(wide)
    assert mixed.columns == wide.columns
    count = Counter(r.doc_id for r in mixed.collect())
    plan = mixing.plan(wide).collect()
    assert count == Counter({d: n for d, n in Counter(
        x for r in plan for x in [r.doc_id] * r.copies).items()})
    assert mixing.plan(table([])).collect() == []


@pytest.mark.parametrize("shards", [16, 5, 1])
def test_shards(given, shards):
    text = dict(pairs(given))
    out = kd_shards.assign(given, shards).collect()
    size, slots = Counter(), defaultdict(list)
    for r in out:
        raw = (text[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(out) == len(text) and set(size) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, most = sum(size.values()) / shards, max(r["size"] for r in out)
    assert all(abs(b - mean) <= most for b in size.values())


def test_shards_of_odd_tables(table, odd_rows, clashing):
    copies = [(9000, "same text", "en", "hot")] * 400 + [(None, None)] * 100
    out = kd_shards.assign(clashing(table([*odd_rows[:12], *copies])), 4).collect()
    size = Counter()
    for r in out:
        size[r.shard] += r["size"]
    assert len(out) == 512 and max(size.values()) - min(size.values()) <= 800
    assert kd_shards.assign(table([]), 16).collect() == []
    assert {r.shard for r in kd_shards.assign(table([(1, "a"), (2, "b")]), 16).collect()} <= set(range(16))
    whole = kd_shards.assign(table(odd_rows), target_bytes=50_000)
    assert whole.agg({"shard": "max"}).first()[0] >= 2


@pytest.mark.parametrize("which,shards", [("given", 16), ("given", 7), ("odd", 16), ("odd", 5), ("copies", 6)])
def test_shards_equal_a_plain_tree(which, shards, given, odd_rows, table):
    """Axis, weighted median and leaf of every row against plain recursion over sorted lists."""
    copies = [(9000, "same text", "en", "hot")] * 40 + [(i, "same text", "en", "hot") for i in range(200)] + [(None, None)] * 9
    df = given if which == "given" else table(odd_rows if which == "odd" else copies)
    rows = [r.asDict() for r in kd_shards._metadata(df).collect()]
    spans = {d: (min(r[d] for r in rows), max(r[d] for r in rows)) for d in kd_shards.DIMENSIONS}
    plain = brute.kd_shards(rows, spans, shards)
    want = Counter((r["doc_id"], r["size"], r["text_crc32"], plain[r["_row"]]) for r in rows)
    out = kd_shards.assign(df, shards).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in out) == want
