"""Improbable-feature digests against a plain version; whole reports on odd tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from holdfast.llm import fingerprints as fp


def pieces(c):
    return round(fp.UNIT * c / fp.WINDOW * math.log2(fp.WINDOW / c))


def plain_classes(data):
    step = 5 * fp.UNIT // 1000 + 1
    return [
        sum(pieces(c) for c in Counter(data[i : i + fp.WINDOW]).values()) // step for i in range(len(data) - fp.WINDOW + 1)
    ]


def plain_picks(data, ranks, picked=8):
    w = fp.WINDOW
    classes = plain_classes(data)
    if not classes:
        return [data] if data else []
    times, ranges = Counter(), max(1, len(classes) - w + 1)
    for a in range(ranges):
        times[min(range(a, min(a + w, len(classes))), key=lambda i: (ranks[classes[i]], i))] += 1
    enough = min(picked, ranges, max(times.values()))
    return [data[i : i + w] for i in sorted(times) if times[i] >= enough]


def plain_digest(features, per_filter=160):
    features = list(dict.fromkeys(features))
    filters = []
    for a in range(0, len(features), per_filter):
        bits = set()
        for f in features[a : a + per_filter]:
            h = hashlib.sha1(f).digest()
            bits |= {int.from_bytes(h[2 * k : 2 * k + 2], "little") % 2048 for k in range(5)}
        filters.append(sum(1 << b for b in bits))
    return tuple(filters)


@pytest.fixture(scope="module")
def texts(odd_rows):
    draw = random.Random(3)
    more = ["", "a", "ab" * 15, "x" * 31, "x" * 32, "x" * 33, "z" * 500, "".join(draw.choices("abc \n", k=63)),
            "".join(draw.choices("abcdefgh  ", k=64)), "é🙂" * 40]
    return [(r[1] or "")[:3000].encode() for r in odd_rows] + [m.encode() for m in more]


def test_classes_are_window_entropies(texts):
    for t in texts:
        assert fp.entropy_classes(np.frombuffer(t, np.uint8)).tolist() == plain_classes(t)


def test_counts_picks_and_filters(texts):
    counts = fp.class_counts(texts)
    want = Counter(c for t in texts for c in plain_classes(t))
    assert {i: int(n) for i, n in enumerate(counts) if n} == dict(want)
    ranks = fp.rarity(counts)
    assert sorted(range(fp.CLASSES), key=lambda c: (want.get(c, 0), c)) == np.argsort(ranks).tolist()
    digester = fp.Digester(ranks)
    for t, picks, digest in zip(texts, digester.picks(texts), digester.digests(texts), strict=True):
        assert picks == plain_picks(t, ranks)
        assert digest.filters == plain_digest(picks)
        assert sum(digest.features) == len(set(picks))
        assert fp.Digest.parsed(digest.text()) == digest


def test_long_texts_in_segments(texts, monkeypatch):
    long = b" ".join(texts)
    whole = fp.class_counts([long])
    digester = fp.Digester(fp.rarity(whole))
    want = digester.picks([long, b"short", long])
    monkeypatch.setattr(fp, "SEGMENT", 700)
    assert fp.class_counts([long]).tolist() == whole.tolist()
    assert digester.picks([long, b"short", long]) == want


def test_likeness(texts):
    digester = fp.Digester(fp.rarity(fp.class_counts(texts)))
    prose = max(texts, key=len)
    other = bytes(random.Random(1).choices(b"abcdefgh ", k=3000))
    a, b, c, none = digester.digests([prose, prose[:2000], other, b""])
    assert fp.likeness(a, a) == 1 == fp.likeness(none, none)
    assert fp.likeness(a, none) == 0 == fp.likeness(none, c)
    assert fp.likeness(a, b) == fp.likeness(b, a) > 0.9
    assert fp.likeness(a, c) < 0.1


def plain_edits(rows):
    """edited text per row, for rows sorted by descending doc_id, null last, then text."""
    line = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    return [(d, t, t[: len(t) - len(t) // 3] + n[: len(t) // 3], n) for (d, t), (_, n) in zip(line, line[1:] + line[:1])]


@pytest.mark.parametrize("partitions", ["3", "8"])
def test_report(spark, table, clashing, odd_rows, partitions):
    rows = odd_rows + [(5, "again " * 30, None, None, None), (None, "no id " * 20, None, None, None), (300, None, None, None, None)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fp.report(clashing(table(rows)).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    ranks = fp.rarity(fp.class_counts([(r[1] or "").encode() for r in rows]))
    digester = fp.Digester(ranks)
    want = Counter()
    for d, t, e, n in plain_edits(rows):
        a, b, c = digester.digests([t.encode(), e.encode(), n.encode()])
        want[(d, len(t), hashlib.sha256(e.encode()).hexdigest(), a.text(), b.text(),
              fp.likeness(a, b), fp.likeness(a, c), sum(a.features))] += 1
    assert Counter(tuple(r) for r in got) == want


def test_single_row_and_empty_table(table):
    assert fp.report(table([])).count() == 0
    (row,) = fp.report(table([(1, "one text " * 20)])).collect()
    assert row["near_next"] == 1 and row["n_chars"] == 180
    (row,) = fp.report(table([(1, None)])).collect()
    assert (row["fingerprint"], row["near_edited"], row["n_features"]) == ("", 1.0, 0)


def test_edited_texts_are_near_and_others_are_not(given):
    rows = [r for r in fp.report(given).collect() if r["n_chars"] > 400]
    near = sorted(r["near_edited"] for r in rows)
    assert near[len(near) // 20] > 0.5
    apart = sorted(r["near_next"] for r in rows)
    assert apart[int(len(apart) * 0.95)] < 0.1
