"""Quality rules, secret scan and exact dedup against plain Python."""

import hashlib
import math
import random
from collections import Counter

import llm_brute as brute
import pytest
from pyspark.sql import functions as F

from holdfast.llm import exact_dedup, quality, secret_scan


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@pytest.mark.parametrize("which", ["given", "odd"])
def test_quality_counts(which, given, odd_rows, table):
    df = given if which == "given" else table(odd_rows)
    text = dict(pairs(df))
    out = quality.judge(df).collect()
    assert len(out) == len(text)
    for r in out:
        assert tuple(r[c] for c in COUNTS) == brute.quality(text[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_quality_rejects_symbols_and_keeps_prose(given, table):
    prose = [(r.doc_id, r.text) for r in given.collect() if len(r.text.split()) > 150 and "%%" not in r.text][:5]
    junk = [(1000 + d, " ".join(w + "%%&&" for w in t.split())) for d, t in prose]
    rows = table([(d, t, "en") for d, t in prose + junk])
    refs = quality.references(given)
    kept = {r.doc_id for r in quality.judge_rows(given.unionByName(rows)).filter("kept").select("_d.doc_id").collect()}
    assert {d for d, _ in prose} <= kept and not {d for d, _ in junk} & kept
    assert all(abs(sum(r.classes) - 1) < 1e-9 and abs(sum(r.shares) - 1) < 1e-9 for r in refs)


def test_quality_rejects_texts_without_common_words(given, table):
    def uncommon(i):  # letters, blanks and lengths of prose
        digest = hashlib.sha512(str(i).encode()).hexdigest()
        return digest[: 3 + i % 6].translate(str.maketrans("0123456789", "ghijklmnop"))

    strange = {-1: " ".join(uncommon(i) for i in range(400)), -2: " ".join([uncommon(7)] * 200)}
    prose = [r.doc_id for r in given.collect() if len(r.text.split()) > 150]
    rows = table([(d, t, "en") for d, t in strange.items()])
    rules = quality.QualityRules(max_repeat_percent=100)
    out = {r["_d"].doc_id: r for r in quality.judge_rows(given.unionByName(rows), rules).collect()}
    for d in strange:  # by this rule alone
        assert out[d].class_distance < rules.max_class_distance and not out[d].base_failed and not out[d].kept, d
    assert sum(out[d].kept for d in prose) > 0.75 * len(prose)


def test_quality_rejects_texts_of_marks_or_controls(given, table):
    marks, controls = "?!.,;:-_@~^=", "\x00\x01\x02\x1b\u200b\ufffd"
    strange = {
        -1 - i: " ".join("".join(sample[(7 * j + k * k) % len(sample)] for k in range(3 + j % 5)) for j in range(90))
        for i, sample in enumerate((marks, controls, "①②③④⑤⑥"))
    }
    rules = quality.QualityRules(max_repeat_percent=100)
    rows = given.unionByName(table([(d, t, "en") for d, t in strange.items()]))
    out = {r["_d"].doc_id: r for r in quality.judge_rows(rows, rules).collect()}
    for d in strange:  # too short for the word rule
        assert out[d].word_distance is None and not out[d].base_failed, d
        assert out[d].class_distance > rules.max_class_distance and not out[d].kept, d


def test_quality_without_labels_or_rows(table, odd_rows, clashing):
    blank = table([(1, "a b", None), (None, None, None)])
    assert [r.class_distance for r in quality.judge(blank).collect()] == [None, None]
    assert quality.judge(table([])).collect() == []
    wide = clashing(table(odd_rows))
    kept = quality.keep_good(wide)
    assert kept.columns == wide.columns and kept.count() > 0


def test_secret_spans(given, table):
    odd = [
        (1, 'x token = "abcdefgh12" token: secret: abcdefgh1 PASSWORD=short api-key=aaaaaaaaaaa'),
        (2, "🙂🙂 AKIA" + "A1" * 8 + " AKIAAKIA12 " + "0123456789abcdef" * 2 + " " + "f" * 31),
        (3, "api_key:'Zz/+=.-_99' apikey=aaaaaaaa" + "é" + "secret=" + "0" * 40), (4, None), (5, ""),
    ]
    df = given.unionByName(table([(90_000 + d, t) for d, t in odd]))
    text = dict(pairs(df))
    for r in secret_scan.report(df).collect():
        spans = brute.secrets(text[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(brute.joined(spans).encode()).hexdigest()
        assert set(brute.joined(spans).split(",")) - {""} <= set(r.spans.split(","))
    assert secret_scan.report(table([])).collect() == []


def test_random_strings_are_found_and_repeats_are_not(table):
    letters = secret_scan.ENCODINGS["base62"]
    keys = []
    for i in range(40):  # bytes of a digest stand for random symbols
        raw = hashlib.sha512(str(i).encode()).digest()
        keys.append("".join(letters[b % 62] for b in raw[:48]))
    plain = ["ab1" * 16, "a1" + "b" * 46, "0123456789" * 4 + "abc", "word1-word1-word1-word1-word1"]
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(100 + i, f"see {k} here") for i, k in enumerate(plain)]
    out = {r.doc_id: r.spans for r in secret_scan.report(table(rows)).collect()}
    found = [i for i in range(40) if out[i] == "random:4:52"]
    assert len(found) >= 34
    assert not any("random" in out[100 + i] for i in range(len(plain)))


@pytest.mark.parametrize("which", ["given", "odd"])
def test_exact_groups(which, given, odd_rows, table):
    df = given if which == "given" else table(odd_rows)
    want = brute.exact(pairs(df))
    out = exact_dedup.resolve(df, capacity=16).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in out} == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out) and len(out) == len(want)


def test_exact_repeats_nulls_and_columns(table, clashing):
    rows = [(7, "a b"), (7, "a b"), (8, "ab"), (None, "a  b"), (None, "zz"), (9, None), (10, " "), (11, "c")]
    out = exact_dedup.resolve(table(rows)).collect()
    group = [r for r in out if r.text_sha256 == hashlib.sha256(b"ab").hexdigest()]
    assert len(out) == 8 and len(group) == 4
    assert {r.keep_id for r in group} == {None} and sum(r.kept for r in group) == 1  # the longest has no id
    wide = clashing(table(rows))
    kept = exact_dedup.keep_first(wide)
    assert kept.columns == wide.columns
    assert sorted(str(r.text) for r in kept.collect()) == [" ", "a  b", "c", "zz"]
    assert exact_dedup.resolve(table([])).collect() == []


def test_directory_splits_until_buckets_fit(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS _hash")
    depth, slots = exact_dedup.directory(keys, capacity=64)
    rows = slots.collect()
    assert depth >= 7 and len(rows) <= 1 << depth
    assert all(1 <= r.local_depth <= depth for r in rows)
    fill = keys.selectExpr(f"shiftrightunsigned(_hash, {64 - depth}) AS slot").join(slots, "slot").groupBy("bucket").count()
    assert fill.agg({"count": "max"}).first()[0] <= 64


def plain_test(token):
    """(encoding, length class, p) in plain Python, or None without an encoding."""
    name = next((n for n, abc in secret_scan.ENCODINGS.items() if set(token) <= set(abc)), None)
    abc = secret_scan.ENCODINGS[name]
    n, k = len(token), len(abc)
    codes = [abc.index(c) for c in token]

    def tail(z):
        return math.erfc(z / math.sqrt(2)) / 2

    chi = sum((c - n / k) ** 2 / (n / k) for c in (token.count(x) for x in abc))
    df = k - 1
    ps = [tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))]
    middle = (k - 1) / 2
    high = [c > middle for c in codes]
    runs, up, down = 1 + sum(a != b for a, b in zip(high, high[1:])), sum(high), n - sum(high)
    var = 2 * up * down * (2 * up * down - n) / (n * n * (n - 1))
    ps.append(2 * tail(abs((runs - 2 * up * down / n - 1) / math.sqrt(var)) if var > 0 else 9.0))
    spread = sum((c - middle) ** 2 for c in codes)
    product = sum((a - middle) * (b - middle) for a, b in zip(codes, codes[1:]))
    ps.append(2 * tail(abs(product / spread * math.sqrt(n)) if spread else 9.0))
    x = -sum(math.log(max(min(q, 1.0), 1e-300)) for q in ps)
    return name, int(math.log2(n)), math.exp(-x) * (1 + x + x * x / 2)


def plain_thresholds(tokens, max_false=0.1):
    classes = {}
    for t in set(tokens):
        name, size, p = plain_test(t)
        classes.setdefault((name, size), []).append(p)
    out = {}
    for key, ps in classes.items():
        sure = sum(p > 0.75 for p in ps)
        for t in secret_scan.THRESHOLDS:
            accepted = sum(p > t for p in ps)
            if sure and max(0, accepted - sure - sure * (0.75 - t) * 4) <= max_false * accepted:
                out[key] = t
                break
    return out


def strings(seed=3):
    draw = random.Random(seed)
    out = []
    for abc in secret_scan.ENCODINGS.values():
        out += ["".join(draw.choices(abc, k=draw.choice([20, 40]))) for _ in range(12)]
    out += ["".join(draw.choice(["key", "user", "id", "-", "_", "2024", "prod"]) for _ in range(8)).ljust(20, "x") for _ in range(30)]
    out += ["a1" * 12, "0" * 19 + "a", "abc123" * 5]
    return out


def test_p_values_and_thresholds_equal_plain_ones(table, tmp_path):
    tokens = strings()
    table([(t,) for t in tokens], "token string").write.parquet(f"{tmp_path}/tokens")
    frame = table([], "token string").sparkSession.read.parquet(f"{tmp_path}/tokens")
    rows = secret_scan.tested(frame).collect()
    for r in rows:
        name, size, p = plain_test(r.token)
        assert (r.encoding, r.size_class) == (name, size) and r.p == pytest.approx(p, abs=2e-6)
    assert secret_scan.thresholds(secret_scan.tested(frame.distinct())) == plain_thresholds(tokens)


def test_copies_of_one_string_change_no_other_verdict(table):
    tokens = [t for t in strings(8) if any(c.isdigit() for c in t) and any(c.isalpha() for c in t)]
    rows = [(i, f"see {t} here") for i, t in enumerate(tokens)]
    before = {r.doc_id: r.spans for r in secret_scan.report(table(rows)).collect()}
    copied = min(tokens, key=lambda t: abs(plain_test(t)[2] - 0.3))
    more = rows + [(10_000 + i, f"see {copied} here") for i in range(300)]
    after = {r.doc_id: r.spans for r in secret_scan.report(table(more)).collect()}
    assert {d: s for d, s in after.items() if d < 10_000} == before
    limits = plain_thresholds(tokens)
    for i, t in enumerate(tokens):
        name, size, p = plain_test(t)
        assert ("random" in before[i]) == (p > limits.get((name, size), 2) and not set(before[i].split(":")) & {"hex", "access", "assign"})


def test_a_class_of_words_accepts_nothing(table):
    rows = [(i, "word1-" * 4 + f"word{i % 10}-wordy") for i in range(60)]
    assert not any("random" in r.spans for r in secret_scan.report(table(rows)).collect())


def test_secret_scan_of_odd_rows(table, clashing):
    long = "x " * 200_000 + "AKIA" + "A1" * 8
    rows = [(None, "secret=abcdefgh1"), (1, long), (1, long), (2, None)]
    df = clashing(table(rows)).selectExpr("*", "'x' AS base", "'x' AS tokens", "'x' AS _row", "'x' AS random", "'x' AS p")
    out = sorted(((r.doc_id or 0, r.n_assign, r.n_access, r.spans) for r in secret_scan.report(df).collect()))
    hit = (1, 0, 1, "access:400000:400020")
    assert out == [(0, 1, 0, "assign:0:16"), hit, hit, (2, 0, 0, "")]


def test_rare_languages_are_judged_by_the_base_rules_only(given, table):
    odd = " ".join("#$%&|<>" for _ in range(200)) + " " + " ".join(f"{i}" for i in range(100))
    rows = given.unionByName(table([(50_000, odd, "rare", None), (50_001, odd, None, None)]))
    out = {r.doc_id: r for r in quality.judge(rows).collect()}
    assert out[50_000].base_failed == out[50_001].base_failed
    assert out[50_000].kept == (not out[50_000].base_failed) and not out[50_001].kept


def test_more_languages_than_once_allowed(table):
    rows = [(i, " ".join(f"w{i % 70}x{k}" for k in range(30)), f"l{i % 70}", None) for i in range(70 * 21)]
    refs = quality.references(table(rows))
    assert len(refs) == 70


def test_distances_equal_plain_ones(given):
    rules = quality.QualityRules(min_chars_for_classes=1, min_words_for_common=1)
    refs = quality.references(given, rules)

    def distance(a, b):
        total = 0
        for p, q in zip(a, b):
            m = (p + q) / 2
            total += (p * math.log2(p / m) if p else 0) + (q * math.log2(q / m) if q else 0)
        return math.sqrt(max(0, total / 2))

    texts = dict(pairs(given))
    hashes = {}
    words = sorted({w for t in texts.values() for w in brute.WORD.findall(t or "")})
    frame = given.sparkSession.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) AS h")
    hashes = {r.w: r.h for r in frame.collect()}
    for r in quality.judge_rows(given, rules).limit(60).collect():
        found = [hashes[w] for w in brute.WORD.findall(texts[r["_d"].doc_id] or "")]
        if not found:
            continue
        best = []
        for ref in refs:
            shares = [sum(h in cell for h in found) / len(found) for cell in map(set, ref.cells)]
            best.append(distance([*shares, max(0, 1 - sum(shares))], ref.shares))
        assert r.word_distance == pytest.approx(min(best), abs=1e-9)


def test_results_hang_on_the_directory(given):
    keys = exact_dedup._hashed(given).select("doc_id", "n_chars", "_hash")
    depth, slots = exact_dedup.directory(keys, 16)
    whole = exact_dedup.chains(given, depth, slots)
    texts = len({v[2] for v in brute.exact(pairs(given)).values()})
    assert whole.count() == texts and slots.count() > 4
    first = slots.orderBy("slot").first()["slot"]
    torn = slots.filter(f"slot != {first}")
    assert exact_dedup.chains(given, depth, torn).count() < texts
    assert exact_dedup.addressed(keys, depth, torn).count() < keys.count()
    split = exact_dedup.chains(given, depth, slots.withColumn("bucket", F.col("slot")))
    assert split.select("bucket").distinct().count() >= whole.select("bucket").distinct().count()


def test_survivors_of_a_hot_text(table):
    rows = [(i, "same  text" if i == 77 else "same text") for i in range(500)] + [(900 + i, f"own {i}") for i in range(20)]
    rows += [(77, "same  text")] * 3
    kept = exact_dedup.keep_first(table(rows)).collect()
    assert sorted(r.doc_id for r in kept) == [77, *range(900, 920)]


def test_quality_is_fitted_on_every_labelled_row(spark):
    n = 9000
    docs = spark.range(n).selectExpr(
        "id AS doc_id", "concat_ws(' ', repeat('the ', cast(1 + pow(id % 89, 2) % 40 AS int)), repeat('of ', 40), concat('w', id)) AS text",
        "'en' AS lang", "'s' AS source", "1L AS n_chars",
    )
    rules = quality.QualityRules(min_words_for_common=1, length_classes=1, common_words=2, max_repeat_percent=100)
    the = [1 + (i % 89) ** 2 % 40 for i in range(n)]
    refs, rows = quality.fitted(docs, rules)
    assert rows.count() == n
    assert refs[0].shares[:2] == pytest.approx(tuple(x / (sum(the) + 41 * n) for x in (40 * n, sum(the))), abs=1e-12)
    distances = sorted(r["_word_ds"][0] for r in quality.judge_rows(docs, rules).select("_word_ds").collect())
    low, middle = distances[int(0.05 * (n - 1))], distances[int(0.5 * (n - 1))]
    cap = min(rules.max_word_distance, 0.95 * quality.without_common_words(refs[0]))
    want = min(cap, middle + max(rules.word_fence * (middle - low), middle / 2))
    assert quality.word_limits(rows, refs, rules)[0][0] == pytest.approx(want, abs=1e-4)


def test_quality_measures_a_text_once_and_splits_it_twice(given, monkeypatch):
    uses = {"words": 0, "marks": 0}
    words, parts = quality.sh.words, quality._class_parts

    def counted(name, function):
        def call(text):
            uses[name] += 1
            return function(text)
        return call

    monkeypatch.setattr(quality.sh, "words", counted("words", words))
    monkeypatch.setattr(quality, "_class_parts", counted("marks", parts))
    rows = quality.judge_rows(given)
    assert uses == {"words": 2, "marks": 1}  # word counts for the references, then the only measurement
    assert "Generate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_quality_counts_words_in_one_shuffle(given):
    _, labelled = quality.word_references(given)
    found = quality.frequent_words(labelled)
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan
    totals = {r["lang"]: r["count"] for r in rows if r["_rank"] is None}
    want = Counter()
    for r in labelled.collect():
        want[r.lang] += len(brute.WORD.findall(r.text))
    assert totals == dict(want)
    assert max(r["_rank"] for r in rows if r["_rank"]) <= quality.QualityRules().common_words


def test_written_rows_give_the_references_of_the_texts(given, table):
    rows = given.unionByName(table([(None, "% & # " * 90, "en", None), (-5, None, "en", None), (-6, "% " * 90, None, None)]))
    refs, labelled = quality.fitted(rows)
    words, _ = quality.word_references(rows)
    measured = quality.measured(rows, words, ["doc_id", "lang"])
    assert measured.select("_d.*").columns == ["doc_id", "lang"]
    counts = measured.filter("_labelled").withColumn("lang", F.col("_d.lang"))
    assert quality.with_classes(words, counts) == refs
    rules = quality.QualityRules(min_words_for_common=1)
    counts = counts.select("lang", "n_words", quality._long_distances(refs, rules).alias("_word_ds"))
    assert quality.distance_limits(counts, refs, rules) == quality.word_limits(labelled, refs, rules)
