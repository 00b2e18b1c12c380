"""The corpus pipeline on the smallest table, stage by stage, against plain Python."""

from collections import Counter

import llm_brute as brute

import corpus_pipeline
from holdfast.llm import mixing, packing, quality


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        kept.append((before, docs))
        if i < 4:
            assert docs.columns == columns and docs.dtypes == start.dtypes

    def rows(df):
        return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    verdicts = {r.doc_id: r for r in quality.judge(start).collect()}
    assert ids(kept[0][1]) == sorted(d for d, r in verdicts.items() if r.kept)
    assert not any(r.kept and brute.quality(t)[5] for d, t in rows(start) for r in [verdicts[d]])
    exact = brute.exact(rows(kept[1][0]))
    assert ids(kept[1][1]) == sorted(d for d, g in exact.items() if g[0] == d)
    near = brute.components(rows(kept[2][0]), words=5)
    assert ids(kept[2][1]) == sorted(d for d, g in near.items() if g[1] == d)
    plan = mixing.plan(kept[3][0]).collect()
    assert Counter(ids(kept[3][1])) == Counter({r.doc_id: r.copies for r in plan if r.copies})
    pieces = docs.collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(ids(kept[3][1]))
    per_sequence = Counter()
    for r in pieces:
        per_sequence[r.sequence_id] += r.length
    assert max(per_sequence.values()) <= packing.PackRules().size
    whole = sum(r.doc_tokens for r in pieces if r.start == 0)
    assert whole == sum(per_sequence.values())
    again = corpus_pipeline.run(spark, sf).select("doc_id", "start", "ids_crc32")
    assert sorted(map(tuple, again.collect())) == sorted((r.doc_id, r.start, r.ids_crc32) for r in pieces)


def test_odd_and_empty_tables(spark, tmp_path, table, clashing, odd_rows):
    """Nulls in every column, blanks, copies, repeated ids and rows, a long text, clashing columns; then no row at all."""
    words = odd_rows[11][1].split()[:40]
    extra = [(700, " ".join(words), "en", "s1", 1), (700, " ".join(words), "en", "s1", 1), (700, " ".join(words[::-1]), None, "s2", 1),
             (701, "  ".join(words), None, None, None), (None, " ".join(words[5:] + words[:5]), "en", "s9", None),
             (None, " ".join(words), "en", "s9", None), (None, None, None, None, None)]
    odd = clashing(table([*odd_rows, *extra]))
    for name, df in (("odd", odd), ("empty", odd.filter("false"))):
        folder = f"{tmp_path}/{name}"
        df.coalesce(2).write.parquet(f"{folder}/documents.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        seen = [docs]
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(f"{folder}/stage{i}")
            docs = spark.read.parquet(f"{folder}/stage{i}")
            seen.append(docs)
            assert i == 4 or (docs.columns == df.columns and docs.dtypes == df.dtypes)
        if name == "empty":
            assert [s.count() for s in seen] == [0] * 6
            assert corpus_pipeline.run(spark, folder).count() == 0
            continue
        texts = [[(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()] for s in seen[:5]]
        assert all(not brute.quality(t)[5] for _, t in texts[1])
        assert Counter("".join(t.split()) for _, t in texts[2]) == Counter({"".join(t.split()) for _, t in texts[1]})
        # Copies of the 40 words: the row with the most blanks stays.
        assert [d for d, t in texts[2] if t.split() == words] == [701]
        linked = [set(brute.shingles(t, 5)) for d, t in texts[3] if d is not None]
        for i, a in enumerate(linked):
            assert not any(100 * len(a & b) >= 80 * len(a | b) for b in linked[:i])
        assert {(d, t) for d, t in texts[4]} <= set(texts[3])
        pieces = docs.collect()
        whole = Counter(d for d, _ in texts[4])
        assert Counter(r.doc_id for r in pieces if r.start == 0) == whole
        assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
