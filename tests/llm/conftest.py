import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, schema=SCHEMA):
        full = [(*r, *[None] * (5 - len(r))) for r in rows] if schema is SCHEMA else rows
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, ties, copies that differ in blanks, a long text, other scripts."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 6))) for _ in range(300)]
    prose = [" ".join(draw.choices(vocabulary, k=60)) for _ in range(12)]
    rows = [(i, p, "en", "s1", None) for i, p in enumerate(prose)]
    rows += [(100 + i, p.replace(" ", "  ", 1), "en", "s2", None) for i, p in enumerate(prose[:5])]
    rows += [(200 + i, p + " tail", None, None, None) for i, p in enumerate(prose[3:8])]
    rows += [
        (300, None, "en", "s1", None), (301, "", None, "s1", None), (302, " \t\n", "de", None, None),
        (303, "One", "en", "s3", None), (304, "one", "en", "s3", None), (305, "漢字 🙂 漢字 🙂\n漢字 🙂 漢字 🙂", None, "s3", None),
        (306, " ".join(draw.choices(vocabulary, k=30_000)), "en", "s4", None),
        (307, "a b c d e f g h " * 9, "en", "s4", None), (308, "x\n" * 40, "en", "s4", None),
    ]
    return rows


@pytest.fixture
def clashing():
    """The same rows with extra columns named like columns that the operators add."""
    names = "kept size copies unit _hash _norm text_sha256 bands shard n_words common keep_id group_size _gone salt band"

    def add(df):
        for n in names.split():
            df = df.selectExpr("*", f"'x' AS {n}")
        return df

    return add
