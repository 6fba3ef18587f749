import random

import pytest

FOLDER = "/root/testdata/sf0.001"
#: Columns that clash with names inside the operators.
EXTRA = "id long, row long, rep string, key string, words string, window string, item long, size int, p double, _bucket long, _row_number long, _text_changed string, shift int, place int"


def long_text(n=150_000, seed=1):
    rng = random.Random(seed)
    out = []
    while sum(map(len, out)) + len(out) < n:
        out.append("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))))
    return " ".join(out)


def odd_rows():
    prose = "The quick brown fox jumps over the lazy dog while seven wizards quietly box the jugs"
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "1234 5678 !!"), (5, prose), (5, prose), (6, prose), (None, prose), (None, None), (7, long_text()), (8, "one two"), (9, "\u0000   é \U0001f600 \x1c ſ K İ"), (10, "the " * 3000)]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None if t is None else len(t)) + tuple(range(1, 3)) + ("r", "k", "w", "x", 1, 1, 0.5, 1, 2, "c", 1, 1) for k, (i, t) in enumerate(texts)]


SHAPE = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Documents with nulls, empty and very long texts, repeated rows and clashing columns, as a table."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), SHAPE).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SHAPE).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def table(spark, tmp_path, rows, shape):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, shape).write.parquet(path)
    return spark.read.parquet(path)


def no_python(df):
    """The plan of a native operator holds no Python."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))
