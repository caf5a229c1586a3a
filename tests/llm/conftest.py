import random

import pytest


@pytest.fixture(autouse=True, scope="session")
def _workers(spark):
    from rillframe.llm.common import ship

    ship(spark)


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


#: Names that operators use inside.
EXTRA = (
    "key", "size", "n", "stats", "unit", "spans", "node", "tag", "row", "held", "_key", "__text_bytes", "a.b", "c0", "c1", "mark", "kept", "_kept", "_gone", "_first_key", "_first_mark", "_one",
    "_mix_key", "_mix_words", "_mix_size", "_mix_own", "_mix_text", "_mix_hold", "_mix_tag", "number", "hold", "cut", "taken", "taken_text", "__seed", "__text", "__t", "__decoded", "secrets", "its", "that",
)


def documents(spark, rows, extra=True):
    """rows: (doc_id, text, lang, source); with columns whose names the operators use inside."""
    df = spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], SCHEMA)
    if extra:
        df = df.selectExpr("*", *[f"concat('x', cast(doc_id as string)) as `{name}`" for name in EXTRA], "map('k', text, 'l', source) as pairs", "struct(map('k', doc_id) as inner) as nested")
    return df


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long and repeated texts, null keys and sources, ties."""
    rng = random.Random(3)
    base = words(rng, 60)
    rows = [
        (0, None, "en", "a"), (1, "", "en", "a"), (2, " \n\t ", "fr", None), (3, "one", None, "b"), (4, "One", "en", "b"), (5, base, "en", "c"), (6, base, "en", "c"), (6, base, "en", "c"),
        (7, base + " tail", "fr", "d"), (8, words(rng, 30_000), "en", "a"), (9, "x" * 50_000, "en", "b"), (10, "é😀 ñ " * 50, "fr", "a"), (None, base, "en", None), (None, None, None, None),
        (11, "▁ literal ▁block", "en", "a"), (12, "a b\u0085c\x1cd", "en", "c"), (13, "ab " * 300, "en", "a"),
    ]
    for i in range(20, 60):
        rows.append((i, words(rng, rng.randrange(5, 120)), rng.choice(["en", "fr"]), rng.choice("abcd")))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return documents(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])
