import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, fp int, `start` string, target double, key string, part int, _fp int, _K string, _key string, _spans int, _size long, _node int, _row string, old int, place string, slot int, _part int, `range` int, spans int"

EXTRA = (5, "K", "key", 6, 7, 8, "row", 9, "p", 10, 11, 12, None)


def odd_rows(seed=7):
    """Nulls in any column, empty and very long texts, ties, repeated rows; extra columns whose names clash with the operators' own."""
    r = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "été", "ße", "x1", "the", "of", "and", "stupid", "idiot", "naïve", "Ünder"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = say(60)
    texts = [None, "", " \t\n", "one", "two words", base, base, base.upper(), base + " more", base.replace("the", "a", 1), say(9), say(10), say(11), say(30000), "a" * 200000, "é b c\x1fd", "\x00nul \x7f", "password = 'hunter2hunter2X9' \n", "line one\nline two\n\nnew section here. And more!"]
    texts += [say(r.randint(1, 120)) for _ in range(40)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((None if i % 17 == 5 else i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 4}", None, i, "s", 3, "st", 0.5, "k", 1, *EXTRA))
    return rows + [rows[8], rows[8], rows[1], (3, "another text of three", "en", "s1", 3, 1, "x", 1, "y", 1.0, "z", 2, *EXTRA)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tiny(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def torn(spark):
    """Texts whose bytes aren't UTF-8."""
    rows = spark.createDataFrame([(1, bytearray(b"a password = 'Zx81Qpw7Lm20' \xff\xfe and \xc3 more words of it")), (2, bytearray(b"\x80")), (3, bytearray(b"fine words here")), (4, None)], "doc_id long, b binary")
    return rows.selectExpr("doc_id", "cast(b AS string) AS text", "'en' AS lang", "'s' AS source", "cast(3 AS long) AS n_chars").repartition(2)
