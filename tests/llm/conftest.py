import random

import pytest

#: Names that operators use inside; further columns may have them.
CLASHES = "score lang_pred ids lossless fp mark chunk at key base added root held_out none id n_words kind key_ piece_text".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def texts():
    r = random.Random(3)
    words = "the of and to in is der die und das le la les et que el los para con por".split()
    some = [" ".join(r.choice(words) + r.choice(("", "s", "er", "en")) for _ in range(r.randint(1, 60))) for _ in range(40)]
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(i, t) for i, t in enumerate(some)]
    rows += [(100 + i, f"{r.choice(words)} {i} {passage} tail {i}") for i in range(6)]
    rows += [(200, None), (201, ""), (202, "  \n\t"), (203, "7 8 9"), (204, "é"), (205, "日本語 текст 😀"), (206, "▁ ▁"), (207, "a" * 3000), (208, "\x00\x01")]
    rows += [(300, some[0]), (300, some[0]), (301, some[0] + " x"), (None, some[0]), (None, None), (None, passage)]
    rows += [(400, " ".join(r.choice(words) for _ in range(40000))), (401, "mail a@b.co or 10.0.0.1 token = abcdefabcdef0123 call +1 (555) 123-4567 or pay 4111 1111 1111 1111")]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and columns whose names clash."""
    rows = [(i, t, ("en", "de", "fr", "es", None)[k % 5], None, None, *("x" for _ in CLASHES)) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
