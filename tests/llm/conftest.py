from __future__ import annotations

import random

import pytest

WORDS = "the of and river stone winter market engine garden silver quiet morning paper window seven bridge letter harbour copper meadow".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every kind of odd row, and columns whose names clash with the operators' own."""
    r = random.Random(7)
    rows = [(i, prose(r, r.randrange(60, 160)), "en", f"s{i % 3}") for i in range(60)]
    base = rows[5][1].split()
    rows += [(100, rows[5][1], "en", "s0"), (101, " ".join([*base[:-1], "changed"]), "en", "s1"), (102, rows[5][1].upper(), "de", None), (103, None, None, "s2"), (104, "", "en", "s0"), (105, " \t\n\x0b ", "en", "s0"), (106, "one", "en", "s0"), (107, "ONE", "fr", "s0"), (108, "x " * 30_000, "en", "s1")]
    rows += [(None, prose(r, 80), "en", "s0"), (None, None, None, None), (109, "same row " * 5, "en", "s2"), (109, "same row " * 5, "en", "s2"), (110, "ünï \x1c\x85 wörd ÀÉ 漢字\nline\nline\n\n", "es", "Z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = {"n_words": "7", "size": "8", "id": "9", "token": "'t'", "part": "1", "h": "2", "file": "'f'", "tier": "3", "full": "4", "below": "5", "row": "6", "bad": "true", "a": "1", "b": "2", "node": "3", "component": "4", "s": "'s'", "toks": "1"}
    return df.selectExpr("*", *(f"{v} AS {k}" for k, v in clash.items())).cache()


@pytest.fixture(scope="session")
def plain(odd):
    """The same documents as Python rows."""
    return [(r.doc_id, r.text, r.source) for r in odd.collect()]


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(60)] + [(None, 1, 0), (3, None, None), (999, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
