"""Edge-case documents that every operator must take."""

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))


@pytest.fixture(scope="session")
def edge(spark):
    """doc_id, text and columns whose names clash with operators' own."""
    base = "The quick brown fox jumps over the lazy dog near the old river bank while seven wise owls watch from tall trees in the quiet wood"
    rows = [
        (1, base), (2, base), (2, base), (3, base.upper()), (4, base + " tonight"), (5, None), (6, ""), (7, " \n\t "), (8, LONG), (9, "one two"), (10, "one two"), (11, "1234 !!"),
        (12, "mail a.b@c.de or +1 (555) 010-9999, card 4111 1111 1111 1111 at 10.0.0.255 and 10.0.0.256"), (None, base), (-5, "Ünïcödé 日本語 😀 text with odd space"), (13, "x" * 50_000),
    ]
    rows = [(i, t, "en", "src", 1, 7.5, "drops", "n") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept_sha256 string, n_lines string").repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
