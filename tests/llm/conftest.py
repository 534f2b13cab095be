import random

import pytest

WORDS = "red green blue stone river cloud quiet bright seven lantern harbour winter signal copper".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text[, source]) rows as a table of documents with extra columns whose names clash."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x", "y", 1) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, Text string, keep_id string, h int")

    return make


@pytest.fixture(scope="session")
def mixed_rows():
    """Copies, near copies, nulls, empty texts, repeated rows, a long text."""
    base = prose(1, 120)
    rows = [(i, prose(i, 40 + i)) for i in range(20, 50)]
    rows += [(60 + i, base) for i in range(8)] + [(70 + i, base.replace("stone", f"st{i}ne", 1)) for i in range(8)]
    rows += [(80, None), (81, ""), (82, "   "), (83, "one"), (83, "one"), (None, base), (None, None), (84, prose(9, 9000)), (85, "Zwölf Boxkämpfer 日本 \U0001f600 " * 5)]
    return rows
