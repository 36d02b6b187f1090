import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared(n, seed=0):
    """n made-up words."""
    return [f"w{(i * 7919 + seed * 104729) % 100003}x{seed}" for i in range(n)]


@pytest.fixture(scope="session")
def docs(spark):
    """Copies, near copies, shared passages, empty, null and very long texts, ties, repeated rows, and columns with clashing names."""
    base, passage, long = shared(120, 1), shared(60, 2), shared(9000, 3)
    near = [*base[:50], "changed", *base[51:]]
    rows = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, "\n".join(shared(40, 4) + passage + shared(30, 5))), (5, " ".join(shared(20, 6) + passage)),
        (6, ""), (7, None), (8, "one two three"), (9, "One TWO three"), (10, " \t\n "), (11, " ".join(long)), (12, " ".join(shared(500, 7) + long[4000:4100])),
        (13, "same line\n" * 30), (14, "é ü ñ “quoted”   x　y \x1c z"), (15, " ".join(base[:30])), (15, " ".join(base[:30])), (16, "a" * 5000 + " b"), (None, " ".join(shared(50, 8))),
    ]
    return spark.createDataFrame([(i, t, "en", "src0", i, 0, "z") for i, t in rows], "doc_id long, text string, lang string, source string, row long, n_words int, chunk string").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]
