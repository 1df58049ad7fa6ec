"""Fixtures for the training-data operators: awkward rows and small tables of the driver."""

import random

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The folder that a cluster would name, and the package for the workers."""
    from shopcast.llm.tables import ship
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    ship(spark)


AWKWARD = [
    (0, "The same words again and again, the same words again and again."), (1, None), (2, ""), (3, " \n\t "), (4, "one"),
    (5, "The same words again and again, the same words again and again."), (6, "mail a.b@c.example.org or 10.0.0.7 now"),
    (7, "é ü 漢字 \U0001F600 " * 30), (None, "a row without an id, with a few words"), (8, "x" * 5000), (9, "word " * 4000),
    (9, "word " * 4000), (10, "call +1 (555) 555-0100 or pay 4111 1111 1111 1111 today"), (11, "12 34 56 78"),
]
CLASH = ("part", "chunk", "fp", "size", "row", "hash", "ends", "target", "take", "component_id", "score", "range", "copy")


def documents(spark, rows=None, extra=False):
    """documents-like table; ``extra`` adds columns whose names the operators use inside."""
    rows = AWKWARD if rows is None else rows
    full = [(i, t, "en", None if n % 5 == 4 else f"s{n % 3}", None if t is None else len(t)) for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    if extra:
        for c in CLASH:
            df = df.selectExpr("*", f"'{c}' AS {c}")
    return df


def passages(seed, n=120):
    """Rows made of random text, shared passages, parts of passages and periodic runs."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(rng.randint(20, 200)) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            kind, p = rng.random(), rng.choice(shared)
            cut = rng.randint(0, len(p))
            parts.append(text(rng.randint(0, 60)) if kind < 0.4 else p[cut:] if kind < 0.6 else p[:cut] if kind < 0.75
                         else p if kind < 0.9 else rng.choice(["a", "ab ", "xyz\n"]) * rng.randint(0, 400))
        rows.append((i, " ".join(parts)))
    return rows + [(n, rows[5][1]), (n + 1, rows[5][1])]
