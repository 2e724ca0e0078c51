import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, h long, shard int, bucket long, node long"


def invented(rng, n, vocabulary=400):
    return " ".join(rng.choice([f"w{rng.randrange(vocabulary)}", f"Ä{rng.randrange(vocabulary)}", f"x{rng.randrange(vocabulary)},"]) for _ in range(n))


def damaged(rng, text, part):
    return " ".join(w if rng.random() > part else f"e{rng.randrange(10 ** 6)}" for w in text.split(" "))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies at all distances, shared passages, repeats, empty, tiny, long and null texts."""
    rng = random.Random(11)
    out = [None, "", " \n\t ", "one", "one two three", "one two three", "One TWO three", "a\u00a0b \x1c c", "x" * 3000]
    base = [invented(rng, rng.randrange(40, 200)) for _ in range(20)]
    for b in base:
        out += [b, b.replace(" ", "\n", 3)]
        out += [damaged(rng, b, rng.choice([0.005, 0.02, 0.03, 0.04, 0.06])) for _ in range(5)]
    passage = invented(rng, 60)
    out += [f"{invented(rng, 30)} {passage} {invented(rng, 30)}" for _ in range(12)]
    out += ["spam and eggs " * 200, "na " * 500, invented(rng, 20000)]
    line = invented(rng, 12)
    out += [f"{invented(rng, 60)}\n{line}\n{invented(rng, 9)}" for _ in range(25)] + [f"{line}\n{line} \n{invented(rng, 45)}" for _ in range(30)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents in several partitions, with columns whose names operators use inside."""
    rows = [(i, t, None if i % 7 == 0 else "en", f"src{i % 2}" if i % 11 else None, len(t or ""), 1, 2, 3, 4, 5) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
