import random

import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names operators use inside."""

    def build(rows):
        schema = "doc_id long, text string, lang string, source string, n long, h long, kept boolean, class long, part int, key string"
        return spark.createDataFrame([(i, t, "en", "s", 1, 2, True, 3, 4, "k") for i, t in rows], schema)

    return build


def prose(rng: random.Random, n: int, words=400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, repeats, nulls, empty and very long ones."""
    rng = random.Random(3)
    rows, k = [], 0
    passage = prose(rng, 60)
    for _ in range(12):
        base = prose(rng, rng.randrange(20, 200)).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(k + i, prose(rng, 30) + " " + passage) for i in range(30)]
    k += 30
    rows += [(k + i, passage.upper() if i % 2 else passage) for i in range(9)]
    k += 9
    rows += [(k, None), (k + 1, ""), (k + 2, " \t\n"), (k + 3, "one"), (k + 4, "ONE"), (k + 5, "a b c d"), (k + 6, "A b\tc d"), (k + 7, prose(rng, 9000)), (None, "no id here at all"), (k + 8, "Ä b c d e é")]
    rows += [(k + 5, "a b c d")]
    return rows
