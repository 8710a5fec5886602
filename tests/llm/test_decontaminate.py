import random
import re

from terradrift.llm import decontaminate as C
from tests.llm.conftest import prose


def grams(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    if not w:
        return set(), 0
    width = min(width, len(w))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}, width


def windows(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(docs, items):
    out = {}
    for i, t in docs:
        for j, b in items:
            g, width = grams(b)
            n = len(g & windows(t, width)) if g else 0
            if g and 10 * n >= 8 * len(g):
                out[(i, j)] = (len(g), n)
    return out


def test_against_brute_force(spark, make):
    rng = random.Random(5)
    items = [(k, prose(rng, n)) for k, n in enumerate([5, 6, 9, 15, 15, 30, 57, 57, 120, 300])] + [(20, "only three words"), (21, "word"), (22, ""), (23, None), (24, None)]
    items.append((25, items[3][1]))
    docs = []
    for k in range(60):
        body = prose(rng, rng.randrange(1, 700)).split()
        text = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(0, 3)):
            if text:
                text[rng.randrange(len(text))] = "changed"
        at = rng.randrange(len(body) + 1)
        docs.append((k, " ".join(body[:at] + [w.upper() for w in text] + body[at:])))
    docs += [(90, None), (91, ""), (92, "word"), (93, prose(rng, 9000) + " " + items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in C.contained_items(make(docs), bench).collect()}
    assert got == brute(docs, items) and len(got) > 30


def test_empty_tables(spark, make):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert C.contained_items(make([]), bench).collect() == []
    assert C.contained_items(make([(1, "a b c d e f")]), bench.limit(0)).collect() == []
    assert [r["doc_id"] for r in C.drop_contaminated(make([(1, "A b c d e f"), (2, "a b"), (None, "z A b c d e f")]), bench).collect()] == [2]


def test_null_and_repeated_item_ids(spark, make):
    """Null item ids are reported like others; the stage judges by texts, so items that share an id are not pooled."""
    rng = random.Random(9)
    x, y, z = (prose(rng, 40) for _ in range(3))
    bench = spark.createDataFrame([(None, x), (1, y), (1, z)], "item_id long, text string")
    docs = [(1, "start " + x + " end"), (None, "start " + x), (3, y + " end"), (4, prose(rng, 60)), (5, None)]
    got = {(r["doc_id"], r["item_id"]) for r in C.contained_items(make(docs), bench).collect()}
    assert got == {(1, None), (None, None)}  # id 1 is one item of two texts here
    left = C.drop_contaminated(make(docs), bench).collect()
    assert sorted(r["doc_id"] for r in left) == [4, 5]
    assert len(left[0]) == len(make([]).columns)


def test_size_partitions_miss_nothing(spark, make):
    """Items of all sizes at the edge of the threshold inside documents just large enough, and in long ones."""
    rng = random.Random(31)
    items = [(k, prose(rng, 5 + k, 10_000)) for k in range(0, 120, 3)]
    docs = []
    for k, t in items:
        words = t.split()
        g = len(words) - 4
        cut = words[: 4 + -(-8 * g // 10)]  # exactly as many shingles as needed
        docs += [(3 * k, " ".join(cut)), (3 * k + 1, " ".join(cut[:-1])), (3 * k + 2, prose(rng, 3000, 10_000) + " " + " ".join(cut))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in C.contained_items(make(docs), bench).collect()}
    assert got == brute(docs, items) and len(got) >= 2 * len(items)
