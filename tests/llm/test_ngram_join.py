import random
import re

import pytest

from terradrift.llm import ngram_join as J


def sets(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    s = sets(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= 80 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((str(k), len(s[i]), str(least.get(find(i)) if s[i] else k)) for i, (k, _) in enumerate(rows)))


def result(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def test_against_brute_force(make, corpus):
    assert result(J.ngram_components(make(corpus))) == brute(corpus)


def near(rng, n, edits, size=80):
    base = [f"b{rng.randrange(500)}" for _ in range(size)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(size)] = f"e{rng.randrange(9999)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("shingles", [3000, 200_000])
def test_large_group_in_chunks(make, monkeypatch, shingles):
    """A group over many chunks, with members that link to few others or to none."""
    monkeypatch.setattr(J, "TASK_SHINGLES", shingles)
    monkeypatch.setattr(J, "FREQUENT", 1)
    rng = random.Random(11)
    texts = near(rng, 150, 4) + near(rng, 40, 1, 12) + [" ".join(f"u{k}-{i}" for i in range(40)) for k in range(20)]
    rows = list(enumerate(texts))
    assert result(J.ngram_components(make(rows))) == brute(rows)


def test_passages_that_chain_and_a_chain_of_near_misses(make, monkeypatch):
    """Common passages join all texts to one cluster at first; neighbours in a row differ by a little more than links allow, or just not."""
    monkeypatch.setattr(J, "TASK_SHINGLES", 4000)
    monkeypatch.setattr(J, "DENSE", 4)
    monkeypatch.setattr(J, "LOCAL_EDGES", 0)
    monkeypatch.setattr(J, "MOST_FREQUENT", 50)
    rng = random.Random(21)
    passages = [" ".join(f"p{k}x{i}" for i in range(12)) for k in range(3)]
    texts = [" ".join([passages[k % 3], passages[(k + 1) % 3], *(f"own{k}x{i}" for i in range(10))]) for k in range(90)]
    for step in (3, 5):  # of 60 words, 20 shingles more or fewer than a fifth
        words = [f"c{step}x{i}" for i in range(60)]
        for k in range(25):
            texts.append(" ".join(words))
            for i in range(step):
                words[(k * step + i) % 60] = f"n{step}x{k}x{i}"
    texts += near(rng, 60, 3)
    rows = list(enumerate(texts))
    assert result(J.ngram_components(make(rows))) == brute(rows)


def test_many_copies_are_one_class(spark):
    """A hundred thousand copies, repeated rows and null ids among them, are one row of the matrix a task."""
    df = spark.range(100_000, numPartitions=4).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as doc_id", "'one two three four five six seven eight' as text")
    got = J.ngram_components(df).groupBy("n_shingles", "component_id").count().collect()
    assert [(r["n_shingles"], r["component_id"], r["count"]) for r in got] == [(4, 2, 100_000)]
    spread = list(J._text_rows(__import__("pyarrow").RecordBatch.from_pydict({"text": ["a b c d e f"] * 1000}) for _ in range(3)))
    assert len(spread) == 1


def test_null_ids_with_many_texts(spark):
    rows = [(None, f"text number {k // 2} of a pair that has more than five words {k % 2}") for k in range(40)]
    got = J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(got) == brute(rows)
    left = J.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert left.count() == len({c for c in _groups(rows)})


def _groups(rows):
    """The root of each row by brute force."""
    s, root = sets(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_bounds_are_exact():
    for n in range(1, 400):
        o = J.need(n)
        assert 100 * o >= 80 * n > 100 * (o - 1)
        assert 1 <= int(J.extra(n)) <= o


def test_empty_and_stage(make):
    assert J.ngram_components(make([])).collect() == []
    left = J.keep_first(make([(5, "a b c d e f"), (3, "A b c d e f"), (9, None), (8, ""), (None, "a b c d e f")])).collect()
    assert sorted(r["doc_id"] for r in left) == [3, 8, 9]
