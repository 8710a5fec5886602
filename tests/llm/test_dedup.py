import hashlib
from collections import Counter, defaultdict

from terradrift.llm import exact_dedup as D

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").translate(LOW).encode()).hexdigest()].append(i)
    return groups


def test_against_brute_force(make, corpus):
    got = D.exact_dedup(make(corpus)).collect()
    groups = expected(corpus)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in corpus)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == Counter(groups.keys())
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]


def test_heavy_digests_are_split(make, spark, monkeypatch):
    monkeypatch.setattr(D, "LEAST_HEAVY", 10)
    rows = [(i, "Same text") for i in range(400)] + [(400 + i, f"other {i % 150}") for i in range(300)] + [(399, "same TEXT"), (None, "same text")]
    df = D.digests(make(rows)).selectExpr("*", "monotonically_increasing_id() as row")
    assert D.heavy_hitters(df, len(rows)).count() == 1
    got = D.exact_dedup(make(rows).repartition(5)).collect()
    heavy = [r for r in got if r["group_size"] == 402]
    assert len(heavy) == 402 and sum(r["kept"] for r in heavy) == 1 and {r["keep_id"] for r in heavy} == {399}
    assert sum(r["kept"] for r in got) == 151


def test_heavy_rows_of_one_id_or_none(make, monkeypatch):
    """Rows that agree in id and text are told apart by their place, not by a window over all of them."""
    monkeypatch.setattr(D, "LEAST_HEAVY", 10)
    for ids in ([None] * 300, [5] * 300, [None, 5] * 150):
        got = D.exact_dedup(make([(i, "Same") for i in ids] + [(9, "other"), (None, None), (None, "")])).collect()
        same = [r for r in got if r["group_size"] == 300]
        assert len(same) == 300 and sum(r["kept"] for r in same) == 1
        assert {r["keep_id"] for r in same} == {max((i for i in ids if i is not None), default=None)}
        assert all(r["doc_id"] == r["keep_id"] for r in same if r["kept"]) and sum(r["kept"] for r in got) == 3
    plan = D.exact_dedup(make([(1, "x")] * 50))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") <= 2  # of the light rows alone


def test_many_empty_partitions_and_empty_table(make):
    assert D.exact_dedup(make([(i, "x") for i in range(200)]).repartition(50)).where("kept").count() == 1
    assert D.exact_dedup(make([])).collect() == []


def test_stage_keeps_one_row(make, corpus):
    left = D.keep_one(make(corpus)).collect()
    assert Counter(hashlib.sha256((r["text"] or "").translate(LOW).encode()).hexdigest() for r in left) == Counter(expected(corpus).keys())
