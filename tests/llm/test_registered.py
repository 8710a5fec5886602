"""The registered queries against their SQL, and the pipeline against brute force, on the smallest tables."""

import datetime as dt
import math
import os
import re
from collections import defaultdict

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return x.isoformat() if isinstance(x, dt.date) else str(x)


def test_against_sql(spark, duck):
    from terradrift.llm.queries import ORACLE, QUERIES

    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
        assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == want, name


def test_others_cover_their_tables(spark, duck):
    from terradrift.llm.queries import ORACLE, QUERIES

    n = duck.execute("select count(*) from documents").fetchall()[0][0]
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, DATA).count() == n, name


def sets(rows):
    out = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def test_pipeline_against_brute_force(spark, duck, tmp_path):
    import sentencepiece

    import corpus_pipeline as P
    import public_tokenizers

    docs = dict(duck.execute("select doc_id, text from documents").fetchall())
    items = dict(duck.execute("select item_id, text from benchmark").fetchall())
    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    steps, df = [], spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, df, DATA).write.parquet(str(tmp_path / str(k)))
        df = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or df.columns == columns
        steps.append({r["doc_id"] for r in df.select("doc_id").collect()})
    # toxicity: few clean labelled rows go, most toxic ones with marking words do
    labels = duck.execute("select doc_id, toxic from labels").fetchall()
    clean, toxic = {i for i, t in labels if t == 0}, {i for i, t in labels if t == 1}
    assert len(clean - steps[0]) <= 0.02 * len(clean) + 1 and len(toxic - steps[0]) >= 0.4 * len(toxic)
    left = {i: docs[i] for i in steps[0]}
    groups = defaultdict(list)
    for i, t in left.items():
        groups[(t or "").translate(LOW)].append(i)
    assert steps[1] == {max(g) for g in groups.values()}
    left = {i: docs[i] for i in steps[1]}
    s, root = sets(left), {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(left)
    for x in ids:
        for y in ids:
            if x < y and s[x] and s[y] and 100 * len(s[x] & s[y]) >= 80 * len(s[x] | s[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    assert steps[2] == {i for i in ids if find(i) == i}
    b = sets(items)
    assert steps[3] == {i for i in steps[2] if not any(10 * len(g & s[i]) >= 8 * len(g) for g in b.values())}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["ids"] for r in df.collect()}
    assert got == {i: library.encode(docs[i] or "") for i in steps[3]}
    assert sorted(r["doc_id"] for r in P.run(spark, DATA).collect()) == sorted(got)
