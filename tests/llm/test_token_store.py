import zlib

import numpy as np
import pytest

from terradrift.llm import token_store as S

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


TEXTS = ["", " ", "  a b", "a\n b", "a \nb", "don't  stop", "a b ", None, "\n", "x y z", "é ü  x", "<|endoftext|> a", "a b<|endoftext|>c d", "<|endof", "text|> z", " a", "a's 'll 12 3", "\x1c a b", "a \x1c", "a b.\nC d,\n\ne f!\ng", "q a.b, c!! d?\n(e 12. 3", "ab c. d", "a　b c", "´. b", "a\tb c", "naïve, “so” said… he.\nEnd;", "日本語 テスト。 x", "😀 a😀. b", "tail.", ". lead", "a b c"]


def test_encoder_equals_the_library(tokenizer):
    coder = S.Encoder(public.path("byte_bpe_50k.json"))
    for _ in range(2):
        got = coder.encode(TEXTS)
        for text, ids in zip(TEXTS, got, strict=True):
            assert np.frombuffer(ids, coder.dtype).tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, S.END_ID], text
    for text in TEXTS:
        assert np.frombuffer(coder.encode([text])[0], coder.dtype).tolist()[:-1] == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_perfect_hash_is_minimal():
    keys = S._hashed(np.random.default_rng(1).choice(10**9, 20_000, replace=False))
    table, _ = S.PerfectHash.from_bytes(S.PerfectHash.build(keys).to_bytes())
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert S.PerfectHash.build(keys[:0]).slots(keys).max() == -1
    others = S._hashed(np.arange(2 * 10**9, 2 * 10**9 + 1000))
    assert ((table.slots(others) >= -1) & (table.slots(others) < len(keys))).all()


def test_store_round_trip(spark, make, tokenizer, monkeypatch):
    monkeypatch.setattr(S, "SHARD_BYTES", 4000)
    monkeypatch.setattr(S, "BUCKET_KEYS", 7)
    rows = [(3 * k - 40, f"text number {k}. " + "word " * (k % 17)) for k in range(60)] + [(500, t) for t in ("twice", "twice", "and again")] + [(None, "no key"), (1000, None), (1001, "long text, " * 3000)]
    got = S.stored_documents(make(rows), public.path("byte_bpe_50k.json")).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    digests = lambda t: (n := [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) and (len(n), zlib.crc32(np.array(n, "<u4").tobytes()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), *digests(t)) for i, t in rows)


def test_an_id_over_many_shards(spark, make, tokenizer, monkeypatch):
    """Half of the rows have one id or none; their range is split, and each shard's part is read on its own."""
    monkeypatch.setattr(S, "SHARD_BYTES", 1500)
    rows = [(7, f"copy {k} of many") for k in range(300)] + [(None, "no id " * 3)] * 150 + [(k, f"row {k}") for k in range(100, 400)] + [(7, None), (6, "before"), (8, "after")]
    docs = make(rows).repartition(6)
    store = S.write_store(docs, public.path("byte_bpe_50k.json"))
    sizes = [r["n_docs"] for r in store.manifest.collect()]
    assert len(sizes) > 6 and max(sizes) < 200
    got = sorted(S.stored_documents(docs, public.path("byte_bpe_50k.json")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == sorted((str(i), crc(t)) for i, t in rows)


def test_running_sums_over_blocks(spark):
    rows = [(k, 1, (7 * k) % 13) for k in range(0, 400) if k % 9]
    shards = spark.createDataFrame(rows, "shard long, n_docs long, n_tokens long")
    got = {r["shard"]: r["start"] for r in S._running(shards, 16).collect()}
    assert got == {k: sum(n for j, _, n in rows if j < k) for k, _, _ in rows}


def test_ids_that_cannot_be_keys(spark):
    for rows, kind in (([("a", "x")], "string"), ([(S.NULL_KEY, "x")], "long")):
        with pytest.raises(ValueError):
            S.write_store(spark.createDataFrame(rows, f"doc_id {kind}, text string"), public.path("byte_bpe_50k.json"))


def test_absent_keys_and_empty_table(spark, make):
    store = S.write_store(make([(1, "a"), (2, "b")]), public.path("byte_bpe_50k.json"))
    keys = spark.createDataFrame([(1,), (7,), (-5,)], "key long")
    assert [r["key"] for r in store.locate(keys).collect()] == [1]
    assert S.stored_documents(make([]), public.path("byte_bpe_50k.json")).collect() == []
