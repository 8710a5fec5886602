import random

import pytest

from terradrift.llm import decontaminate, exact_dedup, ngram_join, toxicity
from tests.llm.conftest import prose


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages_judge_rows_that_share_an_id(spark, make):
    rng = random.Random(11)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    docs = [(5, a), (None, a + " end"), (None, b), (7, c), (7, c + " end"), (7, d)]
    # of the two texts of id 7 that link either may stay
    left = rows(ngram_join.keep_first(make(docs)))
    assert len(left) == 4 and {(5, a), (None, b), (7, d)} < set(left) and ((7, c) in left) != ((7, c + " end") in left)

    docs = [(5, "T"), (None, "t"), (None, "u"), (7, "v"), (8, "V"), (7, "w"), (7, "W")]
    left = rows(exact_dedup.keep_one(make(docs)))
    assert len(left) == 4 and {(5, "T"), (None, "u"), (8, "V")} < set(left)

    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    docs = [(None, "z a b c d e f"), (None, a), (7, "a b c d e f"), (7, b), (9, "a b c d"), (9, "b c d e f")]
    assert rows(decontaminate.drop_contaminated(make(docs), bench)) == sorted([(None, a), (7, b), (9, "a b c d"), (9, "b c d e f")], key=repr)


def test_toxic_rows_that_share_an_id(spark, make):
    docs = [(i, ("vile scum " if i % 2 else "kind words ") * 5) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    more = [(None, "vile scum " * 5), (None, "kind words " * 5), (900, "vile scum " * 5), (900, "kind words " * 5)]
    left = rows(toxicity.drop_toxic(make(docs + more), labels))
    assert {t for _, t in left} == {"kind words " * 5} and sum(i in (None, 900) for i, _ in left) == 2


def test_near_copies_of_null_and_repeated_ids(make):
    """What the ids say must not matter: unique texts stay, of repeated rows one."""
    assert rows(ngram_join.keep_first(make([(3, "a b c d e f"), (None, "a b c d e f"), (None, "u v w x y z")]))) == [(3, "a b c d e f"), (None, "u v w x y z")]
    assert rows(ngram_join.keep_first(make([(3, "a b c d e f"), (5, "a b c d e f"), (5, "u v w x y z")]))) == [(3, "a b c d e f"), (5, "u v w x y z")]
    assert rows(ngram_join.keep_first(make([(3, "a b c d e f")] * 2 + [(4, None)] * 2))) == [(3, "a b c d e f"), (4, None), (4, None)]


def brute_stages(docs, items):
    """The texts that exact dedup, the n-gram join and decontamination leave, whatever the ids."""
    from tests.llm.test_ngram_join import sets

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = list(dict.fromkeys((t or "").translate(low) for _, t in docs))
    s = sets(list(enumerate(texts)))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    bad = [any(g and 10 * len(g & s[i]) >= 8 * len(g) for g in sets(items)) for i in range(len(texts))]
    return texts, root, bad


@pytest.mark.parametrize("empty", ["none", "documents", "labels", "benchmark"])
def test_pipeline_on_odd_tables(spark, tmp_path, empty):
    """Null and repeated ids with differing texts, repeated rows, null and empty texts, columns whose names operators use
    inside, and empty tables."""
    pytest.importorskip("public_tokenizers")
    import sentencepiece

    import corpus_pipeline as P
    import public_tokenizers

    rng = random.Random(41)
    base = [prose(rng, 60) for _ in range(12)]
    items = [(None, prose(rng, 30)), (1, prose(rng, 25)), (1, prose(rng, 25))]
    near = lambda t: " ".join(w if k != 30 else "changed" for k, w in enumerate(t.split()))
    docs = [(k % 4 if k % 3 else None, t) for k, t in enumerate(base)] + [(None, base[0].upper()), (2, base[1]), (2, base[1]), (None, near(base[2])), (9, near(base[3]))]
    docs += [(5, "lead " + items[0][1]), (None, items[1][1] + " tail"), (5, items[2][1]), (7, None), (7, ""), (None, None), (8, "one two"), (8, "ONE two")]
    toxic = [(1000 + k, ("vile scum " if k % 2 else "kind words ") + prose(rng, 20)) for k in range(120)]
    rows_ = [] if empty == "documents" else docs + toxic
    schema = "doc_id long, text string, mark long, class long, `__id` int, `__text` string, kept boolean, label int, h long"
    spark.createDataFrame([(i, t, 1, 2, 3, "x", True, 1, 9) for i, t in rows_], schema).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [] if empty == "labels" else [(1000 + k, 1, k % 2) for k in range(120)] + [(None, 0, 1), (1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    bench = [] if empty == "benchmark" else items
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r["ids"] for r in P.run(spark, str(tmp_path)).collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    left = [(i, t) for i, t in rows_ if empty == "labels" or not (t or "").startswith("vile")]
    texts, root, bad = brute_stages(left, bench)
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(k)
    counts = {}
    for ids in got:
        counts[tuple(ids)] = counts.get(tuple(ids), 0) + 1
    folded = {}
    for ids, n in counts.items():
        key = library.decode(list(ids)).lower()
        folded[key] = folded.get(key, 0) + n
    for g in groups.values():  # each group of linked texts leaves one, if that holds no item; here a group's texts agree in that
        assert len({bad[k] for k in g}) == 1
        assert sum(folded.pop(texts[k], 0) for k in g) == (not bad[g[0]]), [texts[k] for k in g]
    assert not folded
