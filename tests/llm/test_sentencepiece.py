import hashlib
import random

import pytest

from terradrift.llm import sentencepiece_lattice as S

public = pytest.importorskip("public_tokenizers")
PATH = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    return S.PieceTable.load(PATH, "bpe")


TEXTS = [None, "", " ", "a", "a  b", " lead and trail ", "new\nline\ttab", "Ünïcödé ﬁ 😀 日本語", "ExecutionContext.addEventListener(...)", "\x1f a\x1fb", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "don't stop.", "  ", "x" * 5000]


def test_ids_equal_the_library_and_round_trip(make, library, pieces, corpus):
    rows = list(enumerate(TEXTS)) + [(100 + k, t) for k, (_, t) in enumerate(corpus)] + [(None, "no id"), (3, "a")]
    encoded = S.encode(make(rows), pieces)
    got = sorted((str(r["doc_id"]), r["ids"]) for r in encoded.collect())
    assert got == sorted((str(i), library.encode(t or "")) for i, t in rows)
    text = {str(r["doc_id"]): r["text"] for r in S.decode(encoded, pieces).collect()}
    assert all(text[str(i)] == (t or "") for i, t in rows)
    digests = {str(r["doc_id"]): r for r in S.digest(encoded, pieces).collect()}
    assert sorted(map(str, S.encode(make(rows), pieces, digests=True).collect())) == sorted(map(str, S.digest(encoded, pieces).collect()))
    assert all(digests[str(i)]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows)


def test_many_tasks_and_empty(make, pieces, library, corpus):
    rows = [(k, t) for k, (_, t) in enumerate(corpus)]
    got = S.encode(make(rows).coalesce(3), pieces).collect()
    assert all(r["ids"] == library.encode(dict(rows)[r["doc_id"]] or "") for r in got)
    assert S.encode(make([]), pieces).collect() == []


def test_long_units(make, spark, pieces, library):
    """A megabyte without a cut, and texts whose windows share no piece, in linear time."""
    rng = random.Random(9)
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    rows = [(1, blob), (2, "the" * 100_000), (3, "a" * 50_000), (4, "=" * 777), (5, "ab" * 33), (6, "x" + "the" * 21), (7, "an" * 4000 + " tail")]
    got = {r["doc_id"]: r["ids"] for r in S.encode(make(rows), pieces).collect()}
    assert got == {i: library.encode(t) for i, t in rows}


def test_windows_and_folds_give_the_same_pieces(pieces):
    rng = random.Random(5)
    cutter, met = S.Cutter(pieces), 0
    for k in range(60):
        unit = "".join(rng.choice(["the", "ing", "a", "tion", "e", "xq", "99", "er"][: 2 + k % 7]) for _ in range(rng.randrange(40, 200)))
        whole = pieces.fold(unit)
        assert "".join(whole) == unit
        done = S.stitched(len(unit), [pieces.fold(unit[a:b]) for a, b in cutter.windows(len(unit))])
        assert done in (None, whole)
        met += done is not None
    assert met > 20


def test_rows_out_of_a_shuffle(make, pieces, library, corpus):
    rows = [(k, t) for k, (_, t) in enumerate(corpus)]
    got = S.encode(make(rows).repartition(5), pieces).collect()
    assert all(r["ids"] == library.encode(dict(rows)[r["doc_id"]] or "") for r in got) and len(got) == len(rows)


def test_fold_of_unigram_tables_in_the_worker(spark):
    rng = random.Random(3)
    scores = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): -rng.random() * 9 for _ in range(40)}
    table = S.PieceTable({p: (i, s) for i, (p, s) in enumerate(scores.items())}, [-1] * 256, 0, "unigram", [p.encode() for p in scores])
    for _ in range(200):
        unit = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
        assert abs(sum(scores.get(p, -1e4) for p in table.fold(unit)) - best(unit, scores)) < 1e-6


def test_decoding_broken_bytes(spark, pieces, library):
    ids = [library.piece_to_id("<0xC3>"), library.piece_to_id("▁x"), library.piece_to_id("<0x0A>")]
    rows = spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert [r["text"] for r in S.decode(rows, pieces).orderBy("doc_id").collect()] == [library.decode(ids), "", ""]


def best(unit, scores, unknown=-1e4):
    """All segmentations of a short unit; the best total."""
    if not unit:
        return 0.0
    out = -1e300
    for k in range(1, len(unit) + 1):
        s = scores.get(unit[:k], unknown if k == 1 else None)
        if s is not None:
            out = max(out, s + best(unit[k:], scores, unknown))
    return out


def test_viterbi_for_unigram_tables(spark):
    rng = random.Random(2)
    scores = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): -rng.random() * 9 for _ in range(40)}
    table = S.PieceTable({p: (i, s) for i, (p, s) in enumerate(scores.items())}, [-1] * 256, 0, "unigram", [p.encode() for p in scores])
    units = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(80)})
    got = S.segment(spark.createDataFrame([(u,) for u in units], "unit string").repartition(3, "unit"), table).collect()
    for r in got:
        parts = r["cut"].split(S.CUT)
        assert "".join(parts) == r["unit"]
        assert abs(sum(scores.get(p, -1e4) for p in parts) - best(r["unit"], scores)) < 1e-6
    assert {r["unit"] for r in got} >= {u for u in units if any(u[i : i + k] in scores for i in range(len(u)) for k in range(1, 5))}
