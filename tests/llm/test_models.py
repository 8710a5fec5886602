import math
import random
import re
import zlib

import numpy as np
import pytest

from terradrift.llm import language_id as G
from terradrift.llm import toxicity as T
from terradrift.llm.common import hash_word


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    bad = ["idiot", "scum", "trash"]
    rows, labels = [], []
    for k in range(900):
        words = [f"w{int(rng.paretovariate(1))}" for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.15
        for _ in range(rng.randrange(1, 9) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", ",", "!"])
        rows.append((k, " ".join(words).upper() if k % 3 == 0 else " ".join(words), 1.0))
        labels.append((k, None if k % 50 == 7 else int(toxic), 0))
    docs = spark.createDataFrame(rows + [(5000, None, 0.0), (5001, "", 0.0), (5002, "clean " * 30000 + "idiot", 0.0), (None, "you idiot", 0.0), (1, rows[1][1], 0.0)], "doc_id long, text string, grade double")
    table = spark.createDataFrame(labels, "doc_id long, toxic int, severity_hint int")
    model = T.fit(docs, table.where("doc_id < 600"), 500)
    got = T.score(docs, model).collect()
    by = {r["doc_id"]: r for r in got}
    held = [(by[k], t) for k, t, _ in labels if k >= 600 and t is not None]
    assert np.mean([(r["p_toxic"] >= 0.5) == (t == 1) for r, t in held]) > 0.98
    assert by[5000]["severity"] == by[5001]["severity"] < 0.5 and by[None]["p_toxic"] > 0.5
    assert len(got) == len(rows) + 5 and all(0 <= r["severity"] <= 3 for r in got)
    many, one = T.score(spark.createDataFrame([(1, "idiot scum trash " * 4), (2, "idiot")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert many["severity"] > one["severity"]


def test_scores_against_brute_force(spark):
    """Severity, probability and grade of a given model, word by word; equal grades go to the lower one."""
    words = {"bad": 1.5, "awful": 2.25, "kind": -0.75, "é": 0.5}
    hashes = np.array([hash_word(w.encode()) for w in words], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = T.OrdinalModel(hashes[order], np.array(list(words.values()))[order], np.array([1.0, 2.0, 3.5]))
    texts = ["", None, "bad", "BAD bad, kind", "awful awful awful awful", "é-É bad_bad", "nothing here", "kind " * 40_000 + "awful", "bad" * 3, "bad"]
    got = {r["doc_id"]: r for r in T.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        found = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (t or ""))
        low = ["".join(c.lower() if c.isascii() else c for c in w) for w in found]
        f = sum(w * (1 + math.log(low.count(k))) for k, w in words.items() if k in low)
        above = [1 / (1 + math.exp(th - f)) for th in (1.0, 2.0, 3.5)]
        cells = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        assert math.isclose(got[i]["severity"], sum(above), rel_tol=1e-9) and math.isclose(got[i]["p_toxic"], above[0], rel_tol=1e-9)
        assert got[i]["grade"] == cells.index(max(cells))
    tied = T.OrdinalModel(hashes[order], np.zeros(4), np.array([0.0]))
    assert [r["grade"] for r in T.score(spark.createDataFrame([(1, "bad")], "doc_id long, text string"), tied).collect()] == [0]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    for labels in (none, none.limit(0), none.withColumnRenamed("toxic", "severity")):
        assert [r["severity"] for r in T.score(docs, T.fit(docs, labels)).collect()] == [0.0, 0.0] or max(r["severity"] for r in T.score(docs, T.fit(docs, labels)).collect()) < 1e-12
    assert T.score(docs.limit(0), T.fit(docs, none)).collect() == []
    assert T.drop_toxic(docs, none).count() == 2


def brute_phrases(sample: str, text: str) -> int:
    """Phrases of greedy longest matches; letters that the sample lacks are phrases of their own."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample and text[i] in sample:
            k += 1
        i, n = i + k, n + 1
    return n


@pytest.mark.parametrize("piece, run_on", [(512, 1024), (16, 24), (7, 3), (64, 0)])
def test_phrases_against_brute_force(monkeypatch, piece, run_on):
    monkeypatch.setattr(G, "PIECE", piece)
    monkeypatch.setattr(G, "RUN_ON", run_on)
    rng = random.Random(8)
    alphabet = "abcdefg"
    samples = {f"l{k}": "".join(rng.choice(alphabet[:k]) for _ in range(120)) for k in (3, 5, 7)} | {"p": "abc" * 40, "one": "a" * 30}
    model = G.build(samples)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 900))) for _ in range(30)] + ["", "a" * 700, "abc" * 300, "cab" * 200 + "g", "z" * 50]
    got = G.phrases(model, [G._units(t) for t in texts])
    for a in model.automata:
        a.tabulate()
    assert (G.phrases(model, [G._units(t) for t in texts]) == got).all()
    for t, row in zip(texts, got, strict=True):
        assert [int(n) for n in row] == [brute_phrases(samples[k], t) for k in model.names], t


def brute_identify(samples: dict, text: str | None) -> tuple[str, float]:
    low = (text or "").lower()
    if not any(c.isalpha() for c in low) or not samples:
        return "und", 0.0
    plain = lambda t: "".join(c if c.isalpha() else " " for c in t.lower())
    rate = {k: brute_phrases(plain(s), plain(low)) * math.log2(max(2, len(s.lower()))) / len(low) for k, s in samples.items()}
    name = min(sorted(rate), key=lambda k: rate[k])
    return name, 1 / sum(2.0 ** -min(60, r - rate[name]) for r in rate.values())


def test_identify_against_brute_force(spark):
    """Scripts of many letters, letters beyond the basic plane, ties, letters that no sample has."""
    rng = random.Random(11)
    han = [chr(0x4E00 + k) for k in range(1500)]
    gothic = [chr(0x10330 + k) for k in range(20)]
    kinds = {"zh": han[:900], "ja": han[600:], "got": gothic, "en": ["the ", "and ", "er", "on "], "nl": ["het ", "en ", "er", "oo "]}
    rows = [(k, "".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(5, 120))), lang) for k, lang in ((k, rng.choice(list(kinds))) for k in range(160))]
    rows += [(500, "\U00010331\U00010332" * 6, None), (501, "\u0416\u0417", None), (502, "the \U0001F600 and", None), (503, "1 2 3", "en"), (504, None, "zh"), (505, "", None), (506, "THE AND", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model_rows = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    samples = G.sample(spark.createDataFrame(model_rows, "text string, lang string"))
    assert len({c for s in samples.values() for c in s}) > 1000  # far more letters than a byte has
    got = {r["doc_id"]: r for r in G.identify(docs).collect()}
    for i, t, _ in rows:
        name, score = brute_identify(samples, t)
        assert (got[i]["lang_pred"], round(got[i]["score"], 9)) == (name, round(score, 9)), (i, t)
    assert got[500]["lang_pred"] == "got" and got[501]["lang_pred"] != "und"
    held = [got[i]["lang_pred"] == lang for i, _, lang in rows if lang and got[i]["held_out"] and i < 500]
    assert np.mean(held) > 0.7  # half of the letters of two languages are the same


def test_language_sample_bounds(spark):
    rows = [("x " * 100_000, "long")] + [(f"short text {k} " * 9, lang) for k in range(900) for lang in ("a", "b")] + [("y" * 30_000, "a")]
    samples = G.sample(spark.createDataFrame(rows, "text string, lang string"), 100, 4000)
    assert len(samples["long"]) == 4000  # its only row is longer than a sample
    assert all(0 < len(samples[k]) <= 4000 and "y" not in samples[k] for k in "ab")
    whole = {t for t, _ in rows}
    assert sum(samples["a"].count(t) for t in whole if t.strip()) >= 10


def test_language_on_held_out_rows(spark):
    rng = random.Random(6)
    parts = {"en": ["th", "ing", "ou", "er", "wh", "ed"], "de": ["sch", "ein", "ung", "ö", "ich", "ver"], "fr": ["eau", "qu", "é", "tion", "oi", "eux"]}
    rows = []
    for k in range(300):
        lang = rng.choice(list(parts))
        rows.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 80))), None if k % 40 == 3 else lang))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !? 456", "en"), (None, rows[0][1], "en"), (1003, "Schein " * 20000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = G.identify(docs).collect()
    by = {r["doc_id"]: r for r in got}
    held = [(by[k]["lang_pred"], lang) for k, _, lang in rows if k is not None and lang and k < 1000 and zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.98
    assert {by[k]["lang_pred"] for k in (1000, 1001, 1002)} == {"und"} and by[1003]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows)
    assert {r["lang_pred"] for r in G.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("doc_id < 3 and lang <> ''")).collect()} <= {"und", ""}
    assert G.identify(docs.limit(0)).collect() == []
