"""Language identification by cross-parsing entropy.

A suffix automaton per language holds every substring of that language's sample of labelled text. A
document is parsed into phrases, each the longest match from where the last one ended; with c phrases,
c * log2(m) / n bits a character estimate its cross entropy against a sample of m characters (Ziv and
Merhav). The language needing the fewest normalised phrases wins; of equal ones the name that sorts first. The
score is the winner's share of 2**-rate over all languages at the phrase rates found.

Every letter that a sample has is a class of its own, in whatever script or plane; what is no letter is one
class, and so are letters that no sample has, each of which is a phrase. An automaton's transitions are a
hash table, so its size depends on the sample and not on the alphabet.

Texts are cut into pieces that are parsed side by side, each as if a phrase began there; the parse of a piece then runs on
past its end until it begins a phrase where the piece it is in began one too, from where on both are the same. So the phrases
are those of one parse of the whole text. Where the two don't meet within RUN_ON characters (periodic texts), that
text is parsed on character by character.

Learning takes whole rows of least hash, FIT_ROWS of a language and SAMPLE_CHARS characters of them at most
(ALL_CHARS for all languages, which bounds the model that is broadcast). Rows over an eighth of that are passed over;
only where a language has no others, the shortest one's beginning is its sample. Labels and ids are never
inputs of a prediction.

Nulls: a null text, or one without a letter, is `und` with score 0; null labels are not learned. A null id
counts as the empty string for the split. Repeated rows are predicted alike. Without labels all is `und`.
Empty table: empty result. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terradrift.llm.common import blocks, hashed_share
from terradrift.ship import ship

#: Bounds of the sample per language, and of all samples together.
FIT_ROWS, SAMPLE_CHARS, ALL_CHARS = 300, 40_000, 4_000_000
#: Characters of a text that one lane parses, and that it may run on until it meets the parse of the next.
PIECE, RUN_ON = 512, 1024
#: Bytes of plain tables (state by class) that a worker makes of automata of few classes, which is only faster.
TABLE_BYTES = 64 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Suffix automaton of a sequence of classes. The state that no class leaves is the last one."""

    def __init__(self, sample: np.ndarray, width: int):
        step = _steps(sample)
        self.size, self.width, self.dead = len(sample), width, len(step)
        self.root = np.full(width, self.dead, np.int32)
        self.root[list(step[0])] = list(step[0].values())
        n = [len(d) for d in step]
        key = np.repeat(np.arange(len(step), dtype=np.int64), n) * width + np.fromiter((c for d in step for c in d), np.int64, sum(n))
        to = np.fromiter((t for d in step for t in d.values()), np.int32, sum(n))
        bits = max(4, int(np.ceil(np.log2(3 * max(1, len(key))))))
        self.shift, self.mask, self.table = np.uint64(64 - bits), (1 << bits) - 1, None
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at = self._place(key)
        while len(key):  # linear probing; of keys that meet at a free place the first stays
            free = np.flatnonzero(self.keys[at] < 0)
            place, first = np.unique(at[free], return_index=True)
            self.keys[place], self.to[place] = key[free[first]], to[free[first]]
            left = np.ones(len(key), bool)
            left[free[first]] = False
            key, to, at = key[left], to[left], (at[left] + 1) & self.mask

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MULT) >> self.shift).astype(np.int64)

    def table_bytes(self) -> int:
        return 4 * (self.dead + 1) * self.width

    def tabulate(self) -> None:
        """All transitions in one array; where a phrase begins, bit 30 is set."""
        self.table = np.tile(self.root | np.int32(1 << 30), self.dead + 1)
        used = self.keys >= 0
        self.table[self.keys[used]] = self.to[used]

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether a phrase begins with c."""
        key = state * np.int64(self.width) + c
        if self.table is not None:
            to = self.table[key]
            return to & ((1 << 30) - 1), to >= 1 << 30
        at = self._place(key)
        there = self.keys[at]
        begins = there != key
        to = np.where(begins, self.root[c], self.to[at])
        more = np.flatnonzero(begins & (there >= 0))
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            there = self.keys[at[more]]
            hit = there == key[more]
            found = more[hit]
            to[found], begins[found] = self.to[at[found]], False
            more = more[~hit & (there >= 0)]
        return to, begins

    def one(self, state: int, c: int) -> tuple[int, bool]:
        to, begins = self.step(np.array([state], np.int64), np.array([c], np.int64))
        return int(to[0]), bool(begins[0])


def _steps(sample: np.ndarray) -> list[dict[int, int]]:
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in sample.tolist():
        now = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


@dataclass
class LanguageModel:
    names: list[str]
    classes: np.ndarray  # of each code point; 0 no letter, 1 a letter no sample has
    automata: list[Automaton]


@cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _units(text: str | None) -> np.ndarray:
    """Lower-cased code points."""
    return np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def sample(docs: DataFrame, fit_rows: int = FIT_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """The sample of each language. docs: text and lang of the rows to learn from."""
    known = docs.where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    # the sample is found on 20 bytes a row: about four times fit_rows of a language by hash, then the least of them
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("all"))
    least = known.join(F.broadcast(sizes), "lang").where(hashed_share(F.lit(4.0 * fit_rows) / F.col("all"), "h")).select("lang", "h", "n").distinct()  # a row a language
    by = Window.partitionBy("lang")
    least = least.withColumn("r", F.row_number().over(by.orderBy("h", "n")))
    rows = least.where(F.col("r") <= fit_rows).select("lang", "h", "n").toPandas().sort_values(["lang", "h", "n"])  # fit_rows a language, numbers only
    chars = min(chars, ALL_CHARS // max(1, rows["lang"].nunique()))
    wanted = []
    for lang, part in rows.groupby("lang"):
        some = part[part["n"] <= chars // 8]
        some = some[(some["n"] + 1).cumsum() <= chars] if len(some) else part.nsmallest(1, "n")
        wanted += [(lang, int(h)) for h in some["h"]]
    if not wanted:
        return {}
    picked = docs.sparkSession.createDataFrame(wanted, "lang string, h long")
    picked = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["lang", "h"]).dropDuplicates(["lang", "h"])  # fit_rows a language
    got = picked.select("lang", "h", F.substring("text", 1, chars).alias("text")).toPandas().sort_values(["lang", "h"])  # chars a language
    return {lang: " ".join(part["text"]) for lang, part in got.groupby("lang")}


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, chars: int = SAMPLE_CHARS) -> LanguageModel:
    """docs: text and lang of the rows to learn from."""
    return build(sample(docs, fit_rows, chars))


def build(samples: dict[str, str]) -> LanguageModel:
    names = sorted(samples)
    units = [_units(samples[k]) for k in names]
    classes = letters().astype(np.int32)
    if names:
        seen = np.unique(np.concatenate(units))
        seen = seen[letters()[seen]]
        classes[seen] = np.arange(2, 2 + len(seen))
    width = int(classes.max()) + 1
    return LanguageModel(names, classes, [Automaton(classes[u], width) for u in units])


def phrases(model: LanguageModel, texts: list[np.ndarray]) -> np.ndarray:
    """Phrases that each text needs against each language."""
    n = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(n), len(model.names)), np.int64)
    if not n.sum():
        return out
    flat = model.classes[np.concatenate(texts)].astype(np.int64)
    end = np.cumsum(n)
    lanes = -(-n // PIECE)
    owner = np.repeat(np.arange(len(n)), lanes)
    first = np.cumsum(lanes) - lanes
    begin = (end - n)[owner] + (np.arange(len(owner)) - first[owner]) * PIECE
    stop, last = np.minimum(begin + PIECE, end[owner]), end[owner]
    for m, automaton in enumerate(model.automata):
        out[:, m] = _parsed(automaton, flat, begin, stop, last, first, lanes)
    return out


def _parsed(automaton: Automaton, flat, begin, stop, last, first, lanes) -> np.ndarray:
    starts = np.zeros(len(flat), bool)  # whether the lane's own parse begins a phrase there
    order = np.argsort(begin - stop, kind="stable")  # the longest first
    size, at = (stop - begin)[order], begin[order].copy()
    states = np.full(len(order), automaton.dead, np.int64)
    for k in range(int(size[0])):
        a = int(np.searchsorted(-size, -k, "left"))  # lanes with more than k characters
        to, new = automaton.step(states[:a], flat[at[:a]])
        starts[at[:a][new]] = True
        states[:a] = to
        at[:a] += 1
    state = np.empty_like(states)
    state[order] = states
    # lanes that run on: the phrases they begin, until one begins where the lane they are in begins one
    extra, meets = np.zeros(len(begin), np.int64), np.full(len(begin), -1, np.int64)
    on, at = np.flatnonzero(stop < last), stop.copy()
    for _ in range(RUN_ON):
        if not len(on):
            break
        p = at[on]
        to, new = automaton.step(state[on], flat[p])
        met = new & starts[p]
        meets[on[met]] = p[met]
        extra[on[new & ~met]] += 1
        on, p, to = on[~met], p[~met], to[~met]
        state[on], at[on] = to, p + 1
        on = on[p + 1 < last[on]]
    upto = np.concatenate([[0], np.cumsum(starts)])
    total = upto[stop] - upto[begin] + extra
    out = total[first * (lanes > 0)] * (lanes > 0)
    for d in np.flatnonzero(lanes > 1).tolist():
        k, top, count = int(first[d]), int(last[first[d]]), 0
        p = int(begin[k])
        while True:
            count += int(total[k] - (upto[p] - upto[begin[k]]))
            p, q = int(meets[k]), int(at[k])
            if p < 0 and q < top:
                s = int(state[k])
                while q < top:
                    s, new = automaton.one(s, int(flat[q]))
                    if new and starts[q]:
                        p = q
                        break
                    count += new
                    q += 1
            if p < 0:
                break
            k = int(first[d]) + (p - int(begin[first[d]])) // PIECE
        out[d] = count
    return out


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out (if docs has it), lang_pred and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ALL_CHARS bounds it
    keep = [c for c in ("doc_id", "held_out") if c in docs.columns]

    def run(batches):
        import pyarrow as pa

        m = shared.value
        is_letter = letters()
        bits = np.log2(np.maximum(2, [a.size for a in m.automata]))
        left = TABLE_BYTES - sum(a.table_bytes() for a in m.automata if a.table is not None)
        for a in sorted(m.automata, key=Automaton.table_bytes):
            if a.table is None and a.table_bytes() <= left:
                a.tabulate()
                left -= a.table_bytes()
        for batch in batches:
            texts = batch["text"].to_pylist()
            size = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])])
            lang, score = [], np.zeros(len(texts))
            for i, j in blocks(size, 1 << 21):
                units = [_units(t) for t in texts[i:j]]
                some = np.array([bool(is_letter[u].any()) for u in units])
                if not m.names:
                    lang += ["und"] * (j - i)
                    continue
                rate = phrases(m, units) * bits / np.maximum(1, [len(u) for u in units])[:, None]
                best = rate.argmin(1)
                share = 2.0 ** -(rate - rate.min(1, keepdims=True)).clip(0, 60)
                score[i:j] = np.where(some, 1 / share.sum(1), 0)
                lang += [m.names[b] if s else "und" for b, s in zip(best, some, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    ship(docs.sparkSession)
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    return predict(rows.drop("lang"), fit(rows.where("not held_out").select("text", "lang")))
