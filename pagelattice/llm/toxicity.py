"""Operator 2, toxicity by a factorization machine over hashed terms.

Terms are the words of a text in lower case and their beginnings of 3 to 6 letters, hashed. The score is the logistic function of
w0 + sum of w[i] + sum over pairs of <v[i], v[j]> over the distinct terms of the text that the model knows, so that two terms can tell more together
than each does alone. Labels are learned from a bounded sample; the model knows the terms of the sample that go with the labels most clearly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import Memo, in_parts, table, written

#: Labelled rows that are learned from at most: those with the smallest hashes of doc_id.
SAMPLE = 20_000
#: Terms that the model knows at most.
TERMS = 4096
#: Terms that are counted in pairs.
PAIR_TERMS = 2048
BUCKET_BITS = 22
FACTORS = 8
_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[int]:
    """Hashed terms of one word in lower case."""
    names = ["w" + word, *("p" + word[:n] for n in range(3, 7) if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(x.encode()) >> (64 - BUCKET_BITS) for x in names]


def text_terms(text: str | None, terms: Memo) -> np.ndarray:
    """Sorted distinct terms; terms: a memo of word_terms, or of the part of them that is wanted."""
    found: set[int] = set()
    for t in map(terms.__getitem__, set(_WORD.findall(text.lower())) if text else ()):
        found.update(t)
    return np.array(sorted(found), dtype=np.int64)


@dataclass
class Machine:
    """terms: sorted; bias, weights and factors belong to them in this order."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, known: np.ndarray) -> float:
        """known: places of a text's terms in `terms`."""
        v = self.factors[known]
        s = v.sum(axis=0)
        z = self.bias + float(self.weights[known].sum()) + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def likelihood_ratio(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """How clearly presence goes with the label. counts: [label, term] documents; totals: [label]."""
    counts, n = counts.astype(np.float64), totals.sum()
    df, ratio = counts.sum(axis=0), np.zeros(counts.shape[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        for y in (0, 1):
            for have, of in ((counts[y], df), (totals[y] - counts[y], n - df)):
                ratio += np.where(have > 0, 2 * have * np.log(have * n / (totals[y] * of)), 0)
    return ratio


def select_terms(counts: np.ndarray, totals: np.ndarray, most: int, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The terms that are clear alone, at most `most`, and the next PAIR_TERMS, which are to be counted in pairs; both sorted."""
    often = np.flatnonzero(counts.sum(axis=0) >= least)
    ratio = likelihood_ratio(counts[:, often], totals)
    order = np.argsort(-ratio, kind="stable")
    clear = order[: min(most, int((ratio > 15).sum()))]
    return np.sort(often[clear]), np.sort(often[order[len(clear) : len(clear) + PAIR_TERMS]])


def select_pairs(rows: list[tuple[np.ndarray, int]], terms: np.ndarray, totals: np.ndarray, least: int = 4) -> np.ndarray:
    """The terms of the pairs that go with the label clearly, for the number of pairs, and far more so than either term. rows: sorted terms, and label."""
    k = len(terms)
    both = np.zeros((2, k, k), np.float32)
    for y in (0, 1):
        held: list[np.ndarray] = []

        def add(y=y, held=held) -> None:
            x = np.zeros((len(held), k), np.float32)
            for i, t in enumerate(held):
                x[i, t] = 1
            both[y] += x.T @ x
            held.clear()

        for t, label in rows:
            if label == y:
                held.append(np.searchsorted(terms, np.intersect1d(t, terms, assume_unique=True)))
                if len(held) == 2048:
                    add()
        if held:
            add()
    alone = likelihood_ratio(np.stack([np.diag(both[0]), np.diag(both[1])]), totals)
    found = np.zeros(k, bool)
    for i in range(k):
        ratio = likelihood_ratio(both[:, i], totals)
        clear = (both[0, i] + both[1, i] >= least) & (ratio > 40) & (ratio > np.maximum(alone, alone[i]) + 25)
        clear[i] = False
        if clear.any():
            found[i] = True
            found |= clear
    return terms[found]


def fit(rows: list[tuple[np.ndarray, int]], terms: np.ndarray, epochs: int = 30, rate: float = 0.1, decay: float = 1e-4, factors: int = FACTORS) -> Machine:
    """rows: places of known terms, and label. Logistic loss, AdaGrad, batches of 256. Without factors it is a linear model."""
    rng = np.random.default_rng(1)
    labels = np.array([y for _, y in rows], dtype=np.float64)
    share = float(labels.mean()) if len(rows) else 0.0
    m = Machine(terms, float(np.log((share * len(rows) + 0.5) / ((1 - share) * len(rows) + 0.5))), np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), factors)))
    if not len(terms) or share in (0.0, 1.0):
        return m
    gw, gv, gb = np.full(len(terms), 1e-6), np.full((len(terms), factors), 1e-6), 1e-6
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
            places = [rows[i][0] for i in part]
            size = np.array([len(p) for p in places])
            idx, row = np.concatenate(places), np.repeat(np.arange(len(part)), size)
            v = m.factors[idx]
            s = np.zeros((len(part), factors))
            np.add.at(s, row, v)
            linear = np.bincount(row, m.weights[idx], len(part)) + m.bias
            z = linear + 0.5 * ((s * s).sum(axis=1) - np.bincount(row, (v * v).sum(axis=1), len(part)))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[part]) / len(part)
            used, at = np.unique(idx, return_inverse=True)
            dw = np.bincount(at, g[row], len(used)) + decay * m.weights[used]
            dv = np.zeros((len(used), factors))
            np.add.at(dv, at, g[row, None] * (s[row] - v))
            dv += decay * m.factors[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.sum() ** 2
            m.weights[used] -= rate * dw / np.sqrt(gw[used])
            m.factors[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            m.bias -= rate * g.sum() / np.sqrt(gb)
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Machine:
    """Learns from at most `sample` labelled documents, none of which is held out. Null ids, labels and texts teach nothing; with no
    labels, or all of one kind, the model knows no terms and gives their share everywhere."""
    chosen = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)").where(~held_out(F.col("_id")))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_terms, 200_000)
        for b in in_parts(batches, 0):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([text_terms(t, memo).astype("<u4").tobytes() for t in b.column(0).to_pylist()], pa.binary())], names=["label", "terms"])

    # the sample is bounded, so it can be broadcast
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).where("_text is not null").join(F.broadcast(chosen), "_id").select("_text", F.col("_label").alias("label"))
    found = written(rows.mapInArrow(run, "label int, terms binary"), "toxicity-sample")
    if found.count() > sample:  # an id with several documents or labels
        found = written(found.orderBy(F.xxhash64("terms", "label")).limit(sample), "toxicity-sample")
    counts, totals = np.zeros((2, 1 << BUCKET_BITS), np.int32), np.zeros(2)
    for r in found.toLocalIterator():
        counts[r["label"], np.frombuffer(r["terms"], "<u4")] += 1
        totals[r["label"]] += 1
    if not totals.all():
        terms, pairs = np.empty(0, np.int64), np.empty(0, np.int64)
    else:
        terms, pairs = select_terms(counts, totals, TERMS)
    known = np.union1d(terms, pairs)
    rows = [(np.intersect1d(np.frombuffer(r["terms"], "<u4"), known, assume_unique=True), r["label"]) for r in found.toLocalIterator()]
    if len(pairs):
        terms = np.union1d(terms, select_pairs(rows, pairs, totals))
    return fit([(np.searchsorted(terms, np.intersect1d(t, terms, assume_unique=True)), y) for t, y in rows], terms)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. A null or empty text has the score of a text without known terms. Rows are scored each on
    its own, so repeated rows and null ids (never held out) stay; an empty table gives an empty result; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {int(t): i for i, t in enumerate(m.terms)}
        memo = Memo(lambda w: tuple(place[t] for t in word_terms(w) if t in place), 400_000)
        for b in in_parts(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(text_terms(t, memo)) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """`docs` without the rows whose text scores `threshold` or more; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {int(t): i for i, t in enumerate(m.terms)}
        memo = Memo(lambda w: tuple(place[t] for t in word_terms(w) if t in place), 400_000)
        for b in in_parts(batches, at):
            yield b.filter(pa.array([m.score(text_terms(t, memo)) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
