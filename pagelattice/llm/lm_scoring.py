"""Operator 8, masked pseudo-likelihood scoring with a bidirectional window network.

Every word is predicted from the SIDE words before and after it: each of them has, for each of the four places, a row of weights into one hidden layer, and the output is a
softmax over classes times a softmax over the words of the class, so that a prediction costs two small softmaxes. The score of a document is the sum of
the conditional log-probabilities of all its words; documents are padded at both ends.

The words known by name are the most frequent of the corpus, counted over all documents; their number grows with the cube root of its words, and with it the network. The other
words share hashed buckets, an eighth as many; a word has an equal share of its bucket's probability, by the number of distinct words that the corpus has in the bucket.

Training goes over all documents in rounds: each task walks through its own documents and sends its parameters; their averages, weighted by targets,
start the next round. The words of a document are dealt to the rounds in turn, so that the rounds together have every word as a target once. What is sent
grows with the number of tasks and the size of the network.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import Memo, in_parts, slices, table, word_hashes, written

#: Words known by name are this many times the cube root of all words of the corpus: about 4,200 of 26 million, 300,000 of ten trillion.
NAMED_BY_ROOT = 14
SIDE, HIDDEN = 2, 16
ROUNDS, BATCH, RATE = 2, 8192, 0.2
#: Rows whose class scores are held at once, so that they stay in a core's cache.
BLOCK = 1024


@dataclass(frozen=True)
class Words:
    """known: id (from 1) of the hash of each word known by name, the most frequent first; log_share: for each bucket the logarithm of 1 / its distinct words;
    side: classes of the output, and words in each. Id 0 is padding, the ids behind the known ones are buckets."""

    known: dict[int, int]
    log_share: np.ndarray
    side: int

    @property
    def first_bucket(self) -> int:
        return self.side * self.side - len(self.log_share)

    def id(self, h: int) -> int:
        return self.known.get(h) or self.first_bucket + h % len(self.log_share)


def named_words(n: int) -> int:
    return max(64, int(np.ceil(NAMED_BY_ROOT * n ** (1 / 3))))


def initial(side: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(3)
    shapes = {"embed": (2 * SIDE, side * side, HIDDEN), "hidden0": (HIDDEN,), "cls": (HIDDEN, side), "cls0": (side,), "mem": (side, side, HIDDEN), "mem0": (side, side)}
    return {k: (rng.normal(0, 0.1, s) if not k.endswith("0") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}


def vocabulary(docs: DataFrame, text: str) -> Words:
    """The words of all texts, counted; of equally frequent ones the smaller hash is known first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(held)
            b = pa.RecordBatch.from_arrays([pa.array(word_hashes(words).view(np.int64)), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])
            held.clear()
            return b

        for b in in_parts(batches, 0):
            for t in b.column(0).to_pylist():
                if t:
                    held.update(t.encode().split())
                    if len(held) > 300_000:
                        yield out()
        if held:
            yield out()

    counts = written(docs.select(F.col(text).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    most = named_words(int(counts.agg(F.sum("n")).first()[0] or 0))
    side = int(np.ceil(np.sqrt(1 + most + -(-most // 8))))
    buckets = -(-most // 8)
    # as many rows as words are known; the id 0 is padding
    known = {r["word"]: i + 1 for i, r in enumerate(counts.orderBy(F.desc("n"), "word").limit(side * side - buckets - 1).collect())}
    # as many rows as there are buckets: the words in each, then without the known ones
    distinct = np.zeros(buckets, np.int64)
    for r in counts.groupBy(F.pmod("word", F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n")).collect():
        distinct[r["bucket"]] = r["n"]
    for h in known:
        distinct[h % buckets] -= 1
    return Words(known, -np.log(np.maximum(distinct, 1)), side)


class Encoder:
    def __init__(self, words: Words):
        self.words = words
        self.memo = Memo(self._id, 600_000)

    def _id(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        return self.words.id(h - (1 << 64) if h >> 63 else h)

    def ids(self, text: str | None) -> np.ndarray:
        words = text.encode().split() if text else []
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.uint32, count=len(words))


_ENCODERS: dict[int, Encoder] = {}


def shared_encoder(words: Words) -> Encoder:
    """One encoder per worker process and vocabulary, so that tasks go on with what earlier ones have looked up; `words` is one object for all tasks of a process."""
    if id(words) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(words)] = Encoder(words)
    return _ENCODERS[id(words)]


def encoded(docs: DataFrame, words: Words, doc_id: str, text: str) -> DataFrame:
    """doc_id and ids (4 bytes each) of every row, as a table: texts are read once for all rounds and the scoring."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(known.value)
        for b in in_parts(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder.ids(t).astype("<u4").tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary"), "lm-ids")


def unpacked(ids: bytes, side: int) -> np.ndarray:
    """The ids, in two bytes each where they fit: such columns are sorted in linear time."""
    return np.frombuffer(ids, "<u4").astype(np.uint16 if side <= 256 else np.int32)


def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ids padded with SIDE zeros at both ends; at: places in the padded ids. [place, neighbour]"""
    return np.stack([ids[at + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def hidden(m: dict, ctx: np.ndarray) -> np.ndarray:
    h = m["embed"][0][ctx[:, 0]]
    for j in range(1, 2 * SIDE):
        h += m["embed"][j][ctx[:, j]]
    h += m["hidden0"]
    return np.tanh(h, out=h)


def _softmax(z: np.ndarray, share: np.float32, ones: np.ndarray) -> np.ndarray:
    """In place: the softmax of each row, times `share`; scores over 60 count as 60, which exp can hold."""
    np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    z *= (share / (z @ ones))[:, None]
    return z


def _log_sum(z: np.ndarray) -> np.ndarray:
    """The logarithm of each row's sum of exp; z is lost."""
    if z.size and (z.max() > 60 or z.min() < -60):
        top = z.max(axis=1)
        z -= top[:, None]
        return top + np.log(np.exp(z, out=z).sum(axis=1))
    return np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))


def _by_class(cls: np.ndarray, side: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the places by class, and (class, begin, end) in that order for each class there is: each is one product of matrices."""
    order = np.argsort(cls, kind="stable")
    edges = np.searchsorted(cls[order], np.arange(side + 1))
    return order, [(int(c), int(edges[c]), int(edges[c + 1])) for c in np.flatnonzero(np.diff(edges))]


def log_probabilities(m: dict, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(target | context), each; of a bucket, the probability of the whole bucket."""
    side = len(m["cls0"])
    cls, mem = np.divmod(target, target.dtype.type(side))
    order, parts = _by_class(cls, side)
    h, cls, mem = hidden(m, ctx[order]), cls[order].astype(np.int64), mem[order].astype(np.int64)
    each = np.arange(len(h))
    found = np.empty(len(h), np.float32)
    for i in range(0, len(h), BLOCK):
        z = h[i : i + BLOCK] @ m["cls"]
        z += m["cls0"]
        found[i : i + BLOCK] = z[each[: len(z)], cls[i : i + BLOCK]]
        found[i : i + BLOCK] -= _log_sum(z)
    for c, a, b in parts:
        z = h[a:b] @ m["mem"][c].T
        z += m["mem0"][c]
        found[a:b] += z[each[: b - a], mem[a:b]]
        found[a:b] -= _log_sum(z)
    out = np.empty(len(found))
    out[order] = found
    return out


class Trainer:
    """AdaGrad steps on batches of (context, target); weights that belong to one word share one sum of squares."""

    def __init__(self, m: dict[str, np.ndarray], rate: float = RATE):
        self.m, self.rate, self.word_rate = {k: v.copy() for k, v in m.items()}, np.float32(rate), np.float32(rate * np.sqrt(HIDDEN))
        self.sums = {k: np.full(v.shape[:-1] if k in ("embed", "mem") else v.shape, 1e-6, np.float32) for k, v in m.items()}

    def _move(self, name: str, gradient: np.ndarray, at=...) -> None:
        self.sums[name][at] += gradient * gradient
        self.m[name][at] -= self.rate * gradient / np.sqrt(self.sums[name][at])

    def _move_rows(self, name: str, gradient: np.ndarray, at) -> None:
        total = self.sums[name][at] + np.einsum("...j,...j->...", gradient, gradient)
        self.sums[name][at] = total
        gradient *= (self.word_rate / np.sqrt(total))[..., None]
        self.m[name][at] -= gradient

    def step(self, ctx: np.ndarray, target: np.ndarray) -> None:
        m, n, side = self.m, len(ctx), len(self.m["cls0"])
        cls, mem = np.divmod(target, target.dtype.type(side))
        order, parts = _by_class(cls, side)
        ctx, cls, mem, each = ctx[order], cls[order].astype(np.int64), mem[order].astype(np.int64), np.arange(n)
        h, one, ones = hidden(m, ctx), np.float32(1 / n), np.ones(side, np.float32)
        dh, d_cls, d_cls0 = np.empty_like(h), np.zeros_like(m["cls"]), np.zeros_like(m["cls0"])
        for i in range(0, n, BLOCK):
            part = h[i : i + BLOCK]
            g = part @ m["cls"]
            g += m["cls0"]
            _softmax(g, one, ones)[each[: len(g)], cls[i : i + BLOCK]] -= one
            np.matmul(g, m["cls"].T, out=dh[i : i + BLOCK])
            d_cls += part.T @ g
            d_cls0 += g.sum(axis=0)
        d_mem, d_mem0 = np.zeros_like(m["mem"]), np.zeros_like(m["mem0"])
        for c, a, b in parts:
            part = h[a:b]
            g = part @ m["mem"][c].T
            g += m["mem0"][c]
            _softmax(g, one, ones)[each[: b - a], mem[a:b]] -= one
            dh[a:b] += g @ m["mem"][c]
            np.matmul(g.T, part, out=d_mem[c])
            d_mem0[c] = g.sum(axis=0)
        self._move_rows("mem", d_mem, ...)
        self._move("mem0", d_mem0)
        self._move("cls", d_cls)
        self._move("cls0", d_cls0)
        dh *= 1 - h * h
        self._move("hidden0", dh.sum(axis=0))
        for j in range(2 * SIDE):
            order = np.argsort(ctx[:, j], kind="stable")
            words = ctx[order, j]
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            self._move_rows("embed", np.add.reduceat(dh[order], first, axis=0), (j, words[first]))


def _flat(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in m.values()])


def _unflat(x: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = x[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def laid_out(packed: list[bytes], side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of some documents one behind the other, with SIDE zeros before, between and behind them; words of each document; and of every word its document and its place among the ids."""
    gap = bytes(4 * SIDE)
    flat = unpacked(gap + b"".join([x + gap for x in packed]), side)
    size = np.array([len(x) // 4 for x in packed], dtype=np.int64)
    row = np.repeat(np.arange(len(packed)), size)
    return flat, size, row, np.arange(len(row)) + SIDE * (row + 1)


def in_round(size: np.ndarray, row: np.ndarray, r: int, rounds: int) -> np.ndarray:
    """Which words are targets of round r; all rounds together have each word of a document once. size, row: see laid_out()."""
    inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return inside % rounds == ((size * 7 + r) % rounds)[row]


def train(rows: DataFrame, side: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """rows: the table of encoded()."""
    spark: SparkSession = rows.sparkSession
    model = initial(side)
    chunk = 1 << 15
    for r in range(rounds):
        start = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], r=r, start=start) -> Iterator[pa.RecordBatch]:
            trainer, held, size, done = Trainer(start.value), [], 0, 0
            rng = np.random.default_rng(r)
            for b in batches:
                packed = b.column(0).to_pylist()
                for i, j in slices(packed, 1 << 18):
                    flat, sizes, row, at = laid_out(packed[i:j], side)
                    at = at[in_round(sizes, row, r, rounds)]
                    held.append((contexts(flat, at), flat[at]))
                    size += len(at)
                    if size >= 8 * BATCH:
                        done += _walk(trainer, held, rng)
                        held, size = [], 0
            if size:
                done += _walk(trainer, held, rng)
            if done:
                x = _flat(trainer.m).astype(np.float64) * done
                parts = [x[i : i + chunk].tobytes() for i in range(0, len(x), chunk)]
                salt = int(rng.integers(1 << 30) ^ done) & 0x3FFFFFFF
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([done] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["chunk", "salt", "n", "sums"])

        schema = "chunk int, salt int, n long, sums binary"
        sent = written(rows.select("ids").mapInArrow(run, schema), "lm-sums")
        # added up in groups of about 64 tasks, then all groups of a part of the model
        tasks = max(1, sent.where("chunk = 0").count())
        sums = sent.withColumn("salt", F.pmod("salt", F.lit(-(-tasks // 64)))).groupBy("chunk", "salt").applyInArrow(lambda key, t: _added(t), schema).groupBy("chunk").applyInArrow(lambda key, t: _added(t), schema)
        found = sorted(sums.collect(), key=lambda row: row["chunk"])
        if not found:
            continue
        model = _unflat(np.concatenate([np.frombuffer(row["sums"]) / row["n"] for row in found]), model)
    return model


def _walk(trainer: Trainer, held: list, rng: np.random.Generator) -> int:
    ctx, target = np.concatenate([c for c, _ in held]), np.concatenate([t for _, t in held])
    for part in np.array_split(rng.permutation(len(target)), max(1, len(target) // BATCH)):
        trainer.step(ctx[part], target[part])
    return len(target)


def _added(t: pa.Table) -> pa.Table:
    total = None
    for b in t["sums"]:
        x = np.frombuffer(b.as_py())
        total = x.copy() if total is None else total + x
    return pa.table({"chunk": pa.array([t["chunk"][0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})


def score(rows: DataFrame, model: dict[str, np.ndarray], words: Words) -> DataFrame:
    """rows: the table of encoded(). Per row: doc_id, n_words, log_likelihood (the sum over all words; 0 without words), mean_log_likelihood (null without words)."""
    spark = rows.sparkSession
    net, shares, first, side = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(words.log_share), words.first_bucket, words.side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = net.value
        share = np.concatenate([np.zeros(first), shares.value])
        for b in batches:
            packed, n, total = b.column(1).to_pylist(), [], []
            for i, j in slices(packed, 1 << 18):
                flat, size, row, at = laid_out(packed[i:j], side)
                p = np.empty(len(at))
                # a long text by parts, so that working memory is bounded
                for k in range(0, len(at), 1 << 15):
                    part = at[k : k + (1 << 15)]
                    p[k : k + len(part)] = log_probabilities(m, contexts(flat, part), flat[part]) + share[flat[part]]
                n += size.tolist()
                total += np.bincount(row, p, j - i).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "n_words", "log_likelihood"])

    out = rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_words long, log_likelihood double")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Trains on all documents and scores all of them: see score().

    A null or empty text has no words. Rows are scored each on its own, so repeated rows and null ids stay; an empty table gives an empty result; other columns are not read.
    """
    words = vocabulary(docs, text)
    rows = encoded(docs, words, doc_id, text)
    return score(rows, train(rows, words.side), words)


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
