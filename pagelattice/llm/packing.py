"""Operator 3, best-fit packing by large-item matching.

The tokens of every document are cut into pieces of at most `capacity`; the pieces are packed into as few sequences as
possible. Two items above a third of the capacity fill a sequence at most in pairs, so these are matched greedily
(the largest with the largest that still fits); the smaller ones go, largest first, to the gap that they fill best.

The plan needs only how many pieces there are of each length: at most `capacity` numbers, whatever the corpus. It is made
for whole groups of equal sequences at once and stays small; each piece then finds its place from its rank among the
pieces of its length. Nothing but that histogram and the plan passes through the driver.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagelattice.llm.chunks import shared_encoder
from pagelattice.llm.common import in_parts, table, written

CAPACITY = 2048

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of sequences, lengths in each) for `counts` pieces of each length; all pieces are placed.

    >>> plan({1400: 1, 700: 2, 600: 3}, 2048)
    [(1, [1400, 600]), (1, [700, 700, 600]), (1, [600])]
    """
    left = {n: c for n, c in counts.items() if c > 0}
    gaps: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    large = sorted(n for n in left if 3 * n > capacity)
    # sequences opened by a large item, largest first, each with the largest partner that fits
    while large:
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1
        if i < 0:
            gaps[capacity - a].append((left.pop(a), [a]))
        else:
            b = large[i]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if a == b and left[a] % 2 and n == 0:
                # one of this length is left: with the next smaller one, or alone
                del large[-1]
                left.pop(a)
                partner = large[-1] if large else None
                if partner is not None:
                    gaps[capacity - a - partner].append((1, [a, partner]))
                    left[partner] -= 1
                    if not left[partner]:
                        left.pop(partner)
                        large.pop()
                else:
                    gaps[capacity - a].append((1, [a]))
                continue
            gaps[capacity - a - b].append((n, [a, b]))
            left[a] -= n
            left[b] -= n
        large = [n for n in large if left.get(n, 0) > 0]
        left = {n: c for n, c in left.items() if c > 0}
    # the others, largest first, into the smallest gap that takes one
    open_gaps = sorted(g for g in gaps if g > 0)
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            i = bisect.bisect_left(open_gaps, size)
            if i == len(open_gaps):
                each = min(capacity // size, n)
                whole = n // each
                gap = capacity - each * size
                _add(gaps, open_gaps, gap, (whole, [size] * each))
                n -= whole * each
                continue
            gap = open_gaps[i]
            m, inside = gaps[gap].pop()
            if not gaps[gap]:
                del open_gaps[i]
            each = min(gap // size, n)
            used = min(m, n // each)
            if used < m:
                _add(gaps, open_gaps, gap, (m - used, inside))
            _add(gaps, open_gaps, gap - each * size, (used, inside + [size] * each))
            n -= used * each
    return [group for gap in sorted(gaps) for group in gaps[gap]]


def _add(gaps: dict, open_gaps: list[int], gap: int, group: tuple[int, list[int]]) -> None:
    if gap > 0 and not gaps[gap]:
        bisect.insort(open_gaps, gap)
    gaps[gap].append(group)


def places(groups: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each run of pieces, the sequence of that first piece, and the offset that all of the run have."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for n, inside in groups:
        at = 0
        for size in inside:
            runs[size].append((taken[size], base, at))
            taken[size] += n
            at += size
        base += n
    return {size: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for size, r in runs.items()}


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32. A null or empty text has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = shared_encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for b in in_parts(batches, 1):
            cols: list[list] = [[], [], [], [], []]
            for i, ids in zip(b.column(0).to_pylist(), map(encoder.encode, b.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(cols, (i, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, PIECES, strict=True)], schema=PIECES)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: int = CAPACITY, parts: int | None = None) -> DataFrame:
    """`items` (a `length` column of 1..capacity; all other columns are kept) with sequence_id and offset.

    Items of one length are interchangeable, so ties are settled by row order within hashed parts; repeated rows are
    packed each on its own; an empty table gives an empty result. `items` must be a written table or otherwise give the
    same rows when read twice. `parts`: into how many parts the pieces of one length are dealt for ranking, so that a
    length with most of the pieces is no hot group.
    """
    spark = items.sparkSession
    names = items.columns
    parts = parts or max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = items.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(parts)))
    sizes = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(sizes.select("length", "_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "packing-sizes")
    # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    found = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    ranked = dealt.join(bases.drop("_n").hint("merge"), ["length", "_part"]).withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*[F.col(f"`{c}`") for c in names if c != "length"] or ["length"])) - 1 + F.col("_base"))
    out = ranked.select(*[F.col(f"`{c}`") for c in names], "_rank")
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at_length = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = found.value
        for b in batches:
            lengths, ranks = b.column(at_length).to_numpy(zero_copy_only=False), b.column(len(names)).to_numpy(zero_copy_only=False)
            seq, off = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                first, base, at = by[int(n)]
                k = np.searchsorted(first, ranks[rows], side="right") - 1
                seq[rows], off[rows] = base[k] + ranks[rows] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return out.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its offset there; only documents longer than `capacity` are cut.

    Null texts count as empty, and give a piece of the end id alone; documents that share a doc_id, or have none, are packed each on its own;
    an empty table gives an empty result; other columns are not read.
    """
    return pack(written(pieces(docs, tokenizer, end_id, capacity, doc_id, text), "packing-pieces"), capacity)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
