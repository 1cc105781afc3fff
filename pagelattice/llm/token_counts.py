"""Operator 5, token counts by prefix dynamic programming.

A byte-pair encoding is right exactly when each two neighbouring tokens are right next to each other, so the last token of
the encoding of a prefix follows from the last tokens of shorter prefixes: one pass gives the exact token count at every
prefix, and with it answers to where a text must be cut for a budget, without encoding again.
No piece of the vocabulary goes on past the start of a run of spaces, so that pass starts anew at each such start; texts are
then summed from counts of their units, and the count at any prefix is that of the units before plus one row of the unit's own table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import Memo, table

SPACE = "\u2581"
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PrefixCounter:
    """Token counts of a sentencepiece BPE model with byte fallback and an identity normalizer.

    memo: how many counts of units are kept at most, and a quarter as many checked pairs.
    """

    def __init__(self, model: str, memo: int = 1_200_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("the vocabulary has pieces that go on past a space")
        self.longest = max(map(len, self.rank))
        self.parts: dict[str, tuple[str, str]] = {}
        for p in self.rank:
            if len(p) > 1:
                self._build(p)
        #: by the last three characters: how long pieces can be that end so
        self.sizes: dict[str, tuple[int, ...]] = {}
        for p in self.parts:
            if len(p) > 2:
                self.sizes[p[-3:]] = tuple(sorted({*self.sizes.get(p[-3:], ()), len(p)}, reverse=True))
        self.memo = Memo(lambda u: self.prefix_table(SPACE + u)[-1], memo)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.limit = memo

    def _build(self, piece: str) -> None:
        """Finds which two pieces `piece` is merged from last; pieces that merging never makes get none."""
        at = list(piece)
        last = None
        while len(at) > 1:
            best = min(range(len(at) - 1), key=lambda i: (self.rank.get(at[i] + at[i + 1], np.inf), i))
            if at[best] + at[best + 1] not in self.rank:
                return
            last = (at[best], at[best + 1])
            at[best : best + 2] = [at[best] + at[best + 1]]
        self.parts[piece] = last

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the text of a and b ends in just these two: going back from the end, no merge across the border would have come first."""
        limit = np.inf
        rank, parts = self.rank, self.parts
        while True:
            if rank.get(a + b, np.inf) < limit:
                return False
            ra, rb = rank[a] if a in parts else -1, rank[b] if b in parts else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, parts[a][1]
            else:  # of equal merges the left one comes first
                limit, b = np.nextafter(rb, np.inf), parts[b][0]

    def prefix_table(self, unit: str) -> list[int]:
        """Token counts of unit[:0], unit[:1], ... unit."""
        n = len(unit)
        last, count = [""] * (n + 1), [0] * (n + 1)
        pairs, parts, rank = self.pairs, self.parts, self.rank
        sizes = self.sizes
        for i in range(1, n + 1):
            for size in (*sizes.get(unit[i - 3 : i], ()), 2, 1) if i > 2 else range(i, 0, -1):
                if size > i:
                    continue
                piece = unit[i - size : i]
                if size > 1 and piece not in parts:
                    continue
                if size < i:
                    pair = (last[i - size], piece)
                    ok = pairs.get(pair)
                    if ok is None:
                        if len(pairs) >= self.limit // 4:
                            pairs.clear()
                        ok = pairs[pair] = self.fits(*pair)
                    if not ok:
                        continue
                last[i] = piece
                count[i] = count[i - size] + (1 if piece in rank else len(piece.encode()))
                break
        return count

    def units(self, text: str) -> list[str]:
        """The units of a text, each without the space mark it starts with; their lengths plus 1 add up to that of the text and its leading mark."""
        found = text.split(" ")
        if "" in found or SPACE in text:
            return [u[1:] if u[0] == SPACE else "\0" + u for u in _UNITS.findall(SPACE + text.replace(" ", SPACE))]
        return found

    def counts(self, units: list[str]) -> list[int]:
        return list(map(self.memo.__getitem__, units))

    def total(self, units: list[str]) -> int:
        return sum(map(self.memo.__getitem__, units))

    def prefix_counts(self, text: str) -> list[int]:
        """The exact token count of text[:i] for each i from 0 to len(text)."""
        out, base = [0], 0
        for k, u in enumerate(self.units(text) if text else []):
            own = self.prefix_table(SPACE + u)
            # before the text stands a space mark, which is no character of it
            out += [base + c for c in (own[2:] if k == 0 else own[1:])]
            base += own[-1]
        return out

    def longest_prefix(self, units: list[str], counts: list[int], budget: int) -> int:
        """Characters of the longest prefix with at most `budget` tokens, from the units of a text and their counts."""
        before = list(accumulate(counts, initial=0))
        if before[-1] <= budget:
            return max(0, sum(map(len, units)) + len(units) - 1)
        k = int(np.searchsorted(before, budget, side="left"))
        k = k if k < len(units) and before[k] == budget else k - 1
        chars = sum(map(len, units[:k])) + k - 1  # without the mark before the text
        own = self.prefix_table(SPACE + units[k])
        inside = max(i for i, c in enumerate(own) if before[k] + c <= budget)
        return max(0, chars + inside)


@lru_cache(1)
def shared_counter(model: str) -> PrefixCounter:
    """One counter per worker process, so that tasks go on with what earlier ones have learned."""
    return PrefixCounter(model)


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("chars_in_limit", pa.int64())])


def token_counts(docs: DataFrame, model: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit, and chars_in_limit: the characters of the longest prefix with at most `limit` tokens.

    A null text counts as empty (0 bytes, 0 tokens). Rows are answered each on its own, so repeated rows and null ids stay; an empty table
    gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared_counter(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            total, fit = [], []
            for t in texts:
                units = counter.units(t) if t else []
                n = counter.total(units)
                total.append(n)
                fit.append(len(t or "") if n <= limit else counter.longest_prefix(units, counter.counts(units), limit))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(total, pa.int64()), pa.array(fit, pa.int64())], schema=OUT)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, chars_in_limit long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and prefix_counts, the exact token count of every prefix, by characters; a null text has that of the empty text, [0]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared_counter(model)
        for b in batches:
            found = [counter.prefix_counts(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "prefix_counts"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, prefix_counts array<int>")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model"))).select("doc_id", "n_bytes", "n_tokens", "over_limit", "chars_in_limit")
