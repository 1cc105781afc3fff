"""Operator 7, byte-pair encoding and decoding by tree concatenation.

A text longer than a leaf is halved, at any character, until its parts are leaves. The leaves of all texts of a batch are encoded together, each as if
it were a text of its own, and joined in pairs, level by level up the tree: around each join a window is encoded anew by the library, and grows until it agrees
with both sides; the windows of a level are one parallel call. Until then the join is not made.

A node is a row of units, each a stretch of characters with its ids. Units end where the text may be cut without harm: after white space, which the model
drops and no token crosses, and, in stretches without any, between two tokens where normalisation cannot reach across (the next character neither combines with nor is
composed into the one before it). A window begins and ends between units. It agrees with the left side in a unit that has the same ids in both and ends before the cut by more
than the longest string of a special token, so that neither what follows the cut nor a special token across it can change that unit; likewise on the right.
A byte-pair encoding is right exactly when each two neighbouring tokens are right next to each other, and cutting into words goes on in the same way after a token
that is the same in both, so left side, window and right side, changed over in the units that agree, are the encoding of the whole.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.chunks import ChunkEncoder
from pagelattice.llm.common import in_parts, slices, table

#: Characters on each side that a window has at first.
REACH = 32
#: Stretches without white space are units as a whole up to this length.
LONG = 64


@lru_cache(1)
def _composed_into() -> frozenset[str]:
    """Characters that composition can join to the one before them."""
    seconds = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A7, 0x11C3))}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    return frozenset(seconds)


@lru_cache(1 << 16)
def starts_anew(c: str) -> bool:
    """Whether normalisation never moves or composes this character into what stands before it; unassigned ones count as if it could."""
    if c < "\u0300":
        return True
    if unicodedata.category(c) in ("Cn", "Mn", "Mc", "Me"):
        return False
    return all(unicodedata.combining(x) == 0 and x not in _composed_into() for x in (c, unicodedata.normalize("NFD", c)[0]))


class Node:
    """Units of a part of a text: `lengths` in characters, `ids` as little-endian unsigned 32-bit bytes."""

    __slots__ = ("begin", "end", "lengths", "ids")

    def __init__(self, begin: int, end: int, lengths: list[int], ids: list[bytes]):
        self.begin, self.end, self.lengths, self.ids = begin, end, lengths, ids


class TreeEncoder:
    """encode_all(texts) gives for each text its ids and the number of joins that were made.

    leaf: characters up to which a text is encoded in one go; memo: stretches that are kept at most.
    """

    def __init__(self, path: str, leaf: int = 2048, memo: int = 500_000):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # a task has about one core; the others belong to other tasks
        self.chunks = ChunkEncoder(path, memo)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.tokenizer = self.chunks.tokenizer
        if self.chunks.byte_level:
            raise ValueError("made for models that drop white space")
        if self.tokenizer.decoder is not None:
            raise ValueError("made for models that decode to tokens joined by spaces")
        self.special = self.chunks.special
        if any(x.isspace() for s in self.special for x in s):
            raise ValueError("made for special tokens without white space")
        self.margin = max(map(len, self.special), default=0) + 4
        self.leaf = leaf
        size = self.tokenizer.get_vocab_size()
        self.decimal, self.token = [str(i) for i in range(size)], [self.tokenizer.id_to_token(i) for i in range(size)]

    # --- leaves

    def _by_library(self, strings: list[str]) -> list:
        return self.tokenizer.encode_batch(strings, add_special_tokens=False) if strings else []

    def leaves(self, texts: list[str]) -> list[Node]:
        """Each text as one node. What no fast way can encode goes to the library in one parallel call."""
        memo = self.chunks.memo
        found, todo = [], []
        for text in texts:
            parts = text.replace("\n", " ").split(" ")
            odd = any(s in text for s in self.special)
            ids: list = []
            for p in parts:
                if len(p) > LONG or (odd and any(s in p for s in self.special)):
                    todo.append((len(found), len(ids), p))
                    ids.append(None)
                else:
                    ids.append(memo[p])
            found.append((parts, ids))
        later: dict[int, dict[int, list]] = {}
        for (i, j, p), e in zip(todo, self._by_library([p for _, _, p in todo]), strict=True):
            later.setdefault(i, {})[j] = self._units(p, e)
        out = []
        for i, (parts, ids) in enumerate(found):
            lengths = [len(p) + 1 for p in parts]
            lengths[-1] -= 1
            if i in later:
                flat_lengths, flat_ids = [], []
                for j, (n, x) in enumerate(zip(lengths, ids, strict=True)):
                    units = later[i].get(j)
                    if units is None:
                        flat_lengths.append(n)
                        flat_ids.append(x)
                    else:
                        flat_lengths += [u for u, _ in units[:-1]] + [units[-1][0] + n - len(parts[j])]
                        flat_ids += [x for _, x in units]
                lengths, ids = flat_lengths, flat_ids
            if not lengths[-1]:
                lengths.pop()
                ids.pop()
            out.append(Node(0, len(texts[i]), lengths, ids))
        return out

    def _units(self, s: str, e) -> list[tuple[int, bytes]]:
        """An encoded stretch without white space as units: cut before tokens that no token crosses into and that normalisation leaves alone."""
        ids, spans = e.ids, e.offsets
        cuts, reach = [], 0
        for k, (x, y) in enumerate(spans):
            if 0 < x and reach <= x and starts_anew(s[x]):
                cuts.append((x, k))
            reach = max(reach, y)
        at, k, out = 0, 0, []
        for x, j in [*cuts, (len(s), len(ids))]:
            out.append((x - at, array("I", ids[k:j]).tobytes()))
            at, k = x, j
        return out

    # --- joins

    def _try(self, s: str, cut: int, left: Node, right: Node, i: int, j: int, window) -> Node | None:
        """The joined node, if the window over left's units from i and right's units before j agrees with both sides."""
        a, b = cut - sum(left.lengths[i:]), cut + sum(right.lengths[:j])
        ids, spans = window.ids, window.offsets
        begins = {}  # place of a clean token boundary in the window -> number of tokens before it
        reach = 0
        for k, (x, y) in enumerate(spans):
            if reach <= x:
                # white space between two tokens is on either side
                for p in range(reach if k else 0, x + 1):
                    begins[a + p] = k
            reach = max(reach, y)
        for p in range(reach, b - a + 1):
            begins[a + p] = len(ids)

        def same(x: int, y: int, unit: bytes) -> bool:
            return x in begins and y in begins and array("I", ids[begins[x] : begins[y]]).tobytes() == unit

        one, at = (0, a) if i == 0 else (None, a)
        for k in range(i, len(left.ids) - 1) if one is None else ():
            end = at + left.lengths[k]
            if end > cut - self.margin:
                break
            if left.ids[k] and same(at, end, left.ids[k]):
                one = k
                break
            at = end
        if one is None:
            return None
        to, other = b, j if j == len(right.ids) else None
        hard = s[b - 1] in " \n"
        for k in range(j - 1, 0, -1) if other is None else ():
            start = to - right.lengths[k]
            if start < cut + self.margin:
                break
            if (hard or to <= b - self.margin) and right.ids[k] and same(start, to, right.ids[k]):
                other, to = k, start
                break
            to = start
        if other is None or at not in begins or to not in begins:
            return None
        middle = array("I", ids[begins[at] : begins[to]]).tobytes()
        return Node(left.begin, right.end, [*left.lengths[:one], to - at, *right.lengths[other:]], [*left.ids[:one], middle, *right.ids[other:]])

    def _level(self, pairs: list[tuple[str, Node, Node]]) -> list[Node]:
        """Joins of one level; each round encodes the windows of all joins that do not agree yet."""
        out: list = [None] * len(pairs)
        open_, reach = list(range(len(pairs))), REACH
        while open_:
            ends, texts = [], []
            for x in open_:
                s, left, right = pairs[x]
                cut = left.end
                i, a = len(left.lengths), cut
                while i and a > cut - reach:
                    i -= 1
                    a -= left.lengths[i]
                j, b = 0, cut
                while j < len(right.lengths) and b < cut + reach:
                    b += right.lengths[j]
                    j += 1
                ends.append((i, j))
                texts.append(s[a:b])
            still = []
            for x, (i, j), window in zip(open_, ends, self._by_library(texts), strict=True):
                s, left, right = pairs[x]
                out[x] = self._try(s, left.end, left, right, i, j, window)
                if out[x] is None:
                    still.append(x)
            open_, reach = still, reach * 4
        return out

    def encode_all(self, texts: list[str | None]) -> list[tuple[array, int]]:
        """Ids and number of joins of each text; null counts as empty."""
        trees = []
        strings: list[str] = []
        for t in texts:
            t = t or ""
            cuts = [0, len(t)]
            while cuts[1] > self.leaf:
                cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False))})
            trees.append((t, cuts))
            strings += [t[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        nodes = iter(self.leaves(strings))
        levels = []
        for _, cuts in trees:
            row = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                n = next(nodes)
                n.begin, n.end = a, b
                row.append(n)
            levels.append(row)
        joins = [len(row) - 1 for row in levels]
        while True:
            todo = [(r, k) for r, row in enumerate(levels) if len(row) > 1 for k in range(0, len(row), 2)]
            if not todo:
                break
            done = iter(self._level([(trees[r][0], levels[r][k], levels[r][k + 1]) for r, k in todo]))
            levels = [[next(done) for _ in range(0, len(row), 2)] if len(row) > 1 else row for row in levels]
        return [(array("I", b"".join(row[0].ids)), n) for row, n in zip(levels, joins, strict=True)]


@lru_cache(1)
def shared_encoder(path: str, leaf: int) -> TreeEncoder:
    """One encoder per worker process, so that tasks go on with what earlier ones have learned."""
    return TreeEncoder(path, leaf)


def encode_decode(docs: DataFrame, tokenizer: str, leaf: int = 2048, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (decimal, joined by spaces) and decoded (the text that the ids decode to); with digest, the sha-256 of both instead;
    and n_joins, the joins of the text's tree.

    A null text counts as empty. Rows are answered each on its own, so repeated rows and null ids stay; an empty table gives an
    empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, leaf)
        decimal, token = encoder.decimal, encoder.token
        done = (lambda s: hashlib.sha256(s.encode()).hexdigest()) if digest else str
        for b in in_parts(batches, 1):
            cols: list[list] = [[], [], [], []]
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                for ids, joins in encoder.encode_all(texts[i:j]):
                    for c, v in zip(cols, (len(ids), done(" ".join([decimal[x] for x in ids])), done(" ".join([token[x] for x in ids])), joins), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_tokens", "ids", "decoded", "n_joins"])

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string, n_joins long")
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"}) if digest else out


def op7_tree_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), digest=True)
