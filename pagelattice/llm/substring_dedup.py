"""Operator 1, substring dedup with a count-min prefilter.

Every window of `width` consecutive words has a 128-bit key, and an anchor: the run of 2/5 * `width` words inside it with the smallest hash, the leftmost of equals.
Windows of the same words have their anchors at the same place inside, so a window never occurs more often than its anchor does; neighbours
mostly share one, so there is an anchor for every six windows or so. One plan, whose texts are dealt to blocks once:

1. Each task counts its anchors, up to 2, and sends these partial sketches to slices by key, each anchor once with the block of its document. A slice merges them
   in a count-min sketch of two rows with 3 counters per anchor and row. Counters are never below the true count, so a window whose anchor's counters are not both 2
   occurs once. What a slice estimates repeated goes back to the block it came from; a task that sees an anchor twice tells the blocks by itself, so a passage that
   a third of all documents share is one entry per task in its slice.
2. Only windows estimated repeated go on from a block, at most one per key and `flush` of them: the first. They are grouped exactly by key, in
   buckets of keys, and the first occurrence of each key is kept.
3. Those first occurrences return to their blocks; a window estimated repeated that is not the first of its key is covered by an earlier one, and its words go.

The sketch grows with the corpus: there are as many slices as the texts ask for, each of about `SLICE` anchors. Nothing is broadcast and nothing but the size of the texts comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelattice.llm.common import NULL_ID, in_parts, odd_numbers, slices, table, word_hashes

WIDTH = 20
SLICE = 4_000_000
#: counters per anchor and row
COUNTERS = 3
BYTES_A_WORD = 6


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def window_keys(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each run of `width` word hashes, by polynomials whose powers are taken out again, so that a key depends on the words alone."""
    if len(h) < width:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    out = []
    for base, g in zip(odd_numbers(11, 2).tolist(), (h, mixed(h + np.uint64(0x9E3779B97F4A7C15))), strict=True):
        inverse = pow(base, -1, 1 << 64)
        n = len(h)
        up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(g * up, out=total[1:])
        out.append(mixed((total[width:] - total[:-width]) * down[: n - width + 1]))
    return out[0], out[1]


def anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of `width` word hashes, the key of its anchor and where that begins; the places never go down."""
    size = max(1, 2 * width // 5)
    v = window_keys(h, size)[0]
    at, span, room = np.arange(len(v)), 1, width - size + 1
    # the smallest of 2, 4, 8, ... neighbours, then two overlapping stretches
    while span < room:
        step = min(span, room - span)
        left, right = at[:-step], at[step:]
        at = np.where(v[left] <= v[right], left, right)
        span += step
    # smallest hashes are small: mixed again, they are spread over the slices
    return mixed(v[at] + np.uint64(0x9E3779B97F4A7C15)), at


class Words:
    """The words of consecutive texts: `lists`, where each text begins among them, and the keys and anchors of all windows within one text."""

    def __init__(self, texts: list, width: int):
        self.lists = [t.encode().split() if t else [] for t in texts]
        counts = np.array([len(x) for x in self.lists], dtype=np.int64)
        self.begin = np.cumsum(counts) - counts
        h = word_hashes([w for x in self.lists for w in x])
        doc = np.repeat(np.arange(len(texts)), counts)
        k1, k2 = window_keys(h, width)
        inside = np.flatnonzero(doc[: len(k1)] == doc[width - 1 :]) if len(k1) else np.empty(0, np.int64)
        self.k1, self.k2, self.doc = k1[inside], k2[inside], doc[inside]
        self.start = inside - self.begin[self.doc]
        key, at = anchors(h, width) if len(inside) else (k1, inside)
        self.anchor, at = key[inside], at[inside]
        #: one window of each anchor
        self.once = np.flatnonzero(np.diff(at, prepend=-1))


def cells(k: np.ndarray, n: int) -> np.ndarray:
    return (((k >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.uint32)


def shuffled(*arrays: np.ndarray) -> bytes:
    """Numbers by bytes of equal weight, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays))


def unshuffled(data: bytes, kinds: tuple[type, ...]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


_ANCHOR = (np.uint64, np.int32)
_CANDIDATE = (np.uint64, np.uint64, np.int64, np.int32)
_PLACE = (np.int64, np.int32)


def firsts(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, start: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """The first occurrence of each key, by (doc, start); sorted by key."""
    order = np.lexsort((start, doc, k2, k1))
    first = np.ones(len(k1), bool)
    first[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    return [x[order[first]] for x in (k1, k2, doc, start, *more)]


def partial(key: np.ndarray, block: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Anchors counted up to 2: (key, block) sorted by key, each key once, where block -1 stands for 2 and more; and the (key, block) of the latter, sorted by block, each pair once."""
    order = np.argsort(key, kind="stable")
    key, block = key[order], block[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    again = ~new
    again[:-1] |= ~new[1:]
    told = np.lexsort((key[again], block[again]))
    k, b = key[again][told], block[again][told]
    pair = np.ones(len(k), bool)
    pair[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    return [key[new], np.where(again, np.int32(-1), block)[new]], [k[pair], b[pair]]


def estimated(key: np.ndarray, block: np.ndarray, counters: int) -> np.ndarray:
    """Which anchors a count-min sketch of these partial counts estimates to occur more than once; it has `counters` per anchor in each of two rows, one at least."""
    n, out = max(1, counters * len(key)), np.ones(len(key), bool)
    for k in (key << np.uint64(32), mixed(key)):
        c = cells(k, n)
        two = np.bincount(c, minlength=n) > 1
        two[c[block < 0]] = True
        out &= two[c]
    return out


def within(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def by_group(group: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The groups of arrays sorted by group, and the bytes of each; the first column as differences, which wrap around."""
    edges = np.append(np.flatnonzero(np.diff(group, prepend=group[0] - 1)), len(group)) if len(group) else np.zeros(1, np.int64)
    parts = [[c[a:b] for c in columns] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return group[edges[:-1]], [shuffled(np.diff(first, prepend=first.dtype.type(0)), *rest) for first, *rest in parts]


def gathered(payloads: list[bytes], kinds: tuple[type, ...]) -> list[np.ndarray]:
    """The columns of by_group(), of several groups one behind another."""
    held = [unshuffled(p, kinds) for p in payloads]
    if not held:
        return [np.empty(0, k) for k in kinds]
    first, *rest = zip(*held, strict=True)
    return [np.concatenate([np.cumsum(c, dtype=c.dtype) for c in first]), *map(np.concatenate, rest)]


def dedup(docs: DataFrame, width: int = WIDTH, counters: int = COUNTERS, doc_id: str = "doc_id", text: str = "text", columns: list[str] | None = None, flush: int = 500_000) -> DataFrame:
    """`columns` of each row (all, if none are named) with n_words, n_removed, kept_sha256 and kept_text behind them.

    Words are runs of characters other than ASCII white space. A word goes if a window that covers it has the words of a window that starts
    earlier: in a smaller doc_id, or earlier in the same document; windows are judged on the input. kept_text is the text itself where
    nothing is removed, else the kept words joined by one space; kept_sha256 is of the kept words joined by one space, in all rows.

    A null text has no words and stays null. Rows without an id come after all others, each text as a document of its own, in the order of a hash of
    the texts. Rows that share an id are one document, so of two equal rows, with an id or without, neither is earlier and both keep their words. Texts shorter than a window are kept; an empty
    table gives an empty result; columns are told apart by place, so any names may stand beside these.
    """
    about = docs.agg(F.sum(F.octet_length(F.col(text))), F.max(F.col(doc_id).cast("long"))).first()
    size, last = int(about[0] or 0), max(0, about[1] or 0)
    # ids behind the last one, for rows without one
    room = min(1 << 40, NULL_ID - last)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID) if room < 1 << 40 else F.lit(last + 1) + F.pmod(F.xxhash64(text), F.lit(room)))
    windows = max(1, size // BYTES_A_WORD)
    buckets, blocks, parts = max(8, windows // 2_000_000), max(8, size // (4 << 20)), max(16, windows // 6 // SLICE)
    names = columns or docs.columns
    at_id, at_text = len(names), len(names) + 1
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], key.alias(f"c{at_id}"), F.col(text).alias(f"c{at_text}"), block)
    out_schema = T.StructType([*rows.schema.fields[: len(names)], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            counts, told = partial(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            part, sketches = by_group(cells(counts[0], parts).astype(np.int32), *counts)
            # pairs that are known already take the way over some slice, so that those of a block travel together
            order = np.argsort(told[1] % parts, kind="stable")
            via, known = by_group((told[1] % parts)[order].astype(np.int32), *(x[order] for x in told))
            cols = (np.concatenate([part, via]), [*[False] * len(part), *[True] * len(via)], sketches + known)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["part", "known", "payload"])

        n = 0
        for b in in_parts(batches, 0):
            texts, of = b.column(0).to_pylist(), b.column(1).to_numpy()
            for i, j in slices(texts):
                w = Words(texts[i:j], width)
                held.append([w.anchor[w.once], of[i + w.doc[w.once]]])
                n += len(w.once)
                if n >= flush:
                    yield out()
                    n = 0
        if n:
            yield out()

    def sketched(t: pa.Table) -> pa.Table:
        known = t["known"].to_numpy()
        k, b = gathered(t["payload"].filter(pa.array(~known)).to_pylist(), _ANCHOR)
        hit = estimated(k, b, counters) & (b >= 0)
        more = gathered(t["payload"].filter(pa.array(known)).to_pylist(), _ANCHOR)
        k, b = np.concatenate([k[hit], more[0]]), np.concatenate([b[hit], more[1]])
        order = np.lexsort((k, b))
        to, payload = by_group(b[order], k[order])
        return pa.table({"block": pa.array(to, pa.int32()), "first": pa.array([False] * len(to), pa.bool_()), "payload": pa.array(payload, pa.binary())})

    def anchors_of(right: pa.Table) -> np.ndarray:
        return np.unique(gathered(right["payload"].to_pylist(), _ANCHOR[:1])[0])

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts, known = left.column(at_id).to_numpy(), left.column(at_text).to_pylist(), anchors_of(right)
        held: list[list[np.ndarray]] = []
        cols: list[list] = [[], []]

        def out() -> None:
            found = firsts(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            for c, v in zip(cols, by_group(cells(found[0], buckets).astype(np.int32), *found), strict=True):
                c.extend(v)

        for i, j in slices(texts):
            w = Words(texts[i:j], width)
            hit = np.flatnonzero(within(known, w.anchor))
            held.append([w.k1[hit], w.k2[hit], ids[i + w.doc[hit]], w.start[hit].astype(np.int32)])
            if sum(len(x[0]) for x in held) >= flush:
                out()
        if held:
            out()
        of = left.column("block")[0].as_py() if len(left) else 0
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "block": pa.array([of] * len(cols[0]), pa.int32()), "payload": pa.array(cols[1], pa.binary())})

    def exact(t: pa.Table) -> pa.Table:
        held, of = [gathered([p], _CANDIDATE) for p in t["payload"].to_pylist()], t["block"].to_numpy()
        _, _, doc, start, of = firsts(*(np.concatenate(x) for x in zip(*held, strict=True)), np.repeat(of, [len(x[0]) for x in held]))
        order = np.lexsort((start, doc, of))
        to, payload = by_group(of[order], doc[order], start[order])
        return pa.table({"block": pa.array(to, pa.int32()), "first": pa.array([True] * len(to), pa.bool_()), "payload": pa.array(payload, pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        ids, texts = left.column(at_id).to_numpy(), left.column(at_text).to_pylist()
        uniq, own = np.unique(ids, return_inverse=True)
        is_first = right["first"].to_numpy()
        known = anchors_of(right.filter(pa.array(~is_first)))
        d, s = gathered(right["payload"].filter(pa.array(is_first)).to_pylist(), _PLACE)
        first = np.sort(np.searchsorted(uniq, d) << 32 | s.astype(np.int64))
        cols: list[list] = [[], [], [], []]
        for i, j in slices(texts):
            w = Words(texts[i:j], width)
            hit = np.flatnonzero(within(known, w.anchor))
            late = hit[~within(first, own[i + w.doc[hit]].astype(np.int64) << 32 | w.start[hit])]
            step = np.zeros(sum(map(len, w.lists)) + 1, np.int64)
            begin = w.begin[w.doc[late]] + w.start[late]
            np.add.at(step, begin, 1)
            np.add.at(step, begin + width, -1)
            gone = np.cumsum(step) > 0
            for k, words in enumerate(w.lists):
                out = gone[w.begin[k] : w.begin[k] + len(words)]
                removed = int(out.sum())
                kept = b" ".join([x for x, g in zip(words, out.tolist(), strict=True) if not g] if removed else words)
                for c, v in zip(cols, (len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if removed else texts[i + k]), strict=True):
                    c.append(v)
        return pa.Table.from_arrays([*left.columns[: len(names)], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=[f.name for f in out_schema])

    told = "block int, first boolean, payload binary"
    sent = rows.select(f"c{at_text}", "block").mapInArrow(counted, "part int, known boolean, payload binary")
    known = sent.groupBy("part").applyInArrow(lambda key, t: sketched(t), told)
    # the plan names the dealt texts and the slices twice; Spark makes each exchange once
    dealt = rows.groupBy("block")
    found = dealt.cogroup(known.groupBy("block")).applyInArrow(candidates, "bucket int, block int, payload binary").groupBy("bucket").applyInArrow(lambda key, t: exact(t), told)
    out = dealt.cogroup(known.unionAll(found).groupBy("block")).applyInArrow(finish, out_schema)
    return out.toDF(*names, "n_words", "n_removed", "kept_sha256", "kept_text")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), columns=["doc_id"]).drop("kept_text")


OP1_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
late AS (SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
