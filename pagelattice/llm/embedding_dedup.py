"""Operator 10, embedding near-dedup by sorted projection passes.

1. Equal vectors of a label are one node with a count, so a vector with many copies is one row.
2. In each pass every node has a key of concatenated random hashes, the signs of random projections of its vector less the mean of its label. All passes are sorted together by (pass, label, key);
   the order is cut into zones that overlap by the window, and each node is compared with the `window` nodes after it. A zone gives
   the verified pairs that join parts of it, no more than it has nodes.
3. The components of these pairs over all passes are found by large-star and small-star. Rounds of more passes follow until one joins nothing that was apart.
4. Within a component every node is compared with every other, tile by tile, for the exact number of links: so a group larger than the window loses none.

At a distance from the mean of spread s (the mean square, 1 - |mean|^2 of unit vectors) a pair at the threshold c has cosine 1 - (1 - c) / s after centring, so one sign
differs with probability q = arccos(that) / pi, and with a label of n nodes a pair is within the window in a pass with about (1 - q) ** log2(n / window). The passes of
the first round are so many, label by label, that a pair is missed by all with MISSED, but at least PASSES, and no more than n / window, where comparing all would
cost as much. The estimate takes a label as evenly spread; where it is not, the further rounds go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagelattice.llm.common import table, written
from pagelattice.llm.components import connected_components
from pagelattice.llm.minhash_dedup import Forest

PASSES, BITS, WINDOW, MISSED = 10, 30, 96, 1e-5
ZONE, TILE, BUNDLE = 8192, 1024, 4096


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors, of one length, in double precision."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(x: np.ndarray, k: int) -> np.ndarray:
    """The signs of BITS random projections of pass k as a number, per row."""
    planes = np.random.default_rng((x.shape[1], k)).normal(size=(x.shape[1], BITS))
    return ((x @ planes > 0) << np.arange(BITS, dtype=np.int64)[::-1]).sum(axis=1)


def passes_needed(n: int, spread: float, threshold: float, window: int) -> int:
    """Passes of the first round for a label of n nodes: see above."""
    near = 1 - (1 - threshold) / max(spread, 1e-9)
    q = min(0.5, float(np.arccos(np.clip(near, -1, 1))) / np.pi)
    hit = (1 - q) ** max(0.0, np.log2(max(n, 1) / max(window, 1)))
    need = np.log(MISSED) / np.log1p(-hit) if hit < 1 else 1
    return max(PASSES, int(min(np.ceil(need), -(-n // max(window, 1)))))


def centres(nodes: DataFrame, threshold: float, window: int) -> DataFrame:
    """label, dim, centre (the mean of the unit vectors of its nodes) and passes, of each label."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([x.tolist() for _, x in held.values()], pa.list_(pa.float64()))], names=["label", "dim", "n", "sums"])
            held.clear()
            return b

        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                same = b.filter(pa.array(dims == d))
                x = _matrix(same.column("v"))
                names, at = np.unique(np.array(same.column("label").to_pylist(), object), return_inverse=True)
                order = np.argsort(at, kind="stable")
                sums = np.add.reduceat(x[order], np.searchsorted(at[order], np.arange(len(names))), axis=0)
                for name, n, total in zip(names.tolist(), np.bincount(at).tolist(), sums, strict=True):
                    m, before = held.get((name, int(d)), (0, 0))
                    held[name, int(d)] = m + n, before + total
            if len(held) > 4096:
                yield out()
        if held:
            yield out()

    def whole(key: tuple, t: pa.Table) -> pa.Table:
        n = sum(t["n"].to_pylist())
        mean = np.sum([np.array(x) for x in t["sums"].to_pylist()], axis=0) / n
        return pa.table({"label": pa.array([key[0].as_py()], pa.string()), "dim": pa.array([key[1].as_py()], pa.int32()), "centre": pa.array([mean.tolist()], pa.list_(pa.float64())), "passes": pa.array([passes_needed(n, 1 - float(mean @ mean), threshold, window)], pa.int32())})

    sums = nodes.select("label", "dim", "v").mapInArrow(part, "label string, dim int, n long, sums array<double>")
    # written, so that its size is known when it is joined
    return written(sums.groupBy("label", "dim").applyInArrow(lambda key, t: whole(key, t), "label string, dim int, centre array<double>, passes int"), "projection-centres")


def _window_pairs(x: np.ndarray, block: np.ndarray, window: int, threshold: float) -> list[tuple[int, int]]:
    """Of sorted rows: pairs at most `window` apart, in one block, with at least that cosine, that join parts not yet joined."""
    forest, out, step = Forest(len(x)), [], 512
    for i in range(0, len(x), step):
        a, b = np.nonzero(x[i : i + step] @ x[i : i + step + window].T >= threshold)
        near = (b > a) & (b - a <= window)
        for p, q in zip((a[near] + i).tolist(), (b[near] + i).tolist(), strict=True):
            if block[p] == block[q] and forest.join(p, q):
                out.append((p, q))
    return out


def deal_tiles(inside: DataFrame, bundle: int = BUNDLE) -> DataFrame:
    """Every pair (a, b) of tiles of a component as the rows that ask (tile a) and those that answer (tile b), in bundles of about `bundle` rows: there are as many bundles as
    the rows dealt ask for, so no task's share grows with a component."""
    rows = inside.agg(F.sum(2 * F.col("tiles").cast("long"))).first()[0] or 0
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    asks = inside.select("node", "component", "n", "v", "label", F.col("tile").alias("a"), other.alias("b"), F.lit(True).alias("asks"))
    answers = inside.select("node", "component", "n", "v", "label", other.alias("a"), F.col("tile").alias("b"), F.lit(False).alias("asks"))
    return asks.union(answers).withColumn("bundle", F.pmod(F.xxhash64("component", "a", "b"), F.lit(max(1, -(-rows // bundle)))))


def links(vectors: DataFrame, threshold: float = 0.98, window: int = WINDOW, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id, kept. Rows are linked where labels are equal and the cosine is at least `threshold`.

    Vectors that are null, zero, or hold null or non-finite components, and rows whose label or id is null, link with nothing; without an id component_id is null and kept true.
    Vectors of different lengths are not compared. Rows that share an id count as vectors of their own in n_links, and are one node of a component.
    An empty table gives an empty result; other columns are not read.
    """
    x = F.col(embedding)
    whole = x.isNotNull() & F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))) & F.exists(x, lambda c: c != 0)
    plain = F.transform(x, lambda c: c + F.lit(0.0).cast("float"))  # -0.0 is 0.0
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.coalesce(whole, F.lit(False)), plain).alias("v"), F.col(label).cast("string").alias("label"))
    hashed = rows.withColumn("ha", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "label", "v"))).withColumn("hb", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(2), "v", "label")))
    nodes = written(hashed.where("v is not null").groupBy("ha", "hb").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("label").alias("label")).withColumn("dim", F.size("v")).withColumn("node", F.xxhash64("ha", "hb")), "projection-nodes")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                x = _matrix(part.column("v")) - part.column("centre").flatten().to_numpy().reshape(len(part), -1)
                begin, end = part.column("begin").to_numpy(), part.column("end").to_numpy()
                for p in range(begin.min(), end.max()):
                    now = (begin <= p) & (p < end)
                    if now.any():
                        rows = part.filter(pa.array(now))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), p, np.int32)), *(rows.column(c) for c in ("label", "dim")), pa.array(_keys(x[now], p)), rows.column("id"), rows.column("node")], names=["pass", "label", "dim", "key", "id", "node"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = len(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=[*b.schema.names, "part", "at"])
            at += n

    schema = T.StructType().add("pass", "integer").add("label", "string").add("dim", "integer").add("key", "long").add("id", "long").add("node", "long")
    order = ["pass", "label", "dim", "key", "id", "node"]
    ranked_schema = T.StructType([*schema.fields]).add("part", "integer").add("at", "long")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank").combine_chunks()
        ids, dims = t["id"].to_numpy(), t["dim"].to_numpy()
        _, block = np.unique(np.array([f"{p}\0{q}" for p, q in zip(t["pass"].to_pylist(), t["label"].to_pylist(), strict=True)]), return_inverse=True)
        a, b = [], []
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            for p, q in _window_pairs(_matrix(t["v"].take(pa.array(at))), block[at], window, threshold):
                a.append(ids[at[p]])
                b.append(ids[at[q]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    centred = nodes.join(centres(nodes, threshold, window), ["label", "dim"])

    def compared(r: int) -> DataFrame:
        """The pairs of round r: the passes of the label in round 0, PASSES others in each further round."""
        begin, end = (F.lit(0), F.col("passes")) if r == 0 else (F.col("passes") + (r - 1) * PASSES, F.col("passes") + r * PASSES)
        spread = centred.select("label", "dim", "id", "node", "v", "centre", begin.alias("begin"), end.alias("end")).mapInArrow(expand, schema).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, ranked_schema)
        # the keys alone are sorted; vectors are fetched by zone
        spread = written(spread, "projection-order")
        # one row per partition
        before = spread.groupBy("part").agg(F.count("*").alias("rows")).withColumn("base", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ranked = spread.join(before.select("part", "base"), "part").withColumn("rank", F.col("base") + F.col("at"))
        zone = F.floor(F.col("rank") / ZONE)
        zoned = ranked.withColumn("zone", F.explode(F.when((F.col("rank") % ZONE < window) & (zone > 0), F.array(zone, zone - 1)).otherwise(F.array(zone))))
        zoned = zoned.select("pass", "label", "dim", "id", "node", "rank", "zone").join(nodes.select("node", "v"), "node")
        return written(zoned.groupBy("zone").applyInArrow(lambda key, t: compare(t), "a long, b long"), "projection-pairs")

    pairs = compared(0)
    parts = written(connected_components(pairs, "a", "b"), "projection-parts")
    r, more = 0, not pairs.isEmpty()
    while more:
        r += 1
        found = compared(r)
        one, two = (parts.select(F.col("id").alias(c), F.col("component").alias(f"part_{c}")) for c in ("a", "b"))
        apart = found.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b"))
        more = not apart.isEmpty()
        if more:
            pairs = pairs.union(found)
            parts = written(connected_components(pairs, "a", "b"), "projection-parts")

    # exact numbers of links within components; nodes alone in theirs have none
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    inside = nodes.join(parts.join(sizes, "component"), "id").withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")).withColumn("tile", F.pmod(F.col("node"), F.col("tiles")).cast("int"))
    inside = written(inside.select("node", "component", "n", "v", "label", "tile", "tiles"), "projection-inside")
    dealt = deal_tiles(inside)

    def count(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        # vectors that share an id can bring others of another label or length into their component
        keys = list(zip(*(t[c].to_pylist() for c in ("component", "a", "b", "label")), np.diff(t["v"].chunk(0).offsets.to_numpy()).tolist(), strict=True))
        asking, node, n = t["asks"].to_numpy(), t["node"].to_numpy(), t["n"].to_numpy()
        by: dict = {}
        for i, k in enumerate(keys):
            by.setdefault(k, ([], []))[0 if asking[i] else 1].append(i)
        out, found = [], []
        for one, two in by.values():
            if one and two:
                x, y = _matrix(t["v"].take(pa.array(one))), _matrix(t["v"].take(pa.array(two)))
                near = (x @ y.T >= threshold) & (node[one][:, None] != node[two][None, :])
                out += node[one].tolist()
                found += (near * n[two][None, :]).sum(axis=1).tolist()
        return pa.table({"node": pa.array(out, pa.int64()), "links": pa.array(found, pa.int64())})

    counts = dealt.groupBy("bundle").applyInArrow(lambda key, t: count(t), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(parts, "id", "left").join(counts, "node", "left").select("ha", "hb", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    found = hashed.select("vec_id", "ha", "hb").join(known, ["ha", "hb"], "left")
    out = found.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_projection_dedup(spark, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
w AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.98),
c AS (SELECT vec_id AS node, vec_id AS found FROM embeddings UNION SELECT c.node, l.b FROM c JOIN l ON c.found = l.a),
m AS (SELECT node, min(found) AS component_id FROM c GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON m.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
