"""Operator 4, MinHash near-dedup.

1. Each document's set of word shingles gives many universal hash minima, its signature. Documents with equal sets are one node, their smallest id.
2. The minima are cut into bands; nodes with an equal band are candidates. Each bucket links its nodes to its smallest, its centre, where their signatures
   agree in about the share asked for: one row per node, in a bucket of any size. A node that does not agree with the centre is held, by signatures and in tiles, against
   all nodes of the bucket; a tile gives no more links than it has nodes. So two candidates whose signatures agree are always linked, by each other or a centre,
   and documents that only share a passage are not.
3. The components of these links (large-star, small-star) are clusters. Inside clusters, pairs whose signatures agree are confirmed on the full sets. Large clusters are dealt
   into tiles, which also get a few common members: in a group of copies that links nearly all of it. What is not in the largest part
   of its cluster by then is compared, tile by tile, with all other parts of the cluster, so no link between candidates is lost.
4. The components of the confirmed links are the result.

With 32 bands of 4 minima a pair of similarity 0.8 shares no band with probability 5e-8, and the signature check, at 0.62, passes it over with 3e-7. What a task gets is
bounded in rows by counts of the rows that are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import in_parts, odd_numbers, table, word_hashes, written
from pagelattice.llm.components import connected_components
from pagelattice.llm.substring_dedup import mixed

BANDS, IN_BAND = 32, 4
SLACK = 0.18
TILE, PIVOTS = 512, 32
#: Documents of clusters that one task handles together; about 8 MB of text.
BUNDLE = 2000
#: Signatures of a tile, and those that one task handles together; 512 bytes each.
SIG_TILE, SIG_BUNDLE = 1024, 20_000


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit keys of the k-word shingles of a text whose A-Z are lower-cased; with fewer words the whole sequence is one."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h, m = word_hashes(words), odd_numbers(5, max(k, 1))
    if len(h) < k:
        return mixed((h * m[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    total = h[: len(h) - k + 1] * m[0]
    for j in range(1, k):
        total += h[j : len(h) - k + 1 + j] * m[j]
    return np.unique(mixed(total))


def signature(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest of the hashes of a set, for each multiplier; 32 bits of each."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(least, (s[i : i + 1024, None] * factors).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def factors() -> np.ndarray:
    return odd_numbers(7, BANDS * IN_BAND)


def band_keys(sig: np.ndarray) -> np.ndarray:
    x = sig.reshape(BANDS, IN_BAND).astype(np.uint64) * odd_numbers(9, IN_BAND)
    return mixed(x.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * odd_numbers(10, 1)).view(np.int64)


def _signed(docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = factors()
        for b in in_parts(batches, 1):
            cols: list[list] = [[], [], [], [], []]
            for t in b.column(1).to_pylist():
                s = shingles(t, k)
                sig = signature(s, f) if len(s) else None
                # equal sets have equal sums of two independent hashes
                sums = [int(mixed(s * m).sum(dtype=np.uint64).view(np.int64)) for m in odd_numbers(8, 2)] if len(s) else [None, None]
                for c, v in zip(cols, (len(s), *sums, band_keys(sig) if len(s) else None, sig.tobytes() if len(s) else None), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, type=x.type) for c, x in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sig binary")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def confirmed(sets: list[np.ndarray], parts: list, one: np.ndarray, other: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links, by place, between members of different `parts` that join parts not yet joined: for each pair of `one` x `other` with
    100 * shared >= threshold * together, its ends are in one part in the end. The likeliest pairs of each member come first."""
    n, f = len(sets), factors()
    sigs = np.array([signature(s, f) for s in sets])
    size = np.array([len(s) for s in sets], dtype=np.int64)
    forest, links = Forest(n), []
    first: dict = {}
    for i, p in enumerate(parts):
        forest.join(first.setdefault(p, i), i)
    vocabulary = np.unique(np.concatenate(sets))
    packed = None
    if len(vocabulary) * n <= 1 << 28:  # 32 MB of bits
        packed = np.zeros((n, -(-len(vocabulary) // 64)), np.uint64)
        for i, s in enumerate(sets):
            at = np.searchsorted(vocabulary, s)
            np.bitwise_or.at(packed[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    in_one = np.zeros(n, bool)
    in_one[one] = True
    for j in other:
        roots = np.array([forest.root(i) for i in one])
        near = one[(roots != forest.root(int(j))) & (one != j) & ~(in_one[j] & (one > j))]
        low, high = np.minimum(size[near], size[j]), np.maximum(size[near], size[j])
        near = near[100 * low >= threshold * high]
        if not len(near):
            continue
        same = (sigs[near] == sigs[j]).sum(axis=1)
        keep = same >= (threshold / 100 - SLACK) * sigs.shape[1]
        near, same = near[keep], same[keep]
        if not len(near):
            continue
        near = near[np.argsort(-same, kind="stable")]
        if packed is not None:
            shared = np.bitwise_count(packed[near] & packed[j]).sum(axis=1, dtype=np.int64)
        else:
            shared = np.array([np.isin(sets[i], sets[j], assume_unique=True).sum() for i in near], dtype=np.int64)
        for i in near[100 * shared >= threshold * (size[near] + size[j] - shared)]:
            if forest.join(int(i), int(j)):
                links.append((int(i), int(j)))
    return links


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), -1)


def _agreeing(pairs: DataFrame, need: float) -> DataFrame:
    """pairs: node, center, one, other (signatures). node, center and near: whether the share `need` of their minima are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, other = (_matrix(b.column(c).to_pylist()) if len(b) else np.empty((0, 1)) for c in ("one", "other"))
            near = (one == other).sum(axis=1) >= need * one.shape[1]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("center"), pa.array(near, pa.bool_())], names=["node", "center", "near"])

    return pairs.mapInArrow(run, "node long, center long, near boolean")


def _left_in_buckets(left: DataFrame, banded: DataFrame, sigs: DataFrame, need: float) -> DataFrame:
    """Links (node, center) between the nodes of `left` (band, node) and all nodes of their buckets where signatures agree, as many as join them. banded: band, node; sigs: node, sig."""
    asked = left.groupBy("band").agg(F.ceil(F.count("*") / SIG_TILE).cast("int").alias("l_tiles"))
    inside = banded.join(asked, "band")
    sizes = inside.groupBy("band").agg(F.ceil(F.count("*") / SIG_TILE).cast("int").alias("m_tiles"), F.first("l_tiles").alias("l_tiles"))
    rows = inside.select("band", "node").join(left.withColumn("asks", F.lit(True)), ["band", "node"], "left").join(sizes, "band").join(sigs, "node")
    rows = written(rows.select("band", "node", F.coalesce("asks", F.lit(False)).alias("asks"), "m_tiles", "l_tiles", "sig"), "minhash-left")
    dealt = rows.agg(F.sum(F.col("l_tiles") + F.when(F.col("asks"), F.col("m_tiles")).otherwise(0))).first()[0] or 0
    bundles = F.lit(max(1, -(-dealt // SIG_BUNDLE)))
    place = F.xxhash64("node", F.lit(11))
    ones = rows.where("asks").select("band", "node", "sig", F.pmod(place, "l_tiles").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("m_tiles") - 1)).alias("b"), F.lit(0).alias("side"))
    others = rows.select("band", "node", "sig", F.explode(F.sequence(F.lit(0), F.col("l_tiles") - 1)).alias("a"), F.pmod(place, "m_tiles").cast("int").alias("b"), F.lit(1).alias("side"))

    def run(t: pa.Table) -> pa.Table:
        keys = list(zip(*(t[c].to_pylist() for c in ("band", "a", "b")), strict=True))
        node, side, sig = t["node"].to_pylist(), t["side"].to_pylist(), _matrix(t["sig"].to_pylist())
        by: dict = {}
        for i, k in enumerate(keys):
            by.setdefault(k, ([], []))[side[i]].append(i)
        hi, lo = [], []
        for one, other in by.values():
            first: dict = {}
            places = np.array([first.setdefault(node[i], len(first)) for i in other])
            forest, x = Forest(len(other) + len(one)), sig[other]
            for i in one if other else ():
                # an asking node is among the others too, or stands behind them if it is in another tile
                own = first.setdefault(node[i], len(first))
                for j in np.flatnonzero((x == sig[i]).sum(axis=1) >= need * x.shape[1]):
                    if node[other[j]] != node[i] and forest.join(own, int(places[j])):
                        hi.append(node[i])
                        lo.append(node[other[j]])
        return pa.table({"node": pa.array(hi, pa.int64()), "center": pa.array(lo, pa.int64())})

    return ones.union(others).withColumn("bundle", F.pmod(F.xxhash64("band", "a", "b"), bundles)).groupBy("bundle").applyInArrow(lambda key, t: run(t), "node long, center long")


def _tiles(grouped: DataFrame, k: int, threshold: int) -> DataFrame:
    """Confirmed links within each (cluster, a, b) of `grouped`: between members whose side is 0 and those of side 1, or all if there is no side 1."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        by: dict = {}
        for i, r in enumerate(rows):
            by.setdefault((r["cluster"], r["a"], r["b"]), []).append(i)
        hi, lo = [], []
        for places in by.values():
            # a common member can come twice
            places = list({(rows[i]["id"], rows[i]["side"], rows[i]["text"]): i for i in places}.values())
            side = np.array([rows[i]["side"] for i in places])
            whole = not side.any()
            sets = [shingles(rows[i]["text"], k) for i in places]
            parts = [rows[i]["part"] for i in places]
            one, other = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if whole else 1))
            for x, y in confirmed(sets, parts, one, other, threshold) if len(one) and len(other) else []:
                hi.append(rows[places[x]]["id"])
                lo.append(rows[places[y]]["id"])
        return pa.table({"hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64())})

    return grouped.groupBy("bundle").applyInArrow(lambda key, t: run(t), "hi long, lo long")


def components(docs: DataFrame, k: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. Documents are linked where 100 * shared shingles >= threshold * shingles of both.

    Words are runs of characters other than ASCII white space, A-Z in lower case. Null, empty and blank texts have no shingles and are linked with
    nothing. Rows with a null id are linked with nothing: component_id is null, kept true. Rows that share an id are one node, with all their sets.
    An empty table gives an empty result; other columns are not read. `docs` is read three times.
    """
    spark = docs.sparkSession
    signed = written(_signed(docs, k, doc_id, text), "minhash-signed")
    sets = written(signed.where("set_a is not null and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")), "minhash-sets")
    # nodes: one row per set
    nodes = signed.withColumnRenamed("doc_id", "node").join(sets, ["set_a", "set_b", "node"]).dropDuplicates(["set_a", "set_b"])
    banded, sigs = nodes.select("node", F.explode("bands").alias("band")), nodes.select("node", "sig")
    buckets = banded.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("most")).where("center < most")
    starred = written(banded.join(buckets.select("band", "center"), "band"), "minhash-buckets")
    star = starred.where("node <> center").select("node", "center").distinct()
    need = threshold / 100 - SLACK
    pairs = star.join(sigs.withColumnRenamed("sig", "one"), "node").join(sigs.select(F.col("node").alias("center"), F.col("sig").alias("other")), "center")
    # an id that stands for several sets has several signatures; one that agrees is enough
    star = written(_agreeing(pairs.select("node", "center", "one", "other"), need).groupBy("node", "center").agg(F.max("near").alias("near")), "minhash-star")
    left = starred.join(star.where("not near").select("node", "center"), ["node", "center"]).select("band", "node").distinct()
    near = star.where("near").select("node", "center").union(written(_left_in_buckets(left, starred.select("band", "node").distinct(), sigs, need), "minhash-near"))
    clusters = written(connected_components(near, "node", "center").withColumnRenamed("component", "cluster"), "minhash-clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"))

    # never by broadcast, as the members grow with the documents
    members = clusters.join(sizes, "cluster").join(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).hint("merge"), "id")
    members = members.withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int"))
    members = written(members.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")), "minhash-members")
    common = members.where("tiles > 1").where(F.pmod(F.xxhash64("id", F.lit(7)), F.col("members")) < PIVOTS).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    grouped = members.unionByName(common).select("id", "text", "cluster", F.col("tile").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), F.col("id").alias("part"))
    bundles = max(1, -(-grouped.count() // BUNDLE))
    links = written(_tiles(grouped.withColumn("bundle", F.pmod(F.xxhash64("cluster", "a"), F.lit(bundles))), k, threshold), "minhash-links")
    parts = connected_components(links, "hi", "lo")

    if members.where("tiles > 1").limit(1).count():
        # what the tiles of a large cluster have left apart
        large = members.where("tiles > 1").join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
        counted = large.groupBy("cluster", "part").agg(F.count("*").alias("n"))
        main = counted.groupBy("cluster").agg(F.max(F.struct("n", "part")).alias("m")).select("cluster", F.col("m.part").alias("main"))
        large = written(large.join(main, "cluster"), "minhash-large")
        rest = large.where("part <> main")
        rest_tiles = rest.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).cast("int").alias("rest_tiles"))
        columns = ["id", "text", "cluster", "a", "b", "side", "part"]
        ones = rest.join(rest_tiles, "cluster").withColumn("a", F.pmod(F.xxhash64("id", F.lit(3)), F.col("rest_tiles")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("side", F.lit(0))
        others = large.join(rest_tiles, "cluster").withColumn("b", F.col("tile")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("rest_tiles") - 1))).withColumn("side", F.lit(1))
        crossed = ones.select(columns).union(others.select(columns))
        n = max(1, -(-crossed.count() // BUNDLE))
        links = links.union(written(_tiles(crossed.withColumn("bundle", F.pmod(F.xxhash64("cluster", "a", "b"), F.lit(n))), k, threshold), "minhash-rest"))
        parts = connected_components(links, "hi", "lo")

    same_id = signed.where("set_a is not null and doc_id is not null").join(sets, ["set_a", "set_b"]).where("node <> doc_id")
    if signed.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count():
        # an id with several sets holds their components together
        found = parts.unionByName(sets.select(F.col("node").alias("id"), F.col("node").alias("component")))
        parts = connected_components(found.unionByName(same_id.select(F.col("doc_id").alias("id"), F.col("node").alias("component"))), "id", "component")
    node_parts = sets.join(parts.select(F.col("id").alias("node"), "component"), "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    out = signed.drop("bands").join(node_parts, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, k: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the documents that are linked, over any number of links, with one of a smaller id."""
    name = next(x for i in range(len(docs.columns) + 1) if (x := f"gone_{i}") not in docs.columns)
    gone = components(docs, k, threshold, doc_id, text).where("not kept").select(F.col("doc_id").alias(name)).distinct().hint("merge")
    return docs.join(gone, F.col(doc_id) == F.col(name), "left_anti")


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), k=4)


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
c AS (SELECT doc_id AS node, doc_id AS found FROM documents UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.found),
m AS (SELECT node, min(found) AS component_id FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
