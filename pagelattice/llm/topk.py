"""Operator 9, exact top-k search by the threshold algorithm.

The vectors are dealt into blocks. In each block every dimension has a list of the rows by value; for a query the lists are walked together from
the end that helps the query, rows met for the first time are scored in full, and the walk ends when the sum of the best values that the lists can still give
is below the k-th best score so far. The k best of all blocks are merged. Queries are dealt to every block, themselves in blocks, so a task holds one block of each.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelattice.llm.common import table

BLOCK, QUERIES = 8192, 8192


class SortedLists:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        """ids: in ascending order; rows: an integer vector for each."""
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(rows, self.order, axis=0)

    def top(self, own: int, query: np.ndarray, k: int, step: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k rows with the largest inner products, ties to the smaller id; never the row whose id is `own`."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        seen = self.ids == own
        left = n - int(seen.sum())
        best_score, best = np.empty(0, np.int64), np.empty(0, np.int64)
        up = query[used] > 0
        depth = 0
        while left:
            if len(used):
                to = min(n, depth + step)
                # from the end of the largest values where the query is positive, else from that of the smallest
                met = np.concatenate([self.order[n - to : n - depth, used[up]].ravel(), self.order[depth:to, used[~up]].ravel()])
                step *= 2
            else:
                to, met = n, np.arange(n)
            new = np.unique(met)
            new = new[~seen[new]]
            seen[new] = True
            left -= len(new)
            best = np.concatenate([best, new])
            best_score = np.concatenate([best_score, self.rows[new] @ query])
            keep = np.lexsort((self.ids[best], -best_score))[:k]
            best, best_score, depth = best[keep], best_score[keep], to
            if depth >= n:
                break
            bound = int(np.where(up, self.values[n - 1 - depth, used], self.values[depth, used]) @ query[used])
            # an unseen row with the k-th score could still have the smaller id
            if len(best) == k and bound < best_score[-1]:
                break
        return self.ids[best], best_score


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", factor: int = 256) -> DataFrame:
    """id and q, floor(factor * x) of each component; rows that are null, or hold null or non-finite components, or have no id, take no part."""
    x = F.col(embedding)
    whole = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(whole).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * factor)).alias("q"))


def search(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates (id, q) with the largest integer inner products with each query (id, q), ties to the smaller id;
    fewer if there are fewer. A query is not its own candidate. Vectors of different lengths are not compared. Rows that share an id: as candidates
    one is kept for equal vectors, and all with an id equal to the query's are left out; as queries they are one where equal. Empty tables give an empty result.
    """
    candidates, queries = candidates.dropDuplicates(["id", "q"]), queries.dropDuplicates(["id", "q"])
    blocks, groups = max(1, -(-candidates.count() // BLOCK)), max(1, -(-queries.count() // QUERIES))
    dealt = candidates.select("id", "q", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(False).alias("asks"))
    asked = queries.select("id", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("part"), F.lit(True).alias("asks"))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks = t["asks"].to_numpy()
        ids, q = t["id"].to_numpy(), t["q"].combine_chunks()
        size = np.diff(q.offsets.to_numpy())
        flat = q.values.to_numpy()
        at = q.offsets.to_numpy()
        out: list[list] = [[], [], []]
        for n in np.unique(size):
            lists = np.flatnonzero((size == n) & ~asks)
            lists = lists[np.argsort(ids[lists], kind="stable")]
            if not len(lists):
                continue
            index = SortedLists(ids[lists], np.stack([flat[at[i] : at[i] + n] for i in lists]).astype(np.int64))
            for i in np.flatnonzero((size == n) & asks):
                found, score = index.top(ids[i], flat[at[i] : at[i] + n].astype(np.int64), k)
                for c, v in zip(out, (np.full(len(found), ids[i]), found, score), strict=True):
                    c.append(v)
        cat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
        return pa.table({"query_id": cat[0], "vec_id": cat[1], "score": cat[2]})

    found = dealt.union(asked).groupBy("block", "part").applyInArrow(lambda key, t: run(t), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op9_topk_search(spark, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where("id % 50 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS query_id, b.id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
