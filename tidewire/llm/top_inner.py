"""Exact top-k inner products: vectors by descending length, partial sums in SVD-rotated coordinates, Cauchy-Schwarz bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.shared import keep, tidy

#: Vectors that the rotation is fitted on, at most; any rotation gives the same results.
SAMPLE = 4096
#: Queries and candidates of one task.
QUERIES, CANDIDATES = 1024, 65_536
#: Candidates that are bounded together: small at first, while thresholds are low.
STEPS = (256, 1024, 4096)


def quantize(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id, dim and v (binary, little-endian 64-bit integers floor(scale * x)) of vectors whose components are all finite."""

    @tidy

    def run(batches):
        for b in batches:
            ids, rows, keep_ids, out, dims = b.column(0).to_pylist(), b.column(1), [], [], []
            for i, v in zip(ids, rows, strict=True):
                if i is None or not v.is_valid:
                    continue
                x = np.array([np.nan if c is None else c for c in v.values.to_pylist()], np.float64) if v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    keep_ids.append(i)
                    dims.append(len(x))
                    out.append(np.clip(np.floor(scale * x), -(2.0**62), 2.0**62).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep_ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "v"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(run, "vec_id long, dim int, v binary")


def rotation(sample: list[bytes], dim: int) -> np.ndarray:
    """Right singular vectors of the sample, by falling singular value."""
    if not sample or not dim:
        return np.eye(dim)
    return np.linalg.svd(np.frombuffer(b"".join(sample), "<i8").reshape(-1, dim).astype(np.float64), full_matrices=True)[2].T


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(len(column), dim)


def _dots(q: np.ndarray, c: np.ndarray, safe: bool) -> np.ndarray:
    if safe:  # every partial sum is below 2**53
        return np.rint(np.einsum("ij,ij->i", q.astype(np.float64), c.astype(np.float64))).astype(np.int64)
    return np.array([max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=True)))) for x, y in zip(q.tolist(), c.tolist(), strict=True)], np.int64)


def search(queries: pd.DataFrame, candidates: pd.DataFrame, basis: np.ndarray, k: int, lead: int) -> pd.DataFrame:
    """The k best candidates of each query (all, if fewer), exactly: score falling, then vec_id rising."""
    dim = int(queries["dim"].iloc[0])
    qi, ci = _matrix(queries["v"], dim), _matrix(candidates["v"], dim)
    q, c = qi.astype(np.float64), ci.astype(np.float64)
    qn, cn = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    cid, qid = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    order = np.lexsort((cid, -cn))
    ci, c, cn, cid = ci[order], c[order], cn[order], cid[order]
    qr, cr = q @ basis, c @ basis
    qrest, crest = np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(cr[:, lead:], axis=1)
    safe = float(qn.max(initial=0)) * float(cn.max(initial=0)) < 2.0**52
    n = len(q)
    low = np.full(n, -np.inf)
    best = [np.zeros(0, np.int64) for _ in range(3)]  # query, score, candidate
    at, step = 0, 0
    while at < len(c):
        upto = min(len(c), at + STEPS[min(step, len(STEPS) - 1)])
        slack = 1e-9 * qn * cn[at] + 1e-6
        alive = np.flatnonzero(qn * cn[at] + slack >= low)  # lengths fall: no later vector can reach a threshold above this
        if not len(alive):
            break
        bound = qr[alive, :lead] @ cr[at:upto, :lead].T + np.outer(qrest[alive], crest[at:upto]) + slack[alive, None]
        hope = bound >= low[alive, None]
        if safe and hope.mean() > 1 / 64:  # many pairs are left: finish the sums of their rows and columns in one product of whole numbers
            rows, cols = np.flatnonzero(hope.any(1)), np.flatnonzero(hope.any(0))
            full = q[alive[rows]] @ c[at + cols].T
            a, b = np.nonzero(full >= low[alive[rows], None])
            score = np.rint(full[a, b]).astype(np.int64)
            a, b = alive[rows[a]], at + cols[b]
        else:
            a, b = np.nonzero(hope)
            a, b = alive[a], at + b
            score = np.concatenate([_dots(qi[a[i : i + 65_536]], ci[b[i : i + 65_536]], safe) for i in range(0, len(a), 65_536)] or [np.zeros(0, np.int64)])
        other = qid[a] != cid[b]
        a, b, score = a[other], b[other], score[other]
        near = score >= low[a]
        best = [np.concatenate(x) for x in zip(best, (a[near], score[near], b[near]), strict=True)]
        rank = np.lexsort((cid[best[2]], ~best[1], best[0]))  # ~x falls as x rises and never overflows
        best = [x[rank] for x in best]
        first = np.searchsorted(best[0], best[0])
        top = np.arange(len(rank)) - first < k
        best = [x[top] for x in best]
        counts = np.bincount(best[0], minlength=n)
        last = np.cumsum(counts) - 1
        full = counts >= k
        low[full] = best[1][last[full]]
        at, step = upto, step + 1
    return pd.DataFrame({"query_id": qid[best[0]], "v": queries["v"].to_numpy()[best[0]], "vec_id": cid[best[2]], "score": best[1]})


def top_inner(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", lead: float = 0.25) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of the largest integer inner product with each query (id divisible by `every`).

    A null id, a null vector and one with a null or non-finite component take no part; vectors meet only those of their own
    dimension. A candidate with the query's id is its own row. A repeated row is a candidate each time, and one query. Equal scores
    rank by vec_id. Scores beyond 64 bits are clipped. An empty table gives an empty result; other columns are not read.

    Queries and candidates are dealt to cells (query group, lane) of bounded size; within a cell candidates run by falling length
    until no query can gain. Each cell hands on k rows a query, of which the k best are the answer.
    """
    spark = vectors.sparkSession
    rows = keep(quantize(vectors, id_col, vec_col, scale), "vectors")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    size = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).orderBy(F.desc("n")).limit(1).first()
    lanes, groups = (1, 1) if size is None else (max(8, -(-size.n // CANDIDATES)), max(1, -(-size.q // QUERIES)))
    bases = {}
    if size is not None:
        sample = rows.filter(F.col("dim") == size.dim).orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").collect()
        bases[size.dim] = rotation([bytes(r.v) for r in sample], size.dim)
    c = rows.withColumn("lane", F.pmod(F.xxhash64("vec_id", "v"), F.lit(lanes)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    q = rows.filter(is_query).dropDuplicates(["vec_id", "v"]).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "vec_id", "v"), F.lit(groups)).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "v": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})
        dim = int(queries["dim"].iloc[0])
        basis = bases.get(dim)
        return search(queries, candidates, np.eye(dim) if basis is None else basis, k, max(1, int(dim * lead)))

    key = ["dim", "part", "lane"]
    found = q.groupBy(key).cogroup(c.groupBy(key)).applyInPandas(run, "query_id long, v binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    """The registered query in DuckDB: every query against every candidate."""
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""
