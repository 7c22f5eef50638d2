"""Exact top-k by inner product, in three phases with a uniform threshold.

The integer components are cut in m slices, and each partition of the candidates holds a list of partial scores for
each slice and query. Phase one: every partition sends the k best exact totals among the heads of its lists; the k-th
best of all is a total that the result reaches at least, the safe cutoff c of the query. A vector whose total is c or
more has a slice with a partial score of c / m or more, whatever the signs. Phase two: the cutoffs are broadcast and
every partition collects the entries of its lists at or above c / m. Phase three: their other slices are resolved,
which makes exact totals, and those of at least c are ranked. The result is exact with ties to the smaller id.

Queries come in blocks of bounded size, so what is broadcast doesn't grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch

SLICES = 4
#: Bytes of query vectors in a block: what is sent to the executors at once.
QUERY_BYTES = 16 << 20
_CELLS = 1 << 21
#: Beyond this total size a product may not be exact in a double.
_EXACT = 2.0**52
_LONG = (-(2**63), 2**63 - 1)
_MOST = float(np.finfo(np.float64).max)


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, as whole doubles. Vectors that are null or hold null or non-finite components are left out; a product beyond the largest double stops there."""
    v = F.transform(F.col(vec_col), lambda x: _floor(x.cast("double") * scale))
    fit = F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _floor(x):
    """floor() gives a long, which large values leave; those are whole already."""
    return F.when(F.abs(x) < float(2**62), F.floor(x).cast("double")).otherwise(F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), x)))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the queries' width, and which rows those are."""
    sizes = np.diff(column.offsets.to_numpy())
    if not width:
        return np.zeros((int((sizes == 0).sum()), 0)), sizes == 0
    values = column.flatten().to_numpy(zero_copy_only=False)
    ok = sizes == width
    return values[np.repeat(ok, sizes)].reshape(-1, width), ok


def _bounds(width: int, slices: int) -> list[tuple[int, int]]:
    at = np.linspace(0, width, max(1, min(slices, width)) + 1).astype(int).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def _large(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether a sum of products may not be exact in doubles."""
    with np.errstate(over="ignore"):
        return not np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < _EXACT


def list_heads(q: np.ndarray, c: np.ndarray, other: np.ndarray, cut: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) of the k first entries of each query's list of partial scores of each slice, once each; ``other`` marks the pairs that count."""
    picked = np.zeros(other.shape, bool)
    for a, b in cut:
        with np.errstate(over="ignore", invalid="ignore"):
            part = np.where(other, q[:, a:b] @ c[:, a:b].T, -np.inf)
        n = min(k, part.shape[1])
        picked[np.arange(len(q))[:, None], np.argpartition(-part, n - 1, axis=1)[:, :n]] = True
    return np.nonzero(picked & other)


def sufficient(q: np.ndarray, c: np.ndarray, other: np.ndarray, cut: list[tuple[int, int]], cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) of the pairs that have a partial score of an m-th of their query's cutoff in one of the m slices."""
    if _large(q, c):  # partial scores are rounded then: all pairs are resolved
        return np.nonzero(other)
    need, enough = (cutoff / len(cut))[:, None], np.zeros(other.shape, bool)
    for a, b in cut:
        enough |= q[:, a:b] @ c[:, a:b].T >= need
    return np.nonzero(enough & other)


def resolve(q: np.ndarray, c: np.ndarray, r: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs (r, x), as integers; those outside of 64 bits stop at its ends."""
    if _large(q, c):
        whole = [[int(v) for v in row] for row in q], [[int(v) for v in row] for row in c]
        return np.array([min(max(sum(map(mul, whole[0][i], whole[1][j])), _LONG[0]), _LONG[1]) for i, j in zip(r.tolist(), x.tolist(), strict=True)], np.int64)
    out = np.zeros(len(r), np.int64)
    for at in range(0, len(r), 1 << 16):
        e = slice(at, at + (1 << 16))
        out[e] = np.einsum("ij,ij->i", q[r[e]], c[x[e]]).astype(np.int64)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], n_queries: int, width: int):
    step = max(16, _CELLS // max(1, n_queries))
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            m, ok = _matrix(part.column(1), width)
            ids = part.column(0).to_numpy(zero_copy_only=False)[ok]
            if len(ids):
                yield ids, m


_OUT = ["query_id", "vec_id", "score"]


def _frame(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], _OUT)


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query row."""
    order = np.lexsort((v, -s.astype(np.float64), q)) if len(s) and np.abs(s).max() < _EXACT else np.array(sorted(range(len(s)), key=lambda i: (q[i], -int(s[i]), v[i])), np.int64)
    q, v, s = q[order], v[order], s[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], v[keep], s[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, slices: int = SLICES, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of ``queries`` against every row of ``vectors`` with another id.

    Scores are integer inner products; ties go to the smaller id; with fewer than ``k`` candidates all are returned.
    Vectors that are null or hold null or non-finite components take no part, and a query meets only candidates of its own
    length; of empty vectors all scores are 0. Repeated candidate rows count as candidates each; rows that share the query's id are
    its own. Empty tables give no rows. Scores outside of 64 bits stop at its ends. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")
    asked = scratch.put(quantise(queries, id_col, vec_col, scale), "queries")
    sought = scratch.put(quantise(vectors, id_col, vec_col, scale), "vectors")
    found = None
    for width, n in sorted(map(tuple, asked.groupBy(F.size("v")).count().collect())):  # a row for each length of vector
        blocks = max(1, -(-n * width * 8 // query_bytes))
        for block in range(blocks):
            got = asked.where((F.size("v") == width) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)).toArrow()
            if got.num_rows:
                part = _block(spark, scratch, sought.where(F.size("v") == width), got, width, k, slices, f"{width}-{block}")
                found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found


def _block(spark, scratch: Scratch, sought: DataFrame, got: pa.Table, width: int, k: int, slices: int, name: str) -> DataFrame:
    got = got.combine_chunks()
    m, _ = _matrix(got.column(1).chunk(0), width)
    ids = got.column(0).to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, first = np.unique(ids[order], return_index=True)  # a repeated query row is asked once
    shared = spark.sparkContext.broadcast((ids, m[order][first]))
    cut = _bounds(width, slices)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        best = (np.empty(0, np.int64),) * 3
        for vid, c in _chunks(batches, len(qid), width):
            r, x = list_heads(q, c, vid[None, :] != qid[:, None], cut, k)
            best = _best(np.r_[best[0], qid[r]], np.r_[best[1], vid[x]], np.r_[best[2], resolve(q, c, r, x)], k)
        if len(best[0]):
            yield _frame(*best)

    schema = "query_id long, vec_id long, score long"
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    listed = sought.mapInArrow(heads, schema).withColumn("r", F.row_number().over(by_score))
    cutoff = listed.where(F.col("r") == k).select("query_id", "score").toArrow()  # a number for each query of the block
    floor = np.full(len(ids), -np.inf)
    floor[np.searchsorted(ids, cutoff.column(0).to_numpy())] = cutoff.column(1).to_numpy()
    limits = spark.sparkContext.broadcast(floor)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (qid, q), c0 = shared.value, limits.value
        best = (np.empty(0, np.int64),) * 3
        for vid, c in _chunks(batches, len(qid), width):
            r, x = sufficient(q, c, vid[None, :] != qid[:, None], cut, c0)
            s = resolve(q, c, r, x)
            reach = s >= c0[r]
            best = _best(np.r_[best[0], qid[r[reach]]], np.r_[best[1], vid[x[reach]]], np.r_[best[2], s[reach]], k)
        if len(best[0]):
            yield _frame(*best)

    ranked = sought.mapInArrow(entries, schema).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return scratch.put(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), f"found-{name}")
