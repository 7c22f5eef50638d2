"""Semantic relatedness over long vectors (row_id, col_id, value) as joins on features and top-k windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .links import top

VEC = ["row_id", "col_id", "value"]


def norms(v: DataFrame) -> DataFrame:
    """(row_id, norm, n): length and number of entries of each row."""
    return v.groupBy("row_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.count("*").alias("n"))


def transpose(v: DataFrame) -> DataFrame:
    return v.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value")


def normalise_rows(v: DataFrame) -> DataFrame:
    n = norms(v).select("row_id", "norm")
    return v.join(n, "row_id").where("norm > 0").select("row_id", "col_id", (F.col("value") / F.col("norm")).alias("value"))


def dots(a: DataFrame, b: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, dot, n_common) for pairs of rows with a common feature: an inverted-index join, summed by pair.

    If only some ``pairs`` (a, b) are asked for, these are joined with the rows of both, so that no other pair is ever made.
    """
    x = a.select(F.col("row_id").alias("a"), "col_id", F.col("value").alias("x"))
    y = b.select(F.col("row_id").alias("b"), "col_id", F.col("value").alias("y"))
    j = x.join(y, "col_id") if pairs is None else pairs.select("a", "b").distinct().join(x, "a").join(y, ["b", "col_id"])
    return j.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.count("*").alias("n_common"))


def cosine(a: DataFrame, b: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, score) for pairs that share a feature; rows of length 0 take no part. Pairs of a row with itself are left out when b is a."""
    other = a if b is None else b
    na, nb = norms(a).select(F.col("row_id").alias("a"), F.col("norm").alias("na")), norms(other).select(F.col("row_id").alias("b"), F.col("norm").alias("nb"))
    d = dots(a, other, pairs)
    d = d.where("a <> b") if b is None else d
    return d.join(na, "a").join(nb, "b").where("na > 0 and nb > 0").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("score"))


def google(a: DataFrame, n: int, b: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, score): normalised distance 1 - (ln max - ln common) / (ln N - ln min) over sets of features."""
    other = a if b is None else b
    ca, cb = norms(a).select(F.col("row_id").alias("a"), F.col("n").alias("ca")), norms(other).select(F.col("row_id").alias("b"), F.col("n").alias("cb"))
    d = dots(a, other, pairs)
    d = d.where("a <> b") if b is None else d
    return d.join(ca, "a").join(cb, "b").select("a", "b", google_score(F.col("ca"), F.col("cb"), F.col("n_common"), n).alias("score"))


#: Rows of a block of vectors, at least and at most, and pairs of entries that two blocks may have by the mean of a row.
_LEAST, _MOST, _MET = 2048, 32768, 8_000_000


def block_pairs(tables: list[DataFrame], score, k: int | None = None) -> DataFrame:
    """(a, b, score) for pairs of rows that share a column in one or more tables of vectors (row_id, col_id, value), ids whole numbers.

    Rows are in blocks of consecutive ids. Two blocks with a common column meet in one task, which multiplies their vectors, so
    that no pair is sent; blocks meet once, and (a, b) and (b, a) have one score. ``score`` gets the ids of the pairs' rows and for
    each table (sums of products, numbers of common columns, norms and sizes of a, those of b), 0 in common where a pair is
    another table's, and gives the score, NaN for null. With ``k`` only the best of each row and two blocks go on, as
    most_similar() orders them. The more pairs a row has, the smaller the blocks; a task holds two of them and their pairs.
    """
    from .graph import cut

    spark, count = tables[0].sparkSession, len(tables)
    tables = [v.select(F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("long").alias("col_id"), F.col("value").cast("double").alias("value")) for v in tables]
    tables = [cut(v) for v in tables]
    size = _LEAST
    for v in tables:
        met = v.groupBy("col_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
        rows = v.select("row_id").distinct().count()
        fit = _MET / max(1.0, met / max(1, rows))
        mine = _LEAST
        while mine * 2 <= min(fit, _MOST):
            mine *= 2
        size = mine if v is tables[0] else min(size, mine)
    packed = met = None
    for n, v in enumerate(tables):
        block = F.floor(F.col("row_id") / size).cast("long")
        e = v.select(block.alias("block"), F.struct(F.col("col_id").alias("c"), (F.col("row_id") - block * size).cast("int").alias("r"), F.col("value").alias("x")).alias("e"))
        lists = e.groupBy("block").agg(F.sort_array(F.collect_list("e")).alias("e")).select("block", *[F.col(f"e.{f}").alias(f"{f}{n}") for f in "crx"])
        packed = lists if packed is None else packed.join(lists, "block", "full_outer")
        at = v.select(block.alias("i"), "col_id").distinct()
        both = at.join(at.withColumnRenamed("i", "j"), "col_id").where("i <= j").select("i", "j").distinct()
        met = both if met is None else met.unionByName(both)
    packed = cut(packed)
    names = [c for c in packed.columns if c != "block"]
    i, j = (packed.select(F.col("block").alias(s), F.struct(*names).alias(f"v{s}")) for s in "ij")
    # lists are small for the work on them: no fewer partitions than these
    parts = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = met.distinct().join(i, "i").join(j, "j").select("i", "j", "vi", "vj").repartition(parts, "i", "j")

    def entries(side: pa.StructScalar, n: int) -> tuple[np.ndarray, ...]:
        got = [side[f"{f}{n}"].values for f in "crx"]
        return tuple(np.empty(0, t) if g is None else g.to_numpy(zero_copy_only=False) for g, t in zip(got, (np.int64, np.int32, np.float64), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one, other, vi, vj = (batch.column(c)[at] for c in range(4))
                sides = [(entries(vi, n), entries(vj, n)) for n in range(count)]
                found = [_multiply(x, y, size) for x, y in sides]
                cells = found[0][0] if count == 1 else np.unique(np.concatenate([f[0] for f in found]))
                p, q = cells // size, cells % size
                told = []
                for (cell, dot, common), (x, y) in zip(found, sides, strict=True):
                    if count > 1:
                        to = np.searchsorted(cells, cell)
                        d, c = np.zeros(len(cells)), np.zeros(len(cells), np.int64)
                        d[to], c[to] = dot, common
                        dot, common = d, c
                    (nx, sx), (ny, sy) = ((np.sqrt(np.bincount(e[1], e[2] * e[2], size)), np.bincount(e[1], minlength=size)) for e in (x, y))
                    told.append((dot, common, nx[p], sx[p], ny[q], sy[q]))
                a, b = p + one.as_py() * size, q + other.as_py() * size
                if one == other:  # both orders of a pair are there
                    ok = a != b
                    a, b, told = a[ok], b[ok], [tuple(x[ok] for x in t) for t in told]
                with np.errstate(all="ignore"):
                    s = score(a, b, told)
                for x, y in ((a, b),) if one == other else ((a, b), (b, a)):
                    yield from _pair_rows(x, y, s, k, size)

    return pairs.mapInArrow(run, "a long, b long, score double")


def _pair_rows(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int | None, size: int) -> Iterator[pa.RecordBatch]:
    if k is not None:
        if size <= _LEAST and k < size and len(s) > size * size // 16:  # what lies below a row's k-th score goes before the rest is sorted
            full = np.full((size, size), -np.inf)
            full[a % size, b % size] = s
            ok = s >= np.partition(full, size - k, axis=1)[:, size - k][a % size] - 2e-9
            a, b, s = a[ok], b[ok], s[ok]
        order = np.lexsort((b, -np.round(s, 9), a))
        a, b, s = a[order], b[order], s[order]
        ok = np.arange(len(a)) - np.searchsorted(a, a) < k
        a, b, s = a[ok], b[ok], s[ok]
    for at in range(0, len(a), 1 << 18):
        x, y, z = (v[at : at + (1 << 18)] for v in (a, b, s))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(z, mask=np.isnan(z))], ["a", "b", "score"])


def _multiply(a: tuple, b: tuple, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, sums, counts) of two blocks' entries (column, row, value) by column: row * size + row of the pairs with a common column, in order."""
    cols = np.intersect1d(a[0], b[0])
    ends = [(np.searchsorted(e[0], cols, "left"), np.searchsorted(e[0], cols, "right")) for e in (a, b)]
    na, nb = (x[1] - x[0] for x in ends)
    times = na * nb
    if size <= _LEAST and times.sum() > size * size // 4:  # products of matrices, some columns at a time
        sums, counts = np.zeros((size, size)), np.zeros((size, size))
        for at in range(0, len(cols), size):
            some, full = cols[at : at + size], []
            for e in (a, b):
                to = np.minimum(np.searchsorted(some, e[0]), len(some) - 1)
                ok = some[to] == e[0]
                x, one = np.zeros((size, len(some))), np.zeros((size, len(some)), np.float32)
                x[e[1][ok], to[ok]], one[e[1][ok], to[ok]] = e[2][ok], 1
                full.append((x, one))
            sums += full[0][0] @ full[1][0].T
            counts += full[0][1] @ full[1][1].T
        cells = np.flatnonzero(counts > 0.5)
        return cells, sums.reshape(-1)[cells], np.rint(counts.reshape(-1)[cells]).astype(np.int64)
    begins, at = np.r_[0, np.cumsum(times)], 0
    got = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
    while at < len(cols):  # the pairs of some columns' entries at a time
        to = max(at + 1, int(np.searchsorted(begins, begins[at] + 4_000_000, "right")) - 1)
        t = times[at:to]
        c = np.repeat(np.arange(at, to), t)
        w = np.arange(len(c)) - np.repeat(np.cumsum(t) - t, t)
        p, q = ends[0][0][c] + w // nb[c], ends[1][0][c] + w % nb[c]
        cell = np.r_[got[0], a[1][p].astype(np.int64) * size + b[1][q]]
        dot, n = np.r_[got[1], a[2][p] * b[2][q]], np.r_[got[2], np.ones(len(p), np.int64)]
        u, where = np.unique(cell, return_inverse=True)
        got = (u, np.bincount(where, dot, len(u)), np.bincount(where, n, len(u)).astype(np.int64))
        at = to
    return got


def _whole(*frames: DataFrame) -> bool:
    """Whether the row and column ids of vectors are whole numbers."""
    return all(f.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for f in frames for c in ("row_id", "col_id"))


def _google_of(n: int):
    def score(common, ca, cb):
        return 1 - (np.log(np.maximum(ca, cb)) - np.log(common)) / (_ln(n) - np.log(np.minimum(ca, cb)))

    return score


def google_score(ca: Column, cb: Column, common: Column, n: int) -> Column:
    """0 without overlap."""
    low, high = F.least(ca, cb), F.greatest(ca, cb)
    return F.when(common > 0, 1 - (F.log(high) - F.log(common)) / (F.lit(float(_ln(n))) - F.log(low))).otherwise(0.0)


def _ln(n: int) -> float:
    import math

    return math.log(n)


def link_vectors(edges: DataFrame, out: bool = True, weighted: bool = False, logged: bool = False, n: int | None = None) -> DataFrame:
    """Link vectors of pages: 1 for each link, or N / degree of the linked page, logged or not, then of length 1."""
    row, col = ("source_id", "dest_id") if out else ("dest_id", "source_id")
    v = edges.select(F.col(row).alias("row_id"), F.col(col).alias("col_id")).distinct()
    if not weighted:
        return v.withColumn("value", F.lit(1.0))
    deg = v.groupBy("col_id").agg(F.count("*").alias("deg"))
    n = v.select("row_id").distinct().count() if n is None else n
    w = F.lit(float(n)) / F.col("deg")
    v = v.join(deg, "col_id").select("row_id", "col_id", (F.log(w) if logged else w).alias("value")).where("value > 0")
    return normalise_rows(v)


def most_similar(scores: DataFrame, k: int, valid: DataFrame | None = None) -> DataFrame:
    """(a, rank, b, score): the k best of each row, ties to the smaller id.

    Scores that are equal to nine places are ties: sums over a shuffle may differ in the last bit from run to run.
    """
    s = scores if valid is None else scores.join(valid.select(F.col("id").alias("b")).distinct(), "b", "left_semi")
    return top(s, k, [F.desc(F.round("score", 9)), F.asc("b")], ["a"]).select("a", "rank", "b", "score")


def _of(v: DataFrame, rows: DataFrame | None) -> DataFrame | None:
    """The rows of ``v`` that are asked for (row_id); none if all are."""
    return None if rows is None else v.join(rows.select("row_id").distinct(), "row_id", "left_semi")


def inlink(edges: DataFrame, n: int, pairs: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Google distance over in-links; of the asked ``pairs`` (a, b), or of the asked ``rows`` (row_id) with all others."""
    v = link_vectors(edges, out=False)
    if rows is None and pairs is None and _whole(v):
        return _inlink_blocks(v, n)
    return google(v, n, pairs=pairs) if rows is None else google(_of(v, rows), n, v, pairs).where("a <> b")


def outlink(edges: DataFrame, pairs: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Cosine of out-links weighted by log rarity; of the asked ``pairs`` or ``rows``, as in inlink()."""
    v = link_vectors(edges, out=True, weighted=True, logged=True)
    if rows is None and pairs is None and _whole(v):
        return _outlink_blocks(v)
    return cosine(v, pairs=pairs) if rows is None else cosine(_of(v, rows), v, pairs).where("a <> b")


def _inlink_blocks(v: DataFrame, n: int, k: int | None = None) -> DataFrame:
    of = _google_of(n)
    return block_pairs([v], lambda a, b, t: of(t[0][1], t[0][3], t[0][5]), k)


def _outlink_blocks(v: DataFrame, k: int | None = None) -> DataFrame:
    return block_pairs([v], lambda a, b, t: t[0][0] / (t[0][2] * t[0][4]), k)


def inlink_most_similar(edges: DataFrame, n: int, k: int) -> DataFrame:
    """(a, rank, b, score): the k best of inlink() for each page, chosen where pairs are made."""
    v = link_vectors(edges, out=False)
    return most_similar(_inlink_blocks(v, n, k) if _whole(v) else google(v, n), k)


def outlink_most_similar(edges: DataFrame, k: int) -> DataFrame:
    """(a, rank, b, score): the k best of outlink() for each page, chosen where pairs are made."""
    v = link_vectors(edges, out=True, weighted=True, logged=True)
    return most_similar(_outlink_blocks(v, k) if _whole(v) else cosine(v), k)


def milne_witten_pairs(edges: DataFrame, n: int) -> DataFrame:
    """(a, b, score): milne_witten() of inlink() and outlink(), both of a pair made in one place."""
    ins, outs = link_vectors(edges, out=False), link_vectors(edges, out=True, weighted=True, logged=True)
    if not _whole(ins, outs):
        return milne_witten(google(ins, n), cosine(outs))
    of = _google_of(n)

    def score(a, b, t):
        (_, i, _, ca, _, cb), (dot, o, na, _, nb, _) = t
        return np.where((i > 0) & (o > 0), 0.5 * of(i, ca, cb) + 0.5 * dot / (na * nb), np.nan)

    return block_pairs([ins, outs], score)


def milne_witten(ins: DataFrame, outs: DataFrame) -> DataFrame:
    """The mean of two scores; null where either is missing."""
    j = ins.select("a", "b", F.col("score").alias("i")).join(outs.select("a", "b", F.col("score").alias("o")), ["a", "b"], "full_outer")
    return j.select("a", "b", (0.5 * F.col("i") + 0.5 * F.col("o")).alias("score"))


def milne_witten_most_similar(ins: DataFrame, outs: DataFrame, k: int, missing_in: float = 0.0, missing_out: float = 0.0) -> DataFrame:
    """2k of each list, averaged with a list's missing score where an id isn't in it; k of those."""
    return milne_witten_best(most_similar(ins, 2 * k), most_similar(outs, 2 * k), k, missing_in, missing_out)


def milne_witten_best(ins: DataFrame, outs: DataFrame, k: int, missing_in: float = 0.0, missing_out: float = 0.0) -> DataFrame:
    """The same from the 2k best of each list."""
    i = ins.select("a", "b", F.col("score").alias("i"))
    o = outs.select("a", "b", F.col("score").alias("o"))
    s = i.join(o, ["a", "b"], "full_outer").select("a", "b", (0.5 * F.coalesce("i", F.lit(missing_in)) + 0.5 * F.coalesce("o", F.lit(missing_out))).alias("score"))
    return most_similar(s, k)


def direct_link(edges: DataFrame) -> DataFrame:
    """(a, b, score): half for a link in each direction."""
    fwd = edges.select(F.col("source_id").alias("a"), F.col("dest_id").alias("b"))
    return fwd.union(fwd.select("b", "a")).where("a <> b").groupBy("a", "b").agg((F.count("*") / 2.0).alias("score"))


def syn_rank(edges: DataFrame, n: int, linked: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, score): N * ab / (a * b) * log10(ab) / hops over in-links; hops is 1 for pages that link one another, else 2."""
    v = link_vectors(edges, out=False)
    if pairs is None and _whole(v):
        def score(a, b, t):
            _, common, _, ca, _, cb = t[0]
            return float(n) * common / (ca * cb) * np.log10(common) / 2

        d = block_pairs([v], score)
        if linked is None:
            return d
        # pages that link one another are few against pairs: one hop for these
        both = direct_link(linked).select("a", "b", F.lit(1).alias("one"))
        return _doubled(d, both)
    c = norms(v)
    d = dots(v, v, pairs).where("a <> b").join(c.select(F.col("row_id").alias("a"), F.col("n").alias("ca")), "a").join(c.select(F.col("row_id").alias("b"), F.col("n").alias("cb")), "b")
    hops = F.lit(2)
    if linked is not None:
        both = direct_link(linked).select("a", "b", F.lit(1).alias("one"))
        d, hops = d.join(both, ["a", "b"], "left"), F.when(F.col("one") == 1, 1).otherwise(2)
    return d.select("a", "b", (F.lit(float(n)) * F.col("n_common") / (F.col("ca") * F.col("cb")) * F.log10(F.col("n_common").cast("double")) / hops).alias("score"))


def _doubled(scores: DataFrame, linked: DataFrame) -> DataFrame:
    return scores.join(linked, ["a", "b"], "left").select("a", "b", (F.col("score") * F.when(F.col("one") == 1, 2.0).otherwise(1.0)).alias("score"))


def cosimilarity(scores: DataFrame, rows: DataFrame, cols: DataFrame, self_score: float = 1.0, missing: float = 0.0) -> DataFrame:
    """(a, b, score) for all pairs of two stated lists: their product is what is asked for."""
    grid = rows.select(F.col("id").alias("a")).crossJoin(cols.select(F.col("id").alias("b")))
    return grid.join(scores, ["a", "b"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), self_score).otherwise(F.coalesce("score", F.lit(missing))).alias("score"))


def explain(v: DataFrame, k: int = 5, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, rank, col_id, product): for each pair of rows, or each of the asked ``pairs`` (a < b), the shared features that count most."""
    x = v.select(F.col("row_id").alias("a"), "col_id", F.col("value").alias("x"))
    y = v.select(F.col("row_id").alias("b"), "col_id", F.col("value").alias("y"))
    j = x.join(y, "col_id") if pairs is None else pairs.select("a", "b").distinct().join(x, "a").join(y, ["b", "col_id"])
    p = j.where("a < b").select("a", "b", "col_id", (F.col("x") * F.col("y")).alias("product"))
    return top(p, k, [F.desc("product"), F.asc("col_id")], ["a", "b"]).select("a", "b", "rank", "col_id", "product")


def concept_space(edges: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(page_id, in_degree): articles by in-links, without the 2 * cbrt(N) first, the next 1000 * cbrt(N)."""
    from .filters import is_blacklisted

    deg = edges.groupBy(F.col("dest_id").alias("page_id")).agg(F.countDistinct("source_id").alias("in_degree"))
    if pages is not None:
        deg = deg.join(pages.where(~is_blacklisted(F.col("title"))).select("page_id"), "page_id", "left_semi")
    n = deg.count()
    skip, take = int(2 * round(n ** (1 / 3), 9)), int(1000 * round(n ** (1 / 3), 9))
    return deg.orderBy(F.desc("in_degree"), "page_id").offset(skip).limit(take)


def phrase_vectors(candidates: DataFrame, k: int = 20) -> DataFrame:
    """(phrase, page_id, weight): candidates from several generators (phrase, page_id, score, weight), the k best by sqrt of their share."""
    s = candidates.groupBy("phrase", "page_id").agg(F.sum(F.col("score") * F.col("weight")).alias("s"))
    best = top(s, k, [F.desc("s"), F.asc("page_id")], ["phrase"])
    total = Window.partitionBy("phrase")
    return best.select("phrase", "page_id", F.sqrt(F.col("s") / F.sum("s").over(total)).alias("weight"))


def concatenate(vectors: list[tuple[DataFrame, float]]) -> DataFrame:
    """Vectors of several metrics in one space: ids are shifted by metric, values scaled by coefficient."""
    out = None
    for i, (v, c) in enumerate(vectors):
        part = v.select("row_id", (F.col("col_id").cast("long") + F.lit(i * 2**31).cast("long")).alias("col_id"), (F.col("value") * c).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def row_summary(v: DataFrame, k: int = 3) -> DataFrame:
    """(row_id, rank, col_id, value, col_count): top columns of each row with how many rows have them."""
    freq = v.groupBy("col_id").agg(F.count("*").alias("col_count"))
    return top(v.join(freq, "col_id"), k, [F.desc("value"), F.asc("col_id")], ["row_id"]).select("row_id", "rank", "col_id", "value", "col_count")


def dot_dense(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm_dense(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_dense(a: Column, b: Column) -> Column:
    """0 for a null or zero vector."""
    n = norm_dense(a) * norm_dense(b)
    return F.coalesce(F.when(n > 0, dot_dense(a, b) / n), F.lit(0.0))
