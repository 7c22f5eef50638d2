"""Mixing sources to target weights by cube-method balanced sampling.

Each source takes its documents r = target / size times: floor(r) times each, and once more with the inclusion
probability that remains. Which of them is drawn by the cube method: the vector of probabilities moves at random
within the null-space of the constraints, document and word totals, until all but two probabilities are 0 or 1. That
flight goes through chunks of a source at a time; what each leaves goes on in a later round, until a source is one
chunk. The last flight leaves two documents and a few of all sizes that were kept for it; these land where the source's
words come nearest to the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch, n_words, own_name

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Documents that one flight goes through.
CHUNK = 50_000
#: Documents of a source that are left for the landing, besides the two that a flight leaves.
LANDING = 10
_EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, have the weights in turn and share ``share`` of all sizes. No target is
    above ``most`` times its source's size; what is above goes to the others by weight. The level at which the rest
    are served is found at once from the sources in order of size by weight: the first that isn't filled sets it, and
    of all that aren't filled it has the highest level.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    # one row for each source; the windows below run over those
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        ranked.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("w_left"))
        .withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
        .withColumn("cut", F.max(F.when(F.col("open"), F.col("level"))).over(every))
    )
    target = F.when(F.col("cut").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("cut") * F.col("w")))
    return level.select("source", "source_size", target.cast("double").alias("target"))


def _unit(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((key.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def flight(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Moves ``p`` within the null-space of (number, size) until at most two lie strictly between 0 and 1."""
    p = p.astype(np.float64).tolist()
    size, u, n = size.tolist(), u.tolist(), len(p)
    active: list[int] = []
    nxt = step = 0
    while True:
        while len(active) < 3 and nxt < n:
            if _EPS < p[nxt] < 1 - _EPS:
                active.append(nxt)
            nxt += 1
        if len(active) < 2:
            break
        if len(active) == 3:
            a, b, c = active
            d = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
            if d[0] == 0 == d[1]:
                d = [1.0, -1.0, 0.0]
        elif size[active[0]] == size[active[1]]:
            d = [1.0, -1.0]
        else:
            break
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(active, d, strict=True) if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(active, d, strict=True) if x)
        move = up if u[step % n] * (up + down) < down else -down
        step += 1
        left = []
        for i, x in zip(active, d, strict=True):
            p[i] += move * x
            if p[i] <= _EPS:
                p[i] = 0.0
            elif p[i] >= 1 - _EPS:
                p[i] = 1.0
            else:
                left.append(i)
        if len(left) == len(active):  # rounding kept all inside: settle the one nearest to an end
            i = min(left, key=lambda i: min(p[i], 1 - p[i]))
            p[i] = float(round(p[i]))
            left.remove(i)
        active = left
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few that are left: of all 0-1 vectors the one nearest to the expected words; documents off count a little."""
    at = np.flatnonzero((p > 0) & (p < 1))
    if not len(at):
        return p
    s = size[at].astype(np.float64)
    options = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    cost = np.abs(options @ s - p[at] @ s) + 0.02 * s.mean() * np.abs(options.sum(1) - p[at].sum())
    out = p.copy()
    out[at] = options[np.argmin(np.round(cost, 6))]
    return out


def last_flight(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A flight that leaves LANDING documents of all sizes on the ground, and the landing with those."""
    stay = np.unique(np.linspace(0, len(p) - 1, min(LANDING, len(p))).astype(int))
    fly = np.setdiff1d(np.arange(len(p)), stay)
    out = p.astype(np.float64)
    out[fly] = flight(p[fly], size[fly], u[fly]) if len(fly) else out[fly]
    return land(out, size)


_STATE = "sid long, h long, size long, p double, last boolean"


def _fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, sid, h, size, p, last) that come sorted by cell: one flight for each cell, landed where it is the last."""

    def of(rows: pa.Table) -> pa.RecordBatch:
        sid, h, size, p, last = (rows.column(k).to_numpy() for k in range(1, 6))
        u = _unit(np.ascontiguousarray((h ^ np.int64(0x5DEECE66D)) * np.int64(0x2545F4914F6CDD1D)))
        q = last_flight(p, size, u) if last[0] else flight(p, size, u)
        return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(h), pa.array(size), pa.array(q), pa.array(last)], ["sid", "h", "size", "p", "last"])

    held: list[pa.RecordBatch] = []

    def cells(t: pa.Table):
        cell = t.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        return [t.slice(a, b - a) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    for b in batches:
        if b.num_rows:
            parts = cells(pa.Table.from_batches([*held, b]))
            yield from map(of, parts[:-1])
            held = parts[-1].to_batches()
    if held:
        yield of(pa.Table.from_batches(held))


def draw(rows: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """(sid, h, size, p) with p 0 or 1 from probabilities ``p`` in (0, 1) that are equal within a ``sid``.

    The order of a flight and its moves follow from h and size alone, so that reruns agree.
    """
    counts = rows.groupBy("sid").agg(F.count("*").alias("n"))
    state, k, done = rows, 0, None
    while True:
        n = counts if k == 0 else state.groupBy("sid").agg(F.count("*").alias("n"))
        cells = (
            state.select("sid", "h", "size", "p")
            .join(n, "sid")
            .withColumn("nb", F.ceil(F.col("n") / F.lit(chunk)).cast("int"))
            .select(F.struct("sid", F.pmod(F.xxhash64("h", F.lit(k)), F.col("nb")).alias("b")).alias("at"), "sid", "h", "size", "p", (F.col("nb") == 1).alias("last"))
            .withColumn("cell", F.xxhash64("at.sid", "at.b"))
            .select("cell", "sid", "h", "size", "p", "last")
        )
        flown = cells.repartition("cell").sortWithinPartitions("cell", "sid", F.desc("size"), "h").mapInArrow(_fly, _STATE)
        flown = scratch.put(flown, f"flight{k}")
        whole = flown.where("p = 0 or p = 1").select("sid", "h", "size", "p")
        done = whole if done is None else done.unionByName(whole)
        state = flown.where("p > 0 and p < 1")
        k += 1
        if state.isEmpty():
            return done


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) for every row of ``docs``.

    A null text has size 0; a document of size 0 is taken 0 times. Rows with equal id, source and size are told apart
    by nothing and share one draw: all are taken as often. A null source is a source of its own, last in order. An
    empty table gives no rows; if all sizes are 0, all targets are 0. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size: Column = n_words(F.col(text_col))
    narrow = scratch.put(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")), "sizes")
    per_source = scratch.put(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    # copies beyond the whole ones: probability `extra`, the same for all of a source
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + _EPS)
    asked = per_source.withColumn("sid", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())).withColumn("whole", whole.cast("long")).withColumn("extra", F.greatest(rate - whole, F.lit(0.0)))
    keyed = narrow.withColumn("sid", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())).withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(9), "size"))
    per = asked.select("sid", "source_size", "target", "whole", "extra")
    rows = keyed.where("size > 0").join(per.where(F.col("extra") > _EPS), "sid").groupBy("sid", "h").agg(F.sum("size").alias("size"), F.first("extra").alias("p"))
    drawn = draw(rows, scratch, chunk).where("p = 1").select("sid", "h", F.lit(1).alias("more"))
    got = keyed.join(per, "sid").join(drawn, ["sid", "h"], "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("more", F.lit(0))).otherwise(F.lit(0)).cast("long")
    got = got.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` as mixed: rows that the mix takes twice come twice, those it doesn't take go. All columns are kept.

    Rows are known by id, source and size; nulls are values of their own, and rows equal in all three are taken as often. Null
    and empty texts are never taken. An empty table gives no rows. Columns may have any names.
    """
    taken = mix(docs, id_col, text_col, source_col, **how).where("copies > 0")
    at, of, n, k, size = (own_name(c, docs) for c in ("of_id", "of_source", "of_size", "copies", "words"))
    per = taken.groupBy(F.col("doc_id").alias(at), F.col("source").alias(of), F.col("size").alias(n)).agg(F.max("copies").alias(k))
    same = F.col(id_col).eqNullSafe(F.col(at)) & F.col(source_col).eqNullSafe(F.col(of)) & (F.col(size) == F.col(n))
    got = docs.withColumn(size, n_words(F.col(text_col))).join(per, same)
    return got.withColumn(at, F.explode(F.sequence(F.lit(1), F.col(k).cast("int")))).select(*docs.columns)
