"""Points and regions on the sphere: distances, neighbours, containment, hops.

Neighbour searches go through cells of a grid: a point is matched with the cells that its radius can reach, so that
points meet only those nearby. Regions are tables of rings (region_id, ring, path of (lon, lat)).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph
from .links import top

RADIUS = 6_372_800.0  # metres
_WIDE = 6_378_137.0
_FLAT = 1 / 298.257223563


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the great circle."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 12) -> Column:
    """Metres on the ellipsoid by Vincenty's inverse formula; near antipodes, where it does not converge, the great circle."""

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def of(a, b, c, d):
        import numpy as np
        import pandas as pd

        x1, y1, x2, y2 = (np.radians(v.to_numpy(dtype=float)) for v in (a, b, c, d))
        low = (1 - _FLAT) * _WIDE
        u1, u2 = np.arctan((1 - _FLAT) * np.tan(y1)), np.arctan((1 - _FLAT) * np.tan(y2))
        su1, cu1, su2, cu2, big = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2), x2 - x1
        lam, change = big.copy(), np.full(len(big), np.inf)
        with np.errstate(all="ignore"):
            for _ in range(rounds):
                sl, cl = np.sin(lam), np.cos(lam)
                ss = np.sqrt((cu2 * sl) ** 2 + (cu1 * su2 - su1 * cu2 * cl) ** 2)
                cs = su1 * su2 + cu1 * cu2 * cl
                sig = np.arctan2(ss, cs)
                sa = np.where(ss > 0, cu1 * cu2 * sl / ss, 0.0)
                ca2 = 1 - sa**2
                cm = np.where(ca2 > 0, cs - 2 * su1 * su2 / ca2, 0.0)
                k = _FLAT / 16 * ca2 * (4 + _FLAT * (4 - 3 * ca2))
                new = big + (1 - k) * _FLAT * sa * (sig + k * ss * (cm + k * cs * (-1 + 2 * cm**2)))
                change, lam = np.abs(new - lam), new
            q = ca2 * (_WIDE**2 - low**2) / low**2
            e = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
            f = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
            ds = f * ss * (cm + f / 4 * (cs * (-1 + 2 * cm**2) - f / 6 * cm * (-3 + 4 * ss**2) * (-3 + 4 * cm**2)))
            got = low * e * (sig - ds)
            h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
            sphere = 2 * RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1)))
        return pd.Series(np.where((change < 1e-9) & np.isfinite(got), got, sphere))

    return of(lon1, lat1, lon2, lat2)


def unit_vector(lon: Column, lat: Column) -> Column:
    """A point in three dimensions, whose chords are in the order of distances."""
    return F.array(F.cos(F.radians(lat)) * F.sin(F.radians(-lon)), F.cos(F.radians(lat)) * F.cos(F.radians(-lon)), F.sin(F.radians(-lat)))


def _row(lat: Column, size: float) -> Column:
    return F.floor((lat + 90.0) / size).cast("int")


def _col(lon: Column, size: float) -> Column:
    return F.floor((lon + 180.0) / size).cast("int")


def _cells(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("cy", _row(F.col("lat"), size)).withColumn("cx", F.pmod(_col(F.col("lon"), size), F.lit(math.ceil(360 / size))))


#: Points of a list that meets another: of the asked, which are many rows each, and of those that they meet.
_ASKED, _THERE = 64, 8192


def _listed(points: DataFrame, keys: list[str], name: str, most: int, rest: tuple[str, ...] = ()) -> DataFrame:
    """(keys, name): points (id, lon, lat, rest) of equal keys as lists of at most ``most``."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("id")) - 1
    return points.withColumn("__no", F.floor(at / most)).groupBy(*keys, "__no").agg(F.collect_list(F.struct("id", "lon", "lat", *rest)).alias(name)).drop("__no")


def _reach(a: DataFrame, b: DataFrame, far: float) -> DataFrame:
    """(asked, there): lists of points of ``a`` with those of ``b`` that may lie within ``far`` metres of some of them.

    Cells are as high as the radius; a cell's points look in all columns that the radius can reach at its latitude.
    """
    size = max(min(math.degrees(far / RADIUS), 90.0), 1e-3)
    n = math.ceil(360 / size)
    asked = _listed(_cells(a.select("id", "lon", "lat"), size), ["cy", "cx"], "asked", _ASKED)
    # half the width in degrees of a circle around the cell's point nearest to a pole, all the way round near the poles
    edge = F.greatest(F.abs(F.col("cy") * size - 90.0), F.abs((F.col("cy") + 1) * size - 90.0))
    lat = F.least(edge + size, F.lit(90.0))
    reach = F.when(lat >= 89.9, F.lit(180.0)).otherwise(F.least(F.lit(180.0), F.lit(size) / F.cos(F.radians(lat)) + size))
    span = F.least(F.ceil(reach / size).cast("int"), F.lit((n - 1) // 2 + 1))
    cols = F.array_distinct(F.transform(F.sequence(F.col("cx") - span, F.col("cx") + span), lambda x: F.pmod(x, F.lit(n))))
    asked = asked.withColumn("ky", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1))).withColumn("kx", F.explode(cols)).select("ky", "kx", "asked")
    there = _listed(_cells(b.select("id", "lon", "lat"), size), ["cy", "cx"], "there", _THERE)
    # lists are small for the work on them: no fewer partitions than these
    parts = _parts(a)
    there = there.withColumnsRenamed({"cy": "ky", "cx": "kx"}).repartition(parts, "ky", "kx")
    return asked.repartition(parts, "ky", "kx").join(there, ["ky", "kx"]).select("asked", "there")


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _metres(asked: pa.Array, there: pa.Array) -> np.ndarray:
    """The haversine of every asked point, by row, to all of the others."""
    (x1, y1), (x2, y2) = ([np.radians(p.field(c).to_numpy(zero_copy_only=False)) for c in ("lon", "lat")] for p in (asked, there))
    h = np.sin((y2[None, :] - y1[:, None]) / 2) ** 2 + np.cos(y1)[:, None] * np.cos(y2)[None, :] * np.sin((x2[None, :] - x1[:, None]) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1)))


def _type(df: DataFrame, column: str = "id") -> str:
    return df.schema[column].dataType.simpleString()


def within(a: DataFrame, b: DataFrame, far: float, near: float = 0.0) -> DataFrame:
    """(a, b, metres): points of ``b`` between ``near`` and ``far`` metres from those of ``a``; both have (id, lon, lat).

    Lists of points of nearby cells meet and are measured at once; only the pairs found are rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                d = _metres(x, y)
                r, c = np.nonzero((d <= far) & (d >= near))
                if len(r):
                    yield pa.RecordBatch.from_arrays([x.field("id").take(pa.array(r)), y.field("id").take(pa.array(c)), pa.array(d[r, c])], ["a", "b", "metres"])

    return _reach(a, b, far).mapInArrow(run, f"a {_type(a)}, b {_type(b)}, metres double")


def between(pairs: DataFrame, points: DataFrame, far: float) -> DataFrame:
    """Asked pairs (a, b, ..) of points (id, lon, lat) at ``far`` metres or less, with their metres; no other pair is made."""
    for n in ("a", "b"):
        pairs = pairs.join(points.select(F.col("id").alias(n), F.col("lon").alias(f"{n}lon"), F.col("lat").alias(f"{n}lat")), n)
    d = haversine(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat"))
    return pairs.withColumn("metres", d).where(F.col("metres") <= far).drop("alon", "alat", "blon", "blat")


def nearest(a: DataFrame, b: DataFrame, k: int, start: float | None = None, exclude_self: bool = True) -> DataFrame:
    """(a, rank, b, metres): the k nearest points, ties to the smaller id; the radius doubles for points that lack some.

    A point is done once k others lie within its radius, which then hold its k nearest. The first radius is ``start`` metres
    or that of a circle which would hold half of k points if they were spread evenly, so that dense tables begin with small circles.
    """
    half, left, found = math.pi * RADIUS, a, None
    far = 2 * RADIUS * math.sqrt(min(1.0, k / (2 * max(1, b.count())))) if start is None else start
    while True:
        got = within(left, b, min(far, half * 1.01))
        got = got.where("a <> b") if exclude_self else got
        ranked = graph.cut(top(got, k, [F.asc("metres"), F.asc("b")], ["a"]).select("a", "rank", "b", "metres"))
        done = ranked.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("a")
        last = far >= half
        part = ranked if last else ranked.join(done, "a", "left_semi")
        found = part if found is None else found.unionByName(part)
        if last:
            return found
        left = graph.cut(left.join(done, left["id"] == done["a"], "left_anti"))
        if left.isEmpty():
            return found
        far *= 2


def ordinals_within(a: DataFrame, b: DataFrame, far: float, places: int = 3) -> DataFrame:
    """(a, b, ordinal): the rank of b among all other points within ``far`` metres of a; equal distances, rounded to ``places``, share a rank.

    A list of asked points has all that they may reach in one row, so that ranks are told there and no pair is sent.
    """
    met = _reach(a, b, far).groupBy("asked").agg(F.flatten(F.collect_list("there")).alias("there"))  # of the cells within reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                ids, other = x.field("id"), y.field("id")
                number = other.to_numpy(zero_copy_only=False)
                for k in range(len(x)):
                    d = _metres(x.slice(k, 1), y)[0]
                    c = np.flatnonzero((d <= far) & (number != ids[k].as_py()))
                    m = np.round(d[c], places)
                    rank = np.searchsorted(np.sort(m), m) + 1
                    if len(c):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(c), k))), other.take(pa.array(c)), pa.array(rank.astype(np.int32))], ["a", "b", "ordinal"])

    return met.repartition(_parts(a)).mapInArrow(run, f"a {_type(a)}, b {_type(b)}, ordinal int")


def ordinal(pairs: DataFrame) -> DataFrame:
    """(a, b, ordinal): the rank of b among all that are near a, from (a, b, metres); equal distances share a rank."""
    return pairs.select("a", "b", F.rank().over(Window.partitionBy("a").orderBy("metres")).alias("ordinal"))


def graph_distance(start: DataFrame, neighbours: DataFrame, most: int = 30) -> DataFrame:
    """(owner, node, hops) over the graph of nearest neighbours (a, b), taken as undirected."""
    return graph.hops(start, neighbours.select("a", "b"), most)


def rings(regions: DataFrame) -> DataFrame:
    """(region_id, x1, y1, x2, y2): the edges of regions' rings, whose paths are arrays of struct(lon, lat)."""
    path = F.when(F.element_at("path", 1) == F.element_at("path", -1), F.col("path")).otherwise(F.concat("path", F.array(F.element_at("path", 1))))
    e = regions.withColumn("path", path).select("region_id", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "p"), "path")
    return e.select("region_id", F.col("p.lon").alias("x1"), F.col("p.lat").alias("y1"), F.get("path", F.col("i") + 1)["lon"].alias("x2"), F.get("path", F.col("i") + 1)["lat"].alias("y2"))


def inside(path: Column, lon: Column, lat: Column) -> Column:
    """Whether a ring, an array of struct(lon, lat), contains the point: a ray crosses its edges an odd number of times."""
    n = F.size(path)

    def crossing(s: Column, i: Column) -> Column:
        a, b = F.get(path, i), F.get(path, (i + 1) % n)
        cross = ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"])
        return s + F.when(cross, 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), crossing) % 2 == 1


def bounds(regions: DataFrame) -> DataFrame:
    """Rings with their bounding box."""
    x, y = F.transform("path", lambda p: p["lon"]), F.transform("path", lambda p: p["lat"])
    return regions.withColumn("x_min", F.array_min(x)).withColumn("x_max", F.array_max(x)).withColumn("y_min", F.array_min(y)).withColumn("y_max", F.array_max(y))


def containing(points: DataFrame, regions: DataFrame, buffer: float = 0.0, cell: float = 5.0) -> DataFrame:
    """(id, region_id): regions that contain each point; with ``buffer``, also those with an edge within so many degrees.

    Rings are laid out over the cells that their boxes cover, points meet the rings of their cell. Holes are rings of
    their own: a point in an even number of a region's rings is outside.
    """
    r = bounds(regions.select("region_id", "path"))
    low = lambda c: F.floor((F.col(c) - buffer) / cell).cast("int")
    high = lambda c: F.floor((F.col(c) + buffer) / cell).cast("int")
    laid = r.withColumn("cx", F.explode(F.sequence(low("x_min"), high("x_max")))).withColumn("cy", F.explode(F.sequence(low("y_min"), high("y_max"))))
    p = points.select("id", "lon", "lat", F.floor(F.col("lon") / cell).cast("int").alias("cx"), F.floor(F.col("lat") / cell).cast("int").alias("cy"))
    box = (F.col("lon") >= F.col("x_min") - buffer) & (F.col("lon") <= F.col("x_max") + buffer) & (F.col("lat") >= F.col("y_min") - buffer) & (F.col("lat") <= F.col("y_max") + buffer)
    j = p.join(laid, ["cx", "cy"]).where(box).withColumn("in", inside(F.col("path"), F.col("lon"), F.col("lat")).cast("int"))
    close = edge_distance(F.col("path"), F.col("lon"), F.col("lat")) <= buffer if buffer > 0 else F.lit(False)
    g = j.withColumn("close", close).groupBy("id", "region_id").agg(F.sum("in").alias("n"), F.max("close").alias("close"))
    return g.where("n % 2 = 1 or close").select("id", "region_id")


def edge_distance(path: Column, lon: Column, lat: Column) -> Column:
    """Degrees from a point to the nearest edge of a ring."""
    n = F.size(path)

    def least(s: Column, i: Column) -> Column:
        a, b = F.get(path, i), F.get(path, (i + 1) % n)
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        q = dx * dx + dy * dy
        t = F.when(q > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - a["lon"]) * dx + (lat - a["lat"]) * dy) / q))).otherwise(0.0)
        ex, ey = lon - a["lon"] - t * dx, lat - a["lat"] - t * dy
        return F.least(s, F.sqrt(ex * ex + ey * ey))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(float("inf")), least)


def contained(points: DataFrame, regions: DataFrame, buffers: tuple[float, ...] = (0.0, 0.001, 0.1)) -> DataFrame:
    """(id, region_id) with wider buffers for points that no region contains."""
    found, left = None, points
    for b in buffers:
        got = graph.cut(containing(left, regions, b))
        found = got if found is None else found.unionByName(got)
        left = left.join(got.select("id").distinct(), "id", "left_anti")
    return found


def bordering(regions: DataFrame, buffer: float = 0.001) -> DataFrame:
    """(a, b): regions that come within ``buffer`` degrees of one another: a corner of one at an edge of the other."""
    corners = regions.select(F.col("region_id").alias("a"), F.explode("path").alias("p")).select("a", "p.lon", "p.lat").distinct()
    ids = corners.withColumn("id", F.struct("a", "lon", "lat"))
    near = containing(ids.select("id", "lon", "lat"), regions, buffer).select(F.col("id.a").alias("a"), F.col("region_id").alias("b")).where("a <> b")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def centre(regions: DataFrame) -> DataFrame:
    """(region_id, lon, lat): the centroid of each region's largest ring."""
    e = rings(regions.withColumn("region_id", F.struct("region_id", F.col("ring"))))
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    s = e.groupBy("region_id").agg(F.sum(cross).alias("a2"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy")).where("a2 <> 0")
    best = s.groupBy("region_id.region_id").agg(F.max_by(F.struct((F.col("sx") / (3 * F.col("a2"))).alias("lon"), (F.col("sy") / (3 * F.col("a2"))).alias("lat")), F.abs("a2")).alias("c"))
    return best.select("region_id", "c.lon", "c.lat")


def resolve_places(names: DataFrame, senses: DataFrame, weights: list[DataFrame], k: int = 5, decay: float = 0.7) -> DataFrame:
    """(key, rank, univ_id, score): which concept each row of a gazetteer means.

    ``names`` has (key, i, phrase), the columns of a row in order of trust; ``senses`` (phrase, univ_id, prob); each of
    ``weights`` (key, univ_id, score) from a scorer of its own, that only tells candidates apart.
    """
    base = names.join(senses, "phrase").select("key", "univ_id", (F.pow(F.lit(decay), F.col("i")) * F.col("prob")).alias("score"))
    known = base.select("key", "univ_id").distinct()
    every = base
    for w in weights:
        every = every.unionByName(w.join(known, ["key", "univ_id"], "left_semi").select("key", "univ_id", "score"))
    s = every.groupBy("key", "univ_id").agg(F.sum("score").alias("score"))
    return top(s, k, [F.desc("score"), F.asc("univ_id")], ["key"]).select("key", "rank", "univ_id", "score")


def merge_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, univ_id, status): verified matches (V) stay, unverified ones (U) take the new guess."""
    j = old.select("key", F.col("univ_id").alias("o"), "status").join(new.where("rank = 1").select("key", F.col("univ_id").alias("n")), "key", "full_outer")
    keep = F.col("status") == "V"
    return j.select("key", F.when(keep, F.col("o")).otherwise(F.coalesce("n", "o")).alias("univ_id"), F.when(keep, "V").otherwise("U").alias("status"))


def distance_levels(pairs: DataFrame, scores: DataFrame, width: float) -> DataFrame:
    """(level, pairs, mean_score): relatedness by distance, level i from i * width metres on."""
    return scored_levels(pairs.join(scores, ["a", "b"]), width)


def scored_levels(pairs: DataFrame, width: float) -> DataFrame:
    """The same of pairs (metres, score) that have their score already."""
    return pairs.groupBy(F.floor(F.col("metres") / width).alias("level")).agg(F.count("*").alias("pairs"), F.avg("score").alias("mean_score"))


HALF_ROUND = 40_075_017.0 / 2


def ordinal_estimates(pairs: DataFrame, nearest_of: DataFrame, total: int, furthest: float = HALF_ROUND) -> DataFrame:
    """(a, b, ordinal) of any pairs (a, b, metres), from each point's nearest (a, metres): how many of these are nearer.

    Beyond the furthest of them the ordinal grows with the distance, up to ``total`` at ``furthest`` metres.
    """
    known = nearest_of.groupBy("a").agg(F.count("*").alias("n"), F.max("metres").alias("edge"))
    j = pairs.join(known, "a")
    near = j.where("metres < edge").select("a", "b", F.col("metres").alias("d")).join(nearest_of.select("a", "metres"), "a").groupBy("a", "b").agg(F.sum((F.col("metres") < F.col("d")).cast("int")).cast("double").alias("ordinal"))
    far = j.where("metres >= edge").select("a", "b", (F.col("n") + (F.col("metres") - F.col("edge")) / (F.lit(furthest) - F.col("edge")) * (F.lit(total) - F.col("n"))).alias("ordinal"))
    return near.unionByName(far)


def all_ordinals(points: DataFrame, nearest_of: DataFrame, total: int, furthest: float = HALF_ROUND, places: int = 3) -> DataFrame:
    """(a, b, ordinal) of all pairs of points (id, lon, lat), as ordinal_estimates() has them, metres rounded to ``places``.

    Each point carries its nearest as a sorted list; lists of points meet all others, so that a pair is made where its
    ordinal is told and never sent. The pairs themselves are as many as the square of the points.
    """
    known = nearest_of.groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_list("metres")).alias("near"))  # of the few nearest
    blocks = F.pmod(F.xxhash64("id"), F.lit(max(1, total // _THERE)))
    asked = _listed(points.select("id", "lon", "lat").join(known, "id").withColumn("__b", blocks), ["__b"], "asked", _ASKED, ("near",))
    there = _listed(points.select("id", "lon", "lat").withColumn("__b", blocks), ["__b"], "there", _THERE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                a, b, near, d = x.field("id"), y.field("id"), x.field("near"), np.round(_metres(x, y), places)
                same = a.to_numpy(zero_copy_only=False)[:, None] == b.to_numpy(zero_copy_only=False)[None, :]
                for k in range(len(a)):
                    s = near[k].values.to_numpy(zero_copy_only=False)
                    n, edge, m = len(s), s[-1], d[k]
                    d[k] = np.where(m < edge, np.searchsorted(s, m), n + (m - edge) / (furthest - edge) * (total - n))
                r, c = np.nonzero(~same)
                yield pa.RecordBatch.from_arrays([a.take(pa.array(r)), b.take(pa.array(c)), pa.array(d[r, c])], ["a", "b", "ordinal"])

    # lists alone are paired here: a block of the asked for each block of all
    return asked.select("asked").repartition(_parts(points)).crossJoin(there.select("there")).mapInArrow(run, f"a {_type(points)}, b {_type(points)}, ordinal double")


def region_hops(starts: DataFrame, borders: DataFrame, most: int = 50) -> DataFrame:
    """(owner, node, hops): how many borders lie between regions, from (owner, node) over (a, b)."""
    return graph.hops(starts, borders, most)


def touching(regions: DataFrame, asked: DataFrame, exclude: DataFrame | None = None, buffer: float = 0.001) -> DataFrame:
    """(region_id, other): the neighbours of the asked regions, without those to be excluded (region_id)."""
    b = bordering(regions, buffer)
    both = b.select(F.col("a").alias("region_id"), F.col("b").alias("other")).unionByName(b.select(F.col("b").alias("region_id"), F.col("a").alias("other")))
    got = both.join(asked.select("region_id").distinct(), "region_id", "left_semi")
    return got if exclude is None else got.join(exclude.select(F.col("region_id").alias("other")).distinct(), "other", "left_anti").select("region_id", "other")


def intersecting(a: DataFrame, b: DataFrame, cell: float = 5.0) -> DataFrame:
    """(a, b): regions of two tables of rings that share some point: edges that cross or meet, or one within the other.

    Edges are laid over the cells of a grid that their boxes cover, and meet only those of their cell.
    """

    def laid(regions: DataFrame, n: str) -> DataFrame:
        e = rings(regions)
        low = lambda p, q: F.floor(F.least(p, q) / cell).cast("int")
        high = lambda p, q: F.floor(F.greatest(p, q) / cell).cast("int")
        e = e.withColumn("cx", F.explode(F.sequence(low("x1", "x2"), high("x1", "x2")))).withColumn("cy", F.explode(F.sequence(low("y1", "y2"), high("y1", "y2"))))
        return e.select("cx", "cy", F.col("region_id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("x1", "y1", "x2", "y2")])

    def side(p: str, q: str) -> Column:
        """On which side of the edge p its ends of q lie, as the product of the two turns."""
        turn = lambda x, y: (F.col(f"{p}_x2") - F.col(f"{p}_x1")) * (F.col(f"{q}_{y}") - F.col(f"{p}_y1")) - (F.col(f"{p}_y2") - F.col(f"{p}_y1")) * (F.col(f"{q}_{x}") - F.col(f"{p}_x1"))
        return F.signum(turn("x1", "y1")) * F.signum(turn("x2", "y2"))

    def apart(c: str) -> Column:
        p, q = (F.greatest(f"a_{c}1", f"a_{c}2"), F.least(f"a_{c}1", f"a_{c}2")), (F.greatest(f"b_{c}1", f"b_{c}2"), F.least(f"b_{c}1", f"b_{c}2"))
        return (p[0] < q[1]) | (q[0] < p[1])

    met = laid(a, "a").join(laid(b, "b"), ["cx", "cy"]).where(~apart("x") & ~apart("y") & (side("a", "b") <= 0) & (side("b", "a") <= 0)).select("a", "b")
    corner = lambda r: r.select(F.col("region_id").alias("id"), F.element_at("path", 1)["lon"].alias("lon"), F.element_at("path", 1)["lat"].alias("lat"))
    within_b = containing(corner(a), b).select(F.col("id").alias("a"), F.col("region_id").alias("b"))
    within_a = containing(corner(b), a).select(F.col("region_id").alias("a"), F.col("id").alias("b"))
    return met.unionByName(within_b).unionByName(within_a).distinct()


def geometries(shapes: DataFrame, layer: str | None = None, ref_sys: str | None = None, items: DataFrame | None = None, precision: str | None = None, titles: DataFrame | None = None) -> DataFrame:
    """Shapes (item_id, layer, ref_sys, precision, ..) by layer, reference system, least precision, items (item_id) or titles (title, item_id).

    Precision is LOW or HIGH; LOW admits both. Without conditions all shapes of all items.
    """
    out = shapes
    for column, value in (("layer", layer), ("ref_sys", ref_sys)):
        out = out if value is None else out.where(F.col(column) == value)
    out = out.where(F.col("precision") == "HIGH") if precision == "HIGH" else out
    for ids in (items, titles):
        out = out if ids is None else out.join(ids.select("item_id").distinct(), "item_id", "left_semi")
    return out
