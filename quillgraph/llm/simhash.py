"""SimHash near-duplicates linked through Golay codeword indices.

A document's 64-bit fingerprint is cut in three segments, A and B of 23 bits and C of 18 (zero-padded to 23). Each
segment is decoded in the perfect [23, 12, 7] Golay code: a vector has one codeword within distance 3, and if it lies
at distance 3 exactly, five more at distance 4. Two vectors that differ in at most one bit then share an index of
these lists, and one of the two holds it as its nearest.

Three differing bits over three segments leave two cases. If one segment is equal, one of the other two has one error
at most: keys (equal segment, index of another), six kinds. Else each segment has exactly one error: one half of B
and one half of C are equal: keys (index of A, half of B, half of C), four kinds. So any two fingerprints at distance
3 or less meet in a bucket, every kind of key holds 30 bits or more, and candidates are verified by their distance.

Buckets are compared in blocks of bounded size; a task sends out a spanning forest of what it links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, own_name

#: Fingerprints of one bucket that are compared with one another in one task; larger buckets go in pairs of blocks.
BLOCK = 2048
_CHUNK = 1 << 16
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _syndrome(v: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit polynomials by the generator."""
    v = v.astype(np.int64)
    for k in range(22, 10, -1):
        v = np.where((v >> k) & 1, v ^ (_GENERATOR << (k - 11)), v)
    return v


def _patterns() -> np.ndarray:
    """(2048, 6): for each syndrome the error of weight 3 or less, then those of weight 4 where there are some, else -1."""
    from itertools import combinations

    out = np.full((2048, 6), -1, np.int64)
    fill = np.zeros(2048, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for s, e in zip(_syndrome(errors).tolist(), errors.tolist(), strict=True):
            if weight < 4 or out[s, 0] >= 0 and bin(int(out[s, 0])).count("1") == 3:
                out[s, fill[s]] = e
                fill[s] += 1
    return out


_TABLE: np.ndarray | None = None


def golay_indices(segments: np.ndarray) -> np.ndarray:
    """(n, 6) indices of 12 bits for 23-bit vectors: the nearest codeword's, then those at distance 4; -1 where none."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _patterns()
    errors = _TABLE[_syndrome(segments)]
    return np.where(errors >= 0, (segments[:, None] ^ errors) >> 11, -1)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 64-bit fingerprints: bucket keys, the row each belongs to, and whether it comes from the nearest codeword."""
    f = fps.view(np.uint64)
    a, b, c = (((f >> np.uint64(s)) & np.uint64(m)).astype(np.int64) for s, m in ((0, (1 << 23) - 1), (23, (1 << 23) - 1), (46, (1 << 18) - 1)))
    seg = (a, b, c)
    idx = [golay_indices(x) for x in seg]
    rows = np.arange(len(f))
    keys, row, near = [], [], []

    def add(kind: int, exact: np.ndarray, index: np.ndarray) -> None:
        for k in range(6):
            has = index[:, k] >= 0
            keys.append((np.int64(kind) << 58) | (exact[has] << 12) | index[has, k])
            row.append(rows[has])
            near.append(np.full(int(has.sum()), k == 0))

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                add(kind, seg[i], idx[j])
                kind += 1
    for hb in (b & 0xFFF, b >> 12):
        for hc in (c & 0x1FF, c >> 9):
            add(kind, (hb << 9) | hc, idx[0])
            kind += 1
    return np.concatenate(keys), np.concatenate(row), np.concatenate(near)


def majority(hashes: Iterable[np.ndarray], n: int) -> int:
    """The bits that are set in over half of ``n`` 64-bit hashes, which come in arrays, as a signed number."""
    ones = np.zeros(64, np.int64)
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit number; 0 without words."""
    import xxhash

    w = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not w:
        return 0
    if len(w) < size:
        shingles, n = iter([b" ".join(w)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(w[k:] for k in range(size)), strict=False)), len(w) - size + 1
    hashes, parts = map(xxhash.xxh64_intdigest, shingles, repeat(seed)), (min(_CHUNK, n - at) for at in range(0, n, _CHUNK))
    return majority((np.fromiter(islice(hashes, m), np.uint64, m) for m in parts), n)


def digest(text: Column) -> Column:
    """What a row's text is known by where ids are null or shared; a null text counts as empty."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, digests: bool = False) -> DataFrame:
    """(doc_id, fp) for every row, on demand with the text's digest; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.cast(b.column(1), pa.binary())
            fp = [fingerprint(t.as_py() or b"", size) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    more = [digest(F.col(text_col)).alias("digest")] if digests else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return rows.mapInArrow(run, "doc_id long, fp long" + ", digest string" * digests)


def key_rows(fps: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(key, fp, near) for each row's bucket keys, with the columns ``more`` of 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(f), 4096):
                part = f[at : at + 4096]
                key, row, near = keys_of(part)
                others = [c.slice(at, 4096).take(pa.array(row)) for c in b.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row]), pa.array(near), *others], ["key", "fp", "near", *more])

    return fps.select("fp", *more).mapInArrow(run, ", ".join(["key long, fp long, near boolean", *(f"{c} long" for c in more)]))


def _forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) of each linked fingerprint but the roots, by walks through what is not yet reached."""
    rest, roots, members = np.unique(fp), [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count((rest ^ queue.pop()).view(np.uint64)) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                members.append(found)
                roots.append(np.full(len(found), root))
    if not members:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(roots), np.concatenate(members)


def _links(distance: int):
    """Over rows (cell, fp) that come sorted by cell: links within each cell."""

    def of(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(cell)) + 1
        start, end = np.r_[0, cut], np.r_[cut, len(cell)]
        two = start[end - start == 2]
        near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= distance
        two = two[near & (fp[two] != fp[two + 1])]
        src, dst = [np.minimum(fp[two], fp[two + 1])], [np.maximum(fp[two], fp[two + 1])]
        for s, e in zip(start[end - start > 2].tolist(), end[end - start > 2].tolist(), strict=True):
            r, m = _forest(fp[s:e], distance)
            src.append(r)
            dst.append(m)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            cell = np.concatenate([cell, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False)])
            last = np.searchsorted(cell, cell[-1])  # the last cell may go on in the next batch
            if last:
                yield of(cell[:last], fp[:last])
                cell, fp = cell[last:], fp[last:]
        if len(cell):
            yield of(cell, fp)

    return run


def links(fps: DataFrame, scratch: Scratch, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect all at ``distance`` or less. ``fps`` has distinct ones."""
    if not 0 <= distance <= 3:
        raise ValueError("the keys hold for distances up to 3")
    keys = key_rows(fps)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("near").alias("near")).where("n > 1 AND near").select("key", "n")
    sizes = scratch.put(sizes, "buckets")
    cells = (
        keys.select("key", "fp")
        .join(sizes, "key")
        .withColumn("nb", F.ceil(F.col("n") / F.lit(block)).cast("int"))
        .withColumn("b", F.expr("cast(pmod(xxhash64(fp), nb) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
        .select(F.xxhash64("key", F.least("b", "other"), F.greatest("b", "other")).alias("cell"), "fp")
    )
    out = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(distance), "u long, v long")
    return scratch.put(out.distinct(), "links")


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the smallest node of its component.

    Alternating large and small stars; each round is a written table, and rounds end when the edges stay as they are.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = scratch.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}0")
    before, k = state(e), 0
    while before[0]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        k += 1
        e = scratch.put(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}{k}")
        now = state(e)
        if k > 1:
            scratch.drop(f"{name}{k - 1}")
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(fp: DataFrame, scratch: Scratch, distance: int, block: int) -> DataFrame:
    """(fp, least, root) for each fingerprint: the least id that has it and its component."""
    least = scratch.put(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least, scratch, distance, block), scratch)
    return least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows and equal ids get equal results. A
    null id is kept and never names a component that holds another id. An empty table gives no rows. Columns besides
    the two named ones are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fp = scratch.put(fingerprints(docs, id_col, text_col, size), "fp")
    rooted = _rooted(fp, scratch, distance, block)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fp.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, digest, root) for every row of ``docs``: its component, whatever its id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fp = scratch.put(fingerprints(docs, id_col, text_col, size, True), "fp")
    return fp.join(_rooted(fp, scratch, distance, block), "fp").select("doc_id", "digest", "root")


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each root of ``found`` (doc_id, digest, root), all columns kept: that with the smallest id.

    A null id stands behind all others; of several texts with that id the one with the smallest digest stays. Rows of
    other components stay whether or not their ids are null or shared.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("k")
    keep, of, own = (own_name(c, docs) for c in ("keep", "of", "digest"))
    chosen = found.groupBy("root").agg(first).select(F.col("k.doc_id").alias(keep), F.col("k.digest").alias(of))
    d = docs.withColumn(own, digest(F.col(text_col)))
    kept = d.join(chosen, F.col(id_col).cast("long").eqNullSafe(F.col(keep)) & (F.col(own) == F.col(of)), "left_semi")
    return kept.dropDuplicates([id_col, own]).drop(own)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the one with the smallest id, all columns kept.

    A row with a null id stays only where its component has no other id. Unlike texts that share an id are told apart by their
    digests, so each component keeps a row. Of rows that share id and text one stays. An empty table gives no rows.
    """
    return keep_least(docs, groups(docs, id_col, text_col, **how), id_col, text_col)
