"""Sharding by extendible hashing, in DataFrame operations only.

A row's shard is the bucket that the leading bits of its key's hash lead to. All rows start in one bucket; a bucket
above the byte limit splits on the next bit, others stay. Splits go by rounds of BITS bits: one aggregation gives the
bytes of every cell of a round, buckets are sums of cells, and only rows in cells still too large go on to the next.
Rows of one key can't be split by bits; they go to overflow pages of the limit's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch, own_name

#: Bits of hash in all, and those that a round decides.
WIDTH = 60
BITS = 12
MAX_BYTES = 16 << 20


def hash_of(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; a null key hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), 1, WIDTH // 4), 16, 10).cast("long")


def _top(h: str, bits) -> Column:
    return F.expr(f"shiftright({h}, {WIDTH - bits})") if isinstance(bits, int) else F.expr(f"shiftright({h}, cast({WIDTH} - {bits} as int))")


def directory(rows: DataFrame, scratch: Scratch, max_bytes: int) -> list[tuple[int, DataFrame]]:
    """For each round its bits so far and (cell, depth): the depth of the cell's bucket, null where it must go on.

    ``rows`` has h and n_bytes. Each table is an aggregate of at most 2**BITS cells for every cell of the round before
    that was too large; there are no more of those than the bytes divided by the limit.
    """
    out: list[tuple[int, DataFrame]] = []
    left, done = rows.select("h", "n_bytes"), 0
    while done < WIDTH:
        bits = min(done + BITS, WIDTH)
        cells = scratch.put(left.groupBy(_top("h", bits).alias("cell")).agg(F.sum("n_bytes").alias("bytes")), f"cells{bits}")
        ups = cells.withColumn("depth", F.explode(F.sequence(F.lit(done + (done > 0)), F.lit(bits)))).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        sums = ups.groupBy("depth", "prefix").agg(F.sum("bytes").alias("sum"))
        fits = ups.join(sums, ["depth", "prefix"]).where(F.col("sum") <= max_bytes).groupBy("cell").agg(F.min("depth").alias("depth"))
        found = scratch.put(cells.select("cell").join(fits, "cell", "left"), f"directory{bits}")
        out.append((bits, found))
        over = found.where("depth is null").select("cell")
        if over.isEmpty():
            break
        left, done = left.join(over, _top("h", bits) == F.col("cell"), "left_semi"), bits
    return out


def shard(docs: DataFrame, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (default: all) with shard_bytes (the row's bytes), shard_depth, shard_prefix and shard_page.

    A shard is named by depth, prefix (its leading bits as a number) and page. No shard has more than ``max_bytes``
    bytes of text, but for a single row that is larger: it has a page of its own or shares it with rows of no bytes.
    Pages are 0 but for rows of one hash that exceed the limit together; their pages are filled within each input
    partition. A null text has 0 bytes. Repeated rows share a shard unless they overflow it. An empty table gives no
    rows. Columns whose names clash with the new ones are replaced.
    """
    new = ["shard_bytes", "shard_depth", "shard_prefix", "shard_page"]
    own = [c for c in (docs.columns if keep is None else keep) if c not in new]
    scratch = Scratch(docs.sparkSession, "sharding")
    h, n, d, cell, depth, task, before, paged = (own_name(c, docs) for c in ("hash", "bytes", "depth", "cell", "to_depth", "task", "before", "page"))
    hashed, size = hash_of(F.col(id_col)), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    rows = docs.select(*[F.col(c) for c in own], hashed.alias(h), size.alias(n))
    rounds = directory(docs.select(hashed.alias("h"), size.alias("n_bytes")), scratch, max_bytes)
    got = rows.withColumn(d, F.lit(None).cast("int"))
    for bits, found in rounds:
        side = found.where("depth is not null").select(F.col("cell").alias(cell), F.col("depth").alias(depth))
        if bits == BITS:
            side = F.broadcast(side)  # 2**BITS rows at most
        got = got.join(side, _top(h, bits) == F.col(cell), "left").withColumn(d, F.coalesce(d, depth)).drop(cell, depth)
    page = F.lit(0).cast("long")
    if rounds[-1][0] == WIDTH:  # some key alone exceeds the limit
        got = got.withColumn(task, F.when(F.col(d).isNull(), F.spark_partition_id()))
        run = Window.partitionBy(h, task).orderBy(F.desc(n)).rowsBetween(Window.unboundedPreceding, -1)
        over = got.where(F.col(d).isNull()).withColumn(before, F.coalesce(F.sum(n).over(run), F.lit(0)))
        # half-full pages: a row starts within the first half of its page, larger rows have pages of their own
        half = max(1, max_bytes // 2)
        at = F.floor(F.col(before) / half).cast("long")
        over = over.withColumn(paged, F.shiftleft(F.col(task).cast("long"), 32) + at + 1).drop(before)
        got = got.where(F.col(d).isNotNull()).withColumn(paged, page).unionByName(over).withColumn(d, F.coalesce(d, F.lit(WIDTH)))
        page = F.col(paged)
    return got.select(*own, F.col(n).alias("shard_bytes"), F.col(d).alias("shard_depth"), _top(h, d).alias("shard_prefix"), page.alias("shard_page"))


def write_shards(docs: DataFrame, path: str, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``docs`` as Parquet with a folder for each shard; each shard is written by one task, so that it has one file.

    All rows are written, repeated ones and those with null ids or texts among them. Columns named like those that shard() adds are
    replaced by these and not written; a column ``shard`` is the folder's name. An empty table writes no shard.
    """
    placed = shard(docs, max_bytes, id_col, text_col).withColumn("shard", F.concat_ws("-", "shard_depth", "shard_prefix", "shard_page"))
    placed.repartition("shard").drop("shard_bytes", "shard_depth", "shard_prefix", "shard_page").write.mode("overwrite").partitionBy("shard").parquet(path)
