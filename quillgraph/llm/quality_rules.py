"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Documents that pass the base rules have a vector of transformed statistics. For each language and source the minimum
covariance determinant gives a centre and scatter: from several starts, concentration steps keep the share COVERAGE
of the documents nearest by Mahalanobis distance and re-estimate from those, and the start with the least determinant
counts. Documents far from the centre of their group are rejected.

All steps are aggregates by group: medians and cuts come from counts over fine fixed bins, means and scatter from sums over
the bins of distance up to the cut, so that no group is ever gathered, results don't depend on order, and rows never leave the JVM. Rows carry a salt, and what is known of a group is
laid out over the salts where rows are joined with it, so that a large group's rows are spread over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import SPACE, Scratch

STATS = ("length", "symbols", "capitals", "marks", "variety")
#: What each standard deviation is at least: rates of almost zero have no scatter of their own.
FLOORS = (0.05, 0.02, 0.02, 0.02, 0.03)
COVERAGE = 0.75
STEPS = 5
#: Groups with fewer documents take the estimate of their language, then that of all.
MIN_GROUP = 100
#: Squared distance, scaled so that its median is that of the chi-squared distribution, beyond which a document goes. Far
#: above that distribution's own tail, since short texts scatter: of labelled rows all bad ones lie beyond, 0.5 % of the good.
CUTOFF = 200.0
_MEDIAN = 4.351460191095526  # of chi-squared with 5 degrees
_BIN = 512
_LOG_BIN = 64
MIN_WORDS = 10
#: Into how many parts the rows of each group are dealt for joins.
SALTS = 32
_D = len(STATS)


def _salted(side: DataFrame) -> DataFrame:
    return side.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _without(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(h: str) -> Column:
    """Words in windows of five that occur twice, from the words' hashes."""
    idx = F.sequence(F.lit(0), F.size(h) - 5)
    return F.transform(idx, lambda i: F.xxhash64(*[F.get(F.col(h), i + k) for k in range(5)]))


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The base columns and the vector of statistics for every row; null where a text has no words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("t"))
    d = d.withColumn("w", F.array_remove(F.split("t", SPACE), "")).withColumn("l", F.split("t", "\n"))
    d = d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("l", F.filter("l", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("g", F.when(F.size("h") >= 5, _repeat_words("h")))
    d = d.withColumn("dup", F.when(F.size("g") > F.size(F.array_distinct("g")), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("dup", k)["h"] == x["h"], F.lit(False))
    d = d.withColumn("dup", F.when(F.col("dup").isNotNull(), F.filter("dup", lambda x, k: same(x, k - 1) | same(x, k + 1))))
    cover = F.size(F.array_distinct(F.flatten(F.transform("dup", lambda x: F.sequence(x["i"], x["i"] + 4)))))
    n = F.size("w").cast("long")
    d = d.select(
        "doc_id", "lang", "source",
        n.alias("n_words"),
        F.char_length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _without(F.col("t"), "#*$%&|<>").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("dup").isNull(), F.lit(0)).otherwise(cover).cast("long").alias("n_repeat_words"),
        _without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("capitals"),
        _without(F.col("t"), ".,;:!?").alias("marks"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    chars = F.greatest("word_chars", F.lit(1))
    x = (
        F.log((F.col("word_chars") + 5.0) / (F.col("n_words") + 1.0)),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("capitals") / chars),
        F.sqrt(F.col("marks") / chars),
        F.log(F.col("n_distinct") + 1.0) / F.log(F.col("n_words") + 2.0),
    )
    return d.withColumn("base_failed", failed).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *[F.when(~failed, v).alias(f"x{i}") for i, v in enumerate(x)]
    )


def _groups(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, g, feeds): the group whose estimate a document takes, as a number, and all groups whose estimate it is part of.

    A language's estimate is made of all its documents, and the overall one of all there are, if small groups take it.
    """
    n = rows.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = Window.partitionBy("lang")  # over one row for each source
    own = F.xxhash64(F.lit(2), F.col("lang"), F.col("lang").isNull(), F.col("source"), F.col("source").isNull())
    level = F.xxhash64(F.lit(1), F.col("lang"), F.col("lang").isNull())
    large, known = F.col("n") >= MIN_GROUP, F.sum("n").over(by_lang) >= MIN_GROUP
    n = n.select("lang", "source", F.when(large, own).when(known, level).otherwise(F.lit(0)).alias("g"), F.when(known & (F.min("n").over(by_lang) < MIN_GROUP), level).alias("level"))
    n = scratch.put(n, "levels")
    whole = F.lit(None if n.where("g = 0").isEmpty() else 0).cast("long")
    return scratch.put(n.select("lang", "source", "g", F.array_distinct(F.array_compact(F.array("g", "level", whole))).alias("feeds")), "groups")


def _quantile(counts: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """(keys, name): the first bin at which ``share`` of the counts are reached, from (keys, bin, n)."""
    up = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    at = counts.withColumn("c", F.sum("n").over(up)).withColumn("t", F.sum("n").over(whole)).where(F.col("c") >= F.col("t") * share)
    return at.groupBy(*keys).agg(F.min("bin").alias(name))


def _moments(near: DataFrame) -> DataFrame:
    """(g, s, bin, n, t.., q..): for each bin of distances how many there are and the sums of the statistics and of their products."""
    sums = [F.sum(f"x{i}").alias(f"t{i}") for i in range(_D)]
    return near.groupBy("g", "s", "bin").agg(F.count("*").alias("n"), *sums, *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(_D) for j in range(i + 1)])


def _params(bins: DataFrame) -> DataFrame:
    """(g, s, m0.., k00.., logdet): the means and the inverse of the scatter's Cholesky factor of the share COVERAGE in the first bins.

    ``bins`` are moments, a few hundred rows for each group and start; so a concentration step is one aggregate of the rows.
    """
    whole = Window.partitionBy("g", "s")
    up = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    core = bins.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))).withColumn("all", F.sum("n").over(whole)).where(F.col("before") < F.col("all") * COVERAGE)
    sums = [F.sum(c).alias(c) for c in ("n", *(f"t{i}" for i in range(_D)), *(f"q{i}{j}" for i in range(_D) for j in range(i + 1)))]
    p = core.groupBy("g", "s").agg(*sums).select("g", "s", "n", *[(F.col(f"t{i}") / F.col("n")).alias(f"m{i}") for i in range(_D)], *[f"q{i}{j}" for i in range(_D) for j in range(i + 1)])
    p = p.select("g", "s", *[f"m{i}" for i in range(_D)], *[(F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i in range(_D) for j in range(i + 1)])
    for i in range(_D):  # Cholesky: a row of L after the other
        for j in range(i):
            s = F.col(f"c{i}{j}")
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            p = p.withColumn(f"l{i}{j}", s / F.col(f"l{j}{j}"))
        s = F.col(f"c{i}{i}") + F.lit(FLOORS[i] ** 2)
        for k in range(i):
            s = s - F.col(f"l{i}{k}") * F.col(f"l{i}{k}")
        p = p.withColumn(f"l{i}{i}", F.sqrt(F.greatest(s, F.lit(1e-9))))
    for j in range(_D):  # its inverse, column by column
        p = p.withColumn(f"k{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, _D):
            s = F.lit(0.0)
            for k in range(j, i):
                s = s - F.col(f"l{i}{k}") * F.col(f"k{k}{j}")
            p = p.withColumn(f"k{i}{j}", s / F.col(f"l{i}{i}"))
    logdet = sum((F.log(f"l{i}{i}") for i in range(1, _D)), F.log("l00"))
    return p.select("g", "s", *[f"m{i}" for i in range(_D)], *[f"k{i}{j}" for i in range(_D) for j in range(i + 1)], logdet.alias("logdet"))


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(_D):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"k{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        total = total + y * y
    return total


def _log_bin(d: Column) -> Column:
    return F.floor(F.log(d + 1e-6) * _LOG_BIN).cast("int")


def estimates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, m.., k.., scale): for each group its centre, inverse factor and the scale of distances. ``rows`` has g and x."""
    x = [f"x{i}" for i in range(_D)]
    rows = rows if "z" in rows.columns else rows.withColumn("z", F.lit(0))
    long = rows.select("g", "z", F.posexplode(F.array(*x)).alias("i", "x"))
    med = _quantile(long.groupBy("g", "i", F.floor(F.col("x") * _BIN).cast("int").alias("bin")).agg(F.count("*").alias("n")), ["g", "i"], 0.5, "mid")
    med = scratch.put(med.withColumn("mid", (F.col("mid") + 0.5) / _BIN), "medians")
    off = long.join(_salted(med), ["g", "i", "z"]).groupBy("g", "i", F.floor(F.abs(F.col("x") - F.col("mid")) * _BIN).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    mad = _quantile(off, ["g", "i"], 0.5, "mad").withColumn("mad", 1.4826 * (F.col("mad") + 0.5) / _BIN)
    one = med.join(mad, ["g", "i"]).groupBy("g")
    start = one.agg(*[F.max(F.when(F.col("i") == i, F.col("mid"))).alias(f"m{i}") for i in range(_D)], *[F.max(F.when(F.col("i") == i, F.greatest("mad", F.lit(FLOORS[i])))).alias(f"a{i}") for i in range(_D)])
    start = scratch.put(start, "start")
    z = [F.abs(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"a{i}") for i in range(_D)]
    # two starts: nearest to the medians by the sum of squares, and by the largest deviation
    near = rows.join(_salted(start), ["g", "z"]).select("g", "z", *x, F.explode(F.array(F.struct(F.lit(0).alias("s"), sum((v * v for v in z[1:]), z[0] * z[0]).alias("d")), F.struct(F.lit(1).alias("s"), (F.greatest(*z) * F.greatest(*z)).alias("d")))).alias("e"))
    near = near.select("g", "z", *x, "e.s", "e.d").withColumn("bin", _log_bin(F.col("d")))
    params = None
    for step in range(STEPS + 1):
        params = scratch.put(_params(_moments(near)), f"params{step}")
        near = rows.join(_salted(params), ["g", "z"]).withColumn("d", _distance()).select("g", "z", "s", *x, "d").withColumn("bin", _log_bin(F.col("d")))
    best = params.groupBy("g").agg(F.min_by(F.struct(*[c for c in params.columns if c != "g"]), F.struct("logdet", "s")).alias("b")).select("g", "b.*").drop("logdet")
    counts = near.join(_salted(best.select("g", "s")), ["g", "s", "z"]).groupBy("g", "bin").agg(F.count("*").alias("n"))
    mid = _quantile(counts, ["g"], 0.5, "mid").select("g", (F.lit(_MEDIAN) / F.exp((F.col("mid") + 0.5) / _LOG_BIN)).alias("scale"))
    return scratch.put(best.drop("s").join(mid, "g"), "estimates")


def judge(docs: DataFrame, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) for every row.

    A null text has no words and fails the base rules. A null language or source is a value of its own. Groups of fewer
    than MIN_GROUP documents take their language's estimate, and languages of fewer that of all such together; those of
    a group that no document of its own has passed are not asked. Repeated rows count as often as they come and get
    equal results. ``distance`` is the squared Mahalanobis distance, null where the base rules fail. An empty table
    gives no rows. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    # the salt is a row's place in its task, stored with the row: even where ids and texts are all the same
    rows = scratch.put(base(docs, id_col, text_col, lang_col, source_col).withColumn("z", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "base")
    groups = _groups(rows, scratch)
    same = F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("z") == F.col("__z"))
    named = _salted(groups).select(F.col("lang").alias("__l"), F.col("source").alias("__s"), F.col("z").alias("__z"), "g", "feeds")
    grouped = rows.join(named, same, "left").drop("__l", "__s", "__z")
    passed = grouped.where("not base_failed").select(F.explode("feeds").alias("g"), "z", *[f"x{i}" for i in range(_D)])
    found = estimates(passed, scratch)
    got = grouped.join(_salted(found), ["g", "z"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance() * F.col("scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
