"""Token counts through a digest cache.

Texts are known by the SHA-256 of their content, tokenizers by that of their file. Counts are looked up in a stored
table by both; only distinct texts without a stored count are encoded, and their counts are appended to the table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, exists

CACHE = "version string, digest binary, n_tokens long"
#: What goes to the tokenizers library itself: anything but printable ASCII, its usual white space and Latin letters.
_IRREGULAR = re.compile("[^\n\r\t !-~À-ÖØ-öø-ɏ]")
#: Texts of this length are looked through for a run of white space of this length: there the fast pattern gives up.
_RUN = 10_000
_BLANK = re.compile(r"(?<!\s)\s{%d}" % _RUN)
_SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def version_of(model_path: str) -> str:
    with open(model_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column) -> Column:
    """Content as the digest sees it: null is empty. White space and case stay, as they change counts."""
    return F.coalesce(text.cast("string"), F.lit(""))


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE as ranks, if each merge makes the next id; else none."""
    model, added = spec["model"], {t["content"] for t in spec.get("added_tokens", [])}
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or model["type"] != "BPE":
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(char[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(x + y) for x, y in pairs]
    return ranks if made == sorted(made) and len(ranks) == 256 + len(set(made)) else None


class Counter:
    """Counts tokens as the tokenizers library does.

    Texts of ASCII and Latin letters in a byte-level vocabulary are counted by tiktoken over the same vocabulary, six
    times as fast and with equal results; all others, texts that hold an added token or very long runs of white space
    among them, by the library, as is any text that tiktoken gives up on.
    """

    def __init__(self, model_path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(model_path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(model_path) as f:
            spec = json.load(f)
        self.fast, ranks = None, _ranks(spec)
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("|".join([_IRREGULAR.pattern, *(re.escape(t["content"]) for t in spec.get("added_tokens", []))]))

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.lib.encode_batch(texts, add_special_tokens=False)] if texts else []

    def many(self, texts: list[str]) -> list[int]:
        if self.fast is None:
            return self.whole(texts)
        return [self.one(t) for t in texts]

    def one(self, text: str) -> int:
        if self.odd.search(text) or len(text) >= _RUN and _BLANK.search(text):
            return self.whole([text])[0]
        try:
            return len(self.fast.encode_ordinary(text))
        except BaseException as e:  # its panics are no Exception
            if type(e).__name__ != "PanicException":
                raise
            return self.whole([text])[0]


_COUNTERS: dict[str, Counter] = {}


def _encoder(model_path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _COUNTERS:
            _COUNTERS[model_path] = Counter(model_path)
        counter = _COUNTERS[model_path]
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n = counter.many(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), part.column(0), pa.array(n, pa.int64())], ["version", "digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``cache_path`` names the stored counts, a Parquet folder in shared storage; without one a folder of this call
    alone is used. A null text counts as empty: 0 bytes, 0 tokens. Repeated texts are encoded once, also when one text
    fills a third of the table. Repeated rows and ids each get their row. A cache that two jobs have appended to at
    once may hold a count twice; it is read once. Other columns are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cache_path = cache_path or Scratch(spark, "token-counts").path("cache")
    version = version_of(model_path)
    text = normalised(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))

    def stored() -> DataFrame | None:
        if not exists(spark, cache_path):
            return None
        return spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    known, missing = stored(), base.select("digest", "text")
    if known is not None:
        missing = missing.join(known, "digest", "left_anti")
    missing.dropDuplicates(["digest"]).mapInArrow(_encoder(model_path, version), CACHE).write.mode("append").parquet(cache_path)
    # written without its aggregate, so that the join's shuffles are its own and a text that fills a third of the table is split
    counts = Scratch(spark, "token-counts").put(stored(), "counts")
    return (
        base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
        .join(counts, "digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
