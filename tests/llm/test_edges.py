"""Cases at the edges of each operator: hostile inputs, rows that share ids, columns with the operators' own names, limits that bind."""

import collections
import hashlib
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import html_extract, line_dedup, mixing, near_copies, quality_clf, quality_rules, sharding, simhash, token_counts, topk
from quillgraph.llm._common import Scratch, tokenizer_file

# token counts ----------------------------------------------------------------------------------------------------------


def test_long_white_space_is_counted_as_the_library_does(spark):
    texts = [" " * 1_000_000, "\n" * 1_000_000, " \n\t" * 400_000, "a" + " " * 5_000_000 + "b", "x " + "\t" * 1_000_000, "word\n" * 1000, " " * 9_999 + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    path = tokenizer_file("byte_bpe_50k.json")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert got == dict(enumerate(token_counts.Counter(path).whole(texts)))


def test_what_the_fast_counter_gives_up_on_goes_to_the_library(monkeypatch):
    counter = token_counts.Counter(tokenizer_file("byte_bpe_50k.json"))
    monkeypatch.setattr(token_counts, "_RUN", 10**9)
    assert counter.one(" " * 1_000_000) == counter.whole([" " * 1_000_000])[0]


# HTML ------------------------------------------------------------------------------------------------------------------

HOSTILE = {
    "open tags": "<a " * 300_000,
    "stray ends": "<div>" * 90_000 + "</p>" * 90_000,
    "list items in spans": "<ul>" + "<span>" * 50_000 + "<li>" * 50_000,
    "open quotes": '<a "' * 250_000 + '>"',
    "quoted ends": "<a x='>'" * 120_000,
    "long attribute": "<div " + "x" * 1_000_000 + ">t</div>",
    "blank attribute": "<div " + " " * 1_000_000 + "hidden>t",
    "attributes without values": "<div " + "x= " * 300_000 + ">t",
    "a number without end": "<p>&#" + "9" * 1_000_000 + ";",
    "open comments": "<!--" * 250_000,
    "crossed": "<b><div>" * 50_000 + "</b>" * 100_000,
    "open script": "<script>" + "</script " * 100_000,
    "signs": "<" * 1_000_000,
    "class names": "<div class='" + "sponsor_" * 120_000 + "!'>t",
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_seconds(kind):
    began = time.process_time()
    root = html_extract.parse(HOSTILE[kind])
    html_extract.subtrees(root)
    html_extract.marked(root)
    html_extract.blocks(root, frozenset())
    assert time.process_time() - began < 20


def test_recurrence_decides_about_marked_and_unmarked(spark):
    def page(i: int) -> str:
        once = '<p class="alert">Alert level of number 7 is part of its text</p>' * (i == 7)
        note = f'<div class="notice-{i * 7919:x}" id="ad-{i * 104729:x}">Notice {i} of its own words</div>'
        return f"<article><h1>Title {i}</h1><p>A text about number {i}</p>{once}{note}<p>Said under every article</p><div class='comments'>Reader {i}</div></article><aside>See {i}</aside>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(30)] + [(100 + i, f"http://few.example/{i}", page(7 + i)) for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\n\nA text about number 3"
    assert got[7] == "Title 7\n\nA text about number 7\n\nAlert level of number 7 is part of its text"
    assert got[100] == "Title 7\n\nA text about number 7\n\nSaid under every article"  # too few pages to count: marks decide


def test_counts_of_subtrees_and_marks_by_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(9)]
    rows = []
    for i in range(200):
        parts = [f"<p>Own words of page {i} {i * 7} {i * 13}</p>"] + [f"<{t} class='{c}'><i>{rng.choice(words)}</i></{t}>" for t, c in ((rng.choice(("div", "p")), rng.choice(("x", "notice", "share", "y"))) for _ in range(4))]
        rows.append((i, f"http://{'ab'[i % 2]}.example/", "".join(parts)))
    rows += rows[:20]
    scratch = Scratch(spark, "test-html")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = {r["host"]: set(r["keys"]) for r in html_extract.templates(pages, scratch).collect()}
    want: dict = {}
    for host in "ab":
        n, seen, pages_of = collections.Counter(), collections.Counter(), {h for _, u, h in rows if u[7] == host}
        for h in pages_of:
            root = html_extract.parse(h)
            n.update({k for k, _, _ in html_extract.subtrees(root)})
            seen.update(html_extract.marked(root))
        want[f"{host}.example"] = {k for k, c in n.items() if c >= 10 and c >= len(pages_of) ** 0.5} | {k for k, c in seen.items() if c >= 2}
    assert found == want


def test_pages_without_marks_or_templates_keep_all(spark):
    rows = [(i, f"http://h.example/{i}", f"<p>Page {i} has words {i * 3} of its own only</p>") for i in range(15)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == sorted(f"Page {i} has words {i * 3} of its own only" for i in range(15))
    assert np.all([r.n_chars == len(r.text) for r in got])


# columns named as the operators might name theirs ------------------------------------------------------------------------

OWN = ["keep", "of", "digest", "__digest", "__keep", "copies", "words", "of_id", "of_source", "of_size", "__copy", "__n", "__id", "score", "__score", "hash", "bytes", "depth", "cell", "to_depth", "task", "before", "page", "__h", "__d", "doc", "of_text", "text_hash", "gone", "lines", "__doc", "__gone", "__lines", "id"]


def crowded(spark, rows, parts=3):
    """Rows (doc_id, text[, lang, source]) between columns of all those names, with values that would show if they were taken for others."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) + tuple(f"{c}!" for c in OWN) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in OWN)
    return spark.createDataFrame(full, schema).repartition(parts)


def plain(df):
    """Rows as tuples of the five columns of documents; all others have to be as they were."""
    rows = df.collect()
    assert all(r[c] == f"{c}!" for r in rows for c in OWN if c in df.columns)
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows), key=str)


def messy_rows(seed=1):
    """Prose, junk, copies and near copies, shared lines, nulls in every column, repeated rows and shared ids."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = "\n".join(prose(12) for _ in range(4))
    rows = [(i, prose(rng.randint(20, 120)) + ("\n" + shared if i % 4 == 0 else "") + "\n" + prose(30), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None])) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "b") for i in range(5)]  # exact copies
    for i in range(5, 10):  # near copies: a word of a hundred
        w = rows[i][1].split(" ")
        w[3] = "edited"
        rows.append((100 + i, " ".join(w), "en", "a"))
    rows += [rows[11], rows[11], (None, prose(40), "en", "a"), (None, prose(40), None, None), (7, prose(50), "en", "b"), (200, None, None, None), (201, "", "en", "a"), (202, " \n\t ", "de", "b"), (203, "#### $$$$ " * 40, "en", "b"), (204, "#### $$$$ " * 40, "en", "b")]
    return rows


def test_all_columns_pass_whatever_their_names(spark):
    docs = crowded(spark, messy_rows())
    before = plain(docs)
    shards = sharding.shard(docs, max_bytes=500)
    assert plain(shards) == before and set(shards.columns) == {*docs.columns, "shard_bytes", "shard_depth", "shard_prefix", "shard_page"}
    one_key = sharding.shard(docs.withColumn("doc_id", F.lit(5).cast("long")), max_bytes=500)
    assert one_key.count() == len(before) and one_key.where("shard_page = 0").count() == 0
    assert len(plain(line_dedup.dedup_lines(docs))) == len(before)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    good = quality_clf.keep_good(docs, labels)
    assert good.columns == docs.columns and plain(good)
    assert {r["doc_id"] for r in quality_clf.classify(docs, labels).collect()} == {r[0] for r in before}
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and set(plain(mixed)) <= set(before)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and set(plain(kept)) <= set(before)
    assert len(quality_rules.judge(docs).collect()) == len(before)
    assert len(token_counts.count_tokens(docs, tokenizer_file("byte_bpe_50k.json")).collect()) == len(before)


def test_rows_that_differ_in_source_alone_are_mixed_by_their_own(spark):
    rows = [(i % 10, "w " * (20 + i % 3), "en", "a") for i in range(40)] + [(i % 10, "w " * (20 + i % 3), "en", None) for i in range(40)] + [(i, "w " * 30, "en", "b") for i in range(100, 140)]
    docs = crowded(spark, rows)
    copies = {(r.doc_id, r.source, r["size"]): r.copies for r in mixing.mix(docs).collect()}
    got = collections.Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.apply_mix(docs).collect())
    there = collections.Counter((d, s, len(t.split())) for d, t, _, s in rows)
    assert got == {k: n * copies[k] for k, n in there.items() if copies[k]}
    assert mixing.apply_mix(docs.limit(0)).count() == 0


# line dedup ----------------------------------------------------------------------------------------------------------


def test_windows_are_known_by_two_hashes(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "a\nb\nc\nx")], "doc_id long, text string")
    rows = line_dedup.windows(docs).collect()
    assert len({(r.w, r.v) for r in rows}) == 3 and len({r.v for r in rows}) == 3 and not {r.w for r in rows} & {r.v for r in rows}


# quality classifier -----------------------------------------------------------------------------------------------------


def test_updates_are_those_of_ftrl_by_definition():
    rng = random.Random(2)
    rows = [({k: rng.random() for k in rng.sample(range(30), 6)}, rng.randint(0, 1)) for _ in range(60)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.01
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        if k == "bias":
            return -z[k] / ((beta + math.sqrt(n[k])) / alpha)
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for x, y in rows:
        x = {**x, "bias": 1.0}
        w = {k: weight(k) for k in x}
        p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
        for k, v in x.items():
            g = (p - y) * v
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
            n[k] += g * g
    model = quality_clf.Ftrl(5, alpha, beta, l1, l2)
    for x, y in rows:
        model.learn(np.array(list(x)), np.array(list(x.values())), y)
    assert np.allclose(model.weights(slice(0, 30)), [weight(k) for k in range(30)]) and np.isclose(model.bias(), weight("bias"))


# quality rules ----------------------------------------------------------------------------------------------------------


def test_verdicts_by_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", ","]) for _ in range(rng.randint(60, 200))), rng.choice(["en", "de"]), "s") for i in range(400)]
    rows += [(1000 + i, " ".join(w + rng.choice(["##", "*", "%", "&&", ""]) * (i % 5) for w in rng.sample(words, 90)), "en", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    x = {r.doc_id: (r.lang, np.array([r[f"x{k}"] for k in range(5)])) for r in quality_rules.base(docs).collect() if not r.base_failed}
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for lang in ("en", "de"):
        ids = sorted(d for d, (at, _) in x.items() if at == lang)
        m = np.array([x[d][1] for d in ids])
        ridge, best = np.diag(np.square(quality_rules.FLOORS)), None
        z = (m - np.median(m, 0)) / np.maximum(1.4826 * np.median(np.abs(m - np.median(m, 0)), 0), quality_rules.FLOORS)
        for d in ((z * z).sum(1), np.abs(z).max(1)):
            for _ in range(quality_rules.STEPS + 1):
                core = m[np.argsort(d)[: int(np.ceil(0.75 * len(m)))]]
                mean, cov = core.mean(0), np.cov(core.T, bias=True) + ridge
                d = np.einsum("ij,jk,ik->i", m - mean, np.linalg.inv(cov), m - mean)
            if best is None or np.linalg.slogdet(cov)[1] < best[0]:
                best = (np.linalg.slogdet(cov)[1], d)
        want = best[1] * quality_rules._MEDIAN / np.median(best[1])
        have = np.array([got[d].distance for d in ids])
        assert np.all(np.abs(np.log((have + 1) / (want + 1))) < 0.35)  # bins stand for order statistics
        clear = np.abs(np.log(want / quality_rules.CUTOFF)) > 0.35
        assert [got[d].kept for d, c in zip(ids, clear, strict=True) if c] == (want[clear] <= quality_rules.CUTOFF).tolist()


# top-k ------------------------------------------------------------------------------------------------------------------


def test_few_pairs_are_resolved():
    rng = np.random.default_rng(4)
    q, c = np.floor(rng.normal(size=(20, 64)) * 100), np.floor(rng.normal(size=(5000, 64)) * 100)
    cut, other = topk._bounds(64, 4), np.ones((20, 5000), bool)
    r, x = topk.list_heads(q, c, other, cut, 10)
    assert len(r) <= 20 * 4 * 10  # the heads of each query's lists
    total = topk.resolve(q, c, r, x)
    assert np.array_equal(total, (q @ c.T)[r, x])
    cutoff = np.array([np.sort(total[r == i])[-10] for i in range(20)], float)
    assert all(np.sort((q @ c.T)[i])[-10] >= cutoff[i] for i in range(20))  # it is safe
    r, x = topk.sufficient(q, c, other, cut, cutoff)
    assert len(r) < 0.5 * other.size  # the others' totals are never made
    best = np.argsort(-(q @ c.T), axis=1)[:, :10]
    assert {(i, j) for i in range(20) for j in best[i]} <= set(zip(r.tolist(), x.tolist(), strict=True))


def test_very_large_and_empty_vectors_take_part(spark):
    rows = [(0, [1e306, -1e306]), (100, [1e300, 0.0]), (1, [1e300, 1e300]), (2, [5e-324, 1.0]), (3, [-1e308, 1.0]), (200, []), (4, []), (5, [1.0, None])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(t, t.where("vec_id % 100 = 0"), k=3).collect()))
    most = float(np.finfo(np.float64).max)
    v = {i: [int(max(-most, min(most, float(np.floor(x * 1024)))) if abs(x) < 1e300 else max(-most, min(most, x * 1024))) for x in e] for i, e in rows if None not in e}
    want = []
    for q in (0, 100, 200):
        s = sorted((-min(max(sum(a * b for a, b in zip(v[q], w, strict=True)), -(2**63)), 2**63 - 1), i) for i, w in v.items() if i != q and len(w) == len(v[q]))[:3]
        want += [(q, k + 1, i, -t_) for k, (t_, i) in enumerate(s)]
    assert got == sorted(want)


# the pipeline ----------------------------------------------------------------------------------------------------------


def test_each_stage_of_the_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece

    rows = messy_rows(3)
    docs = crowded(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    junk = {203, 204}
    spark.createDataFrame([(i, 0 if i in junk else 1) for i in [*range(60), 203, 204]], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, scratch = spark.read.parquet(f"{tmp_path}/documents.parquet"), Scratch(spark, "test-pipeline")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = plain(docs)
        docs = scratch.put(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        seen[name] = (before, docs)
    # quality classifier: dot products of whole vectors
    before, after = seen["quality classifier"]
    w, bias = quality_clf.fit(crowded(spark, before), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = lambda t: 1 / (1 + math.exp(-(sum(w[i] * v for i, v in zip(*quality_clf.vector((t or "").encode()), strict=True)) + bias))) >= quality_clf.THRESHOLD
    assert plain(after) == [r for r in before if good(r[1])]
    # line dedup: windows in order of id and place
    before, after = seen["line dedup"]
    first, gone = {}, collections.defaultdict(set)
    spans = [((r[0] is not None, r[0] or 0, full[k][0]), k_row, full[k][0], full[k + 2][0], tuple(x for _, x in full[k : k + 3])) for k_row, r in enumerate(before) for full in [[(i, x.strip(" ")) for i, x in enumerate((r[1] or "").split("\n")) if x.strip(" ")]] for k in range(len(full) - 2)]
    for at, _, _, _, win in spans:
        first[win] = min(first.get(win, at), at)
    for at, k, s, e, win in spans:
        if at != first[win]:
            gone[k].update(range(s, e + 1))
    cut = lambda k, t: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k])
    want = [(*r[:1], cut(k, r[1]), *r[2:4], len(cut(k, r[1]))) if gone[k] else r for k, r in enumerate(before)]
    assert any(gone.values()) and plain(after) == sorted(want, key=str)
    # near copies: components of all pairs
    before, after = seen["SimHash near-dedup"]
    sets = [set(near_copies.shingles((r[1] or "").encode()).tolist()) for r in before]
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(before)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, r in enumerate(before):
        k = (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())
        best[find(i)] = min(best.get(find(i), (k, r[:2])), (k, r[:2]))
    assert len(best) < len(before) and sorted((r[:2] for r in plain(after)), key=str) == sorted((r for _, r in best.values()), key=str)
    # mixing: each row as often as the mix takes it
    before, after = seen["mixing to target weights"]
    copies = {(r.doc_id, r.source, r["size"]): r.copies for r in mixing.mix(crowded(spark, before)).collect()}
    assert plain(after) == sorted((r for r in before for _ in range(copies[r[0], r[3], len((r[1] or "").split())])), key=str)
    # encoding: the library's ids
    before, after = seen["SentencePiece encoding"]
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    ids = [lib.encode(r[1] or "", add_bos=True, add_eos=True) for r in before]
    want = [(r[0], len(x), x, hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(x).encode()).hexdigest()) for r, x in zip(before, ids, strict=True)]
    assert sorted(((r.doc_id, r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) for r in after.collect()), key=str) == sorted(want, key=str)
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((tuple(r) for r in ran.collect()), key=str) == sorted((tuple(r) for r in after.collect()), key=str)


def test_the_pipeline_runs_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    crowded(spark, messy_rows()).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# shared folders -----------------------------------------------------------------------------------------------------------


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from quillgraph.llm._common import shared_root

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
