"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from quillgraph.llm import html_extract, line_dedup, mixing, near_copies, quality_clf, quality_rules, sharding, simhash, sp_codec, token_counts, topk
from quillgraph.llm._common import Scratch, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, score double, h long, n_removed long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, parts=3):
    """Rows (doc_id, text[, lang, source]) with columns whose names operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", 1, 2, 3, 4.0, 5, 6) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def odd_rows(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Élan", "x#", "día", "THE!!", "日本", "a|b", "<|endoftext|>", "I'll"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))), "en", f"s{i % 3}") for i in range(n)]
    rows += [(100, None), (101, ""), (102, "   \n\t "), (103, "one"), (104, "word " * 50_000), (None, "no id here"), (105, "same text twice"), (105, "same text twice"), (106, "same text twice"), (107, "x", None, None), (107, "other text", None, None)]
    return rows


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# sharding ------------------------------------------------------------------------------------------------------------


def test_shards_fit_and_only_large_ones_split(spark):
    docs = frame(spark, [(i, "x" * (i % 50 + 1)) for i in range(500)] + [(None, "null id"), (7, None), (9, "")])
    got = sharding.shard(docs, max_bytes=700).collect()
    assert len(got) == 503
    size = {}
    for r in got:
        assert r.shard_page == 0
        h = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16)
        assert r.shard_prefix == h >> (60 - r.shard_depth)
        key = (r.shard_depth, r.shard_prefix)
        size[key] = size.get(key, 0) + len((r.text or "").encode())
    assert all(v <= 700 for v in size.values())
    for d, p in size:  # no shard but the root could have been its parent
        sibling = sum(v for (e, q), v in size.items() if e >= d and q >> (e - d) == p ^ 1)
        assert d == 0 or size[d, p] + sibling > 700


def test_one_key_overflows_into_pages(spark):
    docs = frame(spark, [(1, "y" * 100)] * 300 + [(i, "z") for i in range(2, 50)])
    got = sharding.shard(docs, max_bytes=1000).collect()
    assert len(got) == 348
    size = {}
    for r in got:
        key = (r.shard_depth, r.shard_prefix, r.shard_page)
        size[key] = size.get(key, 0) + r.shard_bytes
    assert max(size.values()) <= 1000 and len(size) > 30
    assert sharding.shard(docs.limit(0)).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = frame(spark, [(i, "x" * 20) for i in range(100)])
    sharding.write_shards(docs, str(tmp_path / "s"), max_bytes=500)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100


# token counts --------------------------------------------------------------------------------------------------------


def test_token_counts_are_the_librarys(spark, tmp_path):
    from tokenizers import Tokenizer

    path, rows = tokenizer_file("byte_bpe_50k.json"), odd_rows()
    lib, cache = Tokenizer.from_file(path), str(tmp_path / "cache")
    want = sorted(((d, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False)), len(lib.encode(t or "", add_special_tokens=False)) > 1024) for d, t, *_ in rows), key=str)
    for _ in range(2):
        assert sorted(rows_of(token_counts.count_tokens(frame(spark, rows), path, cache)), key=str) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t, *_ in rows})
    more = token_counts.count_tokens(frame(spark, [*rows, (500, "a new text")]), path, cache)
    assert more.where("doc_id = 500").first().n_tokens == 3
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in rows}) + 1
    assert token_counts.count_tokens(frame(spark, rows).limit(0), path).count() == 0


def test_other_tokenizers_count_too(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(frame(spark, [(1, "Two WORDS here"), (2, None)]), path).collect():
        assert r.n_tokens == len(lib.encode({1: "Two WORDS here", 2: ""}[r.doc_id], add_special_tokens=False))


def test_fast_counts_equal_the_library():
    counter, rng = token_counts.Counter(tokenizer_file("byte_bpe_50k.json")), random.Random(3)
    assert counter.fast is not None
    parts = ["a", "b", "'s", "é", " ", "  ", "\n", "9", "<|endoftext|>", "'", "À", "#", "日", "ñ", "'ll", "\t", "×", "_", "\r\n", "thbl", "ingre"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    assert counter.many(texts) == counter.whole(texts)


# quality rules -------------------------------------------------------------------------------------------------------


def base_of(text):
    t = text or ""
    w = WORDS.findall(t)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    cover = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def test_base_rules(spark):
    rows = odd_rows() + [(200 + i, "\n".join(["a b c d e f g"] * i)) for i in range(1, 5)] + [(300, "a b c d e f g h i j k l " * 2 + "z " * 3 + "\n\na\n \na")]
    got = sorted(rows_of(quality_rules.judge(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), key=str)
    assert got == sorted(((d, *base_of(t)) for d, t, *_ in rows), key=str)
    assert quality_rules.judge(frame(spark, rows).limit(0)).count() == 0


def mcd_set():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(4000)]

    def prose():
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(60, 300))).capitalize()

    clean = [(i, prose(), "en", f"s{i % 2}") for i in range(600)]
    junk = [(1000 + i, " ".join(w + rng.choice(["###", "***", "%%%"]) for w in prose().split()), "en", "s0") for i in range(40)]
    return clean, junk + [(2000 + i, prose().upper().replace(" ", "!! "), "en", "s1") for i in range(40)]


def test_outliers_go_and_clean_documents_stay(spark):
    clean, junk = mcd_set()
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, clean + junk)).collect()}
    assert not any(got[d].kept for d, *_ in junk)
    assert all(got[d].kept for d, *_ in clean)


def test_small_sources_are_judged_by_their_whole_language(spark):
    clean, junk = mcd_set()
    small = [(3000 + i, t, "en", "spam") for i, (_, t, *_) in enumerate(junk[:3])] + [(4000 + i, t, "en", "few") for i, (_, t, *_) in enumerate(clean[:5])]
    small += [(5000, junk[4][1], "xx", "tiny"), (5001, clean[9][1], "xx", "tiny")]
    got = {r.doc_id: r.kept for r in quality_rules.judge(frame(spark, clean + small)).collect()}
    assert sorted(d for d, k in got.items() if not k) == [3000, 3001, 3002, 5000]


def test_estimates_are_near_a_brute_force_mcd(spark):
    clean, junk = mcd_set()
    scratch = Scratch(spark, "test")
    rows = scratch.put(quality_rules.base(frame(spark, clean + junk)).where("not base_failed"), "rows")
    x = np.array([[r[f"x{i}"] for i in range(5)] for r in rows.collect()])
    best, rng, h = None, np.random.default_rng(0), int(np.ceil(0.75 * len(x)))
    ridge = np.diag(np.square(quality_rules.FLOORS))
    for _ in range(30):
        at = rng.choice(len(x), 6, replace=False)
        for _ in range(15):
            m, c = x[at].mean(0), np.cov(x[at].T, bias=True) + ridge
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            at = np.argsort(d)[:h]
        m, c = x[at].mean(0), np.cov(x[at].T, bias=True) + ridge
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = (np.linalg.slogdet(c)[1], m)
    from pyspark.sql import functions as F

    e = quality_rules.estimates(rows.select(F.lit(1).alias("g"), *[f"x{i}" for i in range(5)]), scratch).first()
    assert np.allclose([e[f"m{i}"] for i in range(5)], best[1], atol=0.01)
    k = np.array([[e[f"k{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])
    assert abs(-2 * np.log(np.diag(k)).sum() - best[0]) < 0.2


# line dedup ----------------------------------------------------------------------------------------------------------


def dedup_brute(rows, size=3):
    seen, out, found = {}, [], []
    for k, (d, t, *_) in enumerate(rows):
        lines = [(i, x.strip(" ")) for i, x in enumerate((t or "").split("\n"))]
        full = [(i, x) for i, x in lines if x]
        found += [((d is not None, d), full[j][0], full[j + size - 1][0], tuple(x for _, x in full[j : j + size]), k) for j in range(len(full) - size + 1)]
    for d, s, _, w, _ in sorted(found, key=lambda x: x[:2]):
        seen.setdefault(w, (d, s))
    gone = {}
    for d, s, e, w, k in found:
        if seen[w] != (d, s):
            gone.setdefault(k, set()).update(range(s, e + 1))
    for k, (d, t, *_) in enumerate(rows):
        out.append((d, t if k not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]), len(gone.get(k, ()))))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c ", " c", "", "d e", f"own {i} {rng.random()}"]) for _ in range(rng.randint(0, 15)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "a\na\na\na\na\na"), (None, "p\nq\nr\ns"), (203, "p\nq\nr\nt"), (204, "u\nv\nw"), (204, "u\nv\nw"), (205, "u\nv\nw\nz")]
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert got.columns[0:2] == ["doc_id", "text"]
    assert sorted(rows_of(got.select("doc_id", "text", "n_removed")), key=str) == dedup_brute(rows)
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


# HTML ----------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><!-- c --><article><h1>Title {0} &amp; more</h1>
<p>First   {0}<br>line<p>Second &eacute;&#233; {0}<div class=promo>Promo</div><ul><li>one {0}<li>two</ul><div>Follow us everywhere</div></article>
<aside>Side</aside><section id="comments"><p>Nice!</p></section><form><input><button>Send</button></form><footer>&copy; Site</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"https://Site.example.com:80/{i}", PAGE.format(f"number{i}"), "x") for i in range(12)]
    rows += [(50, None, None, "x"), (51, "not a url", "", "x"), (52, "http://b.example/", "<p>Open <b>bold", "x"), (53, "http://b.example/", "plain text only", "x"), (54, "http://c.example/1", PAGE.format("few"), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for i in range(12):
        assert got[i].text == f"Title number{i} & more\n\nFirst number{i} line\n\nSecond éé number{i}\n\none number{i}"  # what recurs on the host goes
        assert got[i].n_chars == len(got[i].text)
    assert got[54].text.endswith("one few\n\ntwo\n\nFollow us everywhere")
    assert (got[50].text, got[51].text, got[52].text, got[53].text) == ("", "", "Open bold", "plain text only")
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"http://h.example/{i}", f"<article><h1>One</h1><p>The same long article {'x' * (i % 2)}</p><p>With another paragraph</p></article><div>Edge {i % 3}</div>") for i in range(40)]
    rows += [(100 + i, f"http://h.example/o{i}", f"<article><div class='entry-header'><h1>Own {i}</h1></div><p>An article of its own, {i}</p><p>Boilerplate at the end of all</p></article>") for i in range(30)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "One\n\nThe same long article\n\nWith another paragraph"
    assert got[107] == "Own 7\n\nAn article of its own, 7"


def test_boilerplate_longer_than_the_articles_goes(spark):
    notice = [" ".join(f"{w}{k}" for k in range(60)) for w in ("notice", "disclaimer")]
    rows = [(i, f"http://n.example/{i}", f"<div><p>{notice[0]}</p></div><h1>Title {i}</h1><p>A short article about thing {i}</p><p>{notice[1]}</p>") for i in range(30)]
    body = [[f"p{b}w{k}" for k in range(60)] for b in range(5)]  # near copies on another host: a word differs in one paragraph of five
    for i in range(60):
        text = [list(p) for p in body]
        text[i % 5][7 + i // 5] = f"edit{i}"
        rows.append((100 + i, f"http://c.example/{i}", "".join(f"<p>{' '.join(p)}</p>" for p in text)))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Title 7\n\nA short article about thing 7"
    assert all(len(got[100 + i].split()) == 300 for i in range(60))


def test_what_recurs_in_a_section_goes(spark):
    rows = [(i, f"http://h.example/{i % 5}/{i}", f"<h1>Title {i}</h1><p>A text about thing {i}</p><p>All of section {i % 5} say this</p>" + "<p>Said by a few</p>" * (i < 9)) for i in range(150)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\n\nA text about thing {i}" for i in range(9, 150))
    assert got[3] == "Title 3\n\nA text about thing 3\n\nSaid by a few"


def test_an_article_stands_for_the_page_only_if_it_holds_most():
    read = lambda html: html_extract.blocks(html_extract.parse(html))
    assert read(f"<div><p>{'main ' * 50}</p></div><article>Teaser</article>") == [("main " * 50).strip(), "Teaser"]
    assert read(f"<article>{'a' * 60}</article><article>{'b' * 40}</article>") == ["a" * 60, "b" * 40]
    assert read(f"<div>Edge</div><article>{'a' * 60}</article><article>b</article>") == ["a" * 60]


def test_deep_and_long_pages():
    deep = html_extract.parse("<div>" * 20_000 + "end")
    assert html_extract.blocks(deep) == ["end"]
    assert html_extract.subtrees(deep)
    assert html_extract.blocks(html_extract.parse("<p>" + "x " * 300_000)) == [("x " * 300_000).strip()]
    assert html_extract.blocks(html_extract.parse("a < b <p >c</p")) == ["a < b", "c</p"]


# SentencePiece -------------------------------------------------------------------------------------------------------


def test_encoding_round_trip_and_spans(spark):
    import sentencepiece

    path, rows = tokenizer_file("piece_bpe_32k.model"), odd_rows(4)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows_of(sp_codec.encode(frame(spark, rows), path, outputs=("ids", "begins", "ends", "decoded", "ids_sha256", "decoded_sha256", "n_spanned")))
    text = {}
    for d, t, *_ in rows:
        text.setdefault(d, []).append(t or "")
    assert len(got) == len(rows)
    for d, ids, begins, ends, decoded, s1, s2, n in got:
        t = next(x for x in text[d] if lib.encode(x, add_bos=True, add_eos=True) == ids)
        assert decoded == lib.decode(ids) and n == len(t.encode())
        assert s1 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and s2 == hashlib.sha256(decoded.encode()).hexdigest()
        if len(t) < 5000:
            assert [(p.begin, p.end) for p in lib.encode(t, return_type="proto").pieces] == list(zip(begins, ends, strict=True))[1:-1]
    assert {r[0] for r in rows_of(sp_codec.decode(sp_codec.encode(frame(spark, rows), path).withColumnRenamed("decoded", "old"), path).where("decoded is null"))} == set()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_normaliser_follows_compiled_maps(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    proto = pb.ModelProto()
    proto.ParseFromString(lib.serialized_model_proto())
    mine = sp_codec.Normaliser(proto.normalizer_spec.precompiled_charsmap, True, True, True)
    rng = random.Random(1)
    texts = ["".join(rng.choice(["Ａ", "ｶﾞ", "ﬁ", "Å", "①", " ", "  ", "x", "É", "\n", "　", "½", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    for t in texts:
        out, align = mine.normalise(t.encode())
        assert out == lib.normalize(t).encode()
        assert len(align) == len(out) + 1 and (np.diff(align) >= 0).all() and (not out or align[-1] <= len(t.encode()))


# SimHash -------------------------------------------------------------------------------------------------------------


def fingerprint_brute(text):
    w = [x.encode() for x in WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_brute(fps):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if bin(a ^ b).count("1") <= 3:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def near_rows():
    rng, rows = random.Random(2), odd_rows(3)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(3000)]
    for g in range(6):
        base = [rng.choice(words) for _ in range(400)]
        for k in range(25):
            t = list(base)
            for _ in range(k // 4):
                t[rng.randrange(400)] = rng.choice(words)
            rows.append((1000 + 100 * g + k, " ".join(t)))
    return rows


@pytest.mark.parametrize("block", [4, 2048])
def test_simhash_components(spark, block):
    rows = near_rows()
    fp = {id(r): fingerprint_brute(r[1]) for r in rows}
    root = components_brute(fp.values())
    least = {}
    for r in rows:
        if r[0] is not None:
            k = root[fp[id(r)]]
            least[k] = min(least.get(k, r[0]), r[0])
    want = sorted(((r[0], fp[id(r)], least.get(root[fp[id(r)]])) for r in rows), key=str)
    got = sorted(((d, f % (1 << 64), c) for d, f, c in rows_of(simhash.near_duplicates(frame(spark, rows), block=block))), key=str)
    assert got == want
    kept = simhash.keep_one(frame(spark, rows), block=block)
    assert kept.columns == frame(spark, rows).columns
    # of each component the rows' least id, a null one only if there is no other; of texts that share it the one of the least digest
    first = {}
    for r in rows:
        k = root[fp[id(r)]]
        first[k] = min(first.get(k, (True, 0, "~")), (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    text = {hashlib.md5((r[1] or "").encode()).hexdigest(): r[1] or "" for r in rows}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((n, d, text[h]) for n, d, h in first.values())
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_each_component_keeps_a_row_whatever_the_ids(spark):
    import corpus_pipeline

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(30)]
    rows = [(None, t) for t in texts[:10]] * 2 + [(7, t) for t in texts[10:20]] + [(100 + i, t) for i, t in enumerate(texts[20:])] + [(None, texts[25]), (3, texts[26])]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()
    want = [(None, t) for t in texts[:10]] + [(7, t) for t in texts[10:20]] + [(3 if i == 6 else 100 + i, t) for i, t in enumerate(texts[20:])]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.doc_id is None for r in simhash.keep_one(frame(spark, rows)).collect()) == 10


@pytest.mark.parametrize("block", [3, 1024])
def test_near_copies_are_those_of_five_word_shingles(spark, block):
    rows = near_rows()  # edits of up to six words in 400, and more below
    rng = random.Random(6)
    for g in range(10):
        base = [f"g{g}w{rng.randrange(900)}" for _ in range(200)]
        for k in range(12):
            t = list(base)
            for _ in range(k):
                t[rng.randrange(200)] = f"e{rng.randrange(9000)}"
            rows.append((3000 + 100 * g + k, " ".join(t)))
    sets = [set(near_copies.shingles((t or "").encode()).tolist()) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append((r[0] is None, r[0] or 0))
    got = simhash.keep_least(frame(spark, rows), near_copies.groups(frame(spark, rows), block=block)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(min(v) for v in least.values())
    assert near_copies.groups(frame(spark, rows).limit(0)).count() == 0


def test_near_copies_link_by_fingerprints_what_bands_miss(spark):
    rows, texts = [], []
    for k, i in enumerate((453997, 1293714)):  # nine shingles each, eight in common: 0.8 alike, three bits apart, no band shared
        base = [f"{i}x{j}" for j in range(13)]
        texts += [" ".join(base), " ".join([*base[:12], f"{i}y"])]
        rows += [(10 * k + 1, texts[-2]), (10 * k + 2, texts[-1])]
    sets = [near_copies.shingles(t.encode()) for t in texts]
    for x, y in (sets[:2], sets[2:]):
        assert not (near_copies.least_hashes(x) == near_copies.least_hashes(y)).reshape(near_copies.BANDS, -1).all(1).any()
        assert near_copies._pair(x, y)
    rows += [(50, " ".join(f"o{j}" for j in range(40))), (None, None), (60, "")]
    root = {r.doc_id: r.root for r in near_copies.groups(frame(spark, rows)).collect()}
    assert root[1] == root[2] and root[11] == root[12] and len({root[1], root[11], root[50], root[60]}) == 4
    kept = simhash.keep_least(frame(spark, rows), near_copies.groups(frame(spark, rows))).collect()
    assert sorted(r.doc_id for r in kept) == [1, 11, 50, 60]


@pytest.mark.parametrize("block", [3, 1024])
def test_fingerprints_left_apart_all_meet_in_golay_cells(spark, block):
    rng, fps = random.Random(9), []
    for _ in range(12):
        base = rng.getrandbits(64)
        fps += [base, base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(10)]
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    texts = spark.createDataFrame([(k, f, 8) for k, f in enumerate(fps)], "name long, fp long, size long")
    near, pairs = near_copies._by_prints(texts, Scratch(spark, "test"))
    roots = spark.createDataFrame([(1, 0)], "node long, root long")
    rows = near_copies._golay_rows(texts, near, pairs, roots, Scratch(spark, "test"))
    cells = near_copies._cells(near_copies._in_blocks(rows, block, 1 << 20, True).orderBy("cell").toArrow().to_batches())
    got = set()
    for t in cells:
        name = t.column("name").to_pylist()
        got |= {(min(name[i], name[j]), max(name[i], name[j])) for i, js in near_copies._candidates(t) for j in js.tolist()}
    want = {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if ((fps[i] ^ fps[j]) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == want - {(0, 1)}


def test_golay_lists_share_an_index_at_distance_one():
    v = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    a = simhash.golay_indices(v)
    for bit in range(23):
        b = simhash.golay_indices(v ^ (1 << bit))
        assert all(((x == y[0]) | (x[0] == y)).any() for x, y in zip(a, b, strict=True))


def test_keys_meet_for_all_small_distances():
    rng = np.random.default_rng(1)
    f = rng.integers(-(2**63), 2**63 - 1, 500, dtype=np.int64)
    g = f.copy()
    for i in range(len(g)):
        for b in rng.choice(64, 3, replace=False):
            g[i] ^= np.uint64(1 << int(b)).view(np.int64)
    sets = []
    for x in (f, g):
        key, row, near = simhash.keys_of(x)
        sets.append((set(zip(row.tolist(), key.tolist(), strict=True)), set(zip(row[near].tolist(), key[near].tolist(), strict=True))))
    met = (sets[0][0] & sets[1][1]) | (sets[0][1] & sets[1][0])
    assert {r for r, _ in met} == set(range(500))


# top-k ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("big", [False, True])
def test_top_k(spark, big):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1) * (1e5 if big else 1)], 1) for i in range(150)]
    rows += [(200, None, 1), (201, [1.0, None] + [0.0] * 6, 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] * 8, 1), (204, [], 1), (205, [1.0, 2.0], 1), (300, [2.0, 3.0], 1), (206, rows[3][1], 1), (207, rows[3][1], 1), (None, rows[4][1], 1)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    got = rows_of(topk.top_k(t, t.where("vec_id % 10 = 0"), k=5, query_bytes=500))
    ok = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 10 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:5]
            want += [(q, r + 1, i, max(min(-s_, 2**63 - 1), -(2**63))) for r, (s_, i) in enumerate(s)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(t.limit(0), t.limit(0)).count() == 0


# mixing --------------------------------------------------------------------------------------------------------------


def targets_brute(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, active, out = 1.5 * sum(sizes.values()), set(order), {}
    while active:
        share = {s: left * w[s] / sum(w[x] for x in active) for s in active}
        full = [s for s in active if share[s] > 2 * sizes[s]]
        if not full:
            out |= share
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            active.remove(s)
    return out


@pytest.mark.parametrize("chunk", [20, 50_000])
def test_mix(spark, chunk):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 60), "en", rng.choice(["a", "a", "a", "b", "c", None, "z"])) for i in range(900)]
    rows += [(2000, None, "en", "a"), (2001, "", "en", "empty"), (2002, "x", "en", ""), (2003, "same row", "en", "b"), (2003, "same row", "en", "b"), (None, "no id", "en", "c")]
    docs = frame(spark, rows)
    got = mixing.mix(docs, chunk=chunk).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORDS.findall(t or ""))
    want, by = targets_brute(sizes), {}
    source = {(d, len(WORDS.findall(t or ""))): s for d, t, _, s in rows}
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and r.taken == r.copies * r["size"] <= 2 * r["size"]
        by[s] = by.get(s, 0) + r.taken
    for s, n in by.items():
        assert abs(n - want[s]) <= 0.02 * want[s] + 3
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), chunk=chunk).collect()))
    mixed = mixing.apply_mix(docs, chunk=chunk)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_many_sources(spark, seed):
    rng = random.Random(seed)
    sizes = {None: 40} | {f"s{i}": rng.choice([0, 1, 5, rng.randint(1, 3000), 9000]) for i in range(rng.choice([1, 7, 40]))}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = targets_brute(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in got.collect())


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 500, 3000), np.full(3000, 0.3)
    q = mixing.flight(p, size, rng.random(3000))
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q @ size - p @ size) < 1e-3 and abs(q.sum() - p.sum()) < 1e-6


def test_inclusion_probabilities():
    size, hits = np.array([5, 9, 2, 7, 7, 1, 4, 3, 8, 6]), np.zeros(10)
    for seed in range(4000):
        q = mixing.flight(np.full(10, 0.4), size, np.random.default_rng(seed).random(10))
        hits += q
    assert np.allclose(hits / 4000, 0.4, atol=0.03)


# classifier ----------------------------------------------------------------------------------------------------------


def test_classifier_learns_from_rows_that_are_not_held_out(spark):
    import zlib

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(800):
        good = rng.random() < 0.7
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        rows.append((i, " ".join(w if good else [x + "###" for x in w])))
        labels.append((i, int(good), 0))
    truth = dict((i, y) for i, y, _ in labels)
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in labels]  # held-out labels turned: they must not matter
    lab = spark.createDataFrame([*wrong, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [*rows, (900, None), (901, ""), (None, "x y"), (5, rows[5][1])])
    got = quality_clf.classify(docs, lab).collect()
    assert len(got) == 804
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 800]
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = quality_clf.keep_good(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality_clf.classify(docs.limit(0), lab.limit(0)).count() == 0
    assert quality_clf.classify(docs, lab.limit(0)).where("score <> 0.5").count() == 0


def test_sparse_score_is_the_dot_product():
    w = np.random.default_rng(0).normal(size=1 << quality_clf.BITS).astype(np.float32)
    for t in (b"", b"one", b"a b a b a b c", b"The THE the ### 12"):
        u, v = quality_clf.vector(t)
        (s,) = quality_clf._score(iter([t]), w, 0.1, quality_clf.BITS)
        assert abs(s - 1 / (1 + np.exp(-(w[u] @ v + 0.1)))) < 1e-5
