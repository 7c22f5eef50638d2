"""Text as Columns: titles, phrases, tokens, n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of letters and digits of the languages at hand; explicit, so that any engine reads it alike.
TOKEN = r"[0-9A-Za-zÀ-ÖØ-öø-ÿ]+"
STOP = {
    "en": "a an and are as at be by for from has have he in is it its of on or she that the their they this to was were will with".split(),
    "de": "aber als am an auch auf aus bei bin bis das dem den der des die ein eine einen einer er es für im in ist mit nicht sie sich und von zu".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous on ou par pas pour qui que se sur un une".split(),
    "es": "a al como con de del el ella en es esta este la las lo los más no o para pero por que se sin su sus un una y".split(),
}


def canonical_title(t: Column) -> Column:
    """Underscores are spaces, anchors go, the first letter is a capital, also after a namespace; marks of direction go."""
    t = F.regexp_replace(F.regexp_replace(t, "‎", ""), "_", " ")
    t = F.trim(F.regexp_replace(t, "#.*$", ""))
    t = F.regexp_replace(t, "^([^:]*?) *: *", "$1:")
    first = capitalise(t)
    at = F.instr(first, ":")
    return F.when(at > 0, F.concat(first.substr(F.lit(1), at), F.upper(first.substr(at + 1, F.lit(1))), first.substr(at + 2, F.char_length(first)))).otherwise(first)


def capitalise(t: Column) -> Column:
    return F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.char_length(t)))


def title_name(t: Column) -> Column:
    """Without a disambiguator in brackets."""
    return F.coalesce(F.nullif(F.regexp_extract(t, r"^(.+?)\s*\((.+?)\)$", 1), F.lit("")), t)


def title_disambiguator(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, r"^(.+?)\s*\((.+?)\)$", 2), F.lit(""))


def page_url(lang: Column, page_id: Column, title: Column) -> Column:
    return F.concat(F.lit("/w/"), lang, F.lit("/"), page_id.cast("string"), F.lit("/"), F.regexp_replace(title, " ", "_"))


def url_parts(url: Column) -> Column:
    """struct(lang, page_id, title) of a compact URL."""
    p = r"^/w/([^/]+)/(-?[0-9]+)(?:/(.*))?$"
    return F.struct(F.regexp_extract(url, p, 1).alias("lang"), F.regexp_extract(url, p, 2).cast("long").alias("page_id"), F.regexp_replace(F.regexp_extract(url, p, 3), "_", " ").alias("title"))


def normalise(t: Column) -> Column:
    """Letters and digits in lower case, single spaces between."""
    return F.trim(F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")))


def stemmed(t: Column, lang: str = "en") -> Column:
    """The normal form with each word's stem."""
    from .stem import stem

    return F.array_join(F.transform(F.split(normalise(t), " "), lambda w: stem(w, lang)), " ")


def fold_case(t: Column) -> Column:
    return F.lower(F.trim(t))


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(TOKEN), F.lit(0))


def sentences(t: Column, lang: str = "en") -> Column:
    """Array of sentences, each an array of words, as the JVM's break iterator finds them for a language."""
    return F.sentences(t, F.lit("en" if lang == "simple" else lang), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(toks: Column, low: int, high: int) -> Column:
    """All n-grams of low to high words, joined by spaces, shorter ones first."""

    def of(t: Column, n: int) -> Column:
        at = lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)])
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), at)).otherwise(F.array().cast("array<string>"))

    return let(toks, lambda t: F.concat(*[of(t, n) for n in range(low, high + 1)]))


def without_stop_words(toks: Column, lang: str) -> Column:
    stop = F.array(*map(F.lit, STOP.get("en" if lang == "simple" else lang, [])))
    return F.filter(toks, lambda w: ~F.array_contains(stop, w)) if STOP.get(lang) else toks


def cjk_bigrams(t: Column) -> Column:
    """Bigrams of characters, for languages that write no spaces."""
    c = F.filter(F.split(t, ""), lambda x: x.rlike(r"\p{L}|\p{N}"))
    return F.when(F.size(c) > 1, F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b))).otherwise(c)


def title_hash(lang: Column, name_space: Column, title: Column) -> Column:
    return F.xxhash64(lang, name_space, title)


def strip_markup(t: Column) -> Column:
    """Wiki markup reduced to its text, by rules for what nests not; templates and tables go from the inside out."""
    for _ in range(4):
        t = F.regexp_replace(t, r"(?s)\{\{[^{}]*\}\}", "")
    t = F.regexp_replace(t, r"(?s)\{\|.*?\|\}", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref.*?</ref>", "")
    t = F.regexp_replace(t, r"\[\[(?:File|Image|Category):[^\]]*\]\]", "")
    t = F.regexp_replace(t, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    t = F.regexp_replace(t, r"\[[a-z]+://[^ \]]+ ?([^\]]*)\]", "$1")
    t = F.regexp_replace(t, r"(?m)^=+ *(.*?) *=+ *$", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"'{2,}", ""), r"<[^>]+>", ""))
