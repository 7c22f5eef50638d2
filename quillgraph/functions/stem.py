"""Word analysis by language: tokens in lower case, stop words out, stems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOP, cjk_bigrams, tokens, without_stop_words

#: Endings that a light stem drops, longest first, by language: the commonest of inflection.
ENDINGS = {
    "it": ["azioni", "azione", "amente", "mente", "ità", "ione", "ioni", "are", "ere", "ire", "i", "e", "o", "a"],
    "pt": ["amentos", "amento", "ações", "ação", "mente", "idades", "idade", "ões", "ão", "es", "os", "as", "o", "a", "e"],
    "nl": ["heden", "heid", "ingen", "ing", "en", "e", "s"],
    "sv": ["heterna", "heten", "het", "arna", "erna", "orna", "ande", "ende", "aste", "ens", "ar", "er", "or", "en", "et", "a", "e", "s"],
    "da": ["erendes", "erende", "hedens", "heden", "erne", "eren", "erer", "hed", "ene", "ens", "ere", "er", "en", "et", "es", "e", "s"],
    "no": ["hetenes", "hetene", "heten", "heter", "endes", "ande", "ende", "ene", "ens", "ers", "er", "en", "et", "a", "e", "s"],
    "fi": ["issa", "issä", "ista", "istä", "ille", "illa", "illä", "ssa", "ssä", "sta", "stä", "lla", "llä", "lle", "ksi", "ina", "inä", "in", "en", "na", "nä", "ta", "tä", "a", "ä", "n", "t"],
    "hu": ["okban", "ekben", "oknak", "eknek", "ban", "ben", "ból", "ből", "nak", "nek", "hoz", "hez", "val", "vel", "ról", "ről", "ok", "ek", "ak", "t", "k"],
    "ro": ["urilor", "ului", "elor", "ilor", "uri", "ele", "lor", "ul", "ea", "le", "ii", "i", "e", "a"],
    "ca": ["acions", "ació", "aments", "ament", "ment", "itats", "itat", "es", "os", "as", "a", "e", "o", "s"],
    "gl": ["acións", "ación", "mente", "idades", "idade", "es", "os", "as", "o", "a", "e"],
    "eu": ["arekin", "aren", "etan", "etik", "ean", "ari", "ak", "ek", "en", "an", "ra", "a"],
    "ga": ["eanna", "anna", "acha", "aigh", "adh", "ach", "ta", "te", "a", "e"],
    "lv": ["ajiem", "ajām", "iem", "ām", "iņš", "as", "es", "is", "us", "am", "ai", "u", "a", "e", "i", "s"],
    "cs": ["ového", "ovým", "ích", "ých", "ami", "emi", "ého", "ému", "ům", "ou", "em", "ách", "y", "i", "e", "a", "u", "o"],
    "pl": ["owego", "owych", "ami", "ach", "ego", "emu", "ych", "ów", "om", "em", "ie", "y", "i", "e", "a", "u", "o", "ą", "ę"],
    "tr": ["larının", "lerinin", "ların", "lerin", "ları", "leri", "lar", "ler", "nın", "nin", "dan", "den", "da", "de", "ı", "i", "u", "ü"],
    "ru": ["ированный", "иями", "ями", "ами", "ого", "его", "ому", "ему", "ыми", "ими", "ией", "ий", "ый", "ой", "ых", "их", "ах", "ях", "ов", "ев", "ам", "ям", "ом", "ем", "а", "я", "о", "е", "и", "ы", "у", "ю", "ь", "й"],
    "uk": ["ами", "ями", "ого", "ому", "ими", "ій", "ий", "их", "ах", "ях", "ів", "ам", "ям", "ом", "ем", "а", "я", "о", "е", "и", "і", "у", "ю", "ь"],
    "bg": ["ията", "ето", "ите", "ият", "ове", "та", "то", "те", "ът", "ия", "а", "я", "о", "е", "и"],
    "el": ["ους", "ων", "ους", "ης", "ου", "οι", "ες", "ας", "ος", "α", "η", "ο", "ι"],
    "hi": ["ियों", "ाओं", "ों", "ें", "ीं", "ा", "ी", "े", "ो"],
    "ar": ["ات", "ون", "ين", "ان", "ها", "ية", "ه", "ة", "ي"],
    "fa": ["های", "ها", "ان", "ات", "ی"],
    "hy": ["ների", "ներ", "ում", "ով", "ից", "ին", "ը", "ի", "ն"],
    "id": ["kannya", "annya", "kan", "nya", "an", "i"],
    "de": ["ern", "em", "en", "er", "es", "e", "s", "n"],
    "fr": ["issement", "ement", "euse", "eux", "ives", "ive", "ifs", "if", "es", "er", "ée", "é", "e", "s"],
    "es": ["amientos", "amiento", "aciones", "ación", "mente", "idades", "idad", "es", "os", "as", "o", "a", "e"],
}
#: Languages whose words are those of the token pattern; others take all letters, marks and digits.
LATIN = {"en", "simple", "de", "fr", "es"}
CJK = {"zh", "ja", "ko", "th"}


def stem(w: Column, lang: str) -> Column:
    """A word's stem; languages without a rule keep the word."""
    from ..operators.models import light_stem

    if lang in ("en", "simple"):
        return light_stem(w)
    if lang not in ENDINGS:
        return w
    # an ending goes if three letters stay
    return F.regexp_replace(w, rf"(?<=\p{{L}}{{3}})(?:{'|'.join(ENDINGS[lang])})$", "")


def analyse(t: Column, lang: str, stems: bool = True, stops: bool = True) -> Column:
    """The terms of a text in a language."""
    if lang in CJK:
        return cjk_bigrams(t)
    toks = tokens(F.lower(t)) if lang in LATIN else F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    if stops and STOP.get("en" if lang == "simple" else lang):
        toks = without_stop_words(toks, lang)
    return F.transform(toks, lambda w: stem(w, lang)) if stems else toks
