"""Scalar text functions as Catalyst expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without retrieval signal.
STOPWORDS = (
    "ve veya ile bir bu şu o da de ki mi için gibi daha çok en ise ama fakat ancak olan olarak olur her bazı hem ya the"
).split()
# Abbreviations whose full stop ends no sentence in the chunkers.
ABBREVIATIONS = "dr doç prof op uzm yrd sn av bkz vb vs örn yy no sk mah cad tel bkm mg ml gr".split()
# Capitals that may begin a sentence.
CAPITALS = "ABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZQWX"
ABSTAIN = "BILGI_YOK"
ASCII_FROM, ASCII_TO = "çğıöşüÇĞİÖŞÜâîûÂÎÛ", "cgiosuCGIOSUaiuAIU"
#: prefixes some dense models want before queries and passages (fixed values)
MODEL_PREFIXES = {
    "intfloat/multilingual-e5-small": ("query: ", "passage: "),
    "intfloat/multilingual-e5-base": ("query: ", "passage: "),
    "google/embeddinggemma-300m": ("task: search result | query: ", "title: none | text: "),
}
WS = r"[\s\p{Z}]"
GLUE = "\ue01f"  # stands for white space that ends no sentence
END = "\ue01e"  # stands for white space that may end one
HEADING = r"(?mdU)^(={2,6})\s*(.+?)\s*\1$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, where ``use`` names it inside the lambda of another function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def _composites() -> list[tuple[str, str]]:
    out = []
    for base in "aceginosuyACEGINOSUYеиЕИ":
        for mark in "̧̀́̂̃̆̇̈":
            whole = unicodedata.normalize("NFC", base + mark)
            if len(whole) == 1:
                out.append((base + mark, whole))
    return out


def nfc(c: Column) -> Column:
    """Composed form of Latin letters with the common accents; texts without combining marks pass untouched."""
    whole = c
    for pair, one in _composites():
        whole = F.replace(whole, F.lit(pair), F.lit(one))
    return F.when(c.rlike("[̀-ͯ]"), whole).otherwise(c)


def turkish_lower(c: Column) -> Column:
    """Lower case by Turkish rules (dotted and dotless i)."""
    return F.lower(F.translate(nfc(c), "IİĞÜŞÖÇ", "ıiğüşöç"))


def tokenize(c: Column, stem: int | None = 5) -> Column:
    """Words of ASCII and Turkish letters, stop words and single characters out, cut to a prefix of ``stem``; order and repeats stay. Null gives an empty array."""
    words = F.regexp_extract_all(turkish_lower(F.coalesce(c, F.lit(""))), F.lit("([0-9a-zçğıöşü]+)"), F.lit(1))
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))
    return F.transform(kept, lambda w: F.substring(w, 1, stem)) if stem else kept


def normalise(c: Column) -> Column:
    """T5: white space collapsed and trimmed, plain lower case."""
    return F.lower(F.trim(_sub(c, WS + "+", " ")))


def fold_ascii(c: Column) -> Column:
    """Turkish letters without their marks."""
    return F.replace(F.translate(nfc(c), ASCII_FROM, ASCII_TO), F.lit("̇"), F.lit(""))


def upper_first(c: Column) -> Column:
    """First letter in Turkish upper case."""
    head = F.substring(c, 1, 1)
    return F.concat(F.when(head == "i", "İ").when(head == "ı", "I").otherwise(F.upper(head)), F.substring(c, F.lit(2), F.length(c)))


def is_shouting(c: Column) -> Column:
    """At least six letters, four of five of them capitals."""
    letters = F.length(_sub(c, r"[^\p{L}]", ""))
    return (letters >= 6) & (F.length(_sub(c, r"[^\p{Lu}]", "")) >= 0.8 * letters)


def slugify(c: Column) -> Column:
    """Lower-case ASCII letters and digits with hyphens between; ``doc`` for nothing."""
    flat = F.translate(turkish_lower(c), "ışğüöç", "isguoc")
    slug = _sub(_sub(flat, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("doc")).otherwise(slug)


def snippet(c: Column, size: int = 72) -> Column:
    """One line of at most ``size`` characters."""
    t = F.trim(_sub(c, WS + "+", " "))
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.substring(t, 1, size - 1), F.lit("…")))


def text_digest(c: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(c, 256)


def stress_variants(c: Column) -> dict[str, Column]:
    """Rewrites that typed questions suffer. (Lower case right on upper case would be simplified to lower case alone.)"""
    caps = F.upper(F.translate(c, "iı", "İI"))
    return {"original": c, "ascii": fold_ascii(c), "caps": caps, "naive_lower": F.lower(F.replace(caps, F.lit("\x00"), F.lit("")))}


def overlap(question: Column, span: Column) -> Column:
    """Share of the question's stems that the span has; 1.0 for a question without any."""
    q = F.array_distinct(tokenize(question))
    return F.when(F.size(q) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(q, tokenize(span))) / F.size(q))


def span_iou(a: Column, b: Column) -> Column:
    """Jaccard similarity of the stem sets; 1.0 for two empty ones."""
    x, y = tokenize(a), tokenize(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def span_f1(a: Column, b: Column) -> Column:
    """F1 of the stems as bags; 1.0 for two empty ones, 0.0 for one."""

    def times(bag: Column, w: Column) -> Column:
        return F.size(F.filter(bag, lambda v: v == w))

    def score(x: Column, y: Column) -> Column:
        common = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, w: n + F.least(times(x, w), times(y, w)))
        total = F.size(x) + F.size(y)
        return F.when(total == 0, F.lit(1.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(2.0 * common / total)

    return let(tokenize(a), lambda x: let(tokenize(b), lambda y: score(x, y)))


def passes_agree(a: Column, b: Column, least: float = 0.5) -> Column:
    """One span holds the other, or their bags agree."""
    x, y = normalise(a), normalise(b)
    held = (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
    return held | (span_f1(a, b) >= least)


def abstained(answer: Column) -> Column:
    """The answer holds the sentinel."""
    return F.contains(answer, F.lit(ABSTAIN))


def prefixed(model: str, text: Column, query: bool) -> Column:
    """The text with what its model wants before it."""
    return F.concat(F.lit(MODEL_PREFIXES.get(model, ("", ""))[0 if query else 1]), text)


PROVIDERS = ("anthropic", "openai", "openrouter", "ollama")


def split_model(name: str, known: tuple[str, ...] = PROVIDERS) -> tuple[str, str]:
    """(provider, model) of ``provider:model``; a bare name has the first provider."""
    head, colon, rest = name.partition(":")
    if not colon:
        return known[0], name
    if head not in known:
        raise ValueError(f"unknown provider {head!r}, known ones are {', '.join(known)}")
    return head, rest


def split_sentences(c: Column) -> Column:
    """Array of sentences as the chunkers take them; white space that ends no sentence after all is one space.

    White space behind a full stop, ! or ? becomes one mark first. Patterns then start with that mark: a look-behind
    in front of a pattern would be tried at each character.
    """
    abbr = "|".join(ABBREVIATIONS)
    gap = rf"[\s{END}{GLUE}]"
    t = _sub(c, r"(?U)(?<=[.!?])\s+", END)
    t = _sub(t, rf"(?iuU){END}(?<=(?:^|{gap})(?:{abbr}|\p{{Nd}}{{1,30}})\.{{1,3}}{END})", GLUE)
    roman = r"(?=[XVI])X{0,2}(?:IX|IV|V?I{0,3})"
    t = _sub(t, rf"(?U){END}(?<=(?:^|{gap}){roman}\.{{1,3}}{END})(?=[{CAPITALS}])", GLUE)
    t = _sub(t, rf"(?U){END}(?<=(?:^|{gap})[{CAPITALS}][^\s{END}{GLUE}]{{0,60}}{gap}{{1,3}}[{CAPITALS}]\.{{1,3}}{END})(?=[{CAPITALS}])", GLUE)
    return F.filter(F.transform(F.split(t, END), lambda x: F.translate(x, GLUE, " ")), lambda x: x.rlike(r"(?U)\S"))
