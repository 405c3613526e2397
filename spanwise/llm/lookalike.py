"""One consistent form for text that looks the same: a longest-match transducer over grapheme clusters.

``Transducer`` is compiled from rules (widths, composed accents, ligatures, spaces, characters
without width, look-alike letters). The compile step checks the mapping for conflicts: no input is
mapped twice to different outputs, and no output holds an input again, so a second pass changes
nothing. At run time one pattern, alternatives longest first, walks the text once: emoji sequences
(kept), words that mix look-alike scripts, letters with combining marks, single characters.

``canonical_text(df, ...)`` adds the canonical form and whether it differs; ``skeleton`` is the
coarser key (SQL only) that comparisons use: no case, accents, marks, punctuation or look-alikes.

Defined results: null stays null and does not differ, empty stays empty; repeated rows give equal
results; texts of any length are walked whole; columns with clashing names are replaced by the
output columns, all others are carried.
"""

from __future__ import annotations

import sys
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import spread

# Letters of Cyrillic and Greek that look like a Latin one.
CYRILLIC_LATIN = ("АВЕЅІЈКМНОРСТУХЎЗГԚԜаеѕіјкорсухһԁԛԝӏгпԍ", "ABESIJKMHOPCTYXY3rQWaesijkopcyxhdqwlrng")
GREEK_LATIN = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγηικνορτυχω", "ABEZHIKMNOPTYXaynikvoptuxw")
# The other way round, for words that are Cyrillic or Greek but for a few Latin letters.
_LATIN = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿＡ-Ｚａ-ｚﬀ-ﬆ\u212a\u212b"
_OTHER = "Ͱ-ͽͿ-ҁҊ-ԯἀ-῾\u2126"
_MARKS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃰︠-︯"
_EMOJI = "\U0001f000-\U0001faff☀-➿⬀-⯿⌀-⏿"


def _no_width() -> str:
    cf = [chr(c) for c in range(sys.maxunicode + 1) if ud.category(chr(c)) == "Cf" and not 0xE0000 <= c and not 0x600 <= c <= 0x605 and c not in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD) and not 0x13430 <= c <= 0x1343F and not 0x1D173 <= c <= 0x1D17A and not 0xFFF9 <= c <= 0xFFFB]
    return "".join(cf) + "͏ᅟᅠ឴឵ㅤﾠ"


def rules() -> dict[str, tuple[str, str]]:
    """Single characters: input -> (class, output)."""
    out: dict[str, tuple[str, str]] = {}

    def put(x: str, kind: str, y: str) -> None:
        if out.get(x, (kind, y))[1] != y:
            raise ValueError(f"two outputs for {x!r}")
        out[x] = (kind, y)

    for c in range(0xFF01, 0xFF5F):
        ch = chr(c)
        put(ch, "width" if ch.isalnum() else "width-mark", chr(c - 0xFEE0))
    for c in range(0xFB00, 0xFB07):
        put(chr(c), "ligature", ud.normalize("NFKC", chr(c)))
    for c in range(0x110000):
        ch = chr(c)
        if ud.category(ch) == "Zs" and ch != " ":
            put(ch, "space", " ")
    for ch in "  ":
        put(ch, "space", "\n")
    for ch in _no_width():
        if ud.category(ch) == "Cf" or ch in "͏":
            put(ch, "no-width", "")
    return out


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    return next((k for k, name in (("Latin", "LATIN"), ("Greek", "GREEK"), ("Cyrillic", "CYRILLIC")) if c.isalpha() and name in ud.name(c, "")), "")


class Transducer:
    """Compiled from ``rules``, the canonical compositions and the look-alike tables.

    Arcs: ``single`` (character -> output), ``pairs`` (character and what hangs on it -> composed), and per target script ``table`` (letter -> letter). ``_check`` follows all of them once at compile time.
    """

    def __init__(self) -> None:
        self.single = rules()
        self.pairs: dict[str, str] = {}
        for c in range(0x110000):
            ch = chr(c)
            apart = ud.decomposition(ch)
            if not apart or apart[0] == "<":
                continue
            normal = ud.normalize("NFC", ch)
            if normal != ch:  # stands for another character, or is never composed
                if ch not in self.single:
                    self.single[ch] = ("composed", normal)
            elif len(two := "".join(chr(int(x, 16)) for x in apart.split())) == 2:
                self.pairs[two] = ch
        self.seconds = {x[1] for x in self.pairs}
        self.width_marks = {ord(x): y for x, (k, y) in self.single.items() if k == "width-mark"}
        self.table = {
            "Latin": dict(zip(CYRILLIC_LATIN[0] + GREEK_LATIN[0], CYRILLIC_LATIN[1] + GREEK_LATIN[1], strict=True)),
            "Cyrillic": dict(zip(reversed(CYRILLIC_LATIN[1]), reversed(CYRILLIC_LATIN[0]), strict=True)),
            "Greek": dict(zip(reversed(GREEK_LATIN[1]), reversed(GREEK_LATIN[0]), strict=True)),
        }
        cls = lambda chars: regex.escape("".join(sorted(chars))).replace("-", r"\-")
        nw = cls(x for x, (k, _) in self.single.items() if k == "no-width")
        others = cls(x for x, (k, _) in self.single.items() if k != "no-width")
        # what may stand behind the first character of a cluster: marks of any script, and what is composed with the one before
        hangs = rf"\p{{Mn}}\u1161-\u1175\u11a8-\u11c2{cls(self.seconds)}"
        inside = f"[{hangs}{nw}]*+"
        # what is not in composed form is told without it
        self.need = regex.compile(f"[{cls(x for x, (k, _) in self.single.items() if k not in ('no-width', 'composed'))}{nw}{_MARKS}]")
        self.other = regex.compile("[\u0370-\u052f\u1c80-\u1c8f\u1d26-\u1d2b\u1f00-\u1fff\u2126\u2de0-\u2dff\ua640-\ua69f]")  # all blocks of Greek and Cyrillic
        emoji = rf"(?:[0-9#*]\ufe0f?\u20e3|[{_EMOJI}\U0001f3fb-\U0001f3ff](?<![{others}])\ufe0f?(?:\u200d[{_EMOJI}]\ufe0f?|[\U0001f3fb-\U0001f3ff]\ufe0f?|[\U000e0020-\U000e007f])*)"
        mixed = rf"(?<![{_LATIN}{_OTHER}])(?:(?:[{_LATIN}]{inside})++[{_OTHER}]|(?:[{_OTHER}]{inside})++[{_LATIN}]){inside}(?:[{_LATIN}{_OTHER}]{inside})*+"
        cluster = rf"[^\s{hangs}{nw}][{nw}]*+[{hangs}][{hangs}{nw}]*+|[{hangs}][{hangs}{nw}]*+"
        latin, greek, cyrillic = (rf"[\p{{L}}&&\p{{Script={x}}}]" for x in ("Latin", "Greek", "Cyrillic"))
        # two letters of a word that stand next to each other in different scripts: so it is in each word that mixes two of the three
        self.scripts = regex.compile(rf"(?V1){latin}{inside}(?:{greek}|{cyrillic})|{greek}{inside}(?:{latin}|{cyrillic})|{cyrillic}{inside}(?:{latin}|{greek})")
        # in composed text marks of other scripts matter only behind something without width
        light = rf"[^\s{_MARKS}{nw}](?=[{nw}{_MARKS}])[{nw}]*+[{hangs}][{hangs}{nw}]*+|[{_MARKS}][{_MARKS}{nw}]*+"
        self.pattern, self.light = (regex.compile(f"(?P<emoji>{emoji})|(?P<mixed>{mixed})|(?P<cluster>{x})|(?P<one>[{others}{nw}])") for x in (cluster, light))
        self._check()

    def _check(self) -> None:
        """No output of a table is an input of it or of ``single``, and what the arcs put out they leave as it is."""
        for x, (_, y) in self.single.items():
            if any(c in self.single for c in y):
                raise ValueError(f"the output of {x!r} is an input again")
        for name, t in self.table.items():
            for x, y in t.items():
                if y in t or y in self.single or len(y) != 1:
                    raise ValueError(f"the {name} output of {x!r} is an input again")
        for x, y in self.pairs.items():
            if y in self.single or self.cluster(y) != y or self.cluster(x) != y:
                raise ValueError(f"{x!r} is not composed once and for all")

    @staticmethod
    def _cjk(text: str, at: int) -> bool:
        """Whether the letters around a position are mostly Chinese or Japanese ones."""
        near = text[max(0, at - 40) : at + 40]
        han = plain = 0
        for ch in near:
            o = ord(ch)
            if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
                han += 1
            elif ch.isalpha() and not 0xFF00 <= o <= 0xFFEF:
                plain += 1
        return han > plain

    def cluster(self, x: str) -> str:
        """A character with what hangs on it, in order and composed; marks that have no composed form stay behind their letter.

        Marks without a letter or symbol, and the dot above a letter that has one, show nothing of their own and go.
        """
        x = ud.normalize("NFC", "".join(self.single[c][1] if c in self.single else c for c in x))
        y = self._stray.sub("", x)
        return ud.normalize("NFC", y) if y != x else x

    _stray = regex.compile(r"(?<![\p{L}\p{M}\p{S}])[\u0300-\u036f]++|(?<=[ij][\u0300-\u036f]*)\u0307")

    def _word(self, w: str) -> str:
        """Look-alikes go to one script: to Latin if all letters of the others have one there, else the rest goes to the script with most letters."""
        w = "".join(self.single[c][1] if c in self.single else c for c in w)
        own = [_script(c) for c in w]
        foreign = [c for c, k in zip(w, own, strict=True) if k in ("Greek", "Cyrillic")]
        if all(c in self.table["Latin"] for c in foreign):
            target = "Latin"
        else:
            target = max(("Latin", "Greek", "Cyrillic"), key=own.count)
        t = self.table[target]
        w = "".join(t.get(c, c) if k != target else c for c, k in zip(w, own, strict=True))
        return self.clusters.sub(lambda m: self.cluster(m.group()), w)

    clusters = regex.compile(r"\P{M}?\p{M}++")

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        if not ud.is_normalized("NFC", text):
            return self._walk(self.pattern, text, 0, len(text))
        spots = [m.start() for m in self.need.finditer(text)]
        if self.other.search(text):
            spots += [m.start() for m in self.scripts.finditer(text)]
        # composed text is walked only where something is, from white space to white space
        out, done = [], 0
        for p in sorted(spots):
            if p >= done:
                a = max(done, text.rfind(" ", done, p) + 1, text.rfind("\n", done, p) + 1)
                ends = [e for e in (text.find(" ", p + 1), text.find("\n", p + 1)) if e >= 0]
                out += [text[done:a], self._walk(self.light, text, a, min(ends, default=len(text)))]
                done = min(ends, default=len(text))
        return "".join(out) + text[done:] if out else text

    def _walk(self, pattern: regex.Pattern, text: str, a: int, b: int) -> str:
        def put(m: regex.Match) -> str:
            kind = m.lastgroup
            x = m.group()
            if kind == "emoji":
                return x
            if kind == "mixed":
                return self._word(x)
            if kind == "cluster":
                return self.cluster(x)
            kind, y = self.single[x]
            if kind.startswith("width") and self._cjk(text, a + m.start()):
                return x
            if kind == "width-mark":
                return x if not regex.search(rf"[{_LATIN}]", text[max(0, a + m.start() - 2) : a + m.end() + 2]) else y
            return y

        return pattern.sub(put, text[a:b])

    def departs(self, text: str | None) -> bool:
        """Whether the text holds anything that the canonical form has otherwise, full-width punctuation left aside, or a word of mixed scripts, mapped or not."""
        if not text:
            return False
        if not text.isascii() and self.other.search(text) and self.scripts.search(text):
            return True
        y = self(text)
        if y == text:
            return False
        return y.translate(self.width_marks) != text.translate(self.width_marks)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def canonical_text(df: DataFrame, text: str, out: str = "canonical", flag: str = "departs") -> DataFrame:
    """All columns, ``out`` with the canonical form of ``text`` and ``flag``, whether the text departs from it."""

    @F.pandas_udf(f"`{out}` string, `{flag}` boolean")
    def run(s: pd.Series) -> pd.DataFrame:
        t = transducer()
        return pd.DataFrame({out: [None if x is None else t(x) for x in s], flag: [t.departs(x) for x in s]})

    got = df.withColumn("__c", run(F.col(text)))
    return got.withColumns({out: F.col(f"__c.{out}"), flag: F.col(f"__c.{flag}")}).drop("__c")


def departing_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(row_key STRING, field STRING), once for each field whose canonical form is another text; one pass over the rows."""
    kinds = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("t")) for f in fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer()
        for b in batches:
            yield b.loc[[t.departs(x) for x in b["t"]], ["row_key", "field"]]

    long = spread(df.select(key, *fields)).select(F.col(key).cast("string").alias("row_key"), F.explode(kinds).alias("x")).select("row_key", "x.field", "x.t")
    # ASCII cannot depart: those rows never reach Python
    return long.where(F.col("t").rlike(r"[^\x00-\x7f]")).mapInPandas(run, "row_key string, field string")


@lru_cache(maxsize=1)
def _skeleton_table() -> tuple[str, str]:
    """Letters and digits whose base is another one: rule-based, from the Unicode character data."""
    look = dict(zip(CYRILLIC_LATIN[0] + GREEK_LATIN[0], CYRILLIC_LATIN[1] + GREEK_LATIN[1], strict=True))
    src, dst = [], []
    for c in [*range(0x80, 0x3000), *range(0xFF10, 0xFF5B)]:
        ch = chr(c)
        if not ch.isalnum():
            continue
        low = ch.lower()
        base = "".join(x for x in ud.normalize("NFKD", low if len(low) == 1 else ch) if ud.category(x) != "Mn")
        if len(base) != 1:
            continue
        base = look.get(ch, look.get(base, base)).lower()
        base = {"ı": "i", "ø": "o", "ł": "l", "đ": "d", "ħ": "h"}.get(base, base)
        if base != ch and base.isalnum():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def skeleton(c: Column) -> Column:
    """Words in one coarse form, single spaces between: case, accents, marks, punctuation and look-alike letters left aside. SQL only."""
    src, dst = _skeleton_table()
    c = F.regexp_replace(c, F.lit(r"[\p{M}\p{Cf}]+"), F.lit(""))
    for lig, to in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ß", "ss")):
        c = F.replace(c, F.lit(lig), F.lit(to))
    c = F.translate(F.lower(c), src, dst)
    c = F.regexp_replace(c, F.lit(r"[\p{M}]+"), F.lit(""))  # lower() of a dotted capital leaves one
    c = F.regexp_replace(c, F.lit(r"(?<=[\p{L}\p{N}])[-'’‐‑](?=[\p{L}\p{N}])|(?<=\p{N})[.,:/](?=\p{N})"), F.lit(""))
    return F.trim(F.regexp_replace(c, F.lit(r"[^\p{L}\p{N}]+"), F.lit(" ")))


def skeleton_words(c: Column) -> Column:
    """The words of ``skeleton``; an empty array for null and for texts without letters and digits."""
    s = skeleton(c)
    return F.when(s.isNull() | (s == ""), F.array().cast("array<string>")).otherwise(F.split(s, " "))
