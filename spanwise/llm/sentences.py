"""Sentence units by masking, splitting and restoring, in SQL expressions only.

``sentence_units(df)`` returns one row per unit: every column asked for in ``keep`` plus ``sent_start`` (code-point offset of the first character that is not white
space) and ``sentence`` (the restored text without outer white space).

How: decimals, URLs, initials, abbreviations, ordinals and whatever a quotation holds keep their
terminators out of sight as private-use placeholders (one placeholder for one character, so offsets
hold), then boundary marks are inserted after script-specific terminators, the text is split at the
marks and each piece is restored by cutting it out of the original text at its offset. No Python runs.

Defined results: null, empty and letterless texts give no unit; a heading line and a list line are
one unit each; a text that already holds the placeholders' private-use characters (U+E000..U+E00F)
is cut as any other and gets back exactly its own characters, because pieces are cut out of the
original text by offset. Repeated rows give repeated units. Very long texts take linear time in the
expressions and offsets are summed in blocks.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import spread

MARK = "\ue00f"
_TERMS = ".!?…。！？।॥؟۔｡"
_HIDDEN = "".join(chr(0xE000 + i) for i in range(len(_TERMS)))
_CLOSE, _BLANK, _CUT = "\ue00c", "\ue00d", "\ue00e"  # a “ that closes what „ opened; the line break before a blank line; an edge of a quotation

# Abbreviations after which a full stop does not end a sentence, by language.
ABBREVIATIONS = {
    "tr": "dr prof doç yrd öğr av bkz örn orn vb vs sn st alb cad sok mah no çev yy hz krş çoğ tel bşk",
    "en": "dr mr mrs ms prof st sr jr vs etc fig figs eq no nos vol pp ed eds approx dept est inc ltd co e.g i.e cf u.s u.k a.m p.m ph.d",
    "de": "dr prof hr fr usw bzw ca evtl ggf vgl nr str z.b d.h u.a o.ä inkl zzgl bspw",
    "fr": "dr mme mlle mm prof etc env p.ex c.-à-d av no vol chap",
    "es": "dr dra sr sra srta prof etc pág núm ud uds p.ej av aprox ee.uu",
    "az": "dr prof məs və.s b.k akad c.n",
    "ru": "г гг т д е п др пр см рис стр тыс млн млрд им ул проф акад руб коп св вв",
    "ar": "د أ م إلخ الخ ص ق.م",
    "hi": "डॉ श्री प्रो पं कु",
}
_WORDS = sorted({w for v in ABBREVIATIONS.values() for w in v.split()}, key=lambda w: (-len(w), w))
_OPENS, _CLOSES = "“„«「『", f"”»」』{_CLOSE}"
_THAI = r"\u0E00-\u0E7F"


def _any_width(c: str) -> str:
    """A character of an abbreviation, composed or not, of either case and width."""
    if c == ".":
        return r"\.\s?"
    apart = unicodedata.normalize("NFD", c)
    if apart != c:
        return f"(?:{c}|{c.upper()}|{apart}|{apart[0].upper()}{apart[1:]})"
    if "a" <= c <= "z":
        return "[" + "".join(chr(ord(x) + w) for x in (c, c.upper()) for w in (0, 0xFEE0)) + "]"
    return c.replace("-", r"\-") if c.upper() == c else f"[{c}{c.upper()}]"


def _branches(words: list[str]) -> str:
    """The words as one pattern that shares their beginnings."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    out = "|".join(_any_width(c) + (_branches(rest) if any(rest) else "") for c, rest in heads.items())
    return f"(?:{out})" + ("?" if "" in words else "")


def _re(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def _stops() -> str:
    """Full stops (and ellipses) that end no sentence. The pattern starts with the stop itself, all else looks around from there."""
    start = r"(?:^|[^\p{L}\p{M}\p{N}])"
    german = "(?:[Dd]er|[Dd]ie|[Dd]as|[Dd]em|[Dd]en|[Dd]es|[Ii]m|[Aa]m|[Vv]om|[Zz]um|[Bb]eim)"
    rules = (
        r"(?<=\p{Nd}\.)(?=[\p{Nd}ªºᵃ])",  # decimals, dates, times, 35.ª
        r"(?<=[Ww]{3}\.)(?=\w)",  # addresses
        rf"(?<={start}\p{{L}}\p{{M}}?\.)",  # initials and single letters, chained ones (U.S., т. д.) included
        # Roman numerals; ordinals before a small letter, or after a German article
        r"(?<=(?:^|[^\p{L}\p{N}])(?:[XVI]{2,7}|[xvıi]{2,7})\.)(?=\s)",
        r"(?<=(?:^|[^\p{L}\p{N}])\p{Nd}{1,4}\.)(?=[ \t\p{Zs}]*[\n\r]{0,2}[ ]*\p{Ll})",
        rf"(?<={german}\s\p{{Nd}}{{1,3}}\.)(?=\s\p{{Lu}})",
        rf"(?<={start}{_branches(_WORDS)}\.)",  # abbreviations, also inside
        # an ellipsis within a sentence
        r"(?=\.{0,2}+[\s\x85\p{Z}]*[\p{Ll},;])(?:(?=\.\.)|(?<=\.\.)(?=\.)|(?<=\.\.\.))",
    )
    return rf"\.(?:{'|'.join(rules)})"


def _addresses(c: Column) -> Column:
    """Hide the full stops of addresses of any length: each match goes on where the one before ended."""
    address = r"(https?://|[Ww]{3}(?=[.])|\G(?<=\.))([^\s.]*+)\.(?=[\p{L}\p{Nd}_/-])"
    return F.when(c.contains("://") | c.rlike(r"[Ww]{3}[.]"), _re(c, address, f"$1$2{_HIDDEN[0]}")).otherwise(c)


def _quotations(c: Column) -> Column:
    """Hide the terminators inside quotations of any length.

    The text is cut at the quotation marks, so each piece is walked once. What stands between an opening mark and the closing one is a quotation
    unless a blank line comes between; before any other closing mark it is what this line and the one before hold.
    """
    q = _re(c, r"\n(?=[^\S\n]*+\n)", _BLANK)
    q = _re(q, rf"„([^„“”{_BLANK}]*+)“", f"„$1{_CLOSE}")
    pieces = F.split(_re(q, rf"(?=[\u00AB-\uFFFF])(?:([{_CLOSES}])|([{_OPENS}]))", f"$1{_CUT}$2"), _CUT, -1)

    def hidden(x: Column) -> Column:
        near = F.substring_index(x, _BLANK, -1)
        held = F.when(x.rlike(rf"\A[{_OPENS}]") & (near == x), x).otherwise(F.substring_index(near, "\n", -2))
        return F.concat(F.substring(x, F.lit(1), F.length(x) - F.length(held)), _re(_re(held, "[.!?…।॥؟۔]", _HIDDEN[0]), "[。！？｡]", _HIDDEN[4]))

    q = F.array_join(F.transform(pieces, lambda x: F.when(F.substring(x, -1, 1).isin(*_CLOSES), hidden(x)).otherwise(x)), "")
    q = F.replace(F.replace(q, F.lit(_CLOSE), F.lit("“")), F.lit(_BLANK), F.lit("\n"))
    return F.when(c.rlike("(?=[\\u00BB-\\uFFFF])[“”»」』]"), q).otherwise(c)


def _boundaries(thai: bool) -> str:
    """Where a unit ends: group 1 is what stands before the mark, group 2 a line that is a unit as a whole.

    One pattern, so a text is walked once. A mark may stand anywhere in the white space between two units. Each alternative
    takes its stop or one line break and looks around from there, so that none hides the place of another.
    """
    space = r"[\s\x85\p{Z}]"
    close = r"[\"'”’»›」』)\]“]*+"
    hidden = r"[\uE000-\uE00B]"
    line = r"(?:={2,6}[^\n\r]*={2,6}[ \t]*+(?=[\r\n]|\z)|[*•‣◦▪·–—-][ \t ]++[^\s\x85\p{Z}][^\n\r]*+)"
    breaks = [
        r"(?=[ \t ]*+[\r\n])",  # before a blank line
        r"(?=[ \t]*+[\p{Lu}\p{Lt}¿¡“«„「])",  # an open line that another unit follows: a capital, a figure or an opening mark starts it
        r"(?<=[^\s\x85\p{Z}.,;:!?/]{20}\r?[\n\r])(?=[ \t]*+[^\s\x85\p{Z}])",  # or a record stands before
    ]
    closed = [rf"[”»“](?={space}+[\p{{Lu}}¿¡“«„])", rf"[\"”’»」』“]{close}(?=[ \t]*+[\r\n]{space}*[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{Nd}}¿¡“«„「*•\"(-])"]
    stops = [
        rf"{close}(?={space})",  # white space follows
        r"(?<=[\p{Ll}\p{Lo}\p{M})%][.!?]{1,3})(?=\p{Lu}[\p{L}\p{M}.]|[“«„¿¡]|\p{Nd}{4}\s)",  # or the next sentence stands right behind
        r"(?<=[।؟])(?=\p{L})",
    ]
    cuts = [
        rf"[.!?…؟۔।॥]++(?:{'|'.join(stops)})",
        rf"{hidden}++(?:{'|'.join(closed)})",
        r"[\uE004]”(?=[㐀-鿿])",  # a quotation that closes a sentence of a script without spaces
        r"[。！？｡]++[”’」』）)]*+",
    ]
    # few ranges, as each costs a test of every character: what isn't a stop fails below
    first = r"\r\n.!?\u061F-\uFF61"
    if thai:  # a space between phrases ends one
        breaks.append(rf"(?<=[{_THAI}\p{{Nd}}][ \t]{{0,9}}\r?[\r\n])(?=[ \t]*+[{_THAI}])")
        cuts += [rf"[{_THAI}\p{{Nd}}](?=[ \t\p{{Zs}}]+[{_THAI}])", rf"[{_THAI}](?=[ \t\p{{Zs}}]+[\p{{Lu}}“«„])"]
        first += r"\p{Nd}"
    both = r"(?:\r\n|[\r\n])"
    # behind a heading or a list line the next match starts where that one ended; the first condition keeps the alternatives away from all other characters
    return rf"(?=[{first}])(?:({both})([ \t]*+{line})|(\G{both}|{both}(?:{'|'.join(breaks)})|{'|'.join(cuts)}))"


def marked(df: DataFrame, text: str, out: str) -> DataFrame:
    """``out``: a line break, then the text with placeholders in it, and MARK before each unit but the first.

    One step a projection, as each step reads the one before more than once.
    """
    df = df.withColumn(out, F.concat(F.lit("\n"), _re(F.col(text), r"[\uE000-\uE00F]", "\ufffd")))
    df = df.withColumn(out, _addresses(F.col(out)))
    df = df.withColumn(out, _re(F.col(out), _stops(), _HIDDEN[0]))
    df = df.withColumn(out, _re(F.col(out), r"…(?=[\s\x85\p{Z}]*[\p{Ll},;])", _HIDDEN[3]))
    df = df.withColumn(out, _quotations(F.col(out)))
    to = f"$3$1{MARK}$2"
    return df.withColumn(out, F.when(F.col(out).rlike(f"[{_THAI}]"), _re(F.col(out), _boundaries(True), to)).otherwise(_re(F.col(out), _boundaries(False), to)))


def unit_offsets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), pieces: bool = False) -> DataFrame:
    """``keep``, ``__t`` (the text) and ``__u``: ARRAY<STRUCT<s INT, n INT>>, offset and length of each piece, white space included.

    Texts without letters (null and empty ones too) are left out. With ``pieces`` the structs hold the masked piece, too (``p``).
    """
    base = spread(df.select(*[F.col(k) for k in keep], F.col(text).alias("__t")).where(F.col("__t").isNotNull())).where(F.col("__t").rlike(r"\p{L}"))
    c = marked(base, "__t", "__m").withColumn("__q", F.split("__m", MARK, -1)).drop("__m")
    c = c.withColumn("__p", F.transform("__q", lambda p: F.length(p)))
    block = 64  # running sums in two steps, so that their cost stays far from quadratic in the pieces
    c = c.withColumn("__b", F.transform(F.sequence(F.lit(0), F.floor((F.size("__p") - 1) / block).cast("int")), lambda b: F.aggregate(F.slice("__p", b * block + 1, block), F.lit(0), lambda a, x: a + x)))
    c = c.withColumn("__o", F.transform("__b", lambda _, b: F.aggregate(F.slice("__b", 1, b), F.lit(0), lambda a, x: a + x))).drop("__b")
    # the first piece holds the line break in front of the text
    units = F.transform(
        "__p",
        lambda n, i: F.struct(
            F.greatest(F.lit(0), F.get("__o", F.floor(i / block).cast("int")) + F.aggregate(F.slice("__p", (F.floor(i / block) * block + 1).cast("int"), i % block), F.lit(-1), lambda a, x: a + x)).alias("s"),
            (n - (i == 0).cast("int")).alias("n"),
            *([F.get("__q", i).alias("p")] if pieces else []),
        ),
    )
    return c.select(*keep, "__t", units.alias("__u"))


def unit_starts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``sent_start`` of each unit; the masked pieces tell it, as no white space is masked."""
    out = unit_offsets(df, text, keep, pieces=True).select(*keep, F.explode_outer("__u").alias("u"))
    rest = F.length(F.regexp_replace("u.p", F.lit(r"\A[\s\x85\p{Z}]++"), F.lit("")))
    return out.select(*keep, (F.col("u.s") + F.col("u.n") - rest).alias("sent_start"), rest.alias("__r")).where(F.col("__r") > 0).drop("__r")


def sentence_units(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per sentence unit, see the module. Of the input's columns only ``keep`` is carried."""
    # the outer generator keeps the planner from working all expressions out once more in a filter below it
    out = unit_offsets(df, text, keep).select(*keep, "__t", F.explode_outer("__u").alias("u"))
    piece = F.expr("substring(__t, u.s + 1, u.n)")
    lead = F.length(piece) - F.length(F.regexp_replace(piece, F.lit(r"(?U)^\s+"), F.lit("")))
    out = out.select(*keep, (F.col("u.s") + lead).alias("sent_start"), F.regexp_replace(piece, F.lit(r"(?U)^\s+|\s+$"), F.lit("")).alias("sentence"))
    return out.where(F.length("sentence") > 0)
