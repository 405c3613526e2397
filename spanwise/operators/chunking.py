"""Cutting articles into chunks: fixed windows, packed sentences, sections.

Input: doc_id, title, text, url (others ignored). Output per chunk: chunking, doc_id, chunk_no
(0-based, counting kept chunks), title, url, heading_path, body. (doc_id, chunk_no) orders all
chunks; a global number is never made.

Null and empty texts give no chunk; repeated rows give repeated chunks. Everything is expressions
over one row; texts are cut by folds over sentence lengths, not over growing strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HEADING, WS, let, split_sentences
from ..plans.lineage import spread

LEAST = 50
STRATEGIES = ("fixed", "sentence", "hierarchical")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(rf"^{WS}+|{WS}+$"), F.lit(""))


def _base(docs: DataFrame) -> DataFrame:
    return spread(docs.where(F.col("text").isNotNull()).select("doc_id", F.col("title"), F.coalesce("url", F.lit("")).alias("url"), "text"))


def _numbered(df: DataFrame, pieces: str, chunking: str) -> DataFrame:
    """One row per element of an array of (heading_path, body).

    The outer generator and the filter behind it keep the planner from copying the whole array expression into a
    filter below the generator, where it would be worked out once more.
    """
    return df.select(F.lit(chunking).alias("chunking"), "doc_id", F.posexplode_outer(pieces).alias("chunk_no", "p"), "title", "url").where(F.col("p").isNotNull()).select(
        "chunking", "doc_id", "chunk_no", "title", "url", F.col("p.heading_path"), F.col("p.body")
    )


def chunk_fixed(docs: DataFrame, size: int = 700, overlap: int = 100) -> DataFrame:
    """C4: windows of ``size`` characters every ``size - overlap``; windows of 50 characters or less are dropped."""
    step = size - overlap
    flat = F.trim(F.regexp_replace(F.regexp_replace("text", F.lit(HEADING), F.lit(" ")), F.lit(WS + "+"), F.lit(" ")))
    d = _base(docs).withColumn("t", flat).where(F.length("t") > 0)
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / step).cast("int")), lambda i: F.trim(F.substring(F.col("t"), i * step + 1, F.lit(size))))
    kept = F.transform(F.filter(windows, lambda w: F.length(w) > LEAST), lambda w: F.struct(F.col("title").alias("heading_path"), w.alias("body")))
    return _numbered(d.withColumn("p", kept), "p", "fixed")


def _pack(sentences: Column, size: int) -> Column:
    """Greedy packing; the last buffer has to be longer than 50 characters."""
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("len"), F.lit(0).alias("i"))

    def step(a: Column, s: Column) -> Column:
        over = (a["len"] > 0) & (a["len"] + F.length(s) + 1 > size)
        first = a["len"] == 0
        return F.struct(
            F.when(over | first, F.concat(a["cuts"], F.array(a["i"]))).otherwise(a["cuts"]).alias("cuts"),
            F.when(over | first, F.length(s)).otherwise(a["len"] + F.length(s) + 1).alias("len"),
            (a["i"] + 1).alias("i"),
        )

    def bodies(s: Column, cuts: Column) -> Column:
        return F.transform(cuts, lambda c, i: F.array_join(F.slice(s, c + 1, F.coalesce(F.get(cuts, i + 1), F.size(s)) - c), " "))

    def kept(b: Column) -> Column:
        return F.filter(b, lambda x, i: (i < F.size(b) - 1) | (F.length(x) > LEAST))

    return let(sentences, lambda s: let(F.aggregate(s, start, step, lambda a: a["cuts"]), lambda c: let(bodies(s, c), kept)))


def _sentences(text: Column) -> Column:
    flat = F.regexp_replace(text, F.lit("[ \t]+"), F.lit(" "))
    return F.filter(F.transform(split_sentences(flat), _trim), lambda s: F.length(s) > 0)


def chunk_sentence(docs: DataFrame, size: int = 700) -> DataFrame:
    """Sentences packed up to ``size``; a longer sentence stays whole."""
    d = _base(docs).withColumn("s", _sentences(F.regexp_replace("text", F.lit(HEADING), F.lit(" "))))
    d = d.withColumn("b", _pack(F.col("s"), size))
    return _numbered(d.withColumn("p", F.transform("b", lambda b: F.struct(F.col("title").alias("heading_path"), b.alias("body")))), "p", "sentence")


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, title, url, section_no, heading_path, section: articles cut at headings, with the path of open headings."""
    d = _base(docs).withColumns({
        "depths": F.transform(F.regexp_extract_all("text", F.lit(HEADING), F.lit(1)), lambda x: F.length(x) - 1),
        "names": F.regexp_extract_all("text", F.lit(HEADING), F.lit(2)),
        "bodies": F.split("text", HEADING, -1),
    })
    heads = F.arrays_zip("depths", "names")
    zero = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("paths"))

    def step(a: Column, h: Column) -> Column:
        now = F.concat(F.slice(a["open"], F.lit(1), h["depths"] - 1), F.array(h["names"]))
        return F.struct(now.alias("open"), F.concat(a["paths"], F.array(F.array_join(F.concat(F.array(F.coalesce("title", F.lit(""))), now), " > "))).alias("paths"))

    d = d.withColumn("paths", F.concat(F.array(F.coalesce("title", F.lit(""))), F.aggregate(heads, zero, step, lambda a: a["paths"])))
    cut = d.select("doc_id", "title", "url", F.posexplode_outer(F.arrays_zip("paths", "bodies")).alias("section_no", "x"))
    return cut.select("doc_id", "title", "url", "section_no", F.col("x.paths").alias("heading_path"), _trim(F.col("x.bodies")).alias("section")).where(F.length("section") > 0)


def chunk_hierarchical(docs: DataFrame, size: int = 700) -> DataFrame:
    """Each section packed by itself. Sections stay in their article's row, so numbering needs no shuffle."""
    s = _base(docs).withColumns({
        "depths": F.transform(F.regexp_extract_all("text", F.lit(HEADING), F.lit(1)), lambda x: F.length(x) - 1),
        "names": F.regexp_extract_all("text", F.lit(HEADING), F.lit(2)),
        "bodies": F.transform(F.split("text", HEADING, -1), _trim),
    })
    heads = F.arrays_zip("depths", "names")
    zero = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("paths"))

    def step(a: Column, h: Column) -> Column:
        now = F.concat(F.slice(a["open"], F.lit(1), h["depths"] - 1), F.array(h["names"]))
        return F.struct(now.alias("open"), F.concat(a["paths"], F.array(F.array_join(F.concat(F.array(F.coalesce("title", F.lit(""))), now), " > "))).alias("paths"))

    s = s.withColumn("paths", F.concat(F.array(F.coalesce("title", F.lit(""))), F.aggregate(heads, zero, step, lambda a: a["paths"])))
    s = s.withColumn("sents", F.transform("bodies", _sentences))
    s = s.withColumn("packs", F.transform("sents", lambda x: _pack(x, size)))
    pieces = F.flatten(F.transform(F.arrays_zip("paths", "packs"), lambda z: F.transform(z["packs"], lambda b: F.struct(z["paths"].alias("heading_path"), b.alias("body")))))
    return _numbered(s.withColumn("p", pieces), "p", "hierarchical")


def chunk_all(docs: DataFrame, size: int = 700) -> DataFrame:
    """The three strategies side by side."""
    return chunk_fixed(docs, size).unionByName(chunk_sentence(docs, size)).unionByName(chunk_hierarchical(docs, size))


def chunk_sizes(docs: DataFrame, sizes: tuple[int, ...] = (300, 500, 700, 1000, 1500)) -> DataFrame:
    """Sweep over window sizes, with a column ``size``."""
    out = None
    for n in sizes:
        one = chunk_fixed(docs, n).withColumn("size", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id and the text that is embedded."""
    return chunks.withColumns({
        "chunk_id": F.concat(F.col("doc_id").cast("string"), F.lit("::"), F.col("chunk_no").cast("string")),
        "embed_text": F.concat(F.coalesce("heading_path", F.lit("")), F.lit("\n"), F.col("body")),
    })
