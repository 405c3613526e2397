"""Language of documents and of the segments of mixed ones, by string kernels.

Two sentences are as alike as the character n-grams (n = 1..4, blended) they have in common: the
presence kernel k(x, y) = |g(x) & g(y)| / sqrt(|g(x)| |g(y)|). A Nystroem map over landmark
sentences and one ridge regression per language (one against the rest) are fitted on the sentences
of a bounded sample of labelled documents, ``PER_LABEL`` of each label; further fits leave out
the sentences that the one before puts elsewhere, as labels may be wrong and documents mixed. Kernel, map and
regression are linear in the presence vectors, so they collapse into one n-gram x language matrix;
a batch of sentences is scored as the product of its (sparse) presence matrix with that matrix.

Each document's sentences (the units of ``sentences``) are then decoded together: a change of
language costs ``SWITCH``, so a short or foreign-named sentence makes no segment by itself. Units
without evidence (records, figures) go with the segment they stand in.

Documents that fit none of the languages (their mean score is under that of nearly all training
sentences) are one segment of language ``und``; a label that names a language the model has not
learned is believed unless the document fits a known one well.

Defined results: null, empty and letterless texts give no segment; repeated rows give repeated
segments; if no row of the table is labelled, every segment has language ``und`` and confidence 0.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sentences import unit_offsets

#: documents of each label whose sentences train the model, at most
PER_LABEL = 150
#: sentences of each language used as landmarks, at most, and for the fit
LANDMARKS, FIT = 40, 400
BITS = 18
SIZES = (1, 2, 3, 4)
RIDGE = 1e-2
ROUNDS = 3
#: code points of a training text that are used, at most
PER_TEXT = 20_000
#: sentences scored at once, and code points of documents worked on at once
CHUNK, BLOCK = 8192, 500_000
SHARP, SWITCH, LEAST = 9.0, 2.5, 0.004
#: bytes of letters from which a unit counts in full
FULL = 20
#: shares of the training sentences whose scores are lower than what is taken for no known language, and than what outdoes a label of another language
LEAST_SCORE, DOUBT = 0.0005, 0.1

# Codes a label may stand for in another spelling.
ALIASES = {
    "tr": "tur turkish türkçe turkce", "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français",
    "es": "spa spanish español", "az": "aze azj azerbaijani", "ru": "rus russian", "ar": "ara arb arabic",
    "zh": "zho chi cmn chinese", "ja": "jpn jp japanese", "hi": "hin hindi", "th": "tha thai",
}
MISSING = ("", "und", "unknown", "none", "null", "n/a", "?")


def plain_label(c: Column) -> Column:
    """Two-letter code that a label names, null where it names none; a spelling that is not known stays as it is."""
    c = F.lower(F.trim(c))
    stem = F.regexp_extract(c, r"^([^-_]*)", 1)
    table = F.create_map(*[F.lit(x) for code, names in ALIASES.items() for name in names.split() for x in (name, code)])
    return F.when(c.isNull() | c.isin(*MISSING) | stem.isin(*MISSING), F.lit(None)).otherwise(F.coalesce(table[stem], stem))


SPACE, DIGIT, LETTER = 1, 2, 3


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        kind = ud.category(ch)
        out[c] = SPACE if ch.isspace() else DIGIT if kind == "Nd" else LETTER if kind[0] == "L" else 0
    return out


_ASCII_TR = str.maketrans("çğıöşüâîû", "cgiosuaiu")


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _lower(s: str) -> str:
    """Lower case, character by character."""
    low = s.replace("İ", "i").lower()
    return low if len(low) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


def _runs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all spans, one after the other, and the span of each."""
    owner = np.repeat(np.arange(len(start)), size)
    return np.arange(len(owner)) + (start - (np.cumsum(size) - size))[owner], owner


class Units:
    """Spans of texts, without outer white space, in the folded form that grams are taken from: small letters, a figure 0 for each number, a space at both ends."""

    def __init__(self, texts: list[str], starts: list[np.ndarray]):
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        base = np.cumsum(lens) - lens
        joined = "".join(texts)
        cp, low = _points(joined), _points(_lower(joined)).copy()
        count = np.array([len(x) for x in starts], dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), count)
        s = np.concatenate([np.zeros(0, np.int64), *starts]).astype(np.int64) + base[doc]
        e = np.append(s[1:], len(cp))
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
        e[last] = (base + lens)[doc[last]]
        kind = _kinds()[cp]
        solid = np.flatnonzero(kind != SPACE)
        i, j = np.searchsorted(solid, s), np.searchsorted(solid, e)
        has = j > i
        self.doc, a, z = doc[has], solid[i[has]], solid[j[has] - 1] + 1
        self.start = a - base[self.doc]
        self.n = len(a)
        at, owner = _runs(a, z - a)
        kind, c = kind[at], low[at]
        # a unit tells nothing about its language that is a record (mostly one long run of ASCII) or has hardly a letter
        ascii_ = (cp >= 33) & (cp <= 126)
        turn = np.flatnonzero(np.diff(np.concatenate([[0], ascii_.view(np.int8), [0]])))
        long = np.zeros(len(cp) + 1, dtype=np.int32)
        wide = (turn[1::2] - turn[::2]) >= 21
        long[turn[::2][wide]] += 1
        long[turn[1::2][wide]] -= 1
        record = np.cumsum(long)[:-1][at] > 0
        size = z - a
        rest = size - np.bincount(owner, record, minlength=self.n).astype(np.int64)
        letters = np.bincount(owner, (kind == LETTER) & ~record, minlength=self.n)
        self.bare = ((rest < size) & (rest < 25) & (size - rest > rest)) | (letters < 2)
        # a short unit, such as a heading, weighs less: by the bytes of its letters
        heavy = ((kind == LETTER) & ~record) * (1.0 + (c >= 0x80) + (c >= 0x800))
        self.weight = np.minimum(1.0, np.bincount(owner, heavy, minlength=self.n) / FULL)
        digit = kind == DIGIT
        c[digit] = 48
        again = digit & np.r_[False, digit[:-1] & (owner[1:] == owner[:-1])] if len(digit) else digit
        self.c, self.owner = c[~again], owner[~again]

    def part(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters and their unit of units lo to hi, spaces added."""
        i, j = np.searchsorted(self.owner, [lo, hi])
        own = self.owner[i:j] - lo
        size = np.bincount(own, minlength=hi - lo) + 2
        c = np.full(int(size.sum()), 32, dtype=np.uint32)
        c[np.arange(j - i) + 2 * own + 1] = self.c[i:j]
        return c, np.repeat(np.arange(hi - lo, dtype=np.uint32), size)


def _grams(c: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, gram) of each gram present, both sorted; grams are hashed to BITS bits, units are fewer than 2 ** (32 - BITS)."""
    keys = []
    h = np.zeros(len(c), dtype=np.uint32)
    for n in range(1, max(SIZES) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x9E3779B1) + c[n - 1 :] + np.uint32(n)
        if n in SIZES:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            key = owner[:m] << np.uint32(BITS) | mixed >> np.uint32(32 - BITS)
            keys.append(key if n == 1 else key[owner[:m] == owner[n - 1 :]])
    k = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint32)
    k = k[np.r_[True, k[1:] != k[:-1]]] if len(k) else k
    return (k >> np.uint32(BITS)).astype(np.int64), (k & np.uint32((1 << BITS) - 1)).astype(np.int64)


class Model:
    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table
        self.known = (table != 0).any(axis=1)
        # scores of documents: under ``least`` they are in none of the languages, under ``doubt`` a label that names none of them is believed
        self.least = self.doubt = -np.inf

    def scores(self, units: Units) -> np.ndarray:
        """units x languages."""
        parts = [self._scores(*units.part(i, min(units.n, i + CHUNK)), min(units.n, i + CHUNK) - i) for i in range(0, units.n, CHUNK)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), dtype=np.float32)

    def _scores(self, c: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        who, gram = _grams(c, owner)
        size = np.bincount(who, minlength=n).astype(np.float32)
        use = self.known[gram]
        who, gram = who[use], gram[use]
        out = np.zeros((n, len(self.langs)), dtype=np.float32)
        if len(who):
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            out[who[first]] = np.add.reduceat(self.table[gram], first, axis=0)
        return out / np.sqrt(np.maximum(size, 1))[:, None]


def _nothing() -> Model:
    out = Model(["und"], np.zeros((1 << BITS, 1), dtype=np.float32))
    out.least = np.inf
    return out


def _whole(texts: list[str]) -> Units:
    """Each text as one unit."""
    return Units(texts, [np.zeros(1, np.int64)] * len(texts))


def fit(texts: list[str], labels: list[str], langs: list[str]) -> Model:
    """The collapsed model of landmark map and ridge regressions."""
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(7)
    order = rng.permutation(len(texts))
    rank = np.zeros(len(texts), dtype=int)
    seen: dict[int, int] = {}
    for i in order:
        rank[i] = seen[y[i]] = seen.get(y[i], -1) + 1
    keep = np.flatnonzero(rank < FIT)
    texts, y, rank = [texts[i] for i in keep], y[keep], rank[keep]
    units = _whole(texts)
    parts = [_grams(*units.part(i, min(units.n, i + CHUNK))) for i in range(0, units.n, CHUNK)]
    who = np.concatenate([w + i * CHUNK for i, (w, _) in enumerate(parts)])
    gram = np.concatenate([g for _, g in parts])
    size = np.sqrt(np.bincount(who, minlength=len(texts)))
    marks = np.flatnonzero(rank < LANDMARKS)
    column = np.full(len(texts), -1)
    column[marks] = np.arange(len(marks))
    on = column[who] >= 0
    have = np.unique(gram[on])  # only grams of landmarks count: their rows, not 2 ** BITS of them
    dense = np.zeros((len(have), len(marks)), dtype=np.float32)
    dense[np.searchsorted(have, gram[on]), column[who[on]]] = 1.0 / size[who[on]]
    at = np.searchsorted(have, gram)
    at[at == len(have)] = 0
    known = have[at] == gram
    who, gram = who[known], at[known]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    ends = np.r_[first[1:], len(who)]
    k = np.zeros((len(texts), len(marks)), dtype=np.float64)
    for a, b in zip(first, ends, strict=True):
        k[who[a]] = dense[gram[a:b]].sum(axis=0) / size[who[a]]
    value, vector = np.linalg.eigh(k[marks] + 1e-6 * np.eye(len(marks)))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    z = k @ root
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, 0.0)
    beta = np.linalg.solve(z.T @ z + RIDGE * len(texts) / len(langs) * np.eye(z.shape[1]), z.T @ target)
    table = np.zeros((1 << BITS, len(langs)), dtype=np.float32)
    table[have] = dense @ (root @ beta).astype(np.float32)
    return Model(langs, table)


def train(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = PER_LABEL) -> Model | None:
    """Fits the model on at most ``per_label`` documents of each known label, chosen by a hash of the key."""
    known = df.select(F.col(key).alias("k"), plain_label(F.col(label)).alias("y")).where(F.col("y").isin(*ALIASES))
    w = Window.partitionBy("y").orderBy(F.xxhash64("k"), "k")
    chosen = known.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_label).select("k", "y").distinct()
    picked = df.select(F.col(key).alias("k"), F.substring(F.col(text), 1, PER_TEXT).alias("t")).join(F.broadcast(chosen), "k")  # at most per_label x 12 keys
    rows = unit_offsets(picked, "t", ("k", "y")).collect()
    texts, labels = [], []
    units = Units([r["__t"] for r in rows], [np.array([u["s"] for u in r["__u"]], dtype=np.int64) for r in rows])
    ends = np.append(units.start[1:], 0)
    for i in np.flatnonzero(~units.bare).tolist():
        r = rows[units.doc[i]]
        end = ends[i] if i + 1 < units.n and units.doc[i + 1] == units.doc[i] else len(r["__t"])
        x = r["__t"][units.start[i] : end].strip()
        if len(x) >= 12:
            texts.append(x)
            labels.append(r["y"])
            if r["y"] == "tr" and len(texts) % 2:  # Turkish is also typed without its own letters
                texts.append(_lower(x).translate(_ASCII_TR))
                labels.append("tr")
    langs = sorted(set(labels))
    if not langs:
        return None
    own = np.array([langs.index(x) for x in labels])
    ok = np.ones(len(texts), dtype=bool)
    every = _whole(texts)
    for _ in range(ROUNDS):
        model = fit([t for t, o in zip(texts, ok, strict=True) if o], [x for x, o in zip(labels, ok, strict=True) if o], langs)
        now = model.scores(every).argmax(axis=1) == own
        now |= ~np.isin(own, np.unique(own[now]))  # a language whose sentences are all put elsewhere keeps them
        if (now == ok).all():
            break
        ok = now
    top = model.scores(every).max(axis=1)[ok]
    model.least, model.doubt = np.quantile(top, [LEAST_SCORE, DOUBT])
    return model


def _chances(score: np.ndarray) -> np.ndarray:
    """Logarithms of the languages' shares, LEAST at least."""
    e = SHARP * score.astype(np.float64)
    e = e - e.max(axis=1, keepdims=True)
    return np.maximum(e - np.log(np.exp(e).sum(axis=1, keepdims=True)), np.log(LEAST))


def decode(logp: np.ndarray) -> np.ndarray:
    """The best languages of one document's units; each change costs SWITCH."""
    rows = logp.tolist()
    best, backs = rows[0], [()]
    for row in rows[1:]:
        top = max(best)
        at, low = best.index(top), top - SWITCH
        backs.append([i if x >= low else at for i, x in enumerate(best)])
        best = [(x if x >= low else low) + y for x, y in zip(best, row, strict=True)]
    path = np.zeros(len(rows), dtype=np.int64)
    now = best.index(max(best))
    for i in range(len(rows) - 1, -1, -1):
        path[i] = now
        if i:
            now = backs[i][now]
    return path


def _segmented(units: Units, score: np.ndarray, least: float) -> dict[str, np.ndarray]:
    """Of each segment: document, number, number of segments, start, language (-1: none), confidence, score of its document."""
    first = np.flatnonzero(np.r_[True, units.doc[1:] != units.doc[:-1]])
    ends = np.append(first[1:], units.n)
    which = np.repeat(np.arange(len(first)), ends - first)
    bare = units.bare & ~np.logical_and.reduceat(units.bare, first)[which]  # units that tell little count where there are no others
    logp = _chances(score)
    weighed = logp * np.where(bare, 0.0, np.maximum(units.weight, 0.05))[:, None]
    path = weighed.argmax(axis=1)
    # a document whose units are all best in one language is in it; the others are decoded
    high, low = np.where(bare, -1, path), np.where(bare, score.shape[1], path)
    high, low = np.maximum.reduceat(high, first), np.minimum.reduceat(low, first)
    path = high[which]
    for d in np.flatnonzero(high != low).tolist():
        path[first[d] : ends[d]] = decode(weighed[first[d] : ends[d]])
    rows = np.arange(units.n)
    n = np.add.reduceat((~bare).astype(np.int64), first)
    fit = np.add.reduceat(np.where(bare, 0.0, score[rows, path]), first) / np.maximum(n, 1)  # of a document
    none = (fit < least)[which]
    path[none] = -1
    cut = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (units.doc[1:] != units.doc[:-1])])
    d = which[cut]
    segs = np.bincount(d, minlength=len(first))
    sure = np.where(bare | none, 0.0, np.exp(logp[rows, path]))
    return {
        "doc": units.doc[cut], "seg_no": np.arange(len(cut)) - (np.cumsum(segs) - segs)[d], "n_segs": segs[d],
        "seg_start": units.start[cut], "lang": path[cut], "confidence": np.add.reduceat(sure, cut) / np.maximum(np.add.reduceat((~bare).astype(np.int64), cut), 1), "fit": fit[d],
    }


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Documents of at most BLOCK code points together, or one."""
    lo = size = 0
    for i, n in enumerate(sizes):
        if i > lo and size + n > BLOCK:
            yield lo, i
            lo, size = i, 0
        size += n
    if sizes:
        yield lo, len(sizes)


def segments(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """Per document and segment: ``key``, ``keep``, seg_no, n_segs, seg_start, seg_lang, confidence."""
    kinds = dict(df.dtypes)
    cols = [key, *keep]
    # no model: one language, that nothing is in
    shared = df.sparkSession.sparkContext.broadcast(model or _nothing())  # 12 MB whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            texts, starts = b["__t"].tolist(), b["__s"].tolist()
            for lo, hi in _blocks([len(t) for t in texts]):
                units = Units(texts[lo:hi], starts[lo:hi])
                if not units.n:
                    continue
                x = _segmented(units, m.scores(units), m.least)
                out = b[cols].iloc[x["doc"] + lo].reset_index(drop=True)
                yield out.assign(**{c: x[c] for c in ("seg_no", "n_segs", "seg_start")}, seg_lang=np.array([*m.langs, "und"])[x["lang"]], confidence=x["confidence"], fit=x["fit"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), "seg_no int, n_segs int, seg_start bigint, seg_lang string, confidence double, fit double"])
    return unit_offsets(df, text, tuple(cols)).select(*cols, "__t", F.col("__u.s").alias("__s")).mapInPandas(run, schema)


def mislabelled(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", model: Model | None = None) -> DataFrame:
    """Segments, with confidence, of the documents that mix languages or whose label is missing or names another language.

    A label that names a language the model has not learned is believed where no language of the model fits well.
    """
    model = model or train(df, text, label, key)
    s = segments(df, model, key, text, (label,))
    named = plain_label(F.col(label))
    case = (F.col("n_segs") > 1) | named.isNull() | (named != F.col("seg_lang"))
    if model is not None:
        case = case & (named.isNull() | named.isin(*model.langs) | (F.col("fit") >= float(model.doubt)))
    return s.where(case).select(key, "seg_start", F.col("seg_lang").alias("lang"), "confidence")
