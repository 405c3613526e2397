"""Cutting oversized texts at natural boundaries, with an overlap, by dynamic programming.

``split_oversized(df)`` gives, for each row whose text is longer than ``limit`` code points, its
pieces: ``piece_no``, ``piece_start``, ``piece_end`` (code points, end exclusive), ``boundary`` (what
the piece ends at) and ``piece``. A piece begins ``overlap`` code points before the end of the one
before; only where no natural end can be reached that way the overlap shrinks.

The programme minimises, over all sequences of cut positions, the sum of a penalty per cut (blank
line < line break < sentence < clause < word < overlap given up < within a word) and of the squared
deviation of piece lengths from even ones. A cut within a word is offered only inside a run without
white space and punctuation that is longer than the limit, so a document has such a cut if and only
if it holds such a run.

The texts of a batch are classified together and the programme runs over many texts at once: one
step works out the cheapest way to the j-th cut of each.

Defined results: null, empty and short texts (at most ``limit``) give no piece; repeated rows give
repeated pieces; ties between cut sequences go to the earlier cut. Cost is linear in the text for a
fixed limit, so very long texts are whole texts, not prefixes. Extra columns are ignored: only
``key`` and ``text`` are read.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import spread

KINDS = ("paragraph", "line", "sentence", "clause", "word", "forced", "end")
#: penalty of a cut of each kind
PENALTY = (0.0, 0.05, 0.1, 0.45, 1.0, 50.0, 0.0)
SHORT_OVERLAP = 1000.0  # times the share of the overlap that is given up: more than all other prices, so only what can't be helped
IMBALANCE = 2.0

#: texts classified, and texts cut side by side, at once
BATCH, GROUP = 2048, 256


def _classes() -> np.ndarray:
    """Of every code point: 0 plain, 1 white space, 2 line break, 3 punctuation, 4 that of a clause, 5 a sentence's end, 6 one that needs no space behind it, 7 a closing mark."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isspace():
            out[c] = 1
        elif ud.category(ch)[0] == "P":
            out[c] = 3
    for kind, chars in ((2, "\n\r\x85\u2028\u2029"), (4, ",;:،、；：，)]–—"), (5, ".!?…।؟"), (6, "。！？"), (7, "\"'”’»」』")):
        out[[ord(ch) for ch in chars]] = kind
    return out


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    return _classes()


def _candidates(texts: list[str], limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the cut positions with their kinds, 0 and the end included; the whole batch is classified at once.

    A text may be cut behind each run of white space and behind each run of punctuation that none follows. The kind of the cut
    is told by the line breaks of the run or by the mark before it.
    """
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(lens)])
    # a plain character between texts keeps their runs apart
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    k = _class_table()[cp]
    blank = (k == 1) | (k == 2)
    mark = k >= 3
    fresh = np.zeros(len(k), dtype=bool)  # the first character of a text
    fresh[first[:-1][lens > 0]] = True
    after_blank = blank & np.r_[~blank[1:] | fresh[1:], True]
    after_mark = mark & np.r_[(k[1:] == 0) | fresh[1:], True]
    ends = np.flatnonzero(after_blank | after_mark)
    starts = np.flatnonzero(blank & np.r_[True, ~blank[:-1] | fresh[1:]])
    run = np.searchsorted(starts, ends, side="right") - 1
    at_blank = blank[ends]
    head = np.where(at_blank, starts[run] if len(starts) else 0, ends + 1)  # where the white space starts
    lf = (k == 2) & ~((cp == 13) & np.r_[cp[1:] == 10, False])
    lines = np.concatenate([[0], np.cumsum(lf)])
    breaks = lines[ends + 1] - lines[head]
    owner = np.searchsorted(first, ends, side="right") - 1
    # the mark that stands before, closing marks left aside (at most four of them)
    last = head - 1
    for _ in range(4):
        closing = (last > first[owner]) & (k[np.maximum(last, 0)] == 7)
        last = last - closing
    before = np.where(last >= first[owner], k[np.maximum(last, 0)], 0)
    direct = np.where(head - 1 >= first[owner], k[np.maximum(head - 1, 0)], 0)
    kind = np.full(len(ends), 4, dtype=np.int64)
    kind[direct == 4] = 3
    kind[(before == 6) | ((before == 5) & at_blank)] = 2
    kind[breaks == 1] = 1
    kind[breaks > 1] = 0
    cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    out = []
    for d, n in enumerate(lens.tolist()):
        a, b = cuts[d], cuts[d + 1]
        pos, kd = ends[a:b] + 1 - first[d], kind[a:b]
        if len(pos) and pos[-1] == n:
            pos, kd = pos[:-1], kd[:-1]
        p, q = np.concatenate([[0], pos, [n]]), np.concatenate([[6], kd, [6]])
        wide = np.flatnonzero(np.diff(p) > limit)
        out.append(_filled(k[first[d] : first[d + 1]], p, q, wide, limit) if len(wide) else (p, q))
    return out


def _filled(k: np.ndarray, p: np.ndarray, kind: np.ndarray, wide: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaps over ``limit`` get more places: forced ones inside a run without white space and punctuation, word ends inside a longer separator."""
    add, kinds = [], []
    for i in wide:
        a, b = int(p[i]), int(p[i + 1])
        plain = np.flatnonzero(k[a:b] == 0)
        # the separator before b belongs to the gap: the run ends where it starts
        run_end = a + int(plain[-1]) + 1 if len(plain) else a
        if a < run_end < b:
            add.append(run_end)
            kinds.append(4)
        if b - run_end > limit:
            inner = list(range(run_end + max(1, limit // 2), b, max(1, limit // 14)))
            add += inner
            kinds += [4] * len(inner)
        if run_end - a > limit:
            inner = list(range(a + max(1, limit // 2), run_end, max(1, limit // 14)))
            add += inner
            kinds += [5] * len(inner)
    p, kind = np.concatenate([p, add]).astype(np.int64), np.concatenate([kind, kinds]).astype(np.int64)
    order = np.argsort(p, kind="stable")
    return p[order], kind[order]


def _steps(new: np.ndarray, even: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """What a piece costs that brings ``new`` characters and is not the first one."""
    short = np.maximum(new - (limit - overlap), 0.0)
    return np.where(new > limit, np.inf, IMBALANCE * ((new - even) / limit) ** 2 + SHORT_OVERLAP / max(1, overlap) * short)


def _programme(cuts: list[tuple[np.ndarray, np.ndarray]], limit: int, overlap: int) -> list[list[tuple[int, int, int]]]:
    """The cheapest sequences of cuts of texts that are alike in their numbers of cuts: one step serves all of them."""
    size = np.array([len(p) for p, _ in cuts])
    order = np.argsort(-size, kind="stable")
    d, m = len(cuts), int(size.max())
    pos = np.full((m, d), np.inf)
    price = np.zeros((m, d))
    penalty = np.asarray(PENALTY)
    for c, i in enumerate(order):
        p, k = cuts[i]
        pos[: len(p), c] = p
        price[: len(p), c] = penalty[k]
    n = np.array([cuts[i][0][-1] for i in order], dtype=float)
    even = (n - overlap) / np.maximum(2, np.ceil((n - overlap) / (limit - overlap)))  # new characters of a piece when all are even
    scale = IMBALANCE**0.5 / limit
    scaled = pos * scale
    cost = np.full((m, d), np.inf)
    cost[0] = 0.0
    active = np.searchsorted(-size[order], -np.arange(1, m + 1), side="right")  # texts with more than j cuts
    low = far = 0
    for j in range(1, m):
        a = int(active[j])
        here = pos[j, :a]
        # the first place that any of the texts can still reach from here
        while low < j - 1 and (here - pos[low, :a] > limit).all():
            low += 1
        t = (scaled[j, :a] - even[:a] * scale) - scaled[low:j, :a]
        t *= t
        t += cost[low:j, :a]
        # only the farther places cost overlap, or are out of reach
        far = max(far, low)
        while far < j and (here - pos[far, :a] > limit - overlap).any():
            far += 1
        if far > low:
            new = here - pos[low:far, :a]
            extra = np.maximum(new - (limit - overlap), 0.0) * (SHORT_OVERLAP / max(1, overlap))
            if low == 0:
                extra[0] = 0.0  # the first piece has no overlap
            extra[new > limit] = np.inf
            t[: far - low] += extra
        cost[j, :a] = t.min(axis=0) + price[j, :a]
    out: list[list[tuple[int, int, int]]] = [[] for _ in cuts]
    for c, i in enumerate(order):
        p, k = cuts[i]
        j = len(p) - 1
        row = cost[:, c]
        while j > 0:
            b = int(np.searchsorted(p, p[j] - limit))
            x = row[b:j] + _steps((p[j] - p[b:j]).astype(float), even[c], limit, overlap)
            if b == 0:
                x[0] = IMBALANCE * ((p[j] - even[c]) / limit) ** 2
            best = b + int(np.argmin(np.round(x, 9)))
            start = 0 if best == 0 else int(max(0, p[best] - min(overlap, limit - (p[j] - p[best]))))
            out[i].append((start, int(p[j]), int(k[j])))
            j = best
        out[i].reverse()
    return out


def cut_texts(texts: list[str], limit: int = 700, overlap: int = 100) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind of the end) of each piece of each text longer than ``limit``."""
    out: list[list[tuple[int, int, int]]] = []
    done: dict[int, list[tuple[int, int, int]]] = {}
    for lo in range(0, len(texts), BATCH):
        part = texts[lo : lo + BATCH]
        cuts = _candidates(part, limit)
        # texts of like density and number of cuts are worked on side by side
        dense = [int(len(p) * limit / max(1, p[-1])).bit_length() for p, _ in cuts]
        order = sorted(range(len(cuts)), key=lambda i: (dense[i], len(cuts[i][0])))
        for g in range(0, len(order), GROUP):
            ids = order[g : g + GROUP]
            for i, pieces in zip(ids, _programme([cuts[i] for i in ids], limit, overlap), strict=True):
                done[i] = pieces
        out += [done[i] for i in range(len(part))]
        done.clear()
    return out


def cut_positions(text: str, limit: int = 700, overlap: int = 100) -> list[tuple[int, int, int]]:
    """(start, end, kind of the end) of each piece of one text."""
    return cut_texts([text], limit, overlap)[0]


def split_oversized(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 700, overlap: int = 100, with_piece: bool = True) -> DataFrame:
    """Pieces of the texts longer than ``limit``, see the module; ``with_piece`` False leaves their text out."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (key_, no, s, e, KINDS[kd], *([t[s:e]] if with_piece else []))
                for key_, t, pieces in zip(b["__key"], b["__text"], cut_texts(b["__text"].tolist(), limit, overlap), strict=True)
                for no, (s, e, kd) in enumerate(pieces)
            ]
            yield pd.DataFrame(rows, columns=[key, "piece_no", "piece_start", "piece_end", "boundary", *(["piece"] if with_piece else [])])

    long = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.length("__text") > limit)
    return spread(long).mapInPandas(run, f"`{key}` {kind}, piece_no int, piece_start int, piece_end int, boundary string" + (", piece string" if with_piece else ""))


