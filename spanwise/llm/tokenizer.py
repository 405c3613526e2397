"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens; its states say what may follow the token just read. It is compiled by
successive merge gadgets, in the order of the merges' ranks. The gadget of the merge (x, y) of rank
j takes away every arc v behind a token u, where x stood at the end of u and y at the start of v
when merge j had its turn: u ends in x, in a part that no merge before j had joined, and v starts
with y likewise. Along the chains of last parts (u, its right part, the right part of that, ...) the
tokens that end so in x are one interval of a depth-first numbering, if later merges are numbered
first; so are those that start with y along the chains of first parts. A gadget is therefore a
rectangle of forbidden arcs, and tokens that lie in the same rectangles are one state. A state's
table holds the intervals of tokens that it has no arc for; every other token leads to that token's
state. Compiled, a vocabulary of 50,000 tokens has about 17,000 states and 400,000 such intervals.

A word has exactly one path through the automaton, and so has every prefix of it. Encoding walks all
distinct words of a block of texts side by side: from each position, whose state is known by then,
the arcs are read off the token trie and the state's table, and each arc that exists sets the
state of the position where it ends. Decoding emits the labels' bytes.

Words are the pieces of the vocabulary's pre-splitting pattern (``PATTERN``), found by classes of
characters for a whole block at once. Defined results: the empty list for null and for empty
texts; no special tokens, their strings are ordinary text; repeated rows give equal lists.
"""

from __future__ import annotations

import base64
import unicodedata as ud
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import spread

#: the pre-splitting rule of the vocabulary (fixed value), which ``word_starts`` follows
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: characters that count as white space there (fixed value)
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: code points worked on at once (one text may have more), and bytes of words walked side by side
BLOCK, WALK = 1_000_000, 2_000_000
LETTER, NUMBER, SPACE, OTHER = range(4)


def _numbered(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Depth-first numbers of a forest, younger children first: number, end of the subtree, children with the youngest first."""
    n = len(parent)
    kids: list[list[int]] = [[] for _ in range(n)]
    for c in range(n - 1, -1, -1):
        if parent[c] >= 0:
            kids[parent[c]].append(c)
    number, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    size = np.ones(n, np.int64)
    for c in range(n - 1, -1, -1):  # parts are older than what they make, but for tokens that come out of order
        if parent[c] >= 0 and parent[c] > c:
            raise ValueError("a token's part is younger than the token")
    for c in range(n - 1, -1, -1):
        if parent[c] >= 0:
            size[parent[c]] += size[c]
    at = 0
    for c in range(n):
        if parent[c] < 0:
            number[c] = at
            at += size[c]
    for c in range(n):
        at = number[c] + 1
        for k in kids[c]:
            number[k] = at
            at += size[k]
    end = number + size
    return number, end, kids


class Automaton:
    def __init__(self, ranks: dict[bytes, int]):
        byte_ids = {t: i for t, i in ranks.items() if len(t) == 1}
        if len(byte_ids) < 256:
            raise ValueError("the vocabulary lacks a single byte")
        # tokens by age: single bytes, then merges in the order of their ranks
        tokens = sorted(byte_ids, key=byte_ids.__getitem__) + sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__)
        self.ids = np.array([ranks[t] for t in tokens], dtype=np.int32)
        self._gadgets(tokens)
        self._states()
        self._trie(tokens)
        self.labels = tokens
        self.of_id = {int(i): k for k, i in enumerate(self.ids)}

    @classmethod
    def load(cls, path: str) -> Automaton:
        ranks: dict[bytes, int] = {}
        for line in Path(path).read_bytes().splitlines():
            if line:
                token, _, rank = line.partition(b" ")
                ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks)

    # compilation

    def _gadgets(self, tokens: list[bytes]) -> None:
        """The two parts that each merge joins, in the order of ranks; a token whose parts never meet has no gadget."""
        n = len(tokens)
        place = {t: i for i, t in enumerate(tokens)}
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.live = np.ones(n, dtype=bool)
        left, right = [-1] * n, [-1] * n
        joined: dict[tuple[int, int], int] = {}
        for i in range(256, n):
            t = tokens[i]
            for cut in range(1, len(t)):
                u, v = place.get(t[:cut], n), place.get(t[cut:], n)
                if u < i and v < i and self.live[u] and self.live[v] and self._met(u, v, i, joined, left, right):
                    left[i], right[i] = u, v
                    joined[u, v] = i
                    break
            else:
                self.live[i] = False
        self.left[:], self.right[:] = left, right
        self.joined = joined

    @staticmethod
    def _met(u: int, v: int, before: int, joined: dict[tuple[int, int], int], left: list[int], right: list[int]) -> bool:
        """Whether u and v stand side by side once all merges before that one have had their turn: the seam is undone, younger side first."""
        limit = before
        while True:
            j = joined.get((u, v))
            if j is not None and j < limit:
                return False
            au, av = u if left[u] >= 0 else -1, v if left[v] >= 0 else -1
            if au < 0 and av < 0:
                return True
            # of two of one age the right one is undone first, as the left one is joined first
            if au > av:
                limit, u = au, right[u]
            else:
                limit, v = av + 1, left[v]

    def _states(self) -> None:
        """Each gadget's rectangle of forbidden arcs, cut into states and their tables."""
        ends_in, end_r, kids_r = _numbered(self.right)
        starts_with, end_l, kids_l = _numbered(self.left)
        rows = []
        neg_r = [[-k for k in ks] for ks in kids_r]
        neg_l = [[-k for k in ks] for ks in kids_l]
        for (x, y), j in self.joined.items():
            # what later merges made of x keeps it at its end until then; so does what merge j and later ones made of y
            i, k = bisect_left(neg_r[x], -j), bisect_right(neg_l[y], -j)
            rows.append((ends_in[x], end_r[kids_r[x][i - 1]] if i else ends_in[x] + 1, starts_with[y], end_l[kids_l[y][k - 1]] if k else starts_with[y] + 1))
        box = np.array(rows, dtype=np.int64).reshape(-1, 4)
        edges = np.unique(np.concatenate([[0], box[:, 0], box[:, 1]]))
        self.state = np.searchsorted(edges, ends_in, side="right") - 1  # of the token just read
        self.states = len(edges)
        self.column = starts_with  # of the token to come
        a, b = np.searchsorted(edges, box[:, 0]), np.searchsorted(edges, box[:, 1])
        reach = b - a
        of = np.repeat(np.arange(len(box)), reach)
        s = np.repeat(a - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())
        self.width = len(self.ids) + 1
        low, high = s * self.width + box[of, 2], s * self.width + box[of, 3]
        order = np.lexsort((-high, low))
        low, high = low[order], high[order]
        # intervals of one state are apart or inside each other; the outer ones tell all
        top = np.maximum.accumulate(high)
        keep = np.r_[True, high[1:] > top[:-1]] if len(high) else np.zeros(0, bool)
        self.low, self.high = low[keep], high[keep]

    def _trie(self, tokens: list[bytes]) -> None:
        """Edges (node, byte) -> node of all tokens that can be read, and the token that ends at each node."""
        nodes: dict[bytes, int] = {b"": 0}
        for i, t in enumerate(tokens):
            if self.live[i]:
                for k in range(1, len(t) + 1):
                    nodes.setdefault(t[:k], len(nodes))
        key = np.array([nodes[t[:-1]] << 8 | t[-1] for t in nodes if t], dtype=np.int64)
        to = np.array([v for t, v in nodes.items() if t], dtype=np.int64)
        order = np.argsort(key)
        self.edge, self.edge_to = key[order], to[order]
        self.token_at = np.full(len(nodes), -1, dtype=np.int64)
        for i, t in enumerate(tokens):
            if self.live[i]:
                self.token_at[nodes[t]] = i

    # walking

    def arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the states have an arc of that token each."""
        if not len(self.low):
            return np.ones(len(state), dtype=bool)
        at = state * self.width + self.column[token]
        i = np.searchsorted(self.low, at, side="right") - 1
        return (i < 0) | (self.high[np.maximum(i, 0)] <= at)

    def walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        lo = size = 0
        for i, w in enumerate(words):
            if size and size + len(w) > WALK:
                parts.append(self._walk(words[lo:i]))
                lo, size = i, 0
            size += len(w)
        parts.append(self._walk(words[lo:]))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        n = len(raw)
        first = np.cumsum(lens) - lens
        stop = np.repeat(first + lens, lens)  # where the word of a position ends
        # all tokens at all positions: one step down the trie for all that still have an edge
        pos, node, depth = np.arange(n), np.zeros(n, dtype=np.int64), 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(pos):
            key = node << 8 | raw[pos + depth]
            e = np.searchsorted(self.edge, key)
            e[e == len(self.edge)] = 0
            on = self.edge[e] == key
            pos, node = pos[on], self.edge_to[e[on]]
            depth += 1
            t = self.token_at[node]
            got = t >= 0
            found.append((pos[got], t[got], np.full(int(got.sum()), depth, dtype=np.int64)))
            more = pos + depth < stop[pos]
            pos, node = pos[more], node[more]
        start, token, length = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        local = start - np.repeat(first, lens)[start] if n else start
        order = np.argsort(local, kind="stable")
        start, token, length, local = start[order], token[order], length[order], local[order]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(local)) + 1, [len(local)]])
        last, back = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)  # by the arc's last position
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s, t, z = start[a:b], token[a:b], length[a:b]
            if b > a and local[a] > 0:
                ok = self.arcs(self.state[last[s - 1]], t)
                s, t, z = s[ok], t[ok], z[ok]
            last[s + z - 1], back[s + z - 1] = t, s
        # back along the one path of each word
        who, at = np.flatnonzero(lens > 0), (first + lens - 1)[lens > 0]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            steps.append((who, last[at]))
            before = back[at]
            more = before > first[who]
            who, at = who[more], before[more] - 1
        if not steps:
            return np.zeros(0, np.int32), lens
        w = np.concatenate([x for x, _ in steps])
        t = np.concatenate([x for _, x in steps])
        down = np.repeat(-np.arange(len(steps)), [len(x) for x, _ in steps])
        return self.ids[t[np.lexsort((down, w))]], np.bincount(w, minlength=len(words))

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has; each distinct word is walked once."""
        joined = "".join(texts)
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        first = np.cumsum(lens) - lens
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        head = word_starts(cp, first[lens > 0])
        size = np.diff(np.append(head, len(cp)))
        rep, which = _distinct(cp, head, size)
        ids, counts = self.walk([joined[a:b].encode("utf-8", "surrogatepass") for a, b in zip(head[rep].tolist(), (head + size)[rep].tolist(), strict=True)])
        n = counts[which]
        total = np.cumsum(n)
        at = np.repeat((np.cumsum(counts) - counts)[which] - (total - n), n) + np.arange(total[-1])
        upto = np.concatenate([[0], total])[np.searchsorted(head, np.append(first, len(cp)))]
        return ids[at], np.diff(upto)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_block([text])[0].tolist() if text else []

    def decode(self, ids: list[int]) -> str:
        """The text whose path has these labels."""
        return b"".join(self.labels[self.of_id[i]] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        x = ud.category(chr(c))[0]
        if x == "L":
            out[c] = LETTER
        elif x == "N":
            out[c] = NUMBER
    out[[ord(c) for c in SPACES]] = SPACE
    return out


def word_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pattern's pieces start, in texts that start at ``first``."""
    n = len(cp)
    k = _kinds()[cp]
    new = np.zeros(n + 3, dtype=bool)  # texts start there
    new[first] = True
    new[n] = True
    at = np.zeros(n + 3, dtype=bool)
    at[0] = True
    at[1:n] = k[1:] != k[:-1]
    at |= new
    # the last of a run of white space stands alone, or with what follows if it is a plain space
    last = np.flatnonzero((k == SPACE) & ~new[1 : n + 1] & np.r_[k[1:] != SPACE, True])
    at[last] = True
    at[last[cp[last] == 32] + 1] = False
    # contractions: an apostrophe that starts a piece, and the letters behind it
    mark = np.flatnonzero((cp == 39) & at[:n] & ~new[1 : n + 1])
    mark = mark[k[mark + 1] == LETTER]
    c = np.concatenate([cp, np.zeros(3, dtype=cp.dtype)])
    one = mark[np.isin(c[mark + 1], [ord(x) for x in "stmd"])]
    at[one + 1] = False
    at[one + 2] = True
    pair = (c[mark + 1] << 8 | c[mark + 2]) * (~new[mark + 2])
    two = mark[np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])]
    at[two + 1] = False
    at[two + 3] = True
    return np.flatnonzero(at[:n])


def _distinct(cp: np.ndarray, head: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct word among ``head``, and for each word the number of its like. Words are told apart by hashes, which are verified."""
    base = np.uint64(0x9E3779B97F4A7C15)
    while True:
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(cp), base, dtype=np.uint64))
            x = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power)])
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            undo = np.cumprod(np.full(len(cp), inverse, dtype=np.uint64))
            h = (total[head + size] - total[head]) * undo[head] + size.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        _, rep, which = np.unique(h, return_index=True, return_inverse=True)
        other = head[rep][which]
        if (size[rep][which] == size).all() and (cp == cp[np.repeat(other - head, size) + np.arange(len(cp))]).all():
            return rep, which
        base = base * np.uint64(3) + np.uint64(2)  # two words of one hash: once more with another base


@lru_cache(maxsize=2)
def automaton(path: str = DEFAULT_PATH) -> Automaton:
    return Automaton.load(path)


def blocks(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in blocks of at most BLOCK code points, or one text each."""
    part: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if part and size + len(t) > BLOCK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """``key`` and ``ids`` of each row, see the module. Other columns are not carried.

    The vocabulary is read and compiled on the driver; the executors get the tables (about 15 MB, whatever the input).
    """
    shared = df.sparkSession.sparkContext.broadcast(automaton(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for b in batches:
            row = 0
            for part in blocks(b.column(1).to_pylist()):
                ids, n = a.encode_block(part)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(part)), ids], names=[key, "ids"])
                row += len(part)

    kind = dict(df.dtypes)[key]
    return spread(df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = DEFAULT_PATH) -> DataFrame:
    """``key`` and ``text``: what the ids stand for; null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(automaton(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = shared.value
        for b in batches:
            yield pd.DataFrame({key: b["__key"], "text": [a.decode([] if x is None else list(x)) for x in b["__ids"]]})

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("__key"), F.col(ids).alias("__ids")).mapInPandas(run, f"`{key}` {kind}, text string")
