import os
import random

import numpy as np
import pytest
import regex

from spanwise.llm import tokenizer
from spanwise.llm.tokenizer import DEFAULT_PATH, PATTERN, Automaton, automaton, decode_ids, encode_texts

held = pytest.mark.skipif(not os.path.exists(DEFAULT_PATH), reason="no vocabulary")


def texts():
    rng = random.Random(5)
    out = ["", " ", "  \n\n x", "Hello world's 123456", "şeker ĞÜİ", "如果没有", "😀👩‍⚕️", "<|endoftext|>", "a" * 3000, "ACGT" * 700, "".join(rng.choice("0123456789") for _ in range(2500))]
    alphabet = "abc ABC\n\t123.,'şğü中ก\U0001f600-_"
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(400)]
    return out


@held
def test_equal_to_the_library_and_round_trip():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(DEFAULT_PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    a = automaton()
    for x in texts():
        ids = a.encode(x)
        assert ids == t.encode(x, add_special_tokens=False).ids
        assert a.decode(ids) == x


@held
def test_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "şeker", 0), (3, "şeker", 0)], "doc_id long, text string, ids int")
    got = encode_texts(df)
    rows = got.collect()
    assert [list(r["ids"]) for r in rows if r["doc_id"] < 3] == [[], []]
    assert [r["text"] for r in decode_ids(got).collect() if r["doc_id"] == 3] == ["şeker", "şeker"]
    assert encode_texts(df.limit(0)).count() == 0


def by_merging(merges, word):
    """Brute force: the merge of the lowest rank is done, the leftmost first, again and again."""
    parts = list(word)
    while True:
        best = min(((merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges), default=None)
        if best is None:
            return parts
        parts[best[1] : best[1] + 2] = [best[0]]


def small(rng, merges):
    ranks = {bytes([b]): b for b in range(256)}
    tokens = [b"a", b"b", b"c"]
    while len(ranks) < 256 + merges:
        t = rng.choice(tokens) + rng.choice(tokens)
        if t not in ranks and len(t) < 12:
            ranks[t] = len(ranks)
            tokens.append(t)
    return ranks


def test_compiled_states_against_merging():
    rng = random.Random(3)
    for _ in range(40):
        ranks = small(rng, rng.choice([1, 5, 30, 100]))
        a = Automaton(ranks)
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(100)] + [b"a" * 40]
        ids, n = a.walk(words)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [by_merging(a.joined, w) for w in words]


def test_tables_hold_the_arcs():
    """What the compiled tables say of two tokens is what undoing their seam says."""
    a = Automaton(small(random.Random(4), 200))
    n = len(a.ids)
    u, v = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    use = a.live[u] & a.live[v]
    left, right = a.left.tolist(), a.right.tolist()
    met = [Automaton._met(int(x), int(y), n + 1, a.joined, left, right) for x, y in zip(u[use], v[use])]
    assert a.arcs(a.state[u[use]], v[use]).tolist() == met
    assert 1 < a.states < n


def test_word_starts_follow_the_pattern():
    rng = random.Random(6)
    for _ in range(3000):
        x = "".join(rng.choice(["'", "s", "t", "re", "ll", "ve", " ", "  ", "\n", "\t", "\u3000", "\xa0", "a", "1", "!", "é", "日", "I'm", "\x01", "\u0301", "\U0001f600"]) for _ in range(rng.randint(1, 14)))
        cp = np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32)
        assert tokenizer.word_starts(cp, np.array([0])).tolist() == [m.start() for m in regex.finditer(PATTERN, x)]


@held
def test_blocks_do_not_show(monkeypatch):
    a = automaton()
    t = ["Bir cümle var.", "", "'s 've  x\n", "a" * 200, " ", "12 12 12"]
    whole = [a.encode(x) for x in t]
    monkeypatch.setattr(tokenizer, "WALK", 8)
    assert [a.encode(x) for x in t] == whole
    ids, n = a.encode_block(t)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == whole
    monkeypatch.setattr(tokenizer, "BLOCK", 20)
    assert [x for b in tokenizer.blocks(t) for x in b] == t
