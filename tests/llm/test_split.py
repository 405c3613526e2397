import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwise.llm.split import cut_positions, split_oversized


def pieces(text, limit=700, overlap=100):
    return cut_positions(text, limit, overlap)


def check(text, limit, overlap):
    got = pieces(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for s, e, _ in got:
        assert 0 < e - s <= limit
    for (_, e, _), (s, e2, _) in zip(got, got[1:]):
        assert s <= e < e2
        assert e - s <= overlap
    forced = any(k == 5 for *_, k in got)
    assert forced == bool(regex.search(rf"[^\s\p{{P}}]{{{limit + 1},}}", text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["kelime ", "x" * 33, ". ", "\n\n", ", ", "。", "ü" * 59, "( ", "a"]), min_size=30, max_size=200).map("".join))
def test_pieces_hold_their_promises(text):
    if len(text) > 60:
        check(text, 60, 10)


def test_overlap_is_kept_in_ordinary_text():
    got = pieces("Bu bir cümledir ve biter. " * 100)
    assert all(e - s == 100 for (_, e, _), (s, _, _) in zip(got, got[1:]))
    assert all(k == 2 for *_, k in got[:-1])


def test_runs_at_the_limit():
    for n, forced in ((650, False), (700, False), (701, True), (2000, True)):
        text = "Bir cümle var. " * 30 + "x" * n + " ve devamı. " + "Son cümle. " * 30
        assert any(k == 5 for *_, k in pieces(text)) == forced
        check(text, 700, 100)


def test_rows(spark):
    long = "Bu bir cümledir. " * 60
    df = spark.createDataFrame([(1, long, 0), (2, None, 0), (3, "", 0), (4, "kısa", 0), (1, long, 0)], "doc_id long, text string, piece_no int")
    got = split_oversized(df).collect()
    assert {r["doc_id"] for r in got} == {1}
    assert all(r["piece"] == long[r["piece_start"] : r["piece_end"]] for r in got)
    assert split_oversized(df.limit(0)).count() == 0


def test_separators_over_the_limit():
    for sep in (" ", "-", ".", "\n", ". ", "\t-"):
        for n in (699, 700, 701, 800, 5000):
            run = (sep * n)[:n]
            for text in ("Bir cümle var. " * 30 + run + "Son cümle. " * 30, run + "son" * 10, "x" * 800 + run, run + "y" * 800, run):
                if len(text) > 700:
                    check(text, 700, 100)
