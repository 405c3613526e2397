"""DuckDB SQL for the queries of this subpackage that SQL can express; the others are tested against brute force, a library, a round trip or held-out labels."""

from __future__ import annotations

from .lookalike import _skeleton_table


def _skeleton(x: str) -> str:
    """``lookalike.skeleton`` in DuckDB's SQL (no look-behind there: each join of two sides is done twice)."""
    src, dst = _skeleton_table()
    s = rf"regexp_replace({x}, '[\p{{M}}\p{{Cf}}]+', '', 'g')"
    for lig, to in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ß", "ss")):
        s = f"replace({s}, '{lig}', '{to}')"
    s = f"translate(lower({s}), '{src}', '{dst}')"
    s = rf"regexp_replace({s}, '\p{{M}}+', '', 'g')"
    for pattern in (r"([\p{L}\p{N}])[-''’‐‑]([\p{L}\p{N}])", r"(\p{N})[.,:/](\p{N})"):
        for _ in range(2):
            s = rf"regexp_replace({s}, '{pattern}', '\1\2', 'g')"
    return rf"trim(regexp_replace({s}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


ORACLE: dict[str, str] = {
    "p1_found": r"""SELECT doc_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\s\p{Z}\p{P}]'), lambda x: length(x))) > 700 THEN 'forced' ELSE 'natural' END AS cut
FROM documents WHERE length(text) > 700""",
    "p4_found": f"""WITH q AS (SELECT DISTINCT qid, {_skeleton("question")} AS s FROM gold WHERE second_of IS NULL AND qid IS NOT NULL),
w AS (SELECT qid, len(l) AS n, unnest(l) AS word FROM (SELECT qid, list_distinct(string_split(s, ' ')) AS l FROM q WHERE s <> '')),
c AS (SELECT a.qid AS qid_a, b.qid AS qid_b, a.n AS na, b.n AS nb, count(*) AS shared FROM w a JOIN w b ON a.word = b.word AND a.qid < b.qid GROUP BY ALL)
SELECT qid_a, qid_b FROM c WHERE shared::DOUBLE / (na + nb - shared) >= 0.7::DOUBLE - 1e-9""",
    "p8_found": f"""WITH dw AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, string_split({_skeleton("text")}, ' ') AS l FROM documents WHERE text IS NOT NULL)),
iw AS (SELECT item_id, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM (SELECT item_id, string_split({_skeleton("text")}, ' ') AS l FROM benchmark)),
m AS (SELECT doc_id, item_id, dw.p - iw.p AS diag, dw.p AS p FROM dw JOIN iw USING (word) WHERE word <> ''),
g AS (SELECT doc_id, item_id, diag, list_sort(list(p)) AS l FROM m GROUP BY ALL HAVING count(*) >= 10),
r AS (SELECT doc_id, item_id, diag, unnest(l) AS p, generate_subscripts(l, 1) AS r FROM g)
SELECT DISTINCT a.doc_id, a.item_id FROM r a JOIN r b USING (doc_id, item_id, diag) WHERE b.p - a.p >= 11 AND (b.p - b.r) - (a.p - a.r) <= 2""",
}
