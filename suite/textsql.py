"""SQL steps of the text work, used by the oracle statements."""

from __future__ import annotations

from palimpsest.functions import fixed
from suite.model import with_tables


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(p)})" for p in phrases) + ")"


def norm(column: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def cut(column: str) -> str:
    low = f"lower({column})"
    found = []
    for k in fixed.BIBLIOGRAPHY_KEYWORDS:
        at = f"instr(reverse({low}), reverse({quoted(k)}))"
        start = f"(length({low}) - {len(k)} + 1 - {at})"
        found.append(
            f"CASE WHEN {at} > 0 AND {start} > length({column}) * 0.7::double THEN {start} END"
        )
    best = f"greatest({', '.join(found)})"
    return f"CASE WHEN {best} IS NULL THEN {column} ELSE substr({column}, 1, CAST({best} AS int)) END"


def n_words(column: str) -> str:
    return f"len(list_filter(string_split({column}, ' '), lambda x: x <> ''))"


SEG_RAW = f"""SELECT id AS src_id, CAST(i - 1 AS int) AS pos, raws[i] AS raw FROM (
    SELECT id, raws, unnest(range(1, len(raws) + 1)) AS i FROM (
      SELECT id, regexp_extract_all({cut('content')}, '[^.!?\\n]+[.!?\\n]*|[\\n]+') AS raws FROM SOURCE))"""

SEGS = f"""SELECT *, {n_words('clean')} AS n_words, {n_words('clean')} < 3 AS is_noise,
    {n_words('clean')} >= 3 AND {any_of('clean', fixed.COMMON_PHRASES)} AS is_excluded
    FROM (SELECT *, {norm('raw')} AS clean FROM seg_raw)"""

COUNTED = "SELECT src_id, pos, clean, n_words FROM segs WHERE NOT is_noise AND NOT is_excluded"

CONTENTS = f"""SELECT id AS doc_id, {norm(cut('content'))} AS clean FROM CORPUS"""


def gram_rows(source: str, key: str, n: int, scope: str = "") -> str:
    """``key, n_grams, g`` rows of a step with a ``clean`` column."""
    parts = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))
    return f"""SELECT {key}, n_grams, unnest(gs) AS g FROM (
      SELECT {key}, gs, len(gs) AS n_grams FROM (
        SELECT {key}, list_distinct(list_transform(range(1, len(t) - {n} + 2), lambda i: {parts})) AS gs
        FROM (SELECT {key}, list_filter(string_split(clean, ' '), lambda x: x <> '') AS t FROM {source})
        WHERE len(t) >= {n}))"""


def match_steps(source: str, corpus: str, exclude_self: bool) -> dict[str, str]:
    """Steps up to ``best``: one row per counted segment with its best document."""
    other = "AND d.doc_id <> s.src_id" if exclude_self else ""
    return {
        "seg_raw": SEG_RAW.replace("SOURCE", source),
        "segs": SEGS,
        "counted": COUNTED,
        "contents": CONTENTS.replace("CORPUS", corpus),
        "exact": f"""SELECT s.src_id, s.pos, min(d.doc_id) AS doc_id FROM counted s JOIN contents d
            ON contains(d.clean, s.clean) {other} WHERE s.n_words >= 5 GROUP BY ALL""",
        "sg": gram_rows("counted", "src_id, pos", 2),
        "dg": gram_rows("contents", "doc_id", 2),
        "near_all": f"""SELECT s.src_id, s.pos, d.doc_id, count(*) AS inter,
            count(*) / (any_value(s.n_grams) + any_value(d.n_grams) - count(*)) * 100 AS score
            FROM sg s JOIN dg d ON s.g = d.g {other} GROUP BY s.src_id, s.pos, d.doc_id""",
        "near": """SELECT * FROM near_all QUALIFY row_number() OVER (
            PARTITION BY src_id, pos ORDER BY score DESC, doc_id) = 1""",
        "best": """SELECT c.src_id, c.pos, c.n_words, coalesce(e.doc_id, n.doc_id) AS matched_id,
            e.doc_id IS NOT NULL AS is_exact,
            CASE WHEN e.doc_id IS NOT NULL THEN 100.0 ELSE coalesce(n.score, 0) END AS score_raw
            FROM counted c LEFT JOIN exact e USING (src_id, pos) LEFT JOIN near n USING (src_id, pos)""",
    }
