"""Small SQL builders for the DuckDB twins."""

from __future__ import annotations


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits(source: str, regex: str, cols: str = "doc_id, element_index, element_type, content", where: str = "true") -> str:
    """Rows of ``source`` exploded to regex hits with 0-based start ``s`` and end ``e``."""
    r = lit(regex)
    return f"""
      SELECT {cols}, m[i] AS hit, CAST(p AS INT) AS s, CAST(p + length(m[i]) AS INT) AS e, CAST(i AS INT) AS hit_no FROM (
        SELECT *, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
                + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS p
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT *, regexp_extract_all(content, {r}) AS m, string_split_regex(content, {r}) AS g
          FROM {source} WHERE content <> '' AND ({where}))))"""


def ch(text: str, pos0: str) -> str:
    """Character at a 0-based position, '' outside."""
    return f"(CASE WHEN {pos0} < 0 THEN '' ELSE substr({text}, {pos0} + 1, 1) END)"


def any_word(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def inlist(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def mapping(expr: str, table: dict, default: str = "NULL") -> str:
    return f"(CASE {expr} " + " ".join(f"WHEN {lit(k)} THEN {lit(v) if isinstance(v, str) else v}"
                                        for k, v in table.items()) + f" ELSE {default} END)"
