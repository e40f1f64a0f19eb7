"""SQL for queries that return spans: positions come from the pieces between matches."""

from __future__ import annotations


def spans_sql(kinds: list[tuple[str, str, str]], base: list[str], order: str) -> str:
    """``kinds``: (kind, pattern, condition on ``hit``) in the order listed; ``order``: of the joined spans."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    hits = " UNION ALL ".join(
        f"""SELECT doc_id, '{kind}' AS kind, {n} AS nth, unnest(regexp_extract_all(text, {quoted(p)})) AS hit,
            unnest(list_slice(string_split_regex(text, {quoted(p)}), 1, -2)) AS piece,
            unnest(range(len(regexp_extract_all(text, {quoted(p)})))) AS i FROM d"""
        for n, (kind, p, _) in enumerate(kinds)
    )
    keep = " OR ".join(f"(kind = '{kind}' AND {condition})" for kind, _, condition in kinds)
    listed = ", ".join(f"'{k}'" for k in base)
    one = "kind || ':' || (last - length(hit)) || ':' || last"
    counts = ", ".join(f"count(hit) FILTER (kind = '{k}') AS n_{k}" for k in base)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        hits AS ({hits}),
        placed AS (SELECT *, sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS last FROM hits),
        kept AS (SELECT *, last - length(hit) AS first FROM placed WHERE {keep})
        SELECT d.doc_id, {counts},
            sha256(coalesce(string_agg({one}, ',' ORDER BY {order}) FILTER (kind IN ({listed})), '')) AS base_sha256,
            coalesce(string_agg({one}, ',' ORDER BY {order}), '') AS spans
        FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
    """
