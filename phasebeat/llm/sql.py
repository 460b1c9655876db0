"""SQL that states the same results as the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from phasebeat.llm.quality_rules import RULES, STOP_WORDS

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _centroids(k: int = 16, rounds: int = 3) -> str:
    parts = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE {FINITE} AND len(embedding) = 64)""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x) - 1 AS j, x FROM kept
            QUALIFY row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x) <= {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
            SELECT kept.u, kept.vec_id, kept.x, c{r}.j,
                list_sum(list_transform(list_zip(kept.x, c{r}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
            FROM kept CROSS JOIN c{r}
            QUALIFY row_number() OVER (PARTITION BY kept.u ORDER BY d, c{r}.j) = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""m{r} AS (
            SELECT j, i, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v
            FROM (SELECT j, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY j, i),
        n{r} AS (SELECT j, list(v ORDER BY i) AS x FROM m{r} GROUP BY j),
        c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(n{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN n{r} ON n{r}.j = c{r}.j)"""
            )
    return f"""
        WITH {", ".join(parts)}
        SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
            CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j"""


BLANKS, SYMBOLS = r"[\x20\x09-\x0D]", "[#*$%&|<>]"
NUMBERED = "SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS text FROM documents"


def _quality() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for group in STOP_WORDS for w in group.split()}))
    tests = []
    for r in RULES:
        tests += [f"{r.metric} >= {r.low}"] if r.low is not None else []
        tests += [f"{r.metric} <= {r.high}"] if r.high is not None else []
    return rf"""
        WITH docs AS MATERIALIZED ({NUMBERED}),
        words AS MATERIALIZED (
            SELECT u, w, i FROM (
                SELECT u, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
                FROM (SELECT u, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs))),
        windows AS (
            SELECT u, i, string_agg(w, ' ') OVER (PARTITION BY u ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS x,
                count(*) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM words),
        again AS (SELECT u, i FROM windows WHERE n = 8 QUALIFY count(*) OVER (PARTITION BY u, x) > 1),
        covered AS (SELECT u, count(DISTINCT i + k) AS n FROM again CROSS JOIN (SELECT unnest(range(8)) AS k) GROUP BY u),
        by_word AS (
            SELECT u, count(*) AS n_words, count(*) FILTER (lower(w) IN ({stop})) AS n_stop FROM words GROUP BY u),
        lines AS (
            SELECT u, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
                count(*) FILTER (ends_with(rtrim(line, ' '), '...')) AS n_ellipsis
            FROM (SELECT u, unnest(string_split(text, chr(10))) AS line FROM docs)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY u),
        counts AS (
            SELECT doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '{BLANKS}', '', 'g')) AS word_chars,
                length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                coalesce(covered.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_ellipsis, 0) AS n_ellipsis,
                coalesce(n_stop, 0) AS n_stop, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
                length(text) - length(replace(text, '!', '')) AS n_marks
            FROM docs LEFT JOIN by_word USING (u) LEFT JOIN lines USING (u) LEFT JOIN covered USING (u)),
        ratios AS (
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, word_chars / greatest(n_words, 1) AS mean_word_chars,
                n_symbols / greatest(n_words, 1) AS symbols_per_word, n_marks / greatest(n_words, 1) AS marks_per_word,
                n_upper / greatest(word_chars, 1) AS upper_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
                n_ellipsis / greatest(n_lines, 1) AS ellipsis_line_ratio, n_stop / greatest(n_words, 1) AS stop_word_ratio,
                n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
            FROM counts)
        SELECT *, NOT base_failed AND {" AND ".join(tests)} AS kept FROM ratios"""


def _contamination(length: int = 10) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    def windows(source: str, key: str) -> str:
        return f"""
            SELECT {key}, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS x
            FROM (SELECT {key}, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM {source} WHERE len(ws) >= n)"""

    return f"""
        WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS u, doc_id, {words} AS ws FROM documents),
        items AS MATERIALIZED (
            SELECT *, least({length}, len(ws)) AS n FROM (SELECT row_number() OVER () AS b, item_id, {words} AS ws FROM benchmark)
            WHERE len(ws) > 0),
        wanted AS MATERIALIZED ({windows("items", "b")}),
        sized AS (SELECT u, ws, n FROM docs CROSS JOIN (SELECT DISTINCT n FROM items)),
        present AS ({windows("sized", "u")}),
        hits AS MATERIALIZED (SELECT p.u, w.b, p.n, p.i, w.i AS j FROM present p JOIN wanted w ON w.n = p.n AND w.x = p.x),
        words_hit AS (SELECT u, count(DISTINCT i + k) AS n_hit FROM (SELECT u, i, unnest(range(n)) AS k FROM hits) GROUP BY u),
        found AS (
            SELECT u, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS digest
            FROM (SELECT DISTINCT u, CAST(item_id AS VARCHAR) AS id FROM hits JOIN items USING (b)) GROUP BY u),
        islands AS (
            SELECT u, n + count(*) - 1 AS run
            FROM (SELECT *, i - row_number() OVER (PARTITION BY u, b, i - j ORDER BY i) AS island FROM hits) GROUP BY u, b, n, i - j, island),
        longest AS (SELECT u, max(run) AS longest FROM islands GROUP BY u)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
        FROM docs LEFT JOIN words_hit USING (u) LEFT JOIN found USING (u) LEFT JOIN longest USING (u)"""


ORACLES: dict[str, str] = {
    "op4_quality_rules": _quality(),
    "op6_decontamination": _contamination(),
    "op11_centroids": _centroids(),
    "op12_hard_negatives": f"""
        WITH rows_ AS MATERIALIZED (
            SELECT row_number() OVER () AS u, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
            FROM embeddings WHERE label IS NOT NULL AND {FINITE}),
        scored AS MATERIALIZED (
            SELECT a.u AS anchor, a.id AS anchor_id, a.label = b.label AS same, b.u, b.id,
                CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
            FROM rows_ a JOIN rows_ b ON a.u <> b.u WHERE a.id % 100 = 0),
        positive AS (
            SELECT * FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST, u) <= 5),
        ranked AS (
            SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                CAST(row_number() OVER (PARTITION BY p.anchor, p.u ORDER BY n.score DESC, n.id NULLS LAST, n.u) AS INTEGER) AS rank
            FROM positive p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
            WHERE 80 * p.score <= 100 * n.score AND n.score <= p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5""",
}
