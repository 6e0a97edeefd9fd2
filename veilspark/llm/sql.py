"""DuckDB SQL for the queries that SQL can express: the same rows by other, plainer means."""

from __future__ import annotations

import re

from veilspark.llm.licences import CONTAINED, PHRASES, TEMPLATES, stride, template_words
from veilspark.llm.mixing import EPOCHS, WEIGHTS
from veilspark.llm.secret_scan import BASE, RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x20\x09-\x0D]+"
LICENSE_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def secrets_sql() -> str:
    """Every rule by itself: matches, the gaps between them, and running sums for the positions."""
    kinds = []
    for i, r in enumerate(RULES):
        p = quoted(r.pattern)
        kinds.append(
            f"SELECT row, {i} AS kind, '{r.kind}' AS name, s AS start, s + length(m) AS stop FROM (SELECT row, k, m, v, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY row ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s "
            f"FROM (SELECT row, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS gap FROM (SELECT row, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {r.group}) AS v, string_split_regex(text, {p}) AS g FROM d) WHERE len(m) > 0) WINDOW w AS (PARTITION BY row ORDER BY k)) WHERE length(v) >= {r.least}"
        )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    mine = "name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind"
    return (
        f"WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), s AS ({' UNION ALL '.join(kinds)}), "
        f"a AS (SELECT row, {counts}, coalesce(string_agg({mine}) FILTER (WHERE kind < {len(BASE)}), '') AS base, string_agg({mine}) AS spans FROM s GROUP BY row) "
        f"SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row)"
    )


def mix_sql() -> str:
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return (
        f"WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, md5(text), '')) AS h FROM documents), "
        "z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1), "
        f"r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weights} END AS w FROM z), "
        f"f AS (SELECT *, source_size * {EPOCHS} AS cap, (source_size * {EPOCHS})::DOUBLE / w AS fills, sum(source_size) OVER () AS total FROM r), "
        "g AS (SELECT *, row_number() OVER o AS nth, (total - coalesce(sum(cap) OVER (ORDER BY fills, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER (ORDER BY fills, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f WINDOW o AS (ORDER BY fills, source NULLS LAST)), "
        "l AS (SELECT min_by(level, nth) AS level FROM g WHERE level <= fills), "
        "t AS (SELECT source, source_size, least(cap::DOUBLE, w * coalesce(l.level, fills)) AS target FROM g, l), "
        "p AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size, row) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source), "
        f"c AS (SELECT p.*, (upto + e * source_size)::DOUBLE / target AS finish FROM p, range({EPOCHS}) AS x(e) WHERE size > 0), "
        "q AS (SELECT row, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, h, doc_id, size, upto ROWS UNBOUNDED PRECEDING) AS reached FROM c), "
        "k AS (SELECT row, sum(size)::BIGINT AS taken FROM q WHERE reached <= (SELECT sum(size) FROM d) GROUP BY 1) "
        "SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, source FROM p LEFT JOIN k USING (row)"
    )


def license_sql() -> str:
    """Every place of every phrase, and every block of words against every template that shares a word with it."""
    places = " UNION ALL ".join(f"SELECT row, i - 1 AS place, '{label}' AS label FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i:i + {len(p.split()) - 1}] = [{', '.join(map(quoted, p.split()))}]" for p, label in PHRASES.items())
    sizes = {k: len(re.findall(LICENSE_WORDS, v.lower())) for k, v in TEMPLATES.items()}
    templates = ", ".join(f"('{k}', [{', '.join(map(quoted, ws))}], {sizes[k]}, {stride(sizes[k])})" for k, ws in template_words(TEMPLATES).items())
    low = f"translate(%s, '{UPPER}', '{LOWER}')"
    return (
        f"WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({low % 'coalesce(text, %s)' % quoted('')}, '{LICENSE_WORDS}') AS w FROM documents), "
        f"b AS ({places}), bb AS (SELECT row, count(*) AS n, min(place) AS first, max(place) AS last, list_distinct(list(label)) AS labels FROM b GROUP BY 1), "
        f"t AS (SELECT label, unnest(w) AS word, len(w) AS n, size, step FROM (VALUES {templates}) AS x(label, w, size, step)), "
        "o AS (SELECT row, i - 1 AS spot, w[i] AS word FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d)), "
        "h AS (SELECT row, label, n, word, unnest(range(greatest(floor((spot - size - step) / step)::BIGINT + 1, 0), spot // step + 1)) AS block FROM o JOIN t USING (word)), "
        f"m AS (SELECT row, label, count(DISTINCT word)::DOUBLE / any_value(n) AS score FROM h GROUP BY row, label, block HAVING count(DISTINCT word) >= ceil({CONTAINED} * any_value(n) - 1e-9)), "
        "mm AS (SELECT row, list(label) AS labels, max(score) AS score FROM m GROUP BY 1) "
        "SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word, array_to_string(list_sort(coalesce(bb.labels, [])), ',') AS base_labels, "
        "array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.labels, []), coalesce(mm.labels, [])))), ',') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score FROM d LEFT JOIN bb USING (row) LEFT JOIN mm USING (row)"
    )


def near_sql(width: int = 4) -> str:
    """All pairs of documents that share a shingle, and the components of those at 0.8."""
    return (
        f"WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents), "
        f"s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)), "
        "n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), "
        "j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2), "
        "e AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), "
        "r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) "
        "SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)"
    )


ORACLES: dict[str, str] = {
    "op5_secret_ledger": secrets_sql(),
    "op6_fair_queue_mix": mix_sql(),
    "op7_license_containment": license_sql(),
    "op9_minmax_near_dedup": near_sql(),
}
