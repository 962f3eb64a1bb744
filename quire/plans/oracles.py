"""SQL for queries on checks, short texts, exports and grids, written as rules rather than as the plans are."""

from __future__ import annotations

from ..model import bridge as B
from ..model.bridge import sql
from . import jobs, layout, quality  # noqa: F401  quality names the pages

_ALL = layout._ALL



def _more(body: str, *names: str) -> str:
    """SQL that goes on with tables of its own."""
    return "WITH " + ",\n".join(B.SQL[n] for n in names) + body


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TEN = "array_to_string(list_slice(list({message} ORDER BY {order}){where}, 1, 10), '; ')"


def _check(name: str, status: str, fine: str, found: str, message: str, order: str) -> str:
    """A check that all documents pass but those with rows in ``found``."""
    return f"""SELECT d.doc_id, '{name}' AS "check", CASE WHEN f.detail IS NULL THEN 'PASS' ELSE '{status}' END AS status, coalesce(f.detail, '{fine}') AS detail
FROM documents d LEFT JOIN (SELECT doc_id, {_TEN.format(message=message, order=order, where='')} AS detail FROM ({found}) GROUP BY doc_id) f USING (doc_id)"""


_INSIDE = """FROM ordered a JOIN ordered f ON a.doc_id = f.doc_id AND a.page_index = f.page_index AND f.type = 'figure' AND a.type NOT IN ('figure', 'caption', 'table')
  AND regexp_matches(a.text, '\\S') AND a.x0 >= f.x0 - 2 AND a.x1 <= f.x1 + 2 AND a.y0 >= f.y0 - 2 AND a.y1 <= f.y1 + 2"""
_GLYPH = f"""({_STRIP.format('a.text')} IN ('X', 'x', 'Х', 'х', '×', '+') AND a.x1 - a.x0 > 0 AND a.x1 - a.x0 <= 12 AND a.y1 - a.y0 > 0 AND a.y1 - a.y0 <= 12
  AND f.x1 - f.x0 > 0 AND f.x1 - f.x0 <= 24 AND f.y1 - f.y0 > 0 AND f.y1 - f.y0 <= 36)"""


def _leak(name: str, status: str, fine: str, glyph: str) -> str:
    return f"""SELECT d.doc_id, '{name}', CASE WHEN n IS NULL THEN 'PASS' ELSE '{status}' END, coalesce('texts inside: ' || n, '{fine}')
FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT (page_index, block_id)) AS n FROM (SELECT a.* {_INSIDE} AND {glyph} {_GLYPH}) GROUP BY doc_id) USING (doc_id)"""


_CHECKS = "\nUNION ALL\n".join(
    [
        f"""SELECT d.doc_id, 'ocr_text' AS "check", CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN n > 0 THEN 'characters: ' || n ELSE 'no characters' END AS detail
FROM documents d LEFT JOIN (SELECT doc_id, sum(length({_STRIP.format("coalesce(text, '')")})) AS n FROM ordered GROUP BY doc_id) USING (doc_id)""",
        """SELECT d.doc_id, 'page_count', CASE WHEN n IS NULL OR failed > 0 THEN 'FAIL' WHEN degraded > 0 THEN 'WARN' ELSE 'PASS' END, coalesce(n, 0) || ' pages, failed ' || coalesce(failed, 0) || ', degraded ' || coalesce(degraded, 0)
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'degraded') AS degraded FROM pages GROUP BY doc_id) USING (doc_id)""",
        _check("bbox", "FAIL", "boxes lie on their pages", "SELECT * FROM (SELECT * REPLACE (CASE WHEN doc_id % 11 = 0 AND i = 2 THEN 700 ELSE x1 END AS x1) FROM ordered) WHERE x0 < 0 OR y0 < 0 OR x1 > 595 OR y1 > 842 OR x1 < x0 OR y1 < y0", "'page ' || (page_index + 1) || ', block ' || block_id", "page_index, ord, block_id"),
        _check(
            "figure_files",
            "FAIL",
            "every figure has its file",
            "SELECT * FROM ordered WHERE type = 'figure' AND (i % 7 = 0 OR i % 5 = 0)",
            "CASE WHEN i % 7 = 0 THEN block_id || ': no safe path' ELSE block_id || ': no file ' || file END",
            "block_id",
        ),
        _check(
            "caption_links",
            "FAIL",
            "captions found",
            "SELECT doc_id, page_index, figure_id, CASE WHEN doc_id % 13 = 0 THEN 'gone' ELSE caption_id END AS caption_id FROM links l WHERE NOT EXISTS (SELECT 1 FROM ordered o WHERE o.doc_id = l.doc_id AND o.page_index = l.page_index AND o.block_id = CASE WHEN l.doc_id % 13 = 0 THEN 'gone' ELSE l.caption_id END)",
            "figure_id || ': ' || caption_id",
            "page_index, figure_id",
        ),
        _leak("figure_leakage", "FAIL", "texts inside: 0", "NOT"),
        _leak("figure_pictogram_overlap", "WARN", "no glyph in doubt", ""),
    ]
)
_FOUND = (*_ALL, "pages", "links")
_WORDS = r"regexp_extract_all(replace(lower(coalesce(text, '')), 'ё', 'е'), '[\p{L}\p{N}_]+')"
_FOLDED = r"regexp_extract_all(replace(replace(replace(lower({}), 'ß', 'ss'), 'ё', 'е'), 'Ё', 'е'), '[\p{{L}}\p{{N}}_]+')"
_LOOK = r"regexp_replace(regexp_replace(translate(replace(lower({}), 'ß', 'ss'), 'авсенкмортху', 'abcehkmoptxy'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_MIXED = "translate({}, 'aeopcx', 'аеорсх')"
_CYR = "[А-Яа-яЁё]"


def _median_edges(at: str, span: str, lo: str, hi: str) -> str:
    """table_id, at, edge of tables whose separators increase."""
    return f"""SELECT table_id, "at", edge FROM (
  SELECT *, bool_or(bad) OVER (PARTITION BY table_id) AS any_bad FROM (
    SELECT *, coalesce(lead(edge) OVER (PARTITION BY table_id ORDER BY "at") <= edge, false) AS bad FROM (
      SELECT s.table_id, s."at", CASE WHEN s."at" = 0 THEN first_ WHEN s."at" = n THEN last_ ELSE coalesce(middle, first_ + (last_ - first_) * s."at" / n) END AS edge
      FROM (SELECT *, unnest(range(n + 1))::INT AS "at" FROM (SELECT table_id, min({lo}) AS first_, max({hi}) AS last_, max({at} + {span}) AS n FROM cells GROUP BY table_id)) s
      LEFT JOIN (SELECT table_id, "at", median(side) AS middle FROM (SELECT table_id, {at} AS "at", {lo} AS side FROM cells UNION ALL SELECT table_id, {at} + {span}, {hi} FROM cells) GROUP BY ALL) m
        ON m.table_id = s.table_id AND m."at" = s."at")))
WHERE NOT any_bad"""


B.SQL["col_edges"] = f"col_edges AS ({_median_edges('col', 'colspan', 'x0', 'x1')})"
B.SQL["row_edges"] = f"row_edges AS ({_median_edges('row', 'rowspan', 'y0', 'y1')})"
_ALT = "coalesce(c.text, '')"
B.SQL["md"] = rf"""md AS (
  SELECT doc_id, regexp_replace(string_agg(page, '' ORDER BY page_index), '\s+$', '') || chr(10) AS content FROM (
    SELECT o.doc_id, o.page_index, '<!-- page ' || (o.page_index + 1) || ' -->' || chr(10) || string_agg(
      CASE WHEN o.type = 'figure' THEN '![' || CASE WHEN {_ALT} <> '' THEN c.text ELSE o.block_id END || '](' || o.file || ')' || chr(10) || CASE WHEN {_ALT} <> '' THEN '*' || c.text || '*' || chr(10) ELSE '' END || chr(10)
           WHEN o.type = 'caption' AND u.caption_id IS NOT NULL THEN ''
           WHEN o.type = 'heading' THEN '# ' || coalesce(o.text, '') || chr(10) || chr(10)
           WHEN o.type = 'list_item' THEN '- ' || coalesce(o.text, '') || chr(10)
           WHEN coalesce(o.text, '') <> '' THEN o.text || chr(10) || chr(10) ELSE '' END, '' ORDER BY o.ord) AS page
    FROM ordered o LEFT JOIN links f ON f.doc_id = o.doc_id AND f.page_index = o.page_index AND f.figure_id = o.block_id
    LEFT JOIN ordered c ON c.doc_id = f.doc_id AND c.page_index = f.page_index AND c.block_id = f.caption_id
    LEFT JOIN links u ON u.doc_id = o.doc_id AND u.page_index = o.page_index AND u.caption_id = o.block_id
    GROUP BY o.doc_id, o.page_index) GROUP BY doc_id
)"""
_ESCAPED = """replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""
_ADVANCE = {r"[iljtfrI.,;:'|!()\[\]]": 290, "[mwMWШЩЖЮшщжю@%]": 850, " ": 278}
_COUNTED = {p.replace("'", "''"): n for p, n in _ADVANCE.items()}
_UNITS = " + ".join(f"len(regexp_extract_all(text, '{p}')) * {n}" for p, n in _COUNTED.items()) + " + (length(text) - " + " - ".join(f"len(regexp_extract_all(text, '{p}'))" for p in _COUNTED) + ") * 540"

_SHAPES = """, shapes AS (SELECT table_id, max(row + rowspan) AS n_rows, max(col + colspan) AS n_cols, max(greatest(rowspan, colspan)) AS span FROM cells GROUP BY table_id),
xs AS (SELECT table_id, "at", edge FROM col_edges WHERE NOT (table_id % 7 = 3 AND "at" = 1)),
ys AS (SELECT table_id, "at", edge FROM row_edges UNION ALL SELECT table_id, max("at") + 1, max(edge) + 20 FROM row_edges WHERE table_id % 5 = 1 GROUP BY table_id),
n AS (SELECT * FROM shapes JOIN (SELECT table_id, count(*) AS n_x FROM xs GROUP BY table_id) USING (table_id) JOIN (SELECT table_id, count(*) AS n_y FROM ys GROUP BY table_id) USING (table_id))"""
B.SQL["with_echoes"] = """with_echoes AS (
  SELECT doc_id, page_index, block_id, type, text, ord, x0, y0, x1, y1 FROM ordered
  UNION ALL
  SELECT doc_id, page_index, 'e' || block_id, 'text', text || ' ' || next_text, ord + 1000, x0, y0, greatest(x1, nx1), ny1 FROM (
    SELECT *, lead(text) OVER w AS next_text, lead(y1) OVER w AS ny1, lead(x1) OVER w AS nx1 FROM ordered WINDOW w AS (PARTITION BY doc_id, page_index, page_column ORDER BY y0, x0, block_id))
  WHERE i % 5 = 1 AND next_text IS NOT NULL AND text IS NOT NULL
)"""
#: Letters beyond ASCII as capitals, of which keys have none, so that distances count letters rather than bytes.
_PLAIN = "translate({}, 'àâäáãçèéêëíìîïñóòôöúùûü', 'ABCDEFGHIJKLMNOPQRSTUVW')"
ORACLES = {
    "j06_contained_duplicates": _more(
        r""", k AS (SELECT *, regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', '', 'g') AS key FROM with_echoes WHERE type <> 'figure' AND coalesce(text, '') <> '')
SELECT a.doc_id, a.page_index, a.block_id FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.block_id <> b.block_id AND b.x0 >= a.x0 - 3 AND b.x1 <= a.x1 + 3 AND b.y0 >= a.y0 - 3 AND b.y1 <= a.y1 + 3
GROUP BY a.doc_id, a.page_index, a.block_id, a.key HAVING count(*) > 1 AND string_agg(b.key, '' ORDER BY b.y0, b.x0, b.ord) = a.key""",
        *_ALL,
        "with_echoes",
    ),
    "j07_echoes": _more(
        r""", k AS (SELECT * FROM (SELECT *, array_to_string(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\p{L}\p{N}_]+'), '') AS key FROM with_echoes WHERE type <> 'figure') WHERE key <> ''),
p AS (
  SELECT a.doc_id, a.page_index, a.block_id, a.key, count(*) AS n, max(b.y0) - min(b.y0) <= 1.5 * max(b.y1 - b.y0) AS across,
    string_agg(b.key, '' ORDER BY b.x0, b.y0, b.ord) AS by_x, string_agg(b.key, '' ORDER BY b.y0, b.x0, b.ord) AS by_y
  FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.block_id <> b.block_id AND length(b.key) <= length(a.key)
    AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(greatest(0.01, (a.x1 - a.x0) * (a.y1 - a.y0)), greatest(0.01, (b.x1 - b.x0) * (b.y1 - b.y0))) >= 0.55
  GROUP BY a.doc_id, a.page_index, a.block_id, a.key),
j AS (SELECT *, CASE WHEN across THEN by_x ELSE by_y END AS joined FROM p WHERE n >= 2)
SELECT doc_id, page_index, block_id FROM j WHERE length(joined) / length(key) BETWEEN 0.9 AND 1.1 AND 1 - levenshtein("""
        + _PLAIN.format("key")
        + ", "
        + _PLAIN.format("joined")
        + ") / greatest(length(key), length(joined)) >= 0.94",
        *_ALL,
        "with_echoes",
    ),
    "f01_admission": "WITH RECURSIVE "
    + B.SQL["jobs"]
    + """, e AS (SELECT job_id % 20 AS queue, event_id, job_id, event, row_number() OVER (PARTITION BY job_id % 20 ORDER BY ts, event_id, job_id, event) AS k FROM jobs WHERE event IS NOT NULL),
fold AS (
  SELECT queue, 0::BIGINT AS k, []::BIGINT[] AS open_, NULL::BIGINT AS event_id, 0 AS active, NULL::BOOLEAN AS admitted FROM (SELECT DISTINCT queue FROM e)
  UNION ALL
  SELECT queue, k, CASE WHEN ok THEN list_append(open_, job_id) WHEN event IN ('completed', 'failed', 'cancelled') THEN list_filter(open_, lambda x: x <> job_id) ELSE open_ END, event_id, len(open_)::INT, CASE WHEN event = 'submitted' THEN ok END
  FROM (SELECT f.queue, e.k, f.open_, e.event_id, e.job_id, e.event, e.event = 'submitted' AND NOT list_contains(f.open_, e.job_id) AND len(f.open_) < 3 AS ok FROM fold f JOIN e ON e.queue = f.queue AND e.k = f.k + 1))
SELECT queue, event_id, active, admitted FROM fold WHERE k > 0""",
    "w08_review_batches": "WITH RECURSIVE "
    + ",\n".join(B.SQL[n] for n in ("blocks", "all_blocks"))
    + """, t AS (SELECT doc_id, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, block_id) AS k FROM all_blocks WHERE text IS NOT NULL),
fold AS (
  SELECT doc_id, k, n AS size, 0 AS batch FROM t WHERE k = 1
  UNION ALL
  SELECT t.doc_id, t.k, CASE WHEN f.size > 0 AND f.size + t.n > 400 THEN t.n ELSE f.size + t.n END, f.batch + CASE WHEN f.size > 0 AND f.size + t.n > 400 THEN 1 ELSE 0 END FROM fold f JOIN t ON t.doc_id = f.doc_id AND t.k = f.k + 1)
SELECT doc_id, count(DISTINCT batch) AS batches, count(DISTINCT batch) FILTER (batch < 20) AS checked FROM fold GROUP BY doc_id""",
    "s05_text_layers": sql(
        r"""SELECT doc_id, page_index, CASE WHEN ink = 0 THEN 'absent' WHEN length(regexp_replace(page, '^\s+|\s+$', '', 'g')) < 20 THEN 'garbage'
  WHEN letters / greatest(ink, 1) < 0.35 OR controls / greatest(length(page), 1) > 0.05 OR marks / greatest(length(page), 1) > 0.01 OR mixed / greatest(words, 1) > 0.25 THEN 'garbage' ELSE 'valid' END AS status
FROM (SELECT doc_id, page_index, page, len(regexp_extract_all(page, '\S')) AS ink, len(regexp_extract_all(page, '[\x{400}-\x{52F}A-Za-z\x{C0}-\x{24F}]')) AS letters,
  len(regexp_extract_all(page, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) AS controls, length(page) - length(replace(page, chr(65533), '')) AS marks, len(regexp_extract_all(page, '\S+')) AS words,
  len(list_filter(regexp_extract_all(page, '\S+'), lambda w: regexp_matches(w, '[\x{400}-\x{52F}]') AND regexp_matches(w, '[A-Za-z\x{C0}-\x{24F}]'))) AS mixed
  FROM (SELECT doc_id, page_index, string_agg(CASE WHEN type = 'figure' THEN file ELSE text END, chr(10) ORDER BY ord) AS page FROM ordered GROUP BY doc_id, page_index))""",
        *_ALL,
    ),
    "m07_measured_cells": _more(
        _SHAPES
        + """
SELECT c.table_id, c.row, c.col, round(l.edge, 6) AS x0, round(t.edge, 6) AS y0, round(r.edge, 6) AS x1, round(b.edge, 6) AS y1 FROM cells c JOIN n ON n.table_id = c.table_id AND n_x = n_cols + 1 AND n_y = n_rows + 1
JOIN xs l ON l.table_id = c.table_id AND l."at" = c.col JOIN xs r ON r.table_id = c.table_id AND r."at" = c.col + c.colspan
JOIN ys t ON t.table_id = c.table_id AND t."at" = c.row JOIN ys b ON b.table_id = c.table_id AND b."at" = c.row + c.rowspan""",
        "cells",
        "col_edges",
        "row_edges",
    ),
    "m07_reading_boxes": _more(
        """, t AS (SELECT table_id, min(x0) AS x0, max(x1) AS x1, max(row + rowspan) AS n_rows, max(col + colspan) AS n_cols FROM cells GROUP BY table_id),
ok AS (SELECT t.* FROM t JOIN (SELECT table_id, count(*) AS n_y FROM row_edges GROUP BY table_id) e ON e.table_id = t.table_id AND n_y = n_rows + 1),
places AS (SELECT table_id, col, min((x0 + x1) / 2) AS first_, max((x0 + x1) / 2) AS last_ FROM cells WHERE colspan = 1 GROUP BY ALL),
seps AS (
  SELECT a.table_id, a.col + 1 AS "at", min(x) AS edge FROM places a JOIN places b ON b.table_id = a.table_id AND b.col = a.col + 1
  JOIN (SELECT table_id, unnest(CASE WHEN table_id % 3 = 0 THEN [160.0, 250.0, 251.0, 340.0] ELSE [160.0, 250.0, 340.0] END)::DOUBLE AS x FROM t) r ON r.table_id = a.table_id AND x > a.last_ AND x < b.first_
  GROUP BY ALL HAVING count(*) = 1),
xs AS (SELECT * FROM seps UNION ALL SELECT table_id, 0, x0 FROM ok UNION ALL SELECT table_id, n_cols, x1 FROM ok),
boxes AS (
  SELECT c.table_id, c.row, c.col, (c.y0 + c.y1) / 2 AS middle, l.edge AS x0, u.edge AS y0, r.edge AS x1, d.edge AS y1 FROM cells c JOIN ok ON ok.table_id = c.table_id
  JOIN (SELECT table_id, count(*) AS n_x FROM xs GROUP BY table_id) k ON k.table_id = c.table_id AND n_x = n_cols + 1
  JOIN xs l ON l.table_id = c.table_id AND l."at" = c.col JOIN xs r ON r.table_id = c.table_id AND r."at" = c.col + c.colspan
  JOIN row_edges u ON u.table_id = c.table_id AND u."at" = c.row JOIN row_edges d ON d.table_id = c.table_id AND d."at" = c.row + c.rowspan)
SELECT table_id, row, col, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM boxes QUALIFY bool_and(middle BETWEEN y0 - 4 AND y1 + 4) OVER (PARTITION BY table_id)""",
        "cells",
        "row_edges",
    ),
    "m07_verified_grids": _more(
        _SHAPES
        + r""", sx AS (SELECT table_id, "at" AS col, edge AS x0, lead(edge) OVER (PARTITION BY table_id ORDER BY "at") AS x1 FROM xs QUALIFY x1 IS NOT NULL),
sy AS (SELECT table_id, "at" AS row, edge AS y0, lead(edge) OVER (PARTITION BY table_id ORDER BY "at") AS y1 FROM ys QUALIFY y1 IS NOT NULL),
slots AS (SELECT sx.table_id, row, col, x0, y0, x1, y1 FROM sx JOIN sy USING (table_id)),
filled AS (SELECT * FROM cells WHERE regexp_matches(text, '\S')),
placed AS (SELECT c.table_id, s.row, s.col, c.col AS own, c.text, count(*) OVER (PARTITION BY c.table_id, s.row, s.col) AS claims FROM filled c JOIN slots s ON s.table_id = c.table_id AND (c.x0 + c.x1) / 2 >= s.x0 AND (c.x0 + c.x1) / 2 < s.x1
  AND (c.y0 + c.y1) / 2 >= s.y0 AND (c.y0 + c.y1) / 2 < s.y1 AND greatest(0, least(c.x1, s.x1) - greatest(c.x0, s.x0)) * greatest(0, least(c.y1, s.y1) - greatest(c.y0, s.y0)) / greatest(0.01, (c.x1 - c.x0) * (c.y1 - c.y0)) >= 0.8),
good AS (SELECT * FROM placed WHERE claims = 1 AND own = col),
sure AS (
  SELECT n.table_id FROM n JOIN (SELECT table_id, min(x1 - x0) AS w, min(y1 - y0) AS h FROM slots GROUP BY table_id) USING (table_id)
  LEFT JOIN (SELECT table_id, count(*) AS f FROM filled GROUP BY table_id) USING (table_id) LEFT JOIN (SELECT table_id, count(*) AS g FROM good GROUP BY table_id) USING (table_id)
  WHERE n_cols >= 2 AND n_x = n_cols + 1 AND n_y >= 3 AND n_y - 1 >= n_rows AND span = 1 AND w >= 12 AND h >= 8 AND (n_y - 1) * n_cols <= 4096 AND coalesce(f, 0) = coalesce(g, 0))
SELECT s.table_id, s.row, s.col, coalesce(g.text, '') AS text, round(s.x0, 6) AS x0, round(s.y0, 6) AS y0, round(s.x1, 6) AS x1, round(s.y1, 6) AS y1
FROM slots s JOIN sure USING (table_id) LEFT JOIN good g ON g.table_id = s.table_id AND g.row = s.row AND g.col = s.col""",
        "cells",
        "col_edges",
        "row_edges",
    ),
    "v01_checks": sql(_CHECKS, *_FOUND),
    "k09_reports": sql(
        """SELECT doc_id, 'verification.json' AS name, md5('{"ok":' || CASE WHEN bool_or(status = 'FAIL') THEN 'false' ELSE 'true' END || ',"result":"' || CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END
  || '","checks":[' || string_agg('{"check":"' || "check" || '","status":"' || status || '","detail":' || to_json(detail)::VARCHAR || '}', ',' ORDER BY "check") || ']}') AS md5 FROM ("""
        + _CHECKS
        + ") GROUP BY doc_id",
        *_FOUND,
    ),
    "a14_verification": sql(
        f"SELECT doc_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS result, NOT bool_or(status = 'FAIL') AS ok FROM ({_CHECKS}) GROUP BY doc_id", *_FOUND
    ),
    "v02_contents": _more(
        rf""", t AS (SELECT * REPLACE (CASE WHEN type = 'heading' AND doc_id % 4 = 0 THEN 'СОДЕРЖАНИЕ ' || left(text, 5) ELSE text END AS text) FROM ordered),
heads AS (SELECT *, {_STRIP.format("regexp_extract(text, '(?is)содержание(.*)$', 1)")} AS own FROM t WHERE contains(lower(coalesce(text, '')), 'содержание')),
entries AS (
  SELECT h.doc_id, h.page_index, h.ord, list_concat(CASE WHEN h.own <> '' THEN [h.own] ELSE [] END,
    coalesce(flatten(list(list_filter(list_transform(regexp_split_to_array(coalesce(o.text, ''), '\r?\n'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') ORDER BY o.ord, o.block_id) FILTER (o.block_id <> h.block_id AND o.y0 >= h.y0)), [])) AS lines
  FROM heads h JOIN t o ON o.doc_id = h.doc_id AND o.page_index = h.page_index GROUP BY h.doc_id, h.page_index, h.block_id, h.ord, h.own)
"""
        + _check("table_of_contents", "WARN", "contents have entries", "SELECT * FROM entries WHERE length(array_to_string(lines, ' ')) < 60 OR len(lines) < 3", "'page ' || (page_index + 1) || ': contents with ' || len(lines) || ' entries'", "page_index, ord"),
        *_ALL,
    ),
    "v03_tables": _more(
        f""", t AS (SELECT table_id, max(row) + CASE WHEN table_id % 30 = 0 THEN 0 ELSE 1 END AS n_rows FROM cells GROUP BY table_id),
found AS (
  SELECT table_id, row, col, unnest(list_filter([CASE WHEN row + rowspan > n_rows OR col + colspan > 4 THEN name || 'reaches beyond the grid' END, CASE WHEN x0 < 0 OR y0 < 0 OR right_ > 595 OR y1 > 842 OR right_ < x0 OR y1 < y0 THEN name || 'lies off the page' END], lambda m: m IS NOT NULL)) AS message
  FROM (SELECT c.*, n_rows, 't: cell (' || row || ',' || col || ') ' AS name, CASE WHEN c.table_id % 50 = 0 THEN 900 ELSE x1 END AS right_ FROM cells c JOIN t USING (table_id)))
SELECT t.table_id AS doc_id, CASE WHEN detail IS NULL THEN 'PASS' ELSE 'FAIL' END AS status, md5(coalesce(detail, 'cells lie in grid and page')) AS detail_md5
FROM t LEFT JOIN (SELECT table_id, {_TEN.format(message='message', order='row, col, message', where='')} AS detail FROM found GROUP BY table_id) USING (table_id)""",
        "cells",
    ),
    "v05_figure_flow": sql(
        _check(
            "figure_flow",
            "FAIL",
            "all files named",
            "SELECT o.doc_id, o.file FROM ordered o JOIN md USING (doc_id) WHERE o.type = 'figure' AND NOT contains(CASE WHEN o.doc_id % 6 = 0 THEN replace(content, 'images/', '') ELSE content END, o.file)",
            "'document.md: ' || file || ' not named'",
            "file",
        ),
        *_ALL,
        "links",
        "md",
    ),
    "v07_invariants": _more(
        """, broken AS (SELECT * REPLACE (CASE WHEN doc_id % 9 = 0 THEN 0 ELSE ord END AS ord, CASE WHEN i = 4 THEN 0 ELSE x1 END AS x1) FROM ordered)
SELECT doc_id, page_index, 'box' AS rule, count(*) AS n FROM broken WHERE x1 < x0 OR y1 < y0 GROUP BY ALL
UNION ALL SELECT doc_id, page_index, 'figure', count(*) FROM broken WHERE type = 'figure' AND (file IS NULL OR text IS NOT NULL) GROUP BY ALL
UNION ALL SELECT doc_id, page_index, 'confidence', count(*) FROM broken WHERE confidence < 0 OR confidence > 1 GROUP BY ALL
UNION ALL SELECT doc_id, page_index, 'order', sum(n)::BIGINT FROM (SELECT doc_id, page_index, ord, count(*) AS n FROM broken GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL""",
        *_ALL,
    ),
    "v10_figure_counts": sql(
        "SELECT doc_id, bool_and(length(content) - length(replace(content, file, '')) = length(file)) AS ok FROM ordered JOIN md USING (doc_id) WHERE type = 'figure' GROUP BY doc_id", *_ALL, "links", "md"
    ),
    "p09_lost_in_export": _more(
        f""", want AS (SELECT doc_id, page_index, block_id AS region, word, count(*) AS n FROM (SELECT *, unnest({_FOLDED.format('text')}) AS word FROM all_blocks WHERE text IS NOT NULL) GROUP BY ALL),
have AS (SELECT doc_id, page_index, block_id AS region, word, count(*) AS n FROM (SELECT *, unnest({_FOLDED.format('noisy')}) AS word FROM all_blocks WHERE text IS NOT NULL) GROUP BY ALL),
missing AS (
  SELECT w.doc_id, w.page_index, w.word FROM (SELECT doc_id, page_index, word, sum(n) AS n FROM want GROUP BY ALL) w
  LEFT JOIN (SELECT doc_id, page_index, word, sum(n) AS n FROM have GROUP BY ALL) h USING (doc_id, page_index, word) WHERE w.n > coalesce(h.n, 0))
SELECT w.doc_id, w.page_index, w.region, array_to_string(list_sort(list(w.word)), ' ') AS words
FROM want w JOIN missing m USING (doc_id, page_index, word) LEFT JOIN have h USING (doc_id, page_index, region, word) WHERE w.n > coalesce(h.n, 0) GROUP BY ALL""",
        "blocks",
        "all_blocks",
    ),
    "f11_verified_issues": sql(
        f"""SELECT doc_id, page, kind, contains(text, quote) AND {_STRIP.format('quote')} <> '' AND NOT contains(kind, 'missing') AS verified FROM (
  SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'text_missing' ELSE 'spelling' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'zzz' WHEN 1 THEN substr(text, 5, 12) ELSE ' ' END AS quote
  FROM (SELECT doc_id, page_index + 1 AS page, string_agg(text, ' ' ORDER BY i) AS text FROM all_blocks WHERE text IS NOT NULL AND i >= 0 GROUP BY doc_id, page_index))""",
        "blocks",
        "all_blocks",
    ),
    "f12_visual_review": _more(
        """, f AS (SELECT vec_id % 40 AS doc_id, vec_id % 3 AS page, vec_id % 11 / 10.0::DOUBLE AS confidence, a_x0 / 600 AS x0, a_y0 / 800 AS y0, a_x1 / 600 AS x1, a_y1 / 800 AS y1 FROM boxes),
ranked AS (SELECT * FROM f WHERE x0 BETWEEN 0 AND 1 AND y0 BETWEEN 0 AND 1 AND x1 BETWEEN 0 AND 1 AND y1 BETWEEN 0 AND 1 AND x0 < x1 AND y0 < y1 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY confidence DESC) <= 20)
SELECT d.doc_id, coalesce(issues, 0) AS issues, coalesce(suggestions, 0) AS suggestions, CASE WHEN d.doc_id % 6 = 0 THEN 'partial' WHEN coalesce(issues, 0) > 0 THEN 'completed_with_findings' ELSE 'completed' END AS status
FROM (SELECT DISTINCT doc_id FROM f) d LEFT JOIN (SELECT doc_id, count(*) FILTER (confidence >= 0.8) AS issues, count(*) FILTER (confidence < 0.8) AS suggestions FROM ranked GROUP BY doc_id) USING (doc_id)""",
        "boxes",
    ),
    "p07_unreadable": sql(
        f"""SELECT doc_id, page_index, block_id, 'unreadable_or_low_confidence' AS reason, CASE WHEN (x1 - x0) * (y1 - y0) >= 0.9 * 595 * 842 THEN 'refused' ELSE 'replaced' END AS status,
  greatest(0, floor(x0 * 2))::BIGINT AS px_x0, greatest(0, floor(y0 * 2))::BIGINT AS px_y0, least(1190, ceil(x1 * 2))::BIGINT AS px_x1, least(1684, ceil(y1 * 2))::BIGINT AS px_y1
FROM all_blocks WHERE type <> 'figure' AND ({_STRIP.format("coalesce(noisy, '')")} = '' OR contains(noisy, chr(65533)) OR confidence < 0.7)""",
        "blocks",
        "all_blocks",
    ),
    "p08_replaced_regions": sql(
        f"""SELECT doc_id, CASE WHEN bad THEN 'figure' ELSE type END AS type, count(*) AS n, count(*) FILTER (bad OR file IS NOT NULL) AS files, count(*) FILTER (bad) AS fallbacks
FROM (SELECT *, type <> 'figure' AND (x1 - x0) * (y1 - y0) < 0.9 * 595 * 842 AND ({_STRIP.format("coalesce(text, '')")} = '' OR contains(coalesce(text, ''), chr(65533)) OR confidence < 0.7) AS bad FROM all_blocks) GROUP BY ALL""",
        "blocks",
        "all_blocks",
    ),
    "x15_path_choice": sql(
        rf"""SELECT doc_id, block_id, NOT (changed > 0 AND 1 - changed / greatest(length(folded), 1) >= 0.8 AND len(list_filter(regexp_extract_all(noisy, '[A-Za-z_]{{8,}}'), lambda w: regexp_matches(w, '[aeo]'))) = 0) AS kept
FROM (SELECT *, len(regexp_extract_all(noisy, '[aeo]')) AS changed, replace(lower('я\' || noisy), 'ß', 'ss') AS folded FROM blocks WHERE type <> 'figure')""",
        "blocks",
    ),
    "x16_short_values": sql(
        rf"""SELECT doc_id, block_id, confidence >= 0.55 AND len(regexp_extract_all(w, '\S+')) BETWEEN 1 AND 3 AND 1 - confidence / 2 >= 0.45 AND {_LOOK.format('w')} = {_LOOK.format('m')} AS confirmed, w <> '' AND {_LOOK.format('w')} = {_LOOK.format('m')} AS same
FROM (SELECT *, words[1] AS w, {_MIXED.format('words[1]')} AS m FROM (SELECT *, {_WORDS} AS words FROM blocks) WHERE len(words) >= 2)""",
        "blocks",
    ),
    "x17_visible_lines": sql(
        rf"""SELECT doc_id, block_id, regexp_matches(text, '\S') AND {_LOOK.format('nfc_normalize(text)')} = {_LOOK.format('nfc_normalize(other)')} AS same
FROM (SELECT *, CASE i % 3 WHEN 0 THEN {_MIXED.format('apart')} WHEN 1 THEN apart || chr(769) ELSE apart END AS other FROM (SELECT *, """
        + "replace(" * 7
        + "text"
        + "".join(f", '{x}', '{y}' || chr({z}))" for x, y, z in (("ä", "a", 776), ("ö", "o", 776), ("ü", "u", 776), ("é", "e", 769), ("è", "e", 768), ("ñ", "n", 771), ("й", "и", 774)))
        + " AS apart FROM blocks WHERE text IS NOT NULL))",
        "blocks",
    ),
    "x18_latin_readings": sql(
        rf"""SELECT doc_id, block_id, regexp_matches(m, '[A-Za-z]') AND regexp_matches(m, '{_CYR}') AND confidence >= 0.98 AND regexp_matches(w, '^[A-Za-z0-9_./\\-]+[.,;:!?]?$') AND len(regexp_extract_all(w, '[A-Za-z]')) >= 4 AS taken
FROM (SELECT *, string_split(text, ' ')[1] AS w, {_MIXED.format("string_split(text, ' ')[1]")} AS m FROM blocks WHERE type <> 'figure')""",
        "blocks",
    ),
    "x19_valid_corrections": sql(
        rf"""SELECT doc_id, block_id, length(w) BETWEEN 4 AND 64 AND replace(w, 'ß', 'ss') <> replace(a, 'ß', 'ss') AND NOT regexp_matches(w || a, '\p{{Nd}}|_') AS valid
FROM (SELECT *, left(w, 3) || 'x' || substr(w, 5, 60) AS a FROM (SELECT *, words[1] AS w FROM (SELECT *, {_WORDS} AS words FROM blocks) WHERE len(words) >= 1))""",
        "blocks",
    ),
    "j11_blank_fields": _more(
        """, l AS (SELECT * FROM all_blocks WHERE type = 'text' AND x1 - x0 > 60),
held AS (SELECT a.doc_id, a.page_index, a.block_id AS line_id, a.x0, a.x1, r.x0 + 20 AS r0, r.x0 + 50 AS r1 FROM l a JOIN l r ON r.doc_id = a.doc_id AND r.page_index = a.page_index AND r.i % 3 = 0
  AND a.x0 < r.x0 + 20 AND r.x0 + 50 < a.x1 AND r.y0 + 10 BETWEEN a.y0 AND a.y1 + 3),
parts AS (
  SELECT doc_id, page_index, line_id, greatest(x0, coalesce(max(r1) OVER (PARTITION BY doc_id, page_index, line_id ORDER BY r0, r1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x0)) AS s0, r0 AS s1 FROM held
  UNION ALL SELECT doc_id, page_index, line_id, max(r1), x1 FROM held GROUP BY doc_id, page_index, line_id, x1)
SELECT doc_id, page_index, line_id, (row_number() OVER (PARTITION BY doc_id, page_index, line_id ORDER BY s0) - 1)::INT AS n, s0 AS x0, s1 AS x1 FROM parts WHERE s1 > s0""",
        "blocks",
        "all_blocks",
    ),
    "p03_typography_fit": _more(
        rf""", w AS (SELECT type AS role, 10.0::DOUBLE + i % 3 AS size, sum(length(text)) AS weight FROM all_blocks WHERE regexp_matches(text, '\S') GROUP BY ALL),
r AS (SELECT *, sum(weight) OVER (PARTITION BY role) AS total, row_number() OVER (PARTITION BY role ORDER BY weight DESC, size) AS rank FROM w),
p AS (SELECT role, list(size) AS sizes FROM r WHERE weight >= total * 0.05 OR rank = 1 GROUP BY role),
f AS (SELECT b.*, coalesce(p.sizes, body.sizes) AS sizes, {_UNITS} AS units FROM all_blocks b LEFT JOIN p ON p.role = b.type LEFT JOIN p body ON body.role = 'text' AND p.role IS NULL WHERE b.text IS NOT NULL),
g AS (SELECT *, list_filter(sizes, lambda s: units * s / 1000 <= x1 - x0 + 2) AS fitting FROM f)
SELECT doc_id, page_index, block_id, coalesce(list_max(fitting), list_min(sizes)) AS size_pt, len(fitting) = 0 AS overflow FROM g""",
        "blocks",
        "all_blocks",
    ),
    "a07_column_edges": sql('SELECT table_id, "at", round(edge, 6) AS edge FROM col_edges', "cells", "col_edges"),
    "j08_snapped_cells": _more(
        """, spans_x AS (SELECT table_id, "at" AS col, edge AS lo, lead(edge) OVER (PARTITION BY table_id ORDER BY "at") AS hi FROM col_edges),
spans_y AS (SELECT table_id, "at" AS row, edge AS lo, lead(edge) OVER (PARTITION BY table_id ORDER BY "at") AS hi FROM row_edges)
SELECT table_id, cell_id, row, col FROM (
  SELECT c.table_id, c.row * 10 + c.col AS cell_id, y.row, x.col, count(*) OVER (PARTITION BY c.table_id, y.row, x.col) AS n FROM cells c
  JOIN spans_x x ON x.table_id = c.table_id AND (c.x0 + c.x1) / 2 >= x.lo AND (c.x0 + c.x1) / 2 < x.hi
  JOIN spans_y y ON y.table_id = c.table_id AND (c.y0 + c.y1) / 2 >= y.lo AND (c.y0 + c.y1) / 2 < y.hi
  WHERE greatest(0, least(c.x1, x.hi) - greatest(c.x0, x.lo)) * greatest(0, least(c.y1, y.hi) - greatest(c.y0, y.lo)) / greatest(0.01, (c.x1 - c.x0) * (c.y1 - c.y0)) >= 0.8)
WHERE n = 1""",
        "cells",
        "col_edges",
        "row_edges",
    ),
    "k03_html": sql(
        f"""SELECT doc_id, length(h)::INT AS chars, md5(h) AS md5 FROM (
  SELECT doc_id, '<!doctype html>' || chr(10) || '<html><head><meta charset="utf-8"></head><body>' || chr(10) || string_agg(page, chr(10) ORDER BY page_index) || chr(10) || '</body></html>' || chr(10) AS h FROM (
    SELECT doc_id, page_index, '<section data-page="' || (page_index + 1) || '" style="position:relative;width:595.000pt;height:842.000pt">' || chr(10) || string_agg(
      '<div id="' || block_id || '" class="' || type || '" style="position:absolute;left:' || printf('%.3f', x0) || 'pt;top:' || printf('%.3f', y0) || 'pt;width:' || printf('%.3f', x1 - x0) || 'pt;height:' || printf('%.3f', y1 - y0) || 'pt">'
      || CASE WHEN type = 'figure' THEN '<img src="' || {_ESCAPED.format('file')} || '" alt="">' ELSE replace({_ESCAPED.format("coalesce(text, '')")}, chr(10), '<br>') END || '</div>', chr(10) ORDER BY ord) || chr(10) || '</section>' AS page
    FROM ordered GROUP BY doc_id, page_index) GROUP BY doc_id)""",
        *_ALL,
    ),
    "k09_models": sql(
        """SELECT doc_id, length('{"schema_version":"1.0","pages":[' || string_agg(page, ',' ORDER BY page_index) || ']}')::INT AS chars FROM (
  SELECT doc_id, page_index, '{"index":' || page_index || ',"width_pt":595.0,"height_pt":842.0,"status":"ok","blocks":[' || string_agg(
    '{"order":' || ord || ',"id":"' || block_id || '","type":"' || type || '","bbox":{"x0":' || x0 || ',"y0":' || y0 || ',"x1":' || x1 || ',"y1":' || y1 || '},"confidence":' || confidence
    || CASE WHEN text IS NOT NULL THEN ',"text":' || to_json(text)::VARCHAR ELSE '' END || CASE WHEN file IS NOT NULL THEN ',"figure":{"file":"' || file || '"}' ELSE '' END || '}', ',' ORDER BY ord) || ']}' AS page
  FROM ordered GROUP BY doc_id, page_index) GROUP BY doc_id""",
        *_ALL,
    ),
}
ORACLES["k10_saved_bundles"] = f"SELECT doc_id, 'document.md' AS name, md5 FROM ({jobs.ORACLES['k02_markdown']}) UNION ALL SELECT doc_id, 'document.html', md5 FROM ({ORACLES['k03_html']})"
ORACLES["f01_admission_stream"] = ORACLES["f01_admission"]
