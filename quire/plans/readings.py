"""Queries on second readings, and on the files and reports of a bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import bridge as B
from ..model.bridge import sql
from ..operators import readings as R
from ..sinks import bundles
from . import quality as Q
from . import tables as PT


def parts(spark, d):
    return B.table(spark, d, "part").select("p_partkey", "p_name", "p_type", (F.col("p_partkey") % 6).alias("k"), (0.55 + F.col("p_partkey") % 10 * 0.04).alias("c"))


def uncertain(spark, d):
    """Names of parts with a number, read again alike, with a letter or the number changed, surely or not."""
    text = F.concat("p_name", F.lit(" of the stock no "), F.col("p_partkey").cast("string"))
    second = F.when(F.col("k") == 1, F.upper(text)).when(F.col("k") == 2, F.concat(F.lit("x"), F.substring(text, 2, 500))).when(F.col("k") == 3, F.concat(text, F.lit("1"))).when(F.col("k") == 4, F.reverse(F.concat("p_partkey", F.lit(" "), "p_type"))).otherwise(text)
    score = F.when(F.col("p_partkey") % 4 == 0, 0.95).when(F.col("p_partkey") % 4 == 1, 0.7).otherwise(0.99)
    x = R.uncertain_line(text, F.col("c"), second, score, F.when(F.col("p_partkey") % 5 == 0, second), F.lit(0.93))
    return parts(spark, d).select("p_partkey", F.coalesce(x["text"], F.lit("")).alias("text"), F.round(x["confidence"], 9).alias("confidence"))


def words(spark, d):
    """Names read word by word, and types as paths."""
    w = F.transform(F.split("p_type", " "), lambda t, i: F.struct(t.alias("text"), (F.lit(0.99) - 0.02 * ((F.col("p_partkey") + i) % 6)).alias("score")))
    p = F.transform(F.split("p_type", " "), lambda t, i: F.struct(F.when((F.col("p_partkey") + i) % 7 > 0, t).alias("text"), (F.lit(0.99) - 0.02 * ((F.col("p_partkey") + i) % 6)).alias("score")))
    a, b = R.joined_words(w), R.joined_path(p)
    return parts(spark, d).select("p_partkey", F.coalesce(a["text"], F.lit("")).alias("words"), F.round(a["confidence"], 9).alias("words_confidence"), F.coalesce(b["text"], F.lit("")).alias("path"), F.round(b["confidence"], 9).alias("path_confidence"))


def confirmed(spark, d):
    l = B.table(spark, d, "lineitem").select("l_orderkey", F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"), F.lit("pieces in all of the stock")).alias("text"), "l_partkey")
    second = F.when(F.col("l_partkey") % 9 == 0, F.concat(F.lit("other "), "text")).otherwise(F.upper("text"))
    return R.confirmed(l.select("l_orderkey", "text", second.alias("second"), F.when(F.col("l_partkey") % 11 == 0, 0.5).otherwise(0.95).alias("score")), ["l_orderkey"])


def cell_texts(spark, d):
    l = PT.lines(spark, d).withColumn("row", F.floor(F.col("line_no") / 10))
    found = l.select("table_id", "row", (F.col("x0") - 72).alias("x0"), (F.col("y0") - 100 - 20 * F.col("row")).alias("y0"), (F.col("x1") - 72).alias("x1"), (F.col("y1") - 100 - 20 * F.col("row")).alias("y1"), F.lit(350.0).alias("width"), F.lit(20.0).alias("height"), "text", (F.col("confidence") + 0.08).alias("score"))
    return R.cell_text(found, ["table_id", "row"]).withColumn("row", F.col("row").cast("int"))


def budgets(spark, d):
    c = PT.cells(spark, d).select((F.col("table_id") % 200).alias("page"), "table_id", "row", "col", (F.length("text") % 3 == 1).alias("empty"), (F.length("text") % 2 == 1).alias("uncertain"))
    out = R.rereading_budget(c, ["page"], ["table_id", "row", "col"])
    return out.groupBy("page").agg(F.count_if("empty").alias("empty"), F.count_if("detect").alias("detect"), F.count_if("uncertain").alias("uncertain"), F.count_if("alternate").alias("alternate"))


def bundle_files(spark, d):
    p = B.table(spark, d, "part").select("p_partkey", F.array(F.lit("json"), F.when(F.col("p_partkey") % 2 == 0, "docx"), F.when(F.col("p_partkey") % 3 == 0, "pdf_searchable")).alias("wanted"), (F.col("p_partkey") % 4 == 0).alias("docx"))
    return p.select("p_partkey", F.array_join(bundles.file_names(F.array_compact("wanted"), F.col("docx")), ",").alias("files"))


def reports(spark, d):
    """verification.json of each document, from its checks."""
    r = bundles.verification_reports(Q.checks(spark, d))
    return r.select("doc_id", "name", F.md5("content").alias("md5"))


QUERIES = {
    "m14_uncertain_lines": uncertain,
    "m13_joined_words": words,
    "m05_confirmed_blocks": confirmed,
    "m15_cell_texts": cell_texts,
    "m04_rereading_budgets": budgets,
    "k01_bundle_files": bundle_files,
    "k09_reports": reports,
}

_SQUEEZE = r"regexp_replace(regexp_replace(lower({}), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_NUMBERS = r"regexp_extract_all({}, '\d+(?:[.,]\d+)*')"
_SIM = "1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))"
ORACLES = {
    "m14_uncertain_lines": rf"""WITH t AS (SELECT p_partkey, p_type, p_partkey % 6 AS k, 0.55::DOUBLE + p_partkey % 10 * 0.04::DOUBLE AS c, p_name || ' of the stock no ' || p_partkey AS text,
  CASE p_partkey % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.7 ELSE 0.99 END::DOUBLE AS score FROM part),
s AS (SELECT *, CASE k WHEN 1 THEN upper(text) WHEN 2 THEN 'x' || substr(text, 2, 500) WHEN 3 THEN text || '1' WHEN 4 THEN reverse(p_partkey || ' ' || p_type) ELSE text END AS second_ FROM t),
a AS (SELECT *, c < 0.85 AND {_NUMBERS.format('text')} = {_NUMBERS.format('second_')} AS asked, {_SQUEEZE.format('text')} AS x, {_SQUEEZE.format('second_')} AS y FROM s),
b AS (SELECT *, CASE WHEN NOT asked THEN 0 WHEN c >= 0.65 AND score >= 0.65 AND x = y AND len(regexp_extract_all(text, '\S+')) > 3 AND len(regexp_extract_all(text, '\p{{L}}')) >= 12 THEN 1
  WHEN score >= 0.92 AND c >= 0.6 AND {_SIM.format('x', 'y')} >= 0.9 THEN 2 WHEN score >= 0.92 AND p_partkey % 5 = 0 THEN 3 ELSE 0 END AS way FROM a)
SELECT p_partkey, CASE way WHEN 0 THEN '' WHEN 1 THEN text ELSE regexp_replace(second_, '^\s+|\s+$', '', 'g') END AS text, round(CASE way WHEN 1 THEN c WHEN 2 THEN score WHEN 3 THEN least(score, 0.93) END, 9) AS confidence FROM b""",
    "m13_joined_words": """WITH w AS (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part),
u AS (SELECT p_partkey, len(w) AS n, unnest(w) AS t, unnest(range(len(w))) AS i FROM w),
s AS (SELECT *, 0.99::DOUBLE - 0.02::DOUBLE * ((p_partkey + i) % 6) AS score, (p_partkey + i) % 7 > 0 AS there FROM u)
SELECT p_partkey, CASE WHEN max(n) BETWEEN 3 AND 60 AND bool_and(score >= 0.9) THEN string_agg(t, ' ' ORDER BY i) ELSE '' END AS words, round(CASE WHEN max(n) BETWEEN 3 AND 60 AND bool_and(score >= 0.9) THEN avg(score) END, 9) AS words_confidence,
  CASE WHEN ok THEN path ELSE '' END AS path, round(CASE WHEN ok THEN low END, 9) AS path_confidence
FROM s JOIN (SELECT p_partkey, string_agg(CASE WHEN there THEN t ELSE '' END, '\\' ORDER BY i) AS path, min(score) FILTER (there) AS low,
  max(n) >= 3 AND bool_or(there) AND coalesce(bool_and(score >= 0.9) FILTER (there), true) AND length(string_agg(CASE WHEN there THEN t ELSE '' END, '\\' ORDER BY i)) >= 8 AS ok FROM s GROUP BY p_partkey) USING (p_partkey)
GROUP BY p_partkey, path, low, ok""".replace("\\\\", "\\"),
    "m05_confirmed_blocks": "SELECT l_orderkey, bool_and(l_partkey % 9 <> 0 AND l_partkey % 11 <> 0) AS confirmed FROM lineitem GROUP BY l_orderkey",
    "m15_cell_texts": sql(
        """SELECT table_id, row::INT AS row, coalesce(string_agg(text, ' ' ORDER BY y0, x0, text) FILTER (confidence + 0.08 >= 0.9 AND x1 - 72 <= 351 AND x0 >= 71), '') AS text
FROM (SELECT *, line_no // 10 AS row FROM lines) GROUP BY table_id, row""",
        "cells",
        "lines",
    ),
    "m04_rereading_budgets": sql(
        """SELECT page, count(*) FILTER (empty) AS empty, count(*) FILTER (empty AND e <= 20) AS detect, count(*) FILTER (uncertain) AS uncertain, count(*) FILTER (uncertain AND u <= 80) AS alternate FROM (
  SELECT *, sum(empty::INT) OVER w AS e, sum(uncertain::INT) OVER w AS u FROM (SELECT table_id % 200 AS page, table_id, row, col, length(text) % 3 = 1 AS empty, length(text) % 2 = 1 AS uncertain FROM cells)
  WINDOW w AS (PARTITION BY page ORDER BY table_id, row, col ROWS UNBOUNDED PRECEDING)) GROUP BY page""",
        "cells",
    ),
    "k01_bundle_files": """SELECT p_partkey, 'output-policy.json,document.json,document.md,document.html,document-flow.pdf,document-positional.pdf' || CASE WHEN p_partkey % 3 = 0 THEN ',document-searchable.pdf' ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN ',document.docx' ELSE '' END AS files FROM part""",
}
