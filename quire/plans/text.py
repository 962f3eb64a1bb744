"""Queries on text functions, over lines of documents with the defects of recognition."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import text as X
from ..model import bridge as B
from ..model.bridge import sql
from ..operators import match
from ..operators.align import divided, keeps_words, merged, replace_everywhere, replaced
from ..sources.scratch import kept

KEY = ["doc_id", "block_id"]
ASCII = r"^[\x20-\x7E]*$"


def lines(spark, d):
    return B.blocks(B.table(spark, d, "documents"))


def text_layer(spark, d):
    # A generator makes the text once for all that is counted in it.
    once = lines(spark, d).select(*KEY, F.explode(F.array("noisy")).alias("noisy"))
    return once.select(*KEY, X.text_layer(F.col("noisy")).alias("status"))


def scripts(spark, d):
    t = F.col("noisy")
    return lines(spark, d).groupBy("doc_id").agg(F.sum(X.script_count(t)).cast("long").alias("letters"), F.sum(X.script_count(t, ["cyrillic"])).cast("long").alias("cyrillic"), F.sum(X.mixed_words(t)).cast("long").alias("mixed_words"))


def clean(spark, d):
    return lines(spark, d).select(*KEY, X.clean(F.col("noisy")).alias("text"))


def words(spark, d):
    exploded = lines(spark, d).select("doc_id", F.explode(X.words(F.col("noisy"))).alias("word"))
    return exploded.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.countDistinct("word").alias("n_distinct"))


def keys(spark, d):
    t = F.col("noisy")
    return lines(spark, d).select(*KEY, X.word_key(t).alias("word_key"), X.ink_key(t).alias("ink_key"), X.margin_key(t).alias("margin_key"))


def looks(spark, d):
    t = F.col("noisy")
    return lines(spark, d).select(*KEY, F.md5(X.review_look(t)).alias("review"), F.md5(X.short_value_look(t)).alias("short_value"), F.md5(X.word_look(t)).alias("word"))


def similarity(spark, d):
    """Neighbouring names of customers, of equal and of different length."""
    c = B.table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" "), "c_mktsegment").alias("a"), F.concat("c_mktsegment", F.lit(" "), F.reverse("c_name")).alias("b"))
    return c.select("c_custkey", F.round(X.similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


def chunks(spark, d):
    """Sizes of the chunks of whole documents."""
    docs = B.table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(X.chunks(X.or_empty(F.col("text")), 800)).alias("n", "chunk")).select("doc_id", "n", F.length("chunk").alias("chars"), F.md5("chunk").alias("md5"))


def paths(spark, d):
    """Two readings of each line as a path, the second with Cyrillic vowels."""
    t = lines(spark, d).filter("noisy IS NOT NULL AND type <> 'figure'")
    first, second = F.concat(F.lit("я\\"), "noisy"), F.concat(F.lit("я\\"), F.translate("noisy", "aeo", "аео"))
    return t.select(*KEY, (X.choose_path(first, second) == first).alias("kept"))


def short_values(spark, d):
    word = lambda i: F.element_at(X.words(F.col("text")), i)
    t = lines(spark, d).filter(F.size(X.words(F.col("text"))) >= 2)
    ok = X.confirms_short_value(word(1), F.col("confidence"), F.translate(word(1), *B.MIXED), 1 - F.col("confidence") / 2)
    return t.select(*KEY, ok.alias("confirmed"), X.same_visible_line(word(1), F.translate(word(1), *B.MIXED)).alias("same"))


def visible_lines(spark, d):
    """Lines against themselves with accents written after their letters, and with letters of the other script."""
    t = lines(spark, d).filter("text IS NOT NULL")
    apart = F.col("text")
    for letter in "äöüéèñй":
        apart = F.replace(apart, F.lit(letter), F.lit(unicodedata.normalize("NFD", letter)))
    other = F.when(F.col("i") % 3 == 0, F.translate(apart, *B.MIXED)).when(F.col("i") % 3 == 1, F.concat(apart, F.lit("\u0301"))).otherwise(apart)
    return t.select(*KEY, X.same_visible_line(F.col("text"), other).alias("same"))


def latin_readings(spark, d):
    word = F.element_at(F.split("text", " "), 1)
    return lines(spark, d).filter("type <> 'figure'").select(*KEY, X.takes_latin_reading(F.translate(word, *B.MIXED), word, F.col("confidence")).alias("taken"))


def corrections(spark, d):
    # A generator makes the first word once for all that is asked of it; the words after it aren't looked for.
    t = lines(spark, d).select(*KEY, F.explode(F.array(X.first_word(F.col("text")))).alias("word")).filter("word <> ''")
    word = F.col("word")
    return t.select(*KEY, F.coalesce(X.valid_correction(word, F.concat(F.substring(word, 1, 3), F.lit("x"), F.substring(word, 5, 60))), F.lit(False)).alias("valid"))


def guards(spark, d):
    """Rereads of table rows that keep, extend, change or lose values."""
    l = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws(" ", F.lit("qty"), F.floor("l_quantity").cast("string"), F.lit("="), F.col("l_partkey").cast("string"), F.col("l_returnflag")).alias("old"))
    kind = F.col("l_partkey") % 4
    new = F.when(kind == 0, F.concat("old", F.lit(" more"))).when(kind == 1, F.replace("old", F.lit("="), F.lit(""))).when(kind == 2, F.concat(F.lit("no "), "old")).otherwise(F.lit("qty"))
    t = l.withColumn("new", new)
    a, b = F.col("old"), F.col("new")
    return t.select("l_orderkey", "l_linenumber", X.keeps_values(a, b).alias("keeps_values"), X.extends(a, b).alias("extends"), X.extends_words(a, b).alias("extends_words"), X.same_words(a, b).alias("same_words"), X.accepts_cell(a, b, keeps_words(a, b)).alias("accepted"))


def reread_words(spark, d):
    t = lines(spark, d).filter("type <> 'figure'").select(*KEY, "text", F.regexp_replace("noisy", "^\\S+ ", "").alias("other"))
    return t.select(*KEY, keeps_words(F.col("text"), F.col("other")).alias("kept"), merged(F.col("text"), F.col("other")).alias("merged"))


def divide_lines(spark, d):
    """Words of long blocks on three lines of equal target width, six points a character."""
    t = lines(spark, d).withColumn("words", F.split("text", " ")).filter(F.size("words") >= 3)
    parts = divided(F.col("words"), F.transform("words", lambda w: F.length(w) * 6.0), F.array(*[F.greatest(F.lit(1.0), F.length("text") * 2.0)] * 3))
    return t.select(*KEY, F.posexplode(parts).alias("n", "line"))


def replacements(spark, d):
    """All at once: the first word for the second, the second for a mark."""
    w = lambda i: F.element_at(F.split("text", " "), i)
    t = lines(spark, d).filter((F.size(F.split("text", " ")) > 3) & (w(1) != w(2)) & (w(1) != "") & (w(2) != ""))
    return t.select(*KEY, replaced(F.col("text"), F.array(w(1), w(2)), F.array(w(2), F.lit("MARK"))).alias("text"))


def dictionary(documents):
    """A dictionary that grows with the corpus: a third of all longer words, each to be written backwards."""
    found = documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]{6,}"), F.lit(0))).alias("before")).distinct()
    return found.filter(F.crc32(F.col("before").cast("binary")) % 3 == 0).select("before", F.reverse("before").alias("after"))


def dictionary_replacements(spark, d):
    """Every line with all edits of the dictionary made at once."""
    edits = kept(dictionary(B.table(spark, d, "documents")), "edits")
    t = lines(spark, d).filter("text IS NOT NULL").select(*KEY, "text")
    return replace_everywhere(t, edits).select(*KEY, F.md5("text").alias("md5"))


def hosts(spark, d):
    """Hosts written with Cyrillic letters, put into lines."""
    names = spark.createDataFrame([("store.example.com",), ("example.org",), ("data.example.net",)], "domain string")
    host = F.element_at(F.array(F.lit("stоrе.example.com"), F.lit("ехample.оrg"), F.lit("stоrе.ехamplе.соmСписок"), F.lit("other.ру")), (F.col("i") % 4 + 1).cast("int"))
    t = lines(spark, d).select(*KEY, F.concat_ws(" ", "noisy", host).alias("text"))
    return match.host_corrections(t, names, KEY)


def contents_lines(spark, d):
    t = lines(spark, d).select(*KEY, F.when(F.col("i") % 3 == 0, F.concat(F.col("i").cast("string"), F.lit(". "), F.substring("noisy", 1, 20), F.lit("   "), (F.col("doc_id") % 2000).cast("string"))).otherwise(F.col("noisy")).alias("t"))
    e = X.contents_entry(F.col("t"))
    return t.select(*KEY, e["title"].alias("title"), e["page"].alias("page")).filter("title IS NOT NULL")


def list_marks(spark, d):
    t = lines(spark, d).filter("type <> 'figure'")
    marked = F.when(F.col("i") % 4 == 0, F.concat(F.lit("- "), "text")).when(F.col("i") % 4 == 1, F.concat(F.lit("12) "), "text")).otherwise(F.col("text"))
    return t.select(*KEY, X.list_display(F.lit("list_item"), marked).alias("shown"))


def memory_failures(spark, d):
    e = B.table(spark, d, "events").select("event_id", F.concat_ws(" ", F.element_at(F.array(F.lit("Unable to allocate 24.9 MiB"), F.lit("invalid input"), F.lit("std::bad_alloc"), F.lit("page not found")), (F.col("event_id") % 4 + 1).cast("int")), F.col("event_type")).alias("m"))
    return e.select("event_id", X.is_memory_failure(F.col("m")).alias("memory"))


def styles(spark, d):
    from ..operators.typography import style

    return lines(spark, d).groupBy("type").agg(F.count("*").alias("n")).select("type", "n", style(F.col("type"))["size"].alias("size"), style(F.col("type"))["bold"].alias("bold"), style(F.col("type"))["italic"].alias("italic"))


QUERIES = {
    "x01_text_layer": text_layer,
    "x02_scripts": scripts,
    "x04_clean_text": clean,
    "x05_words": words,
    "x06_text_keys": keys,
    "x09_looks": looks,
    "x10_similarity": similarity,
    "x11_value_guards": guards,
    "x13_keeps_words": reread_words,
    "x15_path_choice": paths,
    "x16_short_values": short_values,
    "x17_visible_lines": visible_lines,
    "x18_latin_readings": latin_readings,
    "x19_valid_corrections": corrections,
    "x20_host_corrections": hosts,
    "x21_replacements": replacements,
    "x21_dictionary_replacements": dictionary_replacements,
    "x22_chunks": chunks,
    "x26_line_division": divide_lines,
    "x28_contents_lines": contents_lines,
    "x29_styles": styles,
    "x30_list_marks": list_marks,
    "x32_memory_failures": memory_failures,
}

_FOLD = "replace(lower(%s), 'ß', 'ss')"
_SQUEEZE = r"regexp_replace(regexp_replace(%s, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_SIM = "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END"
ORACLES = {
    "x01_text_layer": sql(
        r"""SELECT doc_id, block_id, CASE WHEN ink = 0 THEN 'absent' WHEN length(regexp_replace(noisy, '^\s+|\s+$', '', 'g')) < 20 THEN 'garbage'
  WHEN letters / greatest(ink, 1) < 0.35 OR controls / greatest(length(noisy), 1) > 0.05 OR marks / greatest(length(noisy), 1) > 0.01 OR mixed / greatest(words, 1) > 0.25 THEN 'garbage' ELSE 'valid' END AS status
FROM (SELECT doc_id, block_id, noisy, len(regexp_extract_all(noisy, '\S')) AS ink, len(regexp_extract_all(noisy, '[\x{400}-\x{52F}A-Za-z\x{C0}-\x{24F}]')) AS letters,
  len(regexp_extract_all(noisy, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) AS controls, length(noisy) - length(replace(noisy, chr(65533), '')) AS marks, len(regexp_extract_all(noisy, '\S+')) AS words,
  len(list_filter(regexp_extract_all(noisy, '\S+'), lambda w: regexp_matches(w, '[\x{400}-\x{52F}]') AND regexp_matches(w, '[A-Za-z\x{C0}-\x{24F}]'))) AS mixed FROM blocks)""",
        "blocks",
    ),
    "x02_scripts": sql(
        r"""SELECT doc_id, sum(len(regexp_extract_all(noisy, '[\x{400}-\x{52F}A-Za-z\x{C0}-\x{24F}]')))::BIGINT AS letters, sum(len(regexp_extract_all(noisy, '[\x{400}-\x{52F}]')))::BIGINT AS cyrillic,
  sum(len(list_filter(regexp_extract_all(noisy, '\S+'), lambda w: regexp_matches(w, '[\x{400}-\x{52F}]') AND regexp_matches(w, '[A-Za-z\x{C0}-\x{24F}]'))))::BIGINT AS mixed_words FROM blocks GROUP BY doc_id""",
        "blocks",
    ),
    "x04_clean_text": sql(r"""SELECT doc_id, block_id, regexp_replace(regexp_replace(regexp_replace(replace(noisy, chr(173), ''), '-\s*\n\s*', '', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM blocks""", "blocks"),
    "x05_words": sql(r"""SELECT doc_id, count(*) AS n_words, count(DISTINCT w) AS n_distinct FROM (SELECT doc_id, unnest(regexp_extract_all(replace(lower(noisy), 'ё', 'е'), '[\p{L}\p{N}_]+')) AS w FROM blocks) GROUP BY doc_id""", "blocks"),
    "x06_text_keys": sql(
        rf"""SELECT doc_id, block_id, array_to_string(regexp_extract_all({_FOLD % 'noisy'}, '[\p{{L}}\p{{N}}_]+'), '') AS word_key, regexp_replace({_FOLD % 'noisy'}, '\s+', '', 'g') AS ink_key,
  {_SQUEEZE % ("regexp_replace(regexp_replace(" + _FOLD % 'noisy' + r", '[^\p{L}\p{N}_]+', ' ', 'g'), '\p{Nd}+', '', 'g')")} AS margin_key FROM blocks""",
        "blocks",
    ),
    "x09_looks": sql(
        f"""SELECT doc_id, block_id, md5(translate({_FOLD % 'noisy'}, 'роуистаехкмвнп', 'poyucmaexkmbhn')) AS review, md5({_SQUEEZE % ("translate(" + _FOLD % 'noisy' + ", 'авсенкмортху', 'abcehkmoptxy')")}) AS short_value,
  md5({_FOLD % "translate(noisy, 'АВЕКМНОРСТХУаекорсух', 'ABEKMHOPCTXYaekopcyx')"}) AS word FROM blocks""",
        "blocks",
    ),
    "x10_similarity": f"SELECT c_custkey, round({_SIM}, 9) AS similarity FROM (SELECT c_custkey, c_name || ' ' || c_mktsegment AS a, c_mktsegment || ' ' || reverse(c_name) AS b FROM customer)",
    "x22_chunks": r"""WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\s]+\s*') AS t FROM documents
), sized AS (
  SELECT doc_id, t, list_transform(t, lambda x: length(x)) AS sizes FROM tokens WHERE len(t) > 0
), parts AS (
  SELECT doc_id, unnest(t) AS word, unnest(sizes) AS size, unnest(range(1, len(t) + 1)) AS k FROM sized
), sums AS (
  SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM parts
), nexts AS (
  -- The first word that doesn't fit after this one: an as-of match on the sums.
  SELECT a.doc_id, a.k, greatest(a.k + 1, coalesce(b.k + 1, 1)) AS after FROM sums a ASOF LEFT JOIN sums b ON a.doc_id = b.doc_id AND a.upto - a.size + 800 >= b.upto
), chunks AS (
  SELECT doc_id, 0 AS n, 1 AS first, after FROM nexts WHERE k = 1
  UNION ALL SELECT c.doc_id, c.n + 1, c.after, x.after FROM chunks c JOIN nexts x ON x.doc_id = c.doc_id AND x.k = c.after
)
SELECT c.doc_id, n::INT AS n, sum(size)::INT AS chars, md5(string_agg(word, '' ORDER BY k)) AS md5 FROM chunks c JOIN parts p ON p.doc_id = c.doc_id AND p.k >= c.first AND p.k < c.after GROUP BY c.doc_id, n""",
    "x28_contents_lines": sql(
        r"""SELECT doc_id, block_id, regexp_extract(t, '^(\d+(?:\.\d+)*\.\s+.+?)\s+(\d{1,4})$', 1) AS title, regexp_extract(t, '^(\d+(?:\.\d+)*\.\s+.+?)\s+(\d{1,4})$', 2) AS page
FROM (SELECT *, CASE WHEN i % 3 = 0 THEN i || '. ' || left(noisy, 20) || '   ' || (doc_id % 2000) ELSE noisy END AS t FROM blocks) WHERE regexp_matches(t, '^(\d+(?:\.\d+)*\.\s+.+?)\s+(\d{1,4})$')""",
        "blocks",
    ),
    "x29_styles": sql("SELECT type, count(*) AS n, CASE type WHEN 'heading' THEN 12.0 WHEN 'caption' THEN 10.0 ELSE 11.0 END::DOUBLE AS size, type = 'heading' AS bold, type = 'caption' AS italic FROM blocks GROUP BY type", "blocks"),
    "x30_list_marks": sql(
        r"""SELECT doc_id, block_id, CASE WHEN regexp_matches(t, '^\s*(?:[•●▪◦]|[-–—]\s|\d+[.)]\s)') THEN t ELSE '• ' || t END AS shown
FROM (SELECT *, CASE i % 4 WHEN 0 THEN '- ' || text WHEN 1 THEN '12) ' || text ELSE text END AS t FROM blocks WHERE type <> 'figure')""",
        "blocks",
    ),
    "x32_memory_failures": "SELECT event_id, regexp_matches(lower([ 'Unable to allocate 24.9 MiB', 'invalid input', 'std::bad_alloc', 'page not found'][event_id % 4 + 1] || ' ' || event_type), 'out of memory|failed to allocate|unable to allocate|insufficient memory|bad allocation|bad_alloc') AS memory FROM events",
}
