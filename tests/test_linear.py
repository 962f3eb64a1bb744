"""Alignment in linear space, edits by a trie, packing and first-seen words: against plain versions, and on long inputs."""

import random
import re
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from quire import plans
from quire.functions import text as X
from quire.operators import align, match


def whole_table(a, b):
    """Every cost at once; read from the end, keeping or changing goes before dropping, dropping before adding."""
    cost = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = ([cost[i - 1][j - 1] + (a[i - 1] != b[j - 1])] if i and j else []) + ([cost[i - 1][j] + 1] if i else []) + ([cost[i][j - 1] + 1] if j else [])
            cost[i][j] = min(ways, default=0)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("keep" if a[i] == b[j] else "change", i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append(("drop", i, j))
        else:
            j -= 1
            out.append(("add", i, j))
    return out[::-1]


@pytest.mark.parametrize("cells", [1, 2, 9, 40])
def test_parted_ways_are_those_of_the_whole_table(monkeypatch, cells):
    monkeypatch.setattr(align, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(400):
        a, b = ([rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert align._parted(a, b) == whole_table(a, b), (a, b)
    for word in ("a", "z"):
        for n in range(1, 6):
            b = [rng.choice("ab") for _ in range(n)]
            assert align._one(word, b) == whole_table([word], b)


def test_long_texts_take_linear_space():
    rng = random.Random(3)
    a = [f"w{rng.randrange(3000)}" for _ in range(20000)]
    b = [w for w in a if rng.random() > 0.1]
    for _ in range(1500):
        b.insert(rng.randrange(len(b)), "new")
    tracemalloc.start()
    began = time.perf_counter()
    way = align.steps(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20 and time.perf_counter() - began < 120
    assert [i for kind, i, _ in way if kind != "add"] == list(range(len(a))) and [j for kind, _, j in way if kind != "drop"] == list(range(len(b)))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(4)
    words = ["один", "two,", "three", "a.b", "наперёд", "x/y", "long-er", "wording", "aaaaaa", "e", "of"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 14))) for _ in range(40)] + ["", None, "  \n \n", "one\n" * 30]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_reread_words_of_every_line(spark, folder):
    rows = plans.text.lines(spark, folder).filter("type <> 'figure'").select("doc_id", "block_id", "text", F.regexp_replace("noisy", "^\\S+ ", "").alias("other")).collect()
    want = set()
    for r in rows:
        words = lambda t: re.findall(r"\w+", (t or "").casefold())
        kept = all(kind != "drop" for kind, _, _ in whole_table(words(r.text), words(r.other)))
        a, b = r.text.split(), r.other.split()
        merged = " ".join(a[i] if kind == "drop" else b[j] for kind, i, j in whole_table([w.casefold() for w in a], [w.casefold() for w in b]))
        want.add((r.doc_id, r.block_id, kept, merged))
    got = {tuple(r) for r in plans.QUERIES["x13_keeps_words"](spark, folder).collect()}
    assert got == want and {k for _, _, k, _ in got} == {True, False}


def by_regex(text, edits, open_end=False):
    found = "|".join(re.escape(x) for x in sorted(edits, key=lambda x: (-len(x), x)))
    return re.sub(rf"(?<![\w./\\-])(?:{found})" + ("" if open_end else r"(?![\w/\\-])"), lambda m: edits[m[0]], text)


def test_edits_of_a_trie_equal_those_of_a_pattern():
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("ab ж.-/1") for _ in range(rng.randint(1, n)))
    for _ in range(1500):
        edits = {draw(4): draw(3) for _ in range(rng.randint(1, 8))}
        text, open_end = draw(40), rng.random() < 0.5
        assert align.replace_all(text, edits, open_end) == by_regex(text, edits, open_end), (text, edits)
    assert align.replace_all("text", {}) == align.replace_all("text", {"": "x"}) == "text"


@pytest.mark.parametrize("trie", [1 << 17, 7])
def test_dictionary_replacements_of_every_line(spark, folder, monkeypatch, trie):
    import hashlib
    import zlib

    monkeypatch.setattr(align, "TRIE", trie)
    rows = plans.text.lines(spark, folder).filter("text IS NOT NULL").select("doc_id", "block_id", "text").collect()
    docs = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    words = {w for t in docs for w in re.findall(r"\w{6,}", t or "")}
    edits = {w: w[::-1] for w in words if zlib.crc32(w.encode()) % 3 == 0}
    assert edits
    want = {(r.doc_id, r.block_id, hashlib.md5(by_regex(r.text, edits).encode()).hexdigest()) for r in rows}
    assert {tuple(r) for r in plans.QUERIES["x21_dictionary_replacements"](spark, folder).collect()} == want


def test_very_many_edits(spark):
    rng = random.Random(6)
    edits = [(f"word{i} of", f"W{i}") for i in range(100_000)]
    texts = [(i, " ".join(f"word{rng.randrange(100_000)} of" for _ in range(20))) for i in range(5000)]
    began = time.perf_counter()
    got = align.replace_everywhere(spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame(edits, "before string, after string")).collect()
    assert time.perf_counter() - began < 60
    assert {(r.i, r.text) for r in got} == {(i, re.sub(r"word(\d+) of", r"W\1", t)) for i, t in texts}


def test_a_million_words_are_packed_and_cut(spark):
    rng = random.Random(7)
    sizes = [rng.choice([0, 1, 5, 30, 500]) for _ in range(1_000_000)]
    texts = spark.range(len(sizes)).select(F.lit(1).alias("doc"), F.col("id").alias("n")).join(spark.createDataFrame(list(enumerate(sizes)), "n long, size int"), "n").select("doc", "n", F.repeat(F.lit("x"), F.col("size")).alias("text"))
    began = time.perf_counter()
    got = [r.batch for r in match.pack(texts, ["doc"], ["n"], 400).orderBy("n").select("batch").collect()]
    want, batch, size = [], 0, 0
    for n in sizes:
        if size > 0 and size + n > 400:
            batch, size = batch + 1, 0
        size += n
        want.append(batch)
    assert got == want and time.perf_counter() - began < 60
    began = time.perf_counter()
    text = spark.range(1).select(F.repeat(F.lit("words of a text "), 250_000).alias("t"))
    cut = text.select(X.chunks(F.col("t"), 800).alias("c")).select(F.size("c").alias("n"), F.array_max(F.transform("c", F.length)).alias("most"), F.length(F.array_join("c", "")).alias("whole")).first()
    assert (cut.n, cut.most, cut.whole) == (5000, 800, 4_000_000) and time.perf_counter() - began < 20


def test_chunks_equal_packing_word_by_word(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "bb", "ж" * 9, "x" * 25, " ", "  ", "\n", "\t ", "😀"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    got = {r.t: r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.chunks(F.col("t"), 20).alias("c")).collect()}
    for t in texts:
        want = []
        for word in re.findall(r"\S+\s*", t):
            if want and len(want[-1]) + len(word) <= 20:
                want[-1] += word
            else:
                want.append(word)
        assert got[t] == want, t


def test_missing_words_in_order_of_first_appearance(spark):
    a = [(1, 0, "zeta alpha zeta common"), (1, 1, "zeta beta"), (2, 0, " ".join(f"w{i}" for i in range(90, 0, -1))), (3, 0, ""), (4, 0, "same")]
    b = [(1, 0, "common omega beta delta omega"), (2, 0, None), (3, 0, "only here"), (4, 0, "same")]
    schema = "k int, place int, text string"
    got = {r.k: r for r in match.text_match(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], order=["place"]).collect()}
    assert got[1].missing == ["zeta", "zeta", "zeta", "alpha"] and got[1].extra == ["omega", "omega", "delta"]
    assert got[2].missing == [f"w{i}" for i in range(90, 40, -1)] and got[2].extra == []
    assert got[3].extra == ["only", "here"] and got[4].missing == got[4].extra == [] and (got[4].precision, got[4].recall) == (1.0, 1.0)
    plan = match.text_match(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], order=["place"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
