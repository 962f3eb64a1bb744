"""Registered queries without SQL, against plain versions over all rows of small tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire import plans
from quire.plans import layout as PL
from quire.plans import text as PT

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(21)
    words = ["Überblick", "page", "of", "the", "report", "a-b", "x/y", "Straße", "long" * 9, "и", "слово", "7"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 33))) for _ in range(30)] + [None, "", "one line", "\n\n"]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)], DOCS).coalesce(1).write.parquet(f"{path}/documents.parquet")
    items = [(o, n, 37 * o + n, 1, float(rng.randint(1, 50)), 100.5 + o, rng.choice("NRA"), "O") for o in range(1, 60) for n in range(1, o % 5 + 2)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(items, schema).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    vectors = [(i, [rng.uniform(-0.4, 0.4) for _ in range(8)], i % 10) for i in range(400)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_w04_push_down(spark, folder):
    from tests.test_boxes import fold_push

    from quire.operators import typography

    b = PL.ordered(spark, folder)
    size = F.lit(11.0)
    needed = F.greatest(F.col("y1") - F.col("y0"), F.when(F.col("type") != "figure", typography.text_height(F.col("text"), F.col("x1") - F.col("x0"), size)).otherwise(0.0))
    pages = {}
    for r in rows(b.withColumn("needed", needed)):
        pages.setdefault((r["doc_id"], r["page_index"]), []).append(r | {"solid": not (r["type"] == "figure" and r["y1"] - r["y0"] <= 3)})
    want = {(*page, block, round(top, 4)) for page, items in pages.items() for block, top in fold_push(items).items()}
    got = {(r.doc_id, r.page_index, r.block_id, r.top) for r in plans.QUERIES["w04_push_down"](spark, folder).collect()}
    assert got == want and any(r["y0"] != t for r in b.collect() for *k, t in [next(x for x in want if x[:3] == (r.doc_id, r.page_index, r.block_id))])


def test_w03_repeated_margins(spark, folder):
    from tests.test_boxes import distance

    from quire.functions import text as X
    from quire.model import bridge as B
    from quire.operators.layout import G

    b = PL.ordered(spark, folder).withColumn("key", X.margin_key(F.col("text"))).withColumn("region", G.margin_region(G.of(), F.lit(B.PAGE_WIDTH), F.lit(B.PAGE_HEIGHT)))
    groups, pages = {}, {}
    for r in sorted(rows(b), key=lambda r: (r["doc_id"], r["page_index"], r["ord"], r["block_id"])):
        pages.setdefault(r["doc_id"], set()).add(r["page_index"])
        if r["type"] not in ("text", "other") or r["region"] is None or not 5 <= len(r["text"]) <= 300 or len(r["key"]) < 5:
            continue
        heads = groups.setdefault((r["doc_id"], r["region"]), [])
        alike = lambda h: 1 - distance(h, r["key"]) / max(len(h), len(r["key"])) >= 0.85  # noqa: E731, B023
        head = next((x for x in heads if alike(x[0])), None)
        if head is None:
            heads.append(head := (r["key"], []))
        head[1].append(r)
    want = set()
    for (doc, region), heads in groups.items():
        for _, found in heads:
            if len({r["page_index"] for r in found}) >= max(3, -(-len(pages[doc]) // 10)):
                want |= {(doc, r["page_index"], r["block_id"], "header" if region == "header" else "footer") for r in found}
    got = {tuple(r) for r in plans.QUERIES["w03_repeated_margins"](spark, folder).collect()}
    assert got == want and want


def test_x21_replacements(spark, folder):
    want = set()
    for r in rows(PT.lines(spark, folder).filter("text IS NOT NULL")):
        w = r["text"].split(" ")
        if len(w) > 3 and w[0] != w[1] and w[0] and w[1]:
            edits = {w[0]: w[1], w[1]: "MARK"}
            found = "|".join(re.escape(x) for x in sorted(edits, key=lambda x: (-len(x), x)))
            want.add((r["doc_id"], r["block_id"], re.sub(rf"(?<![\w./\\-])(?:{found})(?![\w/\\-])", lambda m: edits[m[0]], r["text"])))  # noqa: B023
    assert {tuple(r) for r in plans.QUERIES["x21_replacements"](spark, folder).collect()} == want and want


def test_x11_guards(spark, folder):
    got = {(r.l_orderkey, r.l_linenumber): r for r in plans.QUERIES["x11_value_guards"](spark, folder).collect()}
    table = rows(spark.read.parquet(f"{folder}/lineitem.parquet"))
    assert len(got) == len(table)
    for r in table:
        g = got[r["l_orderkey"], r["l_linenumber"]]
        kind = r["l_partkey"] % 4
        old = f"qty {int(r['l_quantity'])} = {r['l_partkey']} {r['l_returnflag']}"
        new = [old + " more", old.replace("=", ""), "no " + old, "qty"][kind]
        values = lambda t: re.findall(r"\d+(?:[.,]\d+)*|[<>≤≥±=+*/%()\[\]_-]", t)
        tokens, words = (lambda t: re.findall(r"\w+|[^\w\s]", t.lower())), (lambda t: re.findall(r"\w+", t.lower()))
        more = lambda f: bool(f(old)) and len(f(new)) > len(f(old)) and _subsequence(f(old), f(new))  # noqa: E731, B023
        assert g.keeps_values == _subsequence(values(old), values(new)), (old, new)
        assert (g.extends, g.extends_words) == (more(tokens), more(words)), (old, new)
        assert g.same_words == (re.findall(r"[^\W_]+", old.lower()) == re.findall(r"[^\W_]+", new.lower()))


def _subsequence(a, b):
    rest = iter(b)
    return all(x in rest for x in a)


def test_j02_recovered_lines(spark, folder):
    from tests.test_boxes import brute_recovered

    lines, blocks = {}, {}
    for r in rows(PL.ocr_lines(spark, folder)):
        if r["confidence"] >= 0.75 and (r["text"] or "").strip():
            lines.setdefault((r["doc_id"], r["page_index"]), []).append((r["line_no"], r["text"], r["x0"], r["y0"], r["x1"], r["y1"]))
    for r in sorted(rows(PL.ordered(spark, folder)), key=lambda r: (r["doc_id"], r["page_index"], r["ord"], r["block_id"])):
        page = blocks.setdefault((r["doc_id"], r["page_index"]), [])
        page.append((r["x0"], r["y0"], r["x1"], r["y1"], r["text"] or "", [len(page) + 1]))
    got = {}
    for r in sorted(plans.QUERIES["j02_recovered_lines"](spark, folder).collect(), key=lambda r: r.ord):
        got.setdefault((r.doc_id, r.page_index), []).append(r.text or "")
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower().replace("ß", "ss")))
    for page, own in blocks.items():
        # Words are compared as they look folded.
        want = brute_recovered([(*b[:4], plain(b[4]), b[5]) for b in own], [(n, plain(t), *box) for n, t, *box in lines.get(page, [])])
        assert [plain(t) for t in got[page]] == want, page
    assert sum(map(len, got.values())) > sum(map(len, blocks.values()))


def test_g04_merged_boxes(spark, folder):
    from quire.plans import geometry

    pages = {}
    for r in sorted(rows(geometry.boxes(spark, folder)), key=lambda r: r["vec_id"]):
        kept = pages.setdefault(r["vec_id"] // 10, [])
        box = [r[f"a_{n}"] for n in ("x0", "y0", "x1", "y1")]

        def share(other):
            inner = max(0.0, min(box[2], other[2]) - max(box[0], other[0])) * max(0.0, min(box[3], other[3]) - max(box[1], other[1]))  # noqa: B023
            area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
            whole = area(box) + area(other) - inner  # noqa: B023
            return inner / whole if whole else 0.0

        at = next((i for i, other in enumerate(kept) if share(other) >= 0.3), None)
        if at is None:
            kept.append(box)
        else:
            kept[at] = [min(kept[at][0], box[0]), min(kept[at][1], box[1]), max(kept[at][2], box[2]), max(kept[at][3], box[3])]
    want = {(page, n, *box) for page, kept in pages.items() for n, box in enumerate(kept)}
    got = {(r.page, r.n, r.x0, r.y0, r.x1, r.y1) for r in plans.QUERIES["g04_merged_boxes"](spark, folder).collect()}
    assert got == want and len(got) < 400


def test_a09_grown_rows(spark, folder):
    from quire.plans import tables as PB

    heights = {}
    for r in rows(PB.T.sizes(PB.cells(spark, folder), PB.KEY, across=False)):
        heights.setdefault(r["table_id"], {})[r["at"]] = r["size"]
    for r in sorted(rows(PB.cells(spark, folder)), key=lambda r: (r["table_id"], r["row"], r["col"])):
        own, span = heights[r["table_id"]], range(r["row"], r["row"] + r["rowspan"])
        more = max(0.0, len(r["text"]) * 4.0 - sum(own.get(i, 0.0) for i in span)) / r["rowspan"]
        for i in span:
            if i in own:
                own[i] += more
    want = {(t, at, round(size, 6)) for t, own in heights.items() for at, size in own.items()}
    assert {(r.table_id, r["at"], r.size) for r in plans.QUERIES["a09_grown_rows"](spark, folder).collect()} == want and want


def test_x20_host_corrections(spark, folder):
    # Of the four hosts that the query writes into lines, the first two are near one known domain, the third is one and more text, the last is none.
    hosts = [("stоrе.example.com", "stоrе.example.com", "store.example.com"), ("ехample.оrg", "ехample.оrg", "example.org"), ("stоrе.ехamplе.соmСписок", "stоrе.ехamplе.соm", "store.example.com"), None]
    want = set()
    for r in rows(PT.lines(spark, folder)):
        found = hosts[r["i"] % 4]
        if found:
            want.add((r["doc_id"], r["block_id"], found[1], found[2]))
    assert {tuple(r) for r in plans.QUERIES["x20_host_corrections"](spark, folder).collect()} == want and want
