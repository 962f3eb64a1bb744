"""The corpus pipeline against brute force, stage by stage, and on odd rows."""

import hashlib
import math
import re

import numpy as np
import pytest

import corpus_pipeline
from quire.llm import classifier, mixing, pieces, secrets, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, size long, own_id long, score string"
LABELS = "doc_id long, quality int, toxic int"


def words(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]


def corpus():
    rng = np.random.default_rng(31)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    good = lambda n: " ".join(draw("abcdefgh", int(rng.integers(3, 8))) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        text = good(60 + i % 50)
        if i % 6 == 5:
            text = text.replace(" ", "$$ ").upper()
        elif i % 6 == 1:
            w = words(rows[-1][1])
            w[len(w) // 2] = "changed"
            text = " ".join(w) if i % 12 == 1 else rows[-1][1]
        if i % 7 == 0:
            text += " key " + draw(secrets.ALPHABETS["base62"], 40)
        if i % 9 == 0:
            text += ' password = "' + draw("abcxyz0189", 12) + '"'
        rows.append((i, text, "en", f"s{i % 3}" if i % 11 else None, len(text)))
        labels.append((i, int(i % 6 != 5), 0))
    rows += [(500, None, None, "s0", None), (501, "", "en", None, 0), (502, " \t\n", "en", "s1", 3), (3, rows[3][1], "en", "s0", 9), (3, rows[3][1], "en", "s0", 9), (None, good(70), "en", "s2", 1), (503, good(30000), "en", "s1", 2)]
    return [(*r, "r", 1, 2, 3, "s") for r in rows], labels


def expected_quality(rows, machine):
    def score(text, n_chars):
        at, x = classifier.features(text, n_chars)
        total = (machine.factor[at] * x[:, None]).astype(np.float64)
        pairs = total @ total.T
        raw = machine.bias + float(machine.weight[at].astype(np.float64) @ x) + float(np.triu(pairs, 1).sum())
        return 1 / (1 + math.exp(-raw))

    return [r for r in rows if score(r[1], r[4]) >= 0.5]


def expected_near(rows):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    best = {}
    for i, r in enumerate(rows):
        k = (r[0] is None, r[0] or 0)
        if root(i) not in best or k < best[root(i)][0]:
            best[root(i)] = (k, r)
    return sorted((r for _, r in best.values()), key=lambda r: (r[0] is None, r[0] or 0))


def expected_redacted(rows):
    scans = [secrets.scan(r[1] or "") for r in rows]
    found = [x for _, f in scans for x in f]
    sizes = [min(e - s, secrets.LONGEST) for s, e, _ in found]
    mean = sum(sizes) / len(sizes)
    ranked = sorted((math.floor(-10 * (p - math.log10(w / mean))) for (_, _, p), w in zip(found, sizes)), reverse=True)
    least = min((b for n, b in enumerate(ranked, 1) if 10 ** (-min(max(b, 0), 1000) / 10) <= secrets.RATE * n / len(ranked)), default=math.inf)
    out = []
    for r, (base, f) in zip(rows, scans):
        spans = sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, p in f if math.floor(-10 * (p - math.log10(min(e - s, secrets.LONGEST) / mean))) >= least])
        text, at = "", 0
        for s, e in spans:
            if s >= at:
                text += r[1][at:s] + "[SECRET]"
            at = max(at, e)
        out.append((r[0], text + r[1][at:] if spans else r[1], *r[2:]))
    return out


def expected_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        for s in over or free:
            target[s] = 2.0 * sizes[s] if over else share[s]
        left -= sum(2 * sizes[s] for s in over)
        free = free - over if over else set()
    place = lambda r: int(hashlib.md5(f"mix-1:{'null' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
    taken = []
    for s in sizes:
        own = sorted((place(r), size(r[1]), r) for r in rows if r[3] == s)
        whole = math.floor(target[s] / sizes[s]) if sizes[s] else 0
        goal, total, best = target[s] - whole * sizes[s], 0, None
        cuts = {}
        for h, n, _ in own:
            cuts[h] = cuts.get(h, 0) + n
        best = (goal, -1)
        for h in sorted(cuts):
            total += cuts[h]
            best = min(best, (abs(total - goal), h))
        taken += [r for h, _, r in own for _ in range(whole + (goal > 0 and h <= best[1]))]
    return taken


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, labels = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_equal_brute_force(spark, folder):
    docs, want = spark.read.parquet(f"{folder}/documents.parquet"), corpus()[0]
    machine = classifier.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    show = lambda rows: sorted((str(r[0]), str(r[1]), str(r[3])) for r in rows)
    for stage, brute in zip((corpus_pipeline.quality, corpus_pipeline.near_dedup, corpus_pipeline.secret_scan, corpus_pipeline.mix), (lambda r: expected_quality(r, machine), expected_near, expected_redacted, expected_mix)):
        before = len(want)
        docs, want = stage(spark, docs, folder), brute(want)
        got = docs.collect()
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        assert show(got) == show(want) and want and (stage is corpus_pipeline.mix or stage is corpus_pipeline.secret_scan or len(want) < before)
    vocabulary = pieces.Vocabulary.load()
    out = corpus_pipeline.encode(spark, docs, folder).collect()
    assert len(out) == len(want) and all(r.lossless for r in out)
    assert sorted((str(r.doc_id), pieces.decode(vocabulary, [None if r.ids is None else np.array(r.ids, np.int32)])[0] or "") for r in out) == sorted((str(r[0]), r[1] or "") for r in want)


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    show = lambda rows: sorted(str(r) for r in rows)
    assert show(corpus_pipeline.run(spark, folder).collect()) == show(docs.collect())


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_at_the_threshold_are_all_found(spark):
    # Pairs of 400 words of which the sets of shingles have a similarity of 0.80 to 0.83.
    rng, rows, pairs = np.random.default_rng(32), [], 300
    for i in range(pairs):
        w = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(404)]
        more = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(int(rng.integers(82, 101)))]
        rows += [(2 * i, " ".join(w), "en", "s", 0), (2 * i + 1, " ".join(w + more), "en", "s", 0)]
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert set(range(0, 2 * pairs, 2)) <= kept and len(kept) - pairs <= 0.01 * pairs


def test_one_source_and_blank_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one = mixing.mix_report(spark.createDataFrame([(i, "w " * (i + 1), "en", "s", 0) for i in range(20)], schema)).collect()
    assert {r.target for r in one} == {1.5 * 210} and abs(sum(r.taken for r in one) - 315) <= 20
    blank = mixing.mix_report(spark.createDataFrame([(i, None if i % 2 else " ", "en", f"s{i % 3}", 0) for i in range(9)], schema)).collect()
    assert {(r.size, r.source_size, r.target, r.taken) for r in blank} == {(0, 0, 0.0, 0)}
