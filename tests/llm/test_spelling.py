"""op13 against brute force: every pair of words compared, roots by following forms."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import spelling

DOCS = "doc_id long, text string, lang string, source string, word string, n int"


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def brute(words):
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and distance_one(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, ws in near.items():
        best = min(((-words[x], x) for x in ws), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def collected(df):
    rows = df.collect()
    out = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows) and df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return out


def test_query_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    stems = ["".join(rng.choice(list("abcé"), int(rng.integers(6, 11)))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = []
        for w in rng.choice(stems, 40, p=(p := 1.0 / np.arange(1, 61)) / p.sum()):
            k = int(rng.integers(0, len(w)))
            kind = rng.random()
            words.append(w[:k] + w[k + 1 :] if kind < 0.05 else w[:k] + rng.choice(list("abcÀ÷")) + w[k:] if kind < 0.1 else w.upper() if kind < 0.15 else w)
        rows.append((i, " ".join(words)))
    rows += [(None, None), (None, "Nameless nameless NAMELESS"), (500, ""), (501, "short, words"), (502, "x" * 100000), (502, "x" * 100000), (503, "ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ"), rows[0]]
    docs = spark.createDataFrame([(*r, "en", "s", "x", 1) for r in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_words(rows)
    assert {r.word: r.n for r in spelling.words_of_texts(docs).collect()} == want and len(want) > 300
    assert collected(spelling.op13_spelling(spark, str(tmp_path))) == brute(want)
    assert spelling.group_variants(spelling.words_of_texts(docs.limit(0))).count() == 0


@pytest.mark.parametrize("hot,shard", [(1000, 1 << 16), (1000, 50), (0, 1 << 16), (3, 50)])
def test_all_ways_of_meeting_agree(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "SHARD", shard)
    rng = np.random.default_rng(4)
    # Few letters, so that halves are shared by many words, repeat within words, and lie at several places.
    words = {"".join(rng.choice(list("ab"), int(rng.integers(7, 11)))) for _ in range(500)} | {"a" * n for n in range(7, 14)} | {"ab" * n for n in range(4, 8)} | {"aaaa" + "b" * n for n in range(3, 8)}
    words = {w: int(10 ** rng.uniform(0.4, 4)) for w in sorted(words)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert collected(spelling.group_variants(table)) == brute(words)


def test_long_chains_reach_their_root(spark):
    # Each differs from the next by one character, with ten times its count.
    chain = ["a" * 20 + "bcdefghijklmnopq"[:i] for i in range(17)]
    words = {w: 2 * 10**i for i, w in enumerate(chain)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = collected(spelling.group_variants(table))
    assert got == brute(words) and {r for _, _, r, *_ in got} == {chain[-1]}


def test_edit():
    words = ["".join(w) for n in range(0, 5) for w in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(words, words):
        assert (spelling.edit(a, b) is not None) == distance_one(a, b)
