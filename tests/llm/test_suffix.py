"""Removal of repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from quire.llm import suffix


def brute(rows):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        if doc is not None:
            for i in range(len(data) - 49):
                first[data[i : i + 50]] = min(doc, first.get(data[i : i + 50], doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if doc is not None and first[data[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, kept binary, n_bytes int")
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.remove_repeats(docs, **settings).collect()), key=str)


def cases():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé𝒳") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(6)]
    rows = [(i, text(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 80) :] + text(20) + rng.choice(shared)) for i in range(60)]
    rows += [(100 + i, rows[i % 5][1]) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "a" * 49), (203, "a" * 50), (204, "a" * 51), (205, "a" * 500), (206, "ab" * 300), (207, "ba" * 40), (208, "a" * 49)]
    rows += [(300, rows[7][1]), (300, rows[7][1]), (300, rows[8][1] + "other"), (None, rows[9][1]), (None, rows[9][1])]
    near = list(rows[3][1])
    for i in range(30):
        near[rng.randrange(len(near))] = "Z"
        rows.append((400 + i, "".join(near)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [{}, {"hot": 3}, {"buckets": 1}])
def test_equals_brute_force(spark, settings):
    rows = cases()
    assert run(spark, rows, **settings) == brute(rows)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 64)
    rng = random.Random(2)
    long = "".join(rng.choice("abcd ") for _ in range(3000))
    texts = [long, long[1000:2500] + "tail" + long[:300], "".join(rng.choice("abcd ") for _ in range(200)) + long[77:999]]
    encoded = [t.encode() for t in texts]
    seen = {}
    for data, bounds, text, place in suffix._pieces(encoded):
        seeds = suffix.Seeds(data, bounds)
        for p, s, c, o, k in zip(seeds.piece, seeds.start, seeds.count, seeds.off, seeds.key):
            for j in range(c):
                at = s + j - bounds[p] + place[p]
                string = encoded[text[p]][at : at + 50]
                assert len(string) == 50 and (text[p], at) not in seen
                seen[text[p], at] = (string, int(k))
    assert len(seen) == sum(len(t) - 49 for t in encoded)
    by_string = {}
    for string, key in seen.values():
        assert by_string.setdefault(string, key) == key


def test_interleave_finds_least_documents():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, 90).astype(np.uint8)
    shards = [np.concatenate([rng.integers(97, 100, 5).astype(np.uint8), base[i % 7 : i % 7 + 70]]) for i in range(40)]
    count = np.array([len(s) - 49 for s in shards])
    begin = np.r_[0, np.cumsum([len(s) for s in shards])[:-1]]
    doc = rng.permutation(40).astype(np.int64)
    first = {}
    strings = [(s[j : j + 50].tobytes(), d) for s, d in zip(shards, doc) for j in range(len(s) - 49)]
    for s, d in strings:
        first[s] = min(d, first.get(s, d))
    assert suffix.least_documents(np.concatenate(shards), begin, count, doc).tolist() == [first[s] for s, _ in strings]


def _naive(text):
    """Starts of the suffixes of a text that goes round, by 50 bytes, and these bytes."""
    data = bytes(text)
    wide = data * (50 // len(data) + 2)
    return sorted(range(len(data)), key=lambda i: wide[i : i + 50]), [wide[i : i + 50] for i in range(len(data))]


@pytest.mark.parametrize("letters", [1, 2, 20])
def test_shards_and_interleave_equal_a_naive_suffix_array(letters):
    rng = np.random.default_rng(letters)
    texts = [np.r_[rng.integers(97, 97 + letters, n), 255].astype(np.uint8) for n in (300, 1, 75, 120, 51)]
    texts[3][20:100] = texts[0][40:120]
    shards = [suffix.Shard(t) for t in texts]
    every = []
    for t, shard in zip(texts, shards):
        order, heads = _naive(t)
        assert [heads[i] for i in shard.order] == [heads[i] for i in order] and sorted(shard.order.tolist()) == list(range(len(t)))
        assert shard.transform.tolist() == [t[i - 1] for i in shard.order]
        assert [heads[shard.order[x]][1:50] for x in shard.longer] == [heads[i][:49] for i in shard.order]
        every += [heads[i] for i in shard.order]
    at, common = suffix.interleave(shards)
    merged = [every[i] for i in at]
    assert sorted(at.tolist()) == list(range(len(every))) and merged == sorted(every)
    shared = lambda a, b: next((k for k in range(50) if a[k] != b[k]), 50)
    assert common.tolist() == [0] + [shared(a, b) for a, b in zip(merged, merged[1:])]


def test_long_runs_and_common_strings(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD", 300)
    monkeypatch.setattr(suffix, "MERGE", 500)
    monkeypatch.setattr(suffix, "MOST_COMMON", 5)
    rows = [(i, ("=" * (60 + i) + "common passage that very many of the documents have in them, word by word") * (1 + i % 3) + str(i) * 60) for i in range(40)]
    for hot in (5, 10**6):
        assert run(spark, rows, hot=hot) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_covered_bytes_of_one_and_many_runs():
    rng = np.random.default_rng(41)
    for n in (50, 51, 120, 3000):
        starts = np.flatnonzero(rng.random(n - 49) < 0.02)
        runs = {}
        for at in starts.tolist():
            begin = at - at % 31
            runs[begin] = runs.get(begin, 0) | 1 << (at - begin)
        want = np.zeros(n, bool)
        for at in starts.tolist():
            want[at : at + 50] = True
        assert (suffix.removed_mask(n, np.array(sorted(runs.items()), np.int64).reshape(-1, 2)) == want).all()


def test_rounds_of_two_bytes_give_the_same_order():
    rng = np.random.default_rng(42)
    texts = [np.r_[rng.integers(97, 99, n), 255].astype(np.uint8) for n in (200, 90, 151)]
    shards = [suffix.Shard(t) for t in texts]
    at, common = suffix.interleave(shards)
    some, even = suffix.interleave(shards, exact=False)
    assert (at == some).all() and (common // 2 * 2 == even).all() and (common % 2).any()


def test_thinly_spread_seeds_are_hot(spark):
    # A passage in each three-hundredth row, among rows that have nothing in common.
    rng = np.random.default_rng(31)
    draw = lambda n: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, n))
    passage = draw(120)
    rows = [(i, draw(40) + (passage if i % 300 == 7 else draw(60)) + draw(40)) for i in range(12000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    found = suffix.hot_seeds(docs, 30)
    own = np.unique(suffix.Seeds(*list(suffix._pieces([passage.encode()]))[0][:2]).key)
    assert len(found) and set(found.tolist()) <= set(own.tolist())
    want = {r.doc_id: (r.n_removed, r.kept) for r in suffix.remove_repeats(docs).collect()}
    got = {r.doc_id: (r.n_removed, r.kept) for r in suffix.remove_repeats(docs, 30).collect()}
    assert got == want and sum(n >= 100 for n, _ in got.values()) == 39


def test_counts_of_common_keys_survive_lowering(monkeypatch):
    monkeypatch.setattr(suffix, "SORTED", 500)
    monkeypatch.setattr(suffix, "COUNTED", 50)
    rng = np.random.default_rng(32)
    keys = np.concatenate([rng.integers(1000, 1 << 60, 20000), np.repeat(np.arange(5), 2000)]).astype(np.uint64)
    rng.shuffle(keys)
    often = suffix.Often()
    for part in np.array_split(keys, 100):
        often.add(part)
    often.settle()
    counts = dict(zip(often.key.tolist(), often.n.tolist()))
    assert len(counts) <= 50 and all(2000 - len(keys) / 50 <= counts[k] <= 2000 for k in range(5))
