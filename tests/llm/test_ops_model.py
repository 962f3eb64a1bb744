"""Tokens, pieces and nearest neighbours against brute force."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from quire.llm import ann, pieces, tokens


def test_token_histogram(spark):
    texts = [None, "", "a", "Hello there, world!", "Hello there, world!", "x" * 5000, "naïve 𝒳 <|endoftext|> 123", "\n\n  \t"] + [f"word {i} " * (i % 9) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(tokens.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lens = sorted(len(enc.encode_ordinary(t or "")) for t in texts)
    hist = tokens.histogram(tokens.encoded_lengths(docs))
    rows = {r.n_tokens: r for r in hist.collect()}
    assert sorted(rows) == sorted(set(lens))
    for n, r in rows.items():
        assert r.n_docs == lens.count(n) and r.docs_at_least == sum(x >= n for x in lens) and r.tokens_at_least == sum(x for x in lens if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lens) and r.docs_up_to == sum(x <= n for x in lens)
    for r in tokens.totals_at(hist, [0, 3, 17, 10**9]).collect():
        assert r.truncated_total == sum(min(x, r.limit) for x in lens) and r.kept_docs == sum(x <= r.limit for x in lens)
    for r in tokens.quantiles(hist, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == lens[max(math.ceil(r.share * len(lens)) - 1, 0)]


def test_token_histogram_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    hist = tokens.histogram(tokens.encoded_lengths(docs))
    assert hist.count() == 0 and [r.n_tokens for r in tokens.quantiles(hist, [0.5]).collect()] == [None]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


TEXTS = [" a  b\nc▁d\t", "", None, "hello world, naïve 𝒳𝒴 日本語テスト\r\n\r\n  x", "a" * 3000, " ", "▁", "\x00\x01", " \n", "no break <s> </s> <0x41>", "ｆｕｌｌ  width ﬁ"]


def test_pieces_decode_to_the_text(vocabulary):
    ids = pieces.encode(vocabulary, TEXTS, list(range(len(TEXTS))))
    assert pieces.decode(vocabulary, ids) == TEXTS
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for t, x in zip(TEXTS, ids):
        if t and "▁" not in t:
            assert sp.decode(x.tolist()) == t


def test_pieces_do_not_depend_on_the_batch(vocabulary):
    texts = [f"some words {i} repeated in the text " * 5 for i in range(50)]
    whole = pieces.encode(vocabulary, texts, list(range(50)))
    alone = [pieces.encode(vocabulary, [t], [i])[0] for i, t in enumerate(texts)]
    assert all((a == b).all() for a, b in zip(whole, alone))
    other = pieces.encode(vocabulary, texts, list(range(50)), seed=5)
    assert any(len(a) != len(b) or (a != b).any() for a, b in zip(whole, other))


def test_pieces_of_units_with_equal_hashes(vocabulary):
    # The words of Thue and Morse over two letters have one polynomial hash modulo 2**64, whatever the multiplier.
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    word, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    both = pieces.encode(vocabulary, [word, other, word], [1, 2, 1])
    assert pieces.decode(vocabulary, both) == [word, other, word]
    assert (both[0] == both[2]).all() and (both[1] == pieces.encode(vocabulary, [other], [2])[0]).all()
    # Whatever two units are named, their characters decide.
    codes = np.array([1, 2, 1, 2, 1, 3, 1, 2, 3, 1], np.uint32)
    first, unit = pieces._equal_units(codes, np.array([0, 2, 4, 6, 9]), np.array([2, 2, 2, 3, 1]), np.zeros(5, np.uint64))
    assert unit[0] == unit[1] and len(set(unit[[0, 2, 3, 4]].tolist())) == 4 and sorted(first.tolist()) == [0, 2, 3, 4]


def test_pieces_of_random_batches(vocabulary):
    rng = np.random.default_rng(9)
    letters = list("abc \t\n▁é𝒳日<>") + [" the", "ing "]
    for _ in range(1000):
        texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(rng.integers(1, 6))]
        ids = pieces.encode(vocabulary, texts, list(range(len(texts))))
        assert pieces.decode(vocabulary, ids) == texts
        last = len(texts) - 1
        assert (pieces.encode(vocabulary, texts[last:], [last])[0] == ids[last]).all()


def test_pieces_are_drawn_with_their_probability(vocabulary):
    word, n = "there", 20000
    ids = {p: i for i, p in enumerate(vocabulary.pieces) if p and vocabulary.weights[i]}

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in ids:
                for rest in ways(s[k:]):
                    yield (ids[s[:k]], *rest)

    weight = {w: math.prod(vocabulary.weights[i] for i in w) for w in ways(b" " + word.encode())}
    drawn = Counter(tuple(x.tolist()) for x in pieces.encode(vocabulary, [word] * n, list(range(n))))
    assert set(drawn) <= set(weight)
    assert sum(abs(weight[w] / sum(weight.values()) - drawn[w] / n) for w in weight) / 2 < 0.02


def test_pieces_across_marks():
    rows = [("<unk>", 0, False, True)] + [(f"<0x{i:02X}>", 0, True, False) for i in range(256)] + [(x, -float(i), False, False) for i, x in enumerate(["▁", "a", "b", "a▁b", "▁a"])]
    v = pieces.Vocabulary.of(rows)
    assert not v.splits
    drawn = pieces.encode(v, ["a b c a b"] * 50, list(range(50)))
    assert pieces.decode(v, drawn) == ["a b c a b"] * 50
    assert any(260 in x for x in drawn)


def test_pieces_query(spark):
    rows = [(1, "some text", 1), (1, "some text", 1), (None, None, 2), (3, "", 3), (4, "long " * 40000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.encode_documents(docs).collect()
    assert len(got) == 5 and all(r.lossless for r in got)
    assert got[0].ids == got[1].ids and [r.n_tokens for r in got if r.doc_id in (None, 3)] == [0, 0]
    assert pieces.encode_documents(docs.limit(0)).count() == 0


def brute_nearest(rows, k=20):
    best = {}
    for (qi, q), (vi, v) in itertools.product(rows, rows):
        if qi % 20 == 0 and qi != vi and len(q) == len(v):
            best.setdefault(qi, []).append((-float(np.dot(q, v)), vi))
    return {q: sorted(x)[:k] for q, x in best.items()}


def test_neighbours_of_small_tables_are_exact(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [(400, [1.0, 2.0]), (401, [2.0, 1.0])]
    odd = [(500, None), (520, [0.0] * 4), (540, [nan, 1.0, 1.0, 1.0]), (560, [inf, 1.0, 1.0, 1.0]), (580, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4), rows[3], (600, [])]
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows + odd], "vec_id long, embedding array<float>, rank int, score double")
    single = [(i, np.float32(v).astype(float)) for i, v in rows]
    want = brute_nearest(single)
    got = {}
    for r in ann.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    for q, x in want.items():
        assert [v for v, _ in got[q]] == [v for _, v in x]
        assert np.allclose([s for _, s in got[q]], [-s for s, _ in x])
    assert ann.nearest(table.limit(0)).count() == 0


def test_recall_on_vectors_of_different_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 1500)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 32))
    data = (centres[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 32))) * rng.uniform(0.5, 1.5, (4000, 1))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(data.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 4000, 20):
        s = data @ data[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 200 and hit / 4000 >= 0.9


def test_neighbours_of_vectors_that_overflow(spark):
    rows = [(0, [1e200, 1.0]), (20, [1.0, 2.0]), (40, [3.0, 1e200]), (3, [1e-310, 0.0]), (4, [-1e308, 1e308]), (60, [1e308, 1e308]), (5, [0.5, 0.25])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    with np.errstate(over="ignore", invalid="ignore"):
        for q, v in rows:
            if q % 20 == 0:
                scores = [(float((np.array(v) * np.array(x)).sum()), i) for i, x in rows if i != q]
                want = sorted(scores, key=lambda x: (math.isnan(x[0]), -x[0] if x[0] == x[0] else 0, x[1]))
                assert [i for i, _ in got[q]] == [i for _, i in want] and np.array_equal([s for _, s in got[q]], [s for s, _ in want], equal_nan=True)


def test_near_neighbours_end_a_search_early():
    rng = np.random.default_rng(7)
    data = np.repeat(rng.normal(size=(100, 16)), 40, 0) + 0.02 * rng.normal(size=(4000, 16))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    shard = ann.Shard(np.arange(4000), data, float(np.log2(np.linalg.norm(data, axis=1).max())))
    found = list(shard.search(data[::40], np.arange(0, 4000, 40)))
    # Of 40 entries a vector, if all windows opened wide.
    assert np.mean([e for _, _, e in found]) < 8 * 4000
    hits = [len(set(ids.tolist()) & set((np.argsort(-(data @ data[q]))[:21]).tolist())) for q, (ids, _, _) in zip(range(0, 4000, 40), found)]
    assert np.mean(hits) >= 0.9 * 20
