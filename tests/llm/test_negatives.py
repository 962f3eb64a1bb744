"""op11 against brute force with whole numbers of any size."""

import math

import numpy as np
import pytest

from quire.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, family string"


def brute(rows, every=100, relabel=False):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(x * 256) for x in v):
            continue
        label = (label + 1) % 10 if relabel and i % 7 == 0 else label
        one = (label, [math.floor(x * 256) for x in v])
        best[i] = min(best.get(i, one), one)
    out = {}
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -(1 << 63)), (1 << 63) - 1)
    for a, (label, v) in best.items():
        if a % every:
            continue
        met = [(-score(v, w), i, m == label) for i, (m, w) in best.items() if i != a and len(w) == len(v)]
        for p, j, _ in sorted(x for x in met if x[2])[:5]:
            near = sorted((s, i) for s, i, same in met if not same and 30 * -p <= 100 * -s <= 90 * -p)
            for rank, (s, i) in enumerate(near[:10], 1):
                out[a, j, rank] = (i, -p, -s)
    return out


def collected(df):
    rows = df.collect()
    out = {(r.anchor_id, r.positive_id, r.rank): (r.negative_id, r.positive_score, r.negative_score) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 22), (400, 40)])
def test_negatives_of_whole_tables(spark, tmp_path, monkeypatch, shard, block):
    monkeypatch.setattr(negatives, "SHARD", shard)
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    rows = [(i, np.round(rng.normal(size=6) + 0.5, 2).tolist(), int(rng.integers(0, 3)) if i % 3 else 1) for i in range(700)]
    rows += [(1000 + i, [0.5] * 6, i % 2) for i in range(60)]  # ties
    rows += [(1100, [1.0, 2.0], 1), (1101, [2.0, 1.0], 1), (1102, [0.9, 0.8], 2), (1200, [], 1), (1201, [], 1), (1202, [], 3)]
    rows += [(1300, None, 1), (1400, [nan] + [1.0] * 5, 1), (1500, [None] + [1.0] * 5, 1), (1600, [inf] * 6, 1), (1700, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    rows += [rows[0], (0, [9.0] * 6, 2), (1800, [-1.0] * 6, 1), (1900, [0.0] * 6, 1)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert collected(negatives.mine(table)) == brute(rows)
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert collected(negatives.op11_negatives(spark, str(tmp_path))) == brute(rows, relabel=True)
    assert negatives.mine(table.limit(0)).count() == 0
    assert [t for _, t in negatives.mine(table).dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_negatives_of_very_long_vectors(spark):
    rows = [(100, [1e200, 1.0], 1), (1, [1e150, 2.0], 1), (2, [5e149, 3.0], 2), (3, [1e307, 1e307], 2), (200, [3e6, 5e6], 4), (4, [4e6, 1e6 + 0.3], 4), (5, [1e6, 2e6], 5), (300, [2.0**40, 1.0], 6), (6, [2.0**13, 1.0], 6), (7, [2.0**12, 3.5], 7)]
    assert collected(negatives.mine(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))) == brute(rows)


def test_bounds_drop_most_pairs_early():
    rng = np.random.default_rng(6)
    # Most of a product lies in few of the turned components.
    data = np.floor((rng.normal(size=(6000, 64)) * 0.85 ** np.arange(64)) @ np.linalg.qr(rng.normal(size=(64, 64)))[0] * 256)
    axes = np.linalg.eigh(data.T @ data)[1][:, ::-1]
    ids, labels = np.arange(6000), np.zeros(6000, np.int64)
    anchors = slice(0, 6000, 100)
    block = negatives.Block(ids[anchors], labels[anchors], negatives.Turned(data[anchors], axes), np.full((60, 1), negatives._LEAST), np.full((60, 1), negatives._MOST), 5, True)
    for s in range(0, 6000, 500):
        some = slice(s, s + 500)
        block.meet(ids[some], labels[some], negatives.Turned(data[some], axes))
    assert block.verified < 0.2 * 60 * 6000
    for a in range(60):
        scores = data @ data[100 * a]
        order = [i for i in np.lexsort((ids, -scores)) if i != 100 * a][:5]
        mine = np.flatnonzero(block.slot == a)
        assert block.id[mine].tolist() == order and block.score[mine].tolist() == scores[order].tolist()
