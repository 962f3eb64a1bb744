"""Recall of op4 where vectors have no structure, in one shard and in several."""

import numpy as np
import pytest

from quire.llm import ann


def recall(rows, found, k=20):
    ids, data = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = data @ data[q]
        scores[q] = -np.inf
        want = set(ids[np.argsort(-scores)[:k]].tolist())
        hit, total = hit + len(want & found[int(ids[q])]), total + len(want)
    return hit / total


@pytest.mark.parametrize("dim", [64, 128])
@pytest.mark.parametrize("n,shard", [(500, 16384), (1000, 16384), (2000, 16384), (4000, 16384), (2000, 700), (4000, 700)])
def test_recall_without_structure(spark, tmp_path, monkeypatch, dim, n, shard):
    monkeypatch.setattr(ann, "SHARD", shard)
    rng = np.random.default_rng(dim + n)
    data = rng.normal(size=(n, dim))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    rows = list(enumerate(np.float32(data).astype(float).tolist()))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {}
    for r in ann.op4_ann(spark, str(tmp_path)).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert recall(rows, found) >= 0.9
