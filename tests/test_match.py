"""Pairs of texts by their rarest words: results against counting, and what they take."""

import random
import re
from collections import Counter

import pytest

from quire.operators import match
from quire.sources.scratch import kept


def brute(left, right, least):
    bags = lambda rows: {k: sum((Counter(re.findall(r"\w+", t.lower())) for i, t in rows if i == k), Counter()) for k, _ in rows if k is not None}
    a, b = bags(left), bags(right)
    out = []
    for i, x in a.items():
        for j, y in b.items():
            matched = (x & y).total()
            if matched and matched >= least * x.total():
                out.append((i, j, matched, x.total(), y.total()))
    return sorted(out)


@pytest.mark.parametrize("least", [0.25, 0.5, 1.0])
@pytest.mark.parametrize("step", [None, kept])
def test_pairs_equal_counting(spark, monkeypatch, least, step):
    monkeypatch.setattr(match, "OVERLAP", 3)
    monkeypatch.setattr(match, "PARTS", 2)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    draw = lambda n: " ".join(words[int(40 * rng.random() ** 3)] for _ in range(n))
    left = [(i, draw(1 + i % 9)) for i in range(20)] + [(3, "again w1 w1"), (90, ""), (None, "w1")]
    right = [(i, draw(rng.randrange(30))) for i in range(40)] + [(7, "w0 w0 w1 again"), (91, " "), (None, "w0 w1 w2")]
    args = {"step": step} if step else {}
    got = match.match_pairs(spark.createDataFrame(left, "l long, text string"), spark.createDataFrame(right, "r long, text string"), "l", "r", least, **args)
    assert sorted((x.l, x.r, x.matched, x.l_words, x.r_words) for x in got.collect()) == brute(left, right, least)


def test_texts_are_shuffled_once_and_words_that_no_item_has_never(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"item{rng.randrange(500)}" for _ in range(30))) for i in range(20)]
    texts = [(i, " ".join(f"other{rng.randrange(10**6)}" for _ in range(1000)) + " " + items[i % 20][1]) for i in range(200)]
    left, right = spark.createDataFrame(items, "l long, text string"), kept(spark.createDataFrame(texts, "r long, text string"), "texts")
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    no_quantiles = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def written():
        stages = store.stageList(None, False, False, no_quantiles, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    assert match.match_pairs(left, right, "l", "r", step=kept).count() >= 200
    assert written() - before < sum(len(t) for _, t in texts)
