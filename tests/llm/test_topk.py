import math
import random
from fractions import Fraction

from featherlens.llm import topk


def brute(data, k, step):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, qv in {(i, tuple(v)) for i, v in ok if i is not None and i % step == 0}:
        scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i is None, i or 0) for i, v in ok if i != qi and len(v) == len(qv))
        out += [(qi, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    data = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    data += [(1000 + i, [0.5] * 6) for i in range(300)]  # ties
    data += [(i, [1e4 * rng.random() for _ in range(2)]) for i in range(2000, 2008)]  # another length, fewer than k
    data += [(None, [0.5] * 6), (5, None), (6, [None] * 6), (7, [float("nan")] * 6), (8, [float("inf")] * 6), (20, data[20][1]), (20, [0.0] * 6), (3000, []), (3001, [])]
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<double>, score int").repartition(5)
    monkeypatch.setattr(topk, "SPARE", 3)
    monkeypatch.setattr(topk, "BLOCK", 16)
    got = sorted(map(tuple, topk.top_k(df, 10, 20).collect()), key=str)
    assert got == brute(data, 10, 20)


def test_large_components(spark):
    data = [(i, [1e4 * i, 3e5 - i, 1e3 * i]) for i in range(30)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, 3, 10).collect()), key=str) == brute(data, 3, 10)


def exact(data, k, step):
    """brute() for components of any size: floors and products in integers, scores held to 64 bits."""
    ints = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in data]
    out = []
    for qi, qv in {(i, tuple(v)) for i, v in ints if i % step == 0}:
        scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in ints if i != qi and len(v) == len(qv))
        out += [(qi, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def test_any_finite_component(spark, monkeypatch):
    rng = random.Random(8)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    data += [(200 + i, [rng.choice([1e15, -1e15, 1e300, 1.7e308, -1.7e308, 2.0**52 + 1, 0.3, 1e-320]) for _ in range(4)]) for i in range(40)]
    data += [(240, [1e15, 1.0, 0.0, -0.5]), (260, [1e5, 2e5, 3e5, 4e5])]
    monkeypatch.setattr(topk, "BLOCK", 3)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(map(tuple, topk.top_k(df, 7, 20).collect()), key=str) == exact(data, 7, 20)


def test_lengths_of_one_id_are_two_queries(spark):
    data = [(10, [1.0, 2.0]), (10, [1.0, 2.0, 3.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, 1, 10).collect())) == sorted(exact(data, 1, 10))


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
