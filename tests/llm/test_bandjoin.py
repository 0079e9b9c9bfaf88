import math
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from featherlens.llm import bandjoin

LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, p long, near string"
ITEMS = "item_id long, price double, u long, salt string"
NAMES = ("item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc")


def cents(x):
    return None if x is None or not math.isfinite(x) else math.floor(100 * x + 0.5)


def plain(lines, items, k=2, within=100, per=1000):
    out = []
    for item, price, *_ in items:
        p, pairs = cents(price), []
        for sale, no, line_item, q, amount, *_ in lines:
            a = cents(amount)
            if None in (p, item, sale, line_item, q, a) or q == 0 or line_item == item:
                continue
            u = (2 * a + q) // (2 * q)
            gap = abs(u - p)
            if gap <= within or per * gap <= max(u, p):
                pairs.append((gap, u, sale, no, line_item))
        pairs.sort(key=lambda x: (*x[:3], x[3] is not None, x[3] or 0, x[4]))
        crc = sum(zlib.crc32(f"{s},{'' if no is None else no},{i}".encode()) for _, _, s, no, i in pairs)
        sums = (len(pairs), sum(x[0] for x in pairs), crc)
        out += [(item, r + 1, *x, *sums) for r, x in enumerate(pairs[:k])] or [(item, 0, *[None] * 5, 0, 0, 0)]
    return sorted(out, key=repr)


def ours(spark, lines, items, **how):
    rows = bandjoin.band_join(spark.createDataFrame([(*x, 7, "x") for x in lines], LINES), spark.createDataFrame([(*x, 7, "x") for x in items], ITEMS), **how)
    assert tuple(rows.columns) == NAMES
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def test_plain_version(spark):
    lines = [(s, s % 4 or None, s % 7 if s % 13 else None, s % 5, 3.0 + s * s % 91 / 7) for s in range(300)] + [(9, 1, 3, 2, 8.0)] * 5
    lines += [(1, 1, 2, 1, x) for x in (None, math.nan, math.inf, -4.0, 1e6, 1000.99, 1312.0)] + [(2, 2, 5, -3, 12.0), (None, 1, 1, 1, 4.0)]
    lines += [(s, 1, 50 + s % 3, 1, 655.36 * 2**e + d) for s, (e, d) in enumerate((e, d) for e in range(4) for d in (-2.0, -0.7, 0.0, 0.7, 1.4))]
    items = [(i, 0.5 * i) for i in range(40)] + [(3, 4.0), (3, 4.0), (None, 4.0), (77, None), (78, math.nan), (79, -4.0), (80, 1e6), (81, 1000.0)]
    items += [(100 + e, 655.36 * 2**e + d) for e in range(4) for d in (-1.0, 0.0, 0.65)]
    assert ours(spark, lines, items) == plain(lines, items)
    assert ours(spark, lines, items, k=3, within=40, per=50) == plain(lines, items, 3, 40, 50)


def test_empty_tables(spark):
    assert ours(spark, [], [(1, 2.0)]) == [(1, 0, *[None] * 5, 0, 0, 0)]
    assert ours(spark, [(1, 1, 1, 1, 2.0)], []) == []


def test_own_lines_beyond_the_first(spark):
    """The nearest lines are all the item's own, at one price and at many; others lie further out."""
    lines = [(s, 1, 7, 1, 10.0 + s % 90 / 100) for s in range(500)] + [(1, 1, 8, 1, 10.95), (2, 1, 9, 1, 9.05)]
    assert ours(spark, lines, [(7, 10.0), (8, 10.0)]) == plain(lines, [(7, 10.0), (8, 10.0)])


def test_running_sums_cross_blocks(spark):
    points = [(x * x * 37 - 5000, x % 11 - 5) for x in range(400)]
    df = spark.createDataFrame(points, "at long, v long")
    want, total = [], 0
    for at, v in sorted(points):
        total += v
        want.append((at, total))
    assert sorted(map(tuple, bandjoin.running_sums(df, "at", ("v",)).collect())) == want


@settings(max_examples=300, deadline=None)
@given(st.integers(-(10**4), 10**12), st.integers(-(10**12), 10**12))
def test_outward_stays_within_the_band(p, d):
    u = p + d % (2 * max(100, abs(p) // 999 + 2)) - max(100, abs(p) // 999 + 2)
    gap = abs(u - p)
    found = bandjoin.outward(p, [u], [0, 1], [(u, 1, 1, 1)], 1, 100, 1000)
    assert bool(found) == (gap <= 100 or 1000 * gap <= max(u, p))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10**9), min_size=200, max_size=400))
def test_near_prices_lie_in_neighbouring_cells(spark, ps):
    ps = [p >> (i % 20) for i, p in enumerate(ps)]
    rows = [(p, p + d) for p in ps for d in (max(100, p // 999), -max(100, p // 1000))]
    df = spark.createDataFrame(rows, "p long, u long").select((bandjoin.cell("p", 100, 1000) - bandjoin.cell("u", 100, 1000)).alias("d"))
    assert df.filter("abs(d) > 1").count() == 0


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        bandjoin.band_join(None, None, per=1)
