"""Numeric band join: items with the lines whose unit price lies near theirs, summed over all pairs, the nearest listed.

The join is inverted to price ranges. A line of unit price u pairs with the prices from u - max(within, u div per) to
max(u + within, u + u div (per - 1)), so it adds its count, u and checksum at the start of that range and takes them off
behind its end; behind u itself they change sides, since the gap is u - p below and p - u above. Lines are summed by u first,
and running sums over the sorted positions, read at the distinct prices, give every price's totals. No pair is made for them.
Running sums go up and down a tree of blocks of 256 positions, so that no window has more rows than that. An item's own lines,
summed by (item, u), are taken off again.

The nearest lines come from an outward search. A price needs the first k lines whatever item is left out, so of each u only
the first k lines of its first k + 1 items can matter. Those lie in cells at least as wide as the band; a price looks into its
own cell and the two beside it, walks outward from its place and stops as soon as k lines remain without any one item.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A pair's gap is at most WITHIN cents, or PER times the gap at most the larger of both prices.
WITHIN, PER = 100, 1000
NEAREST = 2
#: Positions of one block of the running sums, as a power of two.
BLOCK_BITS = 8
#: Parts that one item's lines, or the items of one price, are dealt over.
SALTS = 16
#: Amounts and prices that are no finite number, or larger, count as missing.
LARGEST = float(1 << 60)
SUMS = ("n_low", "u_low", "n_high", "u_high", "crc_high", "crc_low")


def cents(x: str) -> Column:
    """floor(100 * x + 0.5) in doubles; NULL for what is missing or no finite number."""
    v = F.col(x).cast("double") * 100 + 0.5
    return F.when(F.abs(v) < LARGEST, F.floor(v)).cast("long")


def unit_lines(lines: DataFrame) -> DataFrame:
    """(line_item_id, sale_id, line_no, u) of the lines that can pair: u is the amount over the quantity in whole cents.

    Lines that miss sale_id, item_id, quantity or amount, or have a quantity of 0, are left out. line_no may be null.
    """
    known = lines.select(F.col("item_id").cast("long").alias("line_item_id"), F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), F.col("quantity").cast("long").alias("q"), cents("amount").alias("a"))
    known = known.filter("line_item_id is not null and sale_id is not null and a is not null and q <> 0")
    parts = known.select("line_item_id", "sale_id", "line_no", F.expr("if(q < 0, -(2 * a + q), 2 * a + q)").alias("over"), F.expr("abs(2 * q)").alias("under"))
    return parts.select("line_item_id", "sale_id", "line_no", F.expr("(over - pmod(over, under)) div under").alias("u"))


def running_sums(points: DataFrame, at: str, sums: tuple[str, ...]) -> DataFrame:
    """points, one row a position, with sums replaced by their running sums over ascending positions.

    points should be a written table; it is read twice a level of blocks.
    """
    first, last = points.agg(F.min(at), F.max(at)).first()
    if first is None:
        return points
    depth = max(1, -(-int(last - first).bit_length() // BLOCK_BITS))
    levels = [points.withColumn("_at", F.col(at) - F.lit(first))]
    for _ in range(depth - 1):
        levels.append(levels[-1].groupBy(F.shiftright("_at", BLOCK_BITS).alias("_at")).agg(*[F.sum(c).alias(c) for c in sums]))
    above = None
    for level in reversed(levels):
        rows = level.withColumn("_block", F.shiftright("_at", BLOCK_BITS))
        earlier = Window.partitionBy("_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({f"_b_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums})
        if above is not None:
            rows = rows.join(above, "_block").withColumns({f"_b_{c}": F.col(f"_b_{c}") + F.col(f"_a_{c}") for c in sums})
        above = rows.select(F.col("_at").alias("_block"), *[F.col(f"_b_{c}").alias(f"_a_{c}") for c in sums])
    return rows.select(*[(F.col(c) + F.col(f"_b_{c}")).alias(c) if c in sums else F.col(c) for c in points.columns])


def near(u: str, p: str, within: int, per: int) -> Column:
    gap = F.abs(F.col(u) - F.col(p))
    return (gap <= within) | (per * gap <= F.greatest(u, p))


def totals(by_u: DataFrame, prices: DataFrame, within: int, per: int) -> DataFrame:
    """(p, n, gap, crc_high, crc_low) of each price over all lines; by_u: (u, n, crc_high, crc_low), prices: distinct (p)."""
    ends = by_u.select(
        "u", "n", (F.col("n") * F.col("u")).alias("nu"), "crc_high", "crc_low",
        F.expr(f"u - greatest({within}L, u div {per})").alias("start"), F.expr(f"greatest(u + {within}, u + greatest(u, 0L) div {per - 1})").alias("end"),
    )
    zero = F.lit(0).cast("long")
    point = lambda at, *v: F.struct(at.alias("at"), *[x.alias(c) for c, x in zip(SUMS, v, strict=True)])
    n, nu, high, low = (F.col(c) for c in ("n", "nu", "crc_high", "crc_low"))
    three = F.array(point(F.col("start"), n, nu, zero, zero, high, low), point(F.col("u") + 1, -n, -nu, n, nu, zero, zero), point(F.col("end") + 1, zero, zero, -n, -nu, -high, -low))
    events = ends.select(F.explode(three).alias("e")).select("e.*", F.lit(0).alias("asked"))
    asked = prices.select(F.col("p").alias("at"), *[zero.alias(c) for c in SUMS], F.lit(1).alias("asked"))
    points = cut(events.unionByName(asked).groupBy("at").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("asked").alias("asked")), "points")
    at_price = running_sums(points, "at", SUMS).filter("asked = 1")
    gap = F.expr("u_low - at * n_low + at * n_high - u_high")
    return at_price.select(F.col("at").alias("p"), F.expr("n_low + n_high").alias("n"), gap.alias("gap"), "crc_high", "crc_low")


def own_totals(sums: DataFrame, items: DataFrame, within: int, per: int) -> DataFrame:
    """(item_id, p, own_n, own_gap, own_high, own_low): the part of the totals that an item's own lines make."""
    lines = sums.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)))
    mine = items.withColumn("salt", F.explode(F.sequence(F.expr("0L"), F.expr(f"{SALTS - 1}L"))))
    met = lines.join(mine, (lines.line_item_id == mine.item_id) & (lines.salt == mine.salt)).filter(near("u", "p", within, per))
    gap = F.col("n") * F.abs(F.col("u") - F.col("p"))
    return met.groupBy("item_id", "p").agg(F.sum("n").alias("own_n"), F.sum(gap).alias("own_gap"), F.sum("crc_high").alias("own_high"), F.sum("crc_low").alias("own_low"))


def first_lines(lines: DataFrame, k: int) -> DataFrame:
    """The lines that may be among the first k of some price: of each u the first k lines of each of its first k + 1 items."""
    order = Window.partitionBy("u", "line_item_id").orderBy("sale_id", F.asc_nulls_first("line_no"))
    first = lines.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    of_item = first.groupBy("u", "line_item_id").agg(F.sort_array(F.collect_list(F.struct("sale_id", "line_no"))).alias("few"))
    items = Window.partitionBy("u").orderBy(F.col("few")[0], "line_item_id")
    few = of_item.withColumn("_n", F.row_number().over(items)).filter(F.col("_n") <= k + 1)
    return few.select("u", "line_item_id", F.explode("few").alias("l")).select("u", "l.sale_id", "l.line_no", "line_item_id")


def cell(x: str, within: int, per: int) -> Column:
    """Number of x's cell. Cells are at least as wide as the band of the prices in them and beside them.

    Up to within * per or so they have one width, beyond it the width doubles with x.
    """
    width = max(0, (within - 1).bit_length())
    share = (per - 1).bit_length() - 1
    limit = width + share
    bits = F.length(F.bin(x))
    octave = F.expr(f"shiftright({x} - shiftleft(1L, length(bin({x})) - 1), length(bin({x})) - {share})")
    wide = (1 << share) + (bits - limit - 1) * (1 << (share - 1)) + octave
    return F.when(F.col(x) < (1 << limit), F.shiftright(x, width)).otherwise(wide).cast("long")


def outward(price: int, us: list[int], starts: list[int], rows: list[tuple], k: int, within: int, per: int) -> list[tuple[int, int]]:
    """(gap, place) of the lines, nearest first, up to where k of them remain without any one item."""
    down = bisect_right(us, price) - 1
    up, found, held = down + 1, [], {}
    while True:
        low = price - us[down] if down >= 0 else None
        if low is not None and low > within and per * low > price:
            down, low = -1, None
        high = us[up] - price if up < len(us) else None
        if high is not None and high > within and per * high > us[up]:
            up, high = len(us), None
        if low is None and high is None:
            return found
        if high is None or low is not None and low <= high:
            gap, at, down = low, down, down - 1
        else:
            gap, at, up = high, up, up + 1
        for place in range(starts[at], starts[at + 1]):
            item = rows[place][3]
            if (n := held.get(item, 0)) < k:
                held[item] = n + 1
                found.append((gap, place))
                if sum(held.values()) - max(held.values()) >= k:
                    return found


def nearest(few: DataFrame, prices: DataFrame, k: int, within: int, per: int) -> DataFrame:
    """(p, near): the first lines of each price over all items, as sorted (gap, u, sale_id, line_no, line_item_id)."""
    none = F.lit(None).cast("long")
    beside = F.explode(F.array(*[cell("p", within, per) + d for d in (-1, 0, 1)])).alias("cell")
    asked = prices.select(beside, "p", *[none.alias(c) for c in ("u", "sale_id", "line_no", "line_item_id")])
    dealt = few.select(cell("u", within, per).alias("cell"), none.alias("p"), "u", "sale_id", "line_no", "line_item_id").unionByName(asked)
    names = ["p", "gap", "u", "sale_id", "line_no", "line_item_id"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        cols = {c: t[c].to_pylist() for c in t.column_names}
        wanted = [p for p in cols["p"] if p is not None]
        rows = sorted((x for x in zip(cols["u"], cols["sale_id"], cols["line_no"], cols["line_item_id"], strict=True) if x[0] is not None), key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0, x[3]))
        us, starts = [], []
        for place, row in enumerate(rows):
            if not us or us[-1] != row[0]:
                us.append(row[0])
                starts.append(place)
        starts.append(len(rows))
        out = [(p, gap, *rows[place]) for p in wanted for gap, place in outward(p, us, starts, rows, k, within, per)]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(6)], names)

    found = dealt.groupBy("cell").applyInArrow(search, ", ".join(f"{c} long" for c in names))
    return found.groupBy("p").agg(F.sort_array(F.collect_list(F.struct(*names[1:]))).alias("near"))


def band_join(lines: DataFrame, items: DataFrame, k: int = NEAREST, within: int = WITHIN, per: int = PER) -> DataFrame:
    """Each item's first k pairs by ascending (gap, u, sale_id, line_no, line_item_id), and the sums over all its pairs.

    lines: sale_id, line_no, item_id, quantity, amount. items: item_id, price. Other columns are ignored, whatever their names.
    An item pairs with the near lines of other items; repeated lines each count and take a rank each, repeated items each get
    their rows. A null line_no comes first and is written as the empty text in the checksum. Items that miss item_id or price,
    and items without pairs, get one row of rank 0 with nulls and zeros. Empty tables are fine.
    """
    if per < 2 or within < 1 or k < 1:
        raise ValueError("within and k start at 1, per at 2")
    units = unit_lines(lines)
    crc = F.crc32(F.concat(F.col("sale_id").cast("string"), F.lit(","), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.lit(","), F.col("line_item_id").cast("string")))
    sums = cut(units.withColumn("crc", crc).groupBy("u", "line_item_id").agg(F.count("*").alias("n"), F.sum(F.shiftright("crc", 16)).alias("crc_high"), F.sum(F.col("crc").bitwiseAND(F.lit(0xFFFF))).alias("crc_low")), "by-unit-price")
    all_items = items.select(F.col("item_id").cast("long").alias("item_id"), cents("price").alias("p"))
    asked = all_items.filter("item_id is not null and p is not null").distinct()
    prices = asked.select("p").distinct()
    by_u = sums.groupBy("u").agg(*[F.sum(c).alias(c) for c in ("n", "crc_high", "crc_low")])
    of_price = totals(by_u, prices, within, per).join(nearest(first_lines(units, k), prices, k, within, per), "p", "left")
    # one row a price against the items of that price, of which one may have most
    of_price = of_price.withColumn("salt", F.explode(F.sequence(F.expr("0L"), F.expr(f"{SALTS - 1}L"))))
    mine = all_items.withColumn("p", F.when(F.col("item_id").isNotNull(), F.col("p"))).withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(SALTS)))
    met = mine.join(of_price, ["p", "salt"], "left").join(own_totals(sums, asked, within, per), ["item_id", "p"], "left")
    left = lambda c, own: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(own), F.lit(0))
    few = F.slice(F.filter("near", lambda x: x["line_item_id"] != F.col("item_id")), 1, k)
    out = met.select(
        "item_id", left("n", "own_n").alias("n_pairs"), left("gap", "own_gap").alias("gap_sum"),
        (left("crc_high", "own_high") * 65536 + left("crc_low", "own_low")).alias("lines_crc"), F.posexplode_outer(few).alias("place", "l"),
    )
    rank = F.coalesce(F.col("place") + 1, F.lit(0)).cast("int")
    return out.select("item_id", rank.alias("rank"), *[F.col(f"l.{c}").alias(c) for c in ("gap", "u", "sale_id", "line_no", "line_item_id")], "n_pairs", "gap_sum", "lines_crc")
