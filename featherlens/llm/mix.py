"""Mixing sources to target weights: a hierarchical token budget over a domain > language > source tree.

Everything is DataFrame operations. The total budget goes down the tree level by level. Among the children of a node it
is shared by weight, but no child gets more than it can supply (its tokens times MAX_EPOCHS); what a child can't use goes
to its siblings by weight first, and only what all of them can't use is left to the level above, because a node's own
cap is the sum of its children's. The share is water-filling in closed form: children in order of cap over weight, those
below the water line get their cap, the others weight times the line.

A leaf with budget b and s tokens takes b div s whole epochs and a prefix of the next one. An epoch's order is the MD5 of
(seed, epoch, id), so it is a seeded shuffle that any engine can repeat. A document is in the prefix if its first token
is: if the tokens before it are fewer than what is left. Rows with the same id in a leaf are one step of the order: all
are in or out, so repeated rows are treated alike.

The prefix needs no sorted leaf: tokens are summed by the first BUCKET_DIGITS digits of the order key, running sums over
those few buckets find the bucket that holds the end, and only its rows are sorted to find the last key. A leaf with a
third of all rows is just a larger sum.

Null lang, source or text: '(none)' for the first two, no tokens for the last. Null ids are one id. A leaf without
tokens gets no budget and isn't selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, quoted

SEED = 17
MAX_EPOCHS = 2
#: Budget as a share of all tokens, in tenths.
BUDGET_TENTHS = 6
BUCKET_DIGITS = 3
#: Leaf tables up to this many rows are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_LEAVES = 100_000
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "code": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
#: Weight of what a table doesn't name.
OTHER_WEIGHT = 1
LEAF = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """Domain of a source by its trailing number: multiples of 3 are web, then books, then code; without one, web."""
    n = F.coalesce(F.expr("try_cast(regexp_extract(__source, '([0-9]{1,9})$', 1) as int)"), F.lit(0)) % 3
    return F.when(n == 1, "books").when(n == 2, "code").otherwise("web")


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def _leaves(docs: DataFrame) -> DataFrame:
    """docs (of doc_id, lang, source and others) with __domain, __lang, __source and __id."""
    out = docs.withColumns({"__lang": F.coalesce(F.col("lang").cast("string"), F.lit("(none)")), "__source": F.coalesce(F.col("source").cast("string"), F.lit("(none)")), "__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("(none)"))})
    return out.withColumn("__domain", domain_of(F.col("__source")))


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(None).cast("long")
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w).cast("long")).otherwise(out)
    return F.coalesce(out, F.lit(OTHER_WEIGHT).cast("long"))


def share(children: DataFrame, parents: list[str], child: str) -> DataFrame:
    """children (parents, child, cap, weight, parent_budget) with budget: the parent's budget by weight under caps."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.asc_nulls_last(F.expr("cap / nullif(cast(weight as double), 0)")), child)
    left = F.col("parent_budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = children.withColumns({"left": left.cast("double"), "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double")})
    rows = rows.withColumn("line", F.try_divide("left", "rest")).withColumn("full", F.coalesce(F.col("cap") * F.col("rest") <= F.col("weight") * F.col("left"), F.col("cap") == 0))
    # the line falls from the first child that isn't full on, so the highest one is right
    top = F.max(F.when(~F.col("full"), F.struct("line", "left", "rest"))).over(by)
    rows = rows.withColumn("top", top)
    part = F.floor(F.col("weight").cast("double") * F.col("top.left") / F.expr("nullif(top.rest, 0)")).cast("long")
    return rows.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(part, F.lit(0)))).drop("left", "rest", "line", "full", "top")


def allocate(leaves: DataFrame) -> DataFrame:
    """(domain, lang, source, tokens) -> with budget, epochs (whole ones) and remainder."""
    caps = leaves.withColumn("cap", F.col("tokens") * MAX_EPOCHS)
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    # a window over the domains, which are a handful
    total = F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * BUDGET_TENTHS / 10).cast("long")
    domains = domains.withColumns({"parent_budget": total, "weight": _weight("domain", DOMAIN_WEIGHTS)})
    domains = share(domains, [], "domain").select("domain", F.col("budget").alias("parent_budget"))
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight("lang", LANG_WEIGHTS)).join(domains, "domain")
    langs = share(langs, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("parent_budget"))
    rows = caps.withColumn("weight", F.lit(1).cast("long")).join(langs, ["domain", "lang"])
    rows = share(rows, ["domain", "lang"], "source")
    epochs = F.coalesce(F.expr("budget div nullif(tokens, 0)"), F.lit(0)).cast("int")
    return rows.select(*LEAF, "tokens", "budget", epochs.alias("epochs")).withColumn("remainder", F.col("budget") - F.col("epochs") * F.col("tokens"))


def order_key(doc_id: Column, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), epoch.cast("string"), doc_id))


def _join_small(rows: DataFrame, small: DataFrame, n: int, how: str) -> DataFrame:
    return rows.join(F.broadcast(small) if n <= MAX_BROADCAST_LEAVES else small, LEAF, how)


def leaf_plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The narrow rows (leaf, id, doc_id, tokens), the leaves' plan with last_key, and the number of leaves."""
    named = [F.col(f"__{c}").alias(c) for c in LEAF]
    narrow = cut(_leaves(docs.select("doc_id", "lang", "source", "text")).select(*named, F.col("__id").alias("id"), "doc_id", token_count(F.col("text")).alias("n")), "narrow")
    plan = cut(allocate(narrow.groupBy(*LEAF).agg(F.sum("n").alias("tokens"))), "plan")
    count = plan.count()
    keyed = _join_small(narrow, plan.filter("remainder > 0"), count, "inner").withColumn("key", order_key(F.col("id"), F.col("epochs")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*LEAF, "bucket", "remainder").agg(F.sum("n").alias("n"))
    running = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("upto", F.sum("n").over(running)).withColumn("before", F.col("upto") - F.col("n")).filter("before < remainder and upto >= remainder")
    ends = cut(ends.select(*LEAF, F.col("bucket").alias("end"), "before"), "ends")
    last = _join_small(keyed, ends, count, "inner").filter("bucket = end")
    peers = last.groupBy(*LEAF, "key", "before", "remainder").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*LEAF).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = peers.withColumn("earlier", F.col("before") + F.coalesce(F.sum("n").over(upto), F.lit(0))).filter("earlier < remainder")
    keys = inside.groupBy(*LEAF).agg(F.max("key").alias("last_key"))
    return narrow, cut(plan.join(keys, LEAF, "left"), "planned"), count


def _epochs() -> Column:
    """The epochs in which a row with id is selected."""
    partial = F.coalesce(order_key(F.col("id"), F.col("epochs")) <= F.col("last_key"), F.lit(False))
    times = F.col("epochs") + partial.cast("int")
    return F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))


def mixture(docs: DataFrame) -> DataFrame:
    """One row per selected copy: doc_id, domain, lang, source, tokens, epoch, leaf_budget."""
    narrow, plan, count = leaf_plan(docs)
    rows = _join_small(narrow, plan.drop("tokens"), count, "inner")
    return rows.select("doc_id", *LEAF, F.col("n").alias("tokens"), F.explode(_epochs()).alias("epoch"), F.col("budget").alias("leaf_budget"))


def mix(docs: DataFrame) -> DataFrame:
    """The selected copies with the documents' own columns."""
    _, plan, count = leaf_plan(docs)
    whole = F.struct(*quoted(docs)).alias("doc")
    rows = _leaves(docs.select("doc_id", "lang", "source", whole)).select(*[F.col(f"__{c}").alias(c) for c in LEAF], F.col("__id").alias("id"), "doc")
    rows = _join_small(rows, plan.select(*LEAF, "epochs", "last_key"), count, "inner")
    return rows.select(F.explode(_epochs()).alias("epoch"), "doc").select("doc.*")
