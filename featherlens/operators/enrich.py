"""Enrichment of gene lists in local gene sets, all lists of all views at once.

The sets are an inverted index, a row a gene and set. One join on the gene counts the hits of every list in every set; lists and
sets are only ever held as rows, so neither their number nor their size is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats


def enrichment(lists: DataFrame, sets: DataFrame, keys: list[str], least: int = 10, most: int | None = 500) -> DataFrame:
    """keys, source, gene_set, hits, marked, drawn, population, p, fdr of every list (keys, gene) in every set it hits.

    sets: (gene, source, gene_set). The population is the genes that some set has; genes of lists outside it don't count.
    Sets of fewer than least or more than most genes aren't tested. p is the hypergeometric tail P[X >= hits]; fdr corrects
    over a list's tested sets. Repeated rows of lists and sets count once; null genes and sets are left out.
    """
    index = sets.filter("gene is not null and gene_set is not null").select("gene", "source", "gene_set").distinct()
    genes = index.select("gene").distinct()
    population = genes.agg(F.count("*").alias("population"))  # one row
    wanted = lists.filter("gene is not null").select(*keys, "gene").distinct().join(genes, "gene", "left_semi")
    drawn = wanted.groupBy(*keys).agg(F.count("*").alias("drawn"))
    size = index.groupBy("source", "gene_set").agg(F.count("*").alias("marked"))
    size = size.filter(F.col("marked") >= least) if most is None else size.filter(F.col("marked").between(least, most))
    hits = wanted.join(index, "gene").groupBy(*keys, "source", "gene_set").agg(F.count("*").alias("hits"))
    counted = hits.join(size, ["source", "gene_set"]).join(drawn, keys).crossJoin(F.broadcast(population))
    ids = [*keys, "source", "gene_set"]
    name = F.concat_ws("|", F.col("source"), F.col("gene_set"))
    return stats.bh_fdr(stats.hypergeometric_tail(counted, ids).withColumn("id", name), keys).drop("id")


def overlaps(found: DataFrame, lists: DataFrame, view: list[str], name: str, a: str, b: str, threshold: float = 0.05) -> DataFrame:
    """view, significant sets of each of lists a and b, pathway_jaccard, gene_jaccard and convergence_ratio of a and b.

    found: enrichment's rows, name the column that tells the lists of a view apart. A Jaccard of nothing, and a ratio over no
    common gene, are NULL.
    """

    def jaccard(rows: DataFrame, member: list[str], out: str) -> DataFrame:
        each = rows.filter(F.col(name).isin(a, b)).groupBy(*view, *member).agg(F.max((F.col(name) == a).cast("int")).alias("a"), F.max((F.col(name) == b).cast("int")).alias("b"))
        return each.groupBy(*view).agg(F.sum("a").alias(f"{out}_a"), F.sum("b").alias(f"{out}_b"), (F.sum(F.col("a") * F.col("b")) / F.count("*")).alias(f"{out}_jaccard"))

    sets = jaccard(found.filter(F.col("fdr") <= threshold), ["source", "gene_set"], "pathway")
    genes = jaccard(lists.filter("gene is not null").select(*view, name, "gene").distinct(), ["gene"], "gene")
    both = genes.join(sets, view, "left").withColumns({f"pathway_{x}": F.coalesce(f"pathway_{x}", F.lit(0)) for x in "ab"})
    ratio = F.when(F.col("gene_jaccard") > 0, F.col("pathway_jaccard") / F.nullif("gene_jaccard", F.lit(0.0)))
    return both.select(*view, F.col("pathway_a").alias("n_a"), F.col("pathway_b").alias("n_b"), "pathway_jaccard", "gene_jaccard", ratio.alias("convergence_ratio"))
