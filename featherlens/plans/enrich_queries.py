"""Queries of enrichment: parts are genes, their brands and sizes are sets, each part type is a view with two gene lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, ranking
from . import fixtures as fx
from .registry import query

_LISTS = """g AS (SELECT p_partkey AS gene, p_type AS view, p_size, p_retailprice, p_brand FROM part),
k AS (SELECT *, greatest(1, CAST(floor(count(*) OVER (PARTITION BY view) / 5.0) AS BIGINT)) AS k FROM g),
ls AS (SELECT view, 'topV' AS list_name, gene FROM k QUALIFY row_number() OVER (PARTITION BY view ORDER BY p_retailprice DESC, gene) <= k
  UNION ALL SELECT view, 'topP', gene FROM k QUALIFY row_number() OVER (PARTITION BY view ORDER BY p_size DESC, gene) <= k),
sets AS (SELECT gene, 'brand' AS source, p_brand AS gene_set FROM g WHERE p_brand IS NOT NULL UNION ALL SELECT gene, 'size', CAST(p_size AS VARCHAR) FROM g WHERE p_size IS NOT NULL),
nn AS (SELECT count(DISTINCT gene) AS population FROM sets)"""
_TESTED = """dr AS (SELECT {key}, count(*) AS drawn FROM wanted GROUP BY ALL), mk AS (SELECT source, gene_set, count(*) AS marked FROM sets GROUP BY ALL HAVING count(*) >= 10),
ct AS (SELECT {key}, source, gene_set, any_value(population) AS population, any_value(marked) AS marked, any_value(drawn) AS drawn, count(*) AS hits FROM wanted JOIN sets USING (gene) JOIN mk USING (source, gene_set) JOIN dr USING ({key}), nn GROUP BY ALL),
lf AS (SELECT i, sum(CASE WHEN i > 0 THEN ln(i) ELSE 0 END) OVER (ORDER BY i) AS lf FROM range(0, (SELECT population + 1 FROM nn)) t(i)),
xs AS (SELECT *, population AS n, marked AS m, drawn AS d, unnest(range(hits, least(marked, drawn) + 1)) AS x FROM ct),
pr AS (SELECT {key}, source, gene_set, any_value(hits) AS hits, any_value(m) AS marked, any_value(d) AS drawn, least(1.0, sum(exp(a.lf - b.lf - c.lf + e.lf - f.lf - g.lf - h.lf + i2.lf + j.lf))) AS p
  FROM xs JOIN lf a ON a.i = m JOIN lf b ON b.i = x JOIN lf c ON c.i = m - x JOIN lf e ON e.i = n - m JOIN lf f ON f.i = d - x JOIN lf g ON g.i = n - m - d + x JOIN lf h ON h.i = n JOIN lf i2 ON i2.i = d JOIN lf j ON j.i = n - d GROUP BY ALL),
q AS (SELECT *, p * count(*) OVER (PARTITION BY {key}) / row_number() OVER w AS q FROM pr WINDOW w AS (PARTITION BY {key} ORDER BY p, source || '|' || gene_set)),
fd AS (SELECT *, least(1.0, min(q) OVER (PARTITION BY {key} ORDER BY p, source || '|' || gene_set ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fdr FROM q)"""
_BY_LIST = f"{_LISTS}, wanted AS (SELECT * FROM ls), {_TESTED.format(key='view, list_name')}"
THRESHOLD = 0.05


def parts(spark, sf):
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("view"), "p_size", "p_retailprice", "p_brand")


def gene_lists(spark, sf):
    """(view, list_name, gene): each view's dearest fifth (topV) and largest fifth (topP)."""
    n = parts(spark, sf).groupBy("view").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 5)).alias("k"))
    top = lambda score, name: ranking.ranked(parts(spark, sf), ["view"], score, name="gene").join(F.broadcast(n), "view").filter("rank <= k").select("view", F.lit(name).alias("list_name"), "gene")
    return top("p_retailprice", "topV").unionAll(top("p_size", "topP"))


def gene_sets(spark, sf):
    p = parts(spark, sf)
    brand = p.select("gene", F.lit("brand").alias("source"), F.col("p_brand").alias("gene_set"))
    return brand.unionAll(p.select("gene", F.lit("size"), F.col("p_size").cast("string")))


@query("tbl_enrich_lists", f"WITH {_BY_LIST} SELECT view, list_name, source, gene_set, hits, marked, drawn, p, fdr FROM fd", "p fdr", "hits marked drawn")
def _(spark, sf):
    """Every view's lists in every set, with what is tested against what."""
    return enrich.enrichment(gene_lists(spark, sf), gene_sets(spark, sf), ["view", "list_name"], most=None).drop("population")


@query(
    "tbl_enrich_view",
    f"""WITH {_BY_LIST}, sg AS (SELECT view, source, gene_set, max(CAST(list_name = 'topV' AS INT)) AS a, max(CAST(list_name = 'topP' AS INT)) AS b FROM fd WHERE fdr <= {THRESHOLD} GROUP BY ALL),
    pw AS (SELECT view, sum(a) AS n_a, sum(b) AS n_b, sum(a * b) / count(*) AS pathway_jaccard FROM sg GROUP BY view),
    gg AS (SELECT view, gene, max(CAST(list_name = 'topV' AS INT)) AS a, max(CAST(list_name = 'topP' AS INT)) AS b FROM ls GROUP BY ALL), gj AS (SELECT view, sum(a * b) / count(*) AS gene_jaccard FROM gg GROUP BY view)
    SELECT view, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, pathway_jaccard, gene_jaccard, CASE WHEN gene_jaccard > 0 THEN pathway_jaccard / gene_jaccard END AS convergence_ratio FROM gj LEFT JOIN pw USING (view)""",
    "pathway_jaccard gene_jaccard convergence_ratio",
    "n_a n_b",
)
def _(spark, sf):
    lists = gene_lists(spark, sf)
    found = enrich.enrichment(lists, gene_sets(spark, sf), ["view", "list_name"], most=None)
    return enrich.overlaps(found, lists, ["view"], "list_name", "topV", "topP", THRESHOLD)


_WHOLE = f"{_LISTS}, wanted AS (SELECT 'all' AS query, gene FROM g QUALIFY row_number() OVER (ORDER BY p_size DESC, gene) <= (SELECT CAST(floor(count(*) / 10.0) AS BIGINT) FROM g)), {_TESTED.format(key='query')}"


@query("stat_gprofiler", f"WITH {_WHOLE} SELECT source, gene_set AS pathway_id, p AS pval, marked AS set_size, drawn AS query_size, hits AS overlap, fdr FROM fd WHERE fdr <= {THRESHOLD}", "pval fdr", "set_size query_size overlap")
def _(spark, sf):
    """One list in the sets of several sources, the significant ones with the columns of a profiling service."""
    p = parts(spark, sf)
    n = p.count()
    wanted = ranking.numbered(p, [F.desc("p_size"), F.asc("gene")], "rank").filter(F.col("rank") <= n // 10).select(F.lit("all").alias("query"), "gene")
    found = enrich.enrichment(wanted, gene_sets(spark, sf), ["query"], most=None).filter(F.col("fdr") <= THRESHOLD)
    return found.select("source", F.col("gene_set").alias("pathway_id"), F.col("p").alias("pval"), F.col("marked").alias("set_size"), F.col("drawn").alias("query_size"), F.col("hits").alias("overlap"), "fdr")
