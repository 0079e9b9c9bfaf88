"""Queries of joins, column resolution, scalar functions, profiling and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import ranking, transform
from . import fixtures as fx
from .fixtures import EMB, FEATURES_SQL, SCATTER, VIEW
from .registry import query

# ---- joins


@query("join_inner_feature", f"WITH {FEATURES_SQL}, a AS (SELECT feature, v_total FROM ft WHERE feature <= 'f050'), b AS (SELECT feature, eta_sq FROM ft WHERE feature >= 'f010') SELECT feature, v_total, eta_sq FROM a JOIN b USING (feature)", "v_total eta_sq")
def _(spark, sf):
    f = fx.features(spark, sf)
    return f.filter("feature <= 'f050'").select("feature", "v_total").join(f.filter("feature >= 'f010'").select("feature", "eta_sq"), "feature")


@query("join_left_1to1_validated", f"WITH {FEATURES_SQL}, b AS (SELECT feature, fis AS p_xgb_score, fis_rank AS p_xgb_rank FROM vp WHERE feature >= 'f010') SELECT v.feature, v.v_rank, p_xgb_score, p_xgb_rank, (SELECT count(*) FROM (SELECT feature FROM b GROUP BY feature HAVING count(*) > 1)) AS n_dup FROM vp v LEFT JOIN b USING (feature)", "p_xgb_score", "v_rank p_xgb_rank n_dup")
def _(spark, sf):
    v = fx.vp(spark, sf)
    b = v.filter("feature >= 'f010'").select("feature", F.col("fis").alias("p_xgb_score"), F.col("fis_rank").alias("p_xgb_rank"))
    dup = b.groupBy("feature").count().filter("count > 1").agg(F.count("*").alias("n_dup"))
    return v.select("feature", "v_rank").join(b, "feature", "left").join(F.broadcast(dup))


@query("join_multi_model_chain", f"WITH {FEATURES_SQL} SELECT feature, v_rank, eta_rank AS p_eta_rank, fis_rank AS p_fis_rank, row_number() OVER (ORDER BY (eta_rank + fis_rank) / 2.0, feature) AS p_consensus_rank FROM vp", "", "v_rank p_eta_rank p_fis_rank p_consensus_rank")
def _(spark, sf):
    v = fx.vp(spark, sf)
    long = v.select("view", "feature", F.expr("stack(2, 'eta', eta_rank, 'fis', fis_rank) as (model, rank)"))
    models = long.groupBy("view", "feature").pivot("model", ["eta", "fis"]).agg(F.first("rank"))
    c = ranking.consensus(long, VIEW).select("view", "feature", "consensus_rank")
    out = v.select("view", "feature", "v_rank").join(models, ["view", "feature"], "left").join(c, ["view", "feature"], "left")
    return out.select("feature", "v_rank", F.col("eta").alias("p_eta_rank"), F.col("fis").alias("p_fis_rank"), F.col("consensus_rank").alias("p_consensus_rank"))


@query("join_left_dedup_right", "SELECT o_orderkey, s.l_suppkey AS first_supp FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey) s ON o_orderkey = l_orderkey")
def _(spark, sf):
    r = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("first_supp"))
    return fx.table(spark, sf, "orders").select("o_orderkey").join(r, "o_orderkey", "left")


@query("join_lookup_map", "WITH m AS (SELECT upper(n_name) AS k, max(n_nationkey) AS v FROM nation GROUP BY 1) SELECT c_custkey, v AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN m ON upper(n_name) = k", "", "nation")
def _(spark, sf):
    n = fx.table(spark, sf, "nation")
    m = n.groupBy(F.upper("n_name").alias("k")).agg(F.max("n_nationkey").alias("nation"))
    c = fx.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(F.broadcast(m), F.upper("n_name") == F.col("k")).select("c_custkey", "nation")


@query("join_align_to_order", f"WITH {fx.SAMPLES}, s AS (SELECT sample_id, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR))) AS ord FROM samples) SELECT count(*) AS n_rows, (SELECT count(*) FROM s WHERE sample_id NOT IN (SELECT vec_id FROM embeddings)) AS n_missing, sum(ord * label) AS checksum FROM s JOIN samples USING (sample_id)", "", "n_rows n_missing checksum")
def _(spark, sf):
    s = fx.samples(spark, sf)
    order = ranking.numbered(s.select("sample_id", F.md5(F.col("sample_id").cast("string")).alias("h")), [F.col("h")], "ord").select("sample_id", "ord")
    missing = order.join(s, "sample_id", "left_anti").agg(F.count("*").alias("n_missing"))
    return order.join(s, "sample_id").agg(F.count("*").alias("n_rows"), F.sum(F.col("ord") * F.col("label")).alias("checksum")).join(missing)


@query("join_semi_isin", f"WITH {FEATURES_SQL} SELECT sample_id, sum(x) AS total FROM emb WHERE feature IN (SELECT feature FROM vp WHERE eta_rank <= 12) GROUP BY sample_id", "total")
def _(spark, sf):
    top = fx.vp(spark, sf).filter("eta_rank <= 12").select("view", "feature")
    return fx.emb(spark, sf).join(top, ["view", "feature"], "left_semi").groupBy("sample_id").agg(F.sum("x").alias("total"))


@query("join_anti_missing_views", "SELECT view FROM (SELECT unnest(['emb', 'rna', 'meth']) AS view) WHERE view NOT IN ('emb', 'brand')")
def _(spark, sf):
    want = spark.createDataFrame([("emb",), ("rna",), ("meth",)], "view string")
    have = fx.emb(spark, sf).select("view").unionByName(fx.brand(spark, sf).select("view")).distinct()
    return want.join(have, "view", "left_anti")


@query("join_best_overlap_column", "WITH v AS (SELECT r_name AS x FROM region UNION SELECT 'BRAZIL'), c AS (SELECT 'n_name' AS col, count(*) AS hits FROM nation WHERE n_name IN (SELECT x FROM v) UNION ALL SELECT 'region', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN (SELECT x FROM v)) SELECT col, hits FROM c ORDER BY hits DESC, col LIMIT 1", "", "hits")
def _(spark, sf):
    r = fx.table(spark, sf, "region")
    n = fx.table(spark, sf, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("region"))
    v = r.select(F.col("r_name").alias("x")).union(spark.createDataFrame([("BRAZIL",)], "x string"))
    long = n.unpivot([], ["n_name", "region"], "col", "x").join(v, "x", "left_semi")
    return long.groupBy("col").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "col").limit(1)


@query("set_best_view_combo", f"WITH {EMB}, {fx.BRAND}, m AS (SELECT sample_id, bit_or(b) AS mask FROM (SELECT DISTINCT sample_id, 1 AS b FROM emb UNION ALL SELECT DISTINCT sample_id, 2 FROM brand UNION ALL SELECT c_custkey, 4 FROM customer) GROUP BY sample_id) SELECT combo, count(*) FILTER (mask & combo = combo) AS n FROM m, unnest([3, 5, 6, 7]) t(combo) GROUP BY combo", "", "combo n")
def _(spark, sf):
    bit = lambda df, b: df.select("sample_id").distinct().withColumn("b", F.lit(b))
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"))
    m = reduce(lambda a, b: a.unionByName(b), [bit(fx.emb(spark, sf), 1), bit(fx.brand(spark, sf), 2), bit(c, 4)]).groupBy("sample_id").agg(F.bit_or("b").alias("mask"))
    rows = m.withColumn("combo", F.explode(F.array(*map(F.lit, (3, 5, 6, 7)))))
    return rows.groupBy("combo").agg(F.count_if(F.col("mask").bitwiseAND(F.col("combo")) == F.col("combo")).alias("n"))


# ---- column resolution and keys


@query("proj_pick_first_col", "SELECT p_partkey AS feature, p_retailprice AS score FROM part", "score")
def _(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("feature"), F.col(transform.resolve(p.columns, ["score", "variance", "p_retailprice"])).alias("score"))


for _name in ("proj_pick_cols_multi", "proj_pick_variance_importance", "proj_coalesce_cols", "scan_variance_scores_resolver"):

    @query(_name, f"WITH {FEATURES_SQL} SELECT feature, v_total AS variance, fis AS importance FROM ft", "variance importance")
    def _(spark, sf):
        f = fx.features(spark, sf)
        pick = lambda *c: F.col(transform.resolve(f.columns, list(c)))
        return f.select("feature", pick("variance", "v_total").alias("variance"), pick("p_fis_score", "fis").alias("importance"))


@query("proj_regex_axis_resolver", f"WITH {FEATURES_SQL} SELECT feature, (fis_rank - 1) / 63.0 * 100 AS pct FROM vp", "pct")
def _(spark, sf):
    v = fx.vp(spark, sf)
    import re

    rank = next(c for c in v.columns if re.search(r"^fis.*rank$", c))
    return v.select("feature", ranking.rescaled(VIEW, rank).alias("pct"))


@query("proj_canonicalise_variance", "WITH d AS (SELECT p_brand AS feature, TRY_CAST(CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE CAST(p_retailprice AS VARCHAR) END AS DOUBLE) AS v_score, p_partkey AS ord FROM part), k AS (SELECT feature, v_score FROM d WHERE v_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feature ORDER BY v_score DESC, ord) = 1), r AS (SELECT *, row_number() OVER (ORDER BY v_score DESC, feature) AS v_rank FROM k) SELECT feature, v_score, v_rank, v_rank / CAST(count(*) OVER () AS DOUBLE) AS v_rank_pct FROM r", "v_score v_rank_pct", "v_rank")
def _(spark, sf):
    raw = fx.table(spark, sf, "part").select(F.lit("p").alias("view"), F.col("p_brand").alias("feature"), F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("raw"), F.col("p_partkey").alias("ord"))
    d = raw.withColumn("v_score", scalars.safe_double(F.col("raw"))).filter("v_score is not null")
    return ranking.dedup_max(d, VIEW, "v_score", "ord").select("feature", "v_score", F.col("rank").alias("v_rank"), F.col("rank_pct").alias("v_rank_pct"))


for _name in ("proj_canonicalise_importance", "scan_rank_list"):

    @query(_name, f"WITH {FEATURES_SQL} SELECT 'emb' AS view, 'fis' AS model, feature, fis AS p_score, fis_rank AS p_rank, fis_rank / 64.0 AS p_rank_pct FROM vp", "p_score p_rank_pct", "p_rank")
    def _(spark, sf):
        v = fx.vp(spark, sf)
        return v.select("view", F.lit("fis").alias("model"), "feature", F.col("fis").alias("p_score"), F.col("fis_rank").alias("p_rank"), ranking.rank_share(VIEW, "fis_rank").alias("p_rank_pct"))


for _name in ("proj_numeric_coerce", "fn_safe_float"):

    @query(_name, "SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 5 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS v FROM part", "v")
    def _(spark, sf):
        raw = F.when(F.col("p_size") % 5 == 0, "x").otherwise(F.col("p_size").cast("string"))
        return fx.table(spark, sf, "part").select("p_partkey", scalars.safe_double(raw).alias("v"))


_TAX = "tx AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'k__B|s__x' WHEN 1 THEN 'k__B|s__x|t__y' WHEN 2 THEN 'g__z' ELSE 'plain' END AS name FROM part)"


def _taxa(spark, sf):
    m = F.col("p_partkey") % 4
    return fx.table(spark, sf, "part").select("p_partkey", F.when(m == 0, "k__B|s__x").when(m == 1, "k__B|s__x|t__y").when(m == 2, "g__z").otherwise("plain").alias("name"))


@query("pred_semantic_species", f"WITH {_TAX} SELECT p_partkey FROM tx WHERE name LIKE '%s\\_\\_%' ESCAPE '\\' AND name NOT LIKE '%t\\_\\_%' ESCAPE '\\'")
def _(spark, sf):
    return _taxa(spark, sf).filter(F.col("name").contains("s__") & ~F.col("name").contains("t__")).select("p_partkey")


@query("pred_multilevel_taxonomy_probe", f"WITH {_TAX} SELECT bool_or(regexp_matches(name, '[kpcofgst]__')) AS multilevel FROM (SELECT name FROM tx ORDER BY p_partkey LIMIT 500)")
def _(spark, sf):
    return _taxa(spark, sf).orderBy("p_partkey").limit(500).agg(F.bool_or(F.col("name").rlike("[kpcofgst]__")).alias("multilevel"))


@query("pred_view_kw_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE regexp_matches(lower(c_mktsegment), 'auto|mach')")
def _(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_mktsegment").withColumn("hit", F.lower("c_mktsegment").rlike("auto|mach"))
    some = c.agg(F.bool_or("hit").alias("some"))
    return c.join(F.broadcast(some)).filter(F.col("hit") | ~F.col("some")).select("c_custkey", "c_mktsegment")


for _name in ("proj_split_key", "proj_vp_filename"):

    @query(_name, "SELECT n_nationkey, r_name AS dataset, n_name AS view FROM nation JOIN region ON n_regionkey = r_regionkey", "", "n_nationkey")
    def _(spark, sf):
        n = fx.table(spark, sf, "nation").join(fx.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        path = n.select("n_nationkey", F.concat(F.lit("/out/vp_joined__"), "r_name", F.lit("__"), "n_name", F.lit(".csv.gz")).alias("p"))
        part = lambda i: F.regexp_extract("p", r"vp_joined__(.+?)__(.+?)\.csv(\.gz)?$", i)
        return path.select("n_nationkey", part(1).alias("dataset"), part(2).alias("view"))


@query("scan_di_values", f"WITH {SCATTER}, a AS (SELECT view, di AS a FROM sc WHERE di > 1), b AS (SELECT view, di_lo AS b FROM sc WHERE delta > 0) SELECT sc.view, coalesce(a, b, di_hi) AS di FROM sc LEFT JOIN a USING (view) LEFT JOIN b USING (view)", "di")
def _(spark, sf):
    s = fx.scatter(spark, sf)
    a, b = s.filter("di > 1").select("view", F.col("di").alias("a")), s.filter("delta > 0").select("view", F.col("di_lo").alias("b"))
    return s.join(a, "view", "left").join(b, "view", "left").select("view", F.coalesce("a", "b", "di_hi").alias("di"))


# ---- scalar functions

_IDS = "ids AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'TCGA.' ELSE 'X.' END || p_partkey || '.AB.CDEFGHIJ_profile' AS s FROM part)"


def _ids(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "TCGA.").otherwise("X."), F.col("p_partkey").cast("string"), F.lit(".AB.CDEFGHIJ_profile")).alias("s"))


@query("fn_normalize_id", f"WITH {_IDS} SELECT p_partkey, CASE WHEN s LIKE 'TCGA%' THEN substr(replace(s, '.', '-'), 1, 15) ELSE replace(s, '.', '-') END AS id FROM ids")
def _(spark, sf):
    return _ids(spark, sf).select("p_partkey", scalars.normalize_id(F.col("s")).alias("id"))


@query("fn_strip_suffix", f"WITH {_IDS} SELECT p_partkey, regexp_replace(s, '(_profile|_counts)$', '') AS id FROM ids")
def _(spark, sf):
    return _ids(spark, sf).select("p_partkey", scalars.strip_suffix(F.col("s"), ["_profile", "_counts"]).alias("id"))


@query("fn_token_prefix", f"WITH {_IDS} SELECT p_partkey, list_filter(string_split(s, '.'), lambda t: starts_with(t, 'AB') OR starts_with(t, 'TC'))[1] AS token FROM ids")
def _(spark, sf):
    return _ids(spark, sf).select("p_partkey", scalars.first_token(F.col("s"), ["AB", "TC"], r"\.").alias("token"))


@query("fn_gene_from_feature", f"WITH {_IDS} SELECT p_partkey, coalesce(nullif(regexp_extract(s, '^TCGA\\.(\\d+)', 1), ''), nullif(regexp_extract(s, '\\.(\\d+)\\.AB', 1), '')) AS gene FROM ids")
def _(spark, sf):
    get = lambda p: F.nullif(F.regexp_extract("s", p, 1), F.lit(""))
    return _ids(spark, sf).select("p_partkey", F.coalesce(get(r"^TCGA\.(\d+)"), get(r"\.(\d+)\.AB")).alias("gene"))


@query("fn_feature_type", "SELECT c_custkey, CASE split_part(c_name, '#', 1) WHEN 'Customer' THEN 'person' ELSE 'other' END AS kind FROM customer")
def _(spark, sf):
    m = F.create_map(F.lit("Customer"), F.lit("person"))
    return fx.table(spark, sf, "customer").select("c_custkey", F.coalesce(F.try_element_at(m, F.split_part("c_name", F.lit("#"), F.lit(1))), F.lit("other")).alias("kind"))


_WORDS = [w for ws in scalars.PATHWAY_KEYWORDS.values() for w in ws] + ["thing"]
_HITS = " ".join("WHEN " + " OR ".join(f"contains(lower(s), '{w.lower()}')" for w in ws) + f" THEN '{k}'" for k, ws in scalars.PATHWAY_KEYWORDS.items())


@query(
    "fn_pathway_category",
    f"""SELECT p_partkey, CASE {_HITS} ELSE 'other' END AS category
    FROM (SELECT p_partkey, upper(w[1 + p_partkey % {len(_WORDS)}]) || ' of ' || w[1 + (p_partkey // 7) % {len(_WORDS)}] AS s FROM part, (SELECT {_WORDS} AS w))""",
)
def _(spark, sf):
    """Names of two keywords each, so that precedence decides."""
    words = F.array(*map(F.lit, _WORDS))
    at = lambda n: F.element_at(words, (1 + n % len(_WORDS)).cast("int"))
    name = F.concat(F.upper(at(F.col("p_partkey"))), F.lit(" of "), at(F.floor(F.col("p_partkey") / 7)))
    return fx.table(spark, sf, "part").select("p_partkey", scalars.category(name).alias("category"))


@query("fn_stable_seed", "SELECT n_name, CAST('0x' || substr(md5(n_name || '|' || n_nationkey), 1, 8) AS BIGINT) AS seed FROM nation")
def _(spark, sf):
    return fx.table(spark, sf, "nation").select("n_name", scalars.stable_seed(F.col("n_name"), F.col("n_nationkey")).alias("seed"))


@query("fn_stable_u64", "WITH h AS (SELECT n_name, sha256(n_name || '|1') AS h FROM nation) SELECT n_name, CAST(CAST('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS UBIGINT) AS VARCHAR) AS u FROM h")
def _(spark, sf):
    return fx.table(spark, sf, "nation").select("n_name", scalars.stable_u64(F.col("n_name"), F.lit(1)).cast("string").alias("u"))


@query("fn_selection_hash", f"WITH {FEATURES_SQL} SELECT sha1(string_agg(feature, ',' ORDER BY feature)) AS h FROM vp WHERE eta_rank <= 12")
def _(spark, sf):
    return fx.vp(spark, sf).filter("eta_rank <= 12").agg(scalars.selection_hash(F.collect_list("feature")).alias("h"))


@query("fn_view_label", "SELECT n_nationkey, r_name || '/' || n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey", "", "n_nationkey")
def _(spark, sf):
    n = fx.table(spark, sf, "nation").join(fx.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("label"))


@query("fn_fraction_parse", "SELECT l_orderkey, l_linenumber, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS d FROM lineitem", "", "l_linenumber n d")
def _(spark, sf):
    s = F.concat(F.lit("harm in "), F.col("l_linenumber").cast("string"), F.lit(" / "), F.col("l_quantity").cast("long").cast("string"), F.lit(" views"))
    n, d = scalars.fraction(s)
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"), d.alias("d"))


@query("fn_number_extract", "SELECT doc_id, len(regexp_extract_all(text, '[-+]?\\d+(?:\\.\\d+)?')) AS n_numbers FROM documents", "", "n_numbers")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.size(scalars.numbers(F.col("text"))).alias("n_numbers"))


@query("fn_number_inventory", "SELECT doc_id, n, count(*) AS n_lines FROM (SELECT doc_id, len(regexp_extract_all(l, '[-+]?\\d+(?:\\.\\d+)?')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE n > 0 GROUP BY doc_id, n", "", "n n_lines")
def _(spark, sf):
    lines = fx.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.select("doc_id", F.size(scalars.numbers(F.col("l"))).alias("n")).filter("n > 0").groupBy("doc_id", "n").agg(F.count("*").alias("n_lines"))


@query("fn_first_matching_line", "SELECT doc_id, line_no, line FROM (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE line LIKE '%icense%' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1", "", "line_no")
def _(spark, sf):
    lines = fx.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line").rlike("icense"))
    return lines.groupBy("doc_id").agg(F.min(F.struct("line_no", "line")).alias("m")).select("doc_id", "m.line_no", "m.line")


@query("fn_citation_numbers", "SELECT n_nationkey, [n_nationkey, n_nationkey + 10] AS cited FROM nation", "", "n_nationkey")
def _(spark, sf):
    k = F.col("n_nationkey")
    s = F.concat(F.lit("see Table "), (k + 10).cast("string"), F.lit(" and table "), k.cast("string"), F.lit(", Table "), k.cast("string"))
    return fx.table(spark, sf, "nation").select("n_nationkey", scalars.distinct_citations(s, "table").alias("cited"))


@query("fn_format_cell", "SELECT p_partkey, printf(CASE WHEN p_retailprice < 1000 THEN '%.4f' ELSE '%.2f' END, CASE WHEN p_retailprice < 1000 THEN p_retailprice / 1000 ELSE p_retailprice END) AS cell FROM part")
def _(spark, sf):
    p = F.col("p_retailprice")
    return fx.table(spark, sf, "part").select("p_partkey", scalars.format_cell(F.when(p < 1000, p / 1000).otherwise(p)).alias("cell"))


@query("fn_compare_tol", f"WITH {SCATTER} SELECT view, abs(di - 0.9) <= 0.1 AS close FROM sc")
def _(spark, sf):
    return fx.scatter(spark, sf).select("view", scalars.within(F.col("di"), F.lit(0.9), 0.1).alias("close"))


@query("fn_json_expand", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("fn_array_ops", f"WITH {FEATURES_SQL} SELECT count(*) FILTER (v_rank <= 12 AND eta_rank <= 12) AS n_both, count(*) FILTER (v_rank <= 12 AND eta_rank > 12) AS only_v, count(*) FILTER (v_rank > 12 AND eta_rank <= 12) AS only_p FROM vp", "", "n_both only_v only_p")
def _(spark, sf):
    v = F.collect_list(F.when(F.col("v_rank") <= 12, F.col("feature")))
    p = F.collect_list(F.when(F.col("eta_rank") <= 12, F.col("feature")))
    s = fx.vp(spark, sf).agg(v.alias("v"), p.alias("p"))
    return s.select(F.size(F.array_intersect("v", "p")).alias("n_both"), F.size(F.array_except("v", "p")).alias("only_v"), F.size(F.array_except("p", "v")).alias("only_p"))


@query("fn_task_type", "SELECT count(DISTINCT label) AS n_values, max(abs(label - round(label))) = 0 AND count(DISTINCT label) <= 20 AS classification FROM embeddings", "", "n_values")
def _(spark, sf):
    y = F.col("label").cast("double")
    s = fx.samples(spark, sf).agg(F.countDistinct("label").alias("n_values"), F.max(F.abs(y - F.round(y))).alias("gap"))
    return s.select("n_values", ((F.col("gap") == 0) & (F.col("n_values") <= 20)).alias("classification"))


# ---- profiles and upserts

_COLS = ["p_size", "p_retailprice"]


for _name in ("agg_profile_columns",):

    @query(_name, " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) AS n, count({c}) AS n_present, count(DISTINCT {c}) AS n_distinct, min({c}) AS lo, max({c}) AS hi, avg({c}) AS mean, stddev_samp({c}) AS sd, quantile_cont({c}, 0.5) AS median FROM part" for c in _COLS), "lo hi mean sd median", "n n_present n_distinct")
    def _(spark, sf):
        long = fx.table(spark, sf, "part").select(*[F.col(c).cast("double").alias(c) for c in _COLS]).unpivot([], _COLS, "col", "x")
        return long.groupBy("col").agg(F.count("*").alias("n"), F.count("x").alias("n_present"), F.countDistinct("x").alias("n_distinct"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.percentile("x", 0.5).alias("median"))


@query("agg_missing_heatmap", "SELECT col, pct FROM (SELECT 'quality' AS col, avg(CAST(quality IS NULL AS INT)) * 100 AS pct FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'text', avg(CAST(text IS NULL AS INT)) * 100 FROM documents) ORDER BY pct DESC LIMIT 2", "pct")
def _(spark, sf):
    d = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id", "left")
    miss = d.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in ("quality", "text")])
    return miss.unpivot([], ["quality", "text"], "col", "pct").orderBy(F.desc("pct"), "col").limit(2)


@query("sink_upsert_keep_last", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM customer")
def _(spark, sf):
    old = fx.table(spark, sf, "customer").select("c_custkey", F.lit("old").alias("state"))
    return transform.keep_last(old, old.filter("c_custkey % 3 = 0").withColumn("state", F.lit("new")), ["c_custkey"])


@query("limit_head", "SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 7")
def _(spark, sf):
    return fx.table(spark, sf, "part").select("p_brand").dropDuplicates().orderBy("p_brand").limit(7)


@query("sort_multi_key", f"WITH {FEATURES_SQL} SELECT view, feature, v_rank, eta_rank FROM vp", "", "v_rank eta_rank")
def _(spark, sf):
    return fx.vp(spark, sf).select("view", "feature", "v_rank", "eta_rank").orderBy("view", "v_rank", "feature")
