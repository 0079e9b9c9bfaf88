"""Queries of readers and sinks, on files that they write themselves from the tables."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from ..operators import moments, overlap, profile, ranking, simulate
from ..sources import readers, sinks
from . import fixtures as fx
from .registry import query

_SUPPLIERS = """sup AS (SELECT 'money' AS view, 's' || s_suppkey AS sample_id, feature, CAST(x AS DOUBLE) AS x, CAST(label AS BIGINT) AS label FROM (
  SELECT s_suppkey, s_nationkey % 4 AS label, CAST(CAST(s_acctbal AS FLOAT) AS DOUBLE) AS balance, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier) UNPIVOT (x FOR feature IN (balance, nation)))"""


def _suppliers(spark, sf):
    s = fx.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("sample_id"), (F.col("s_nationkey") % 4).cast("long").alias("label"), F.col("s_acctbal").cast("float").cast("double").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot(["sample_id", "label"], ["balance", "nation"], "feature", "x").withColumn("view", F.lit("money"))


for _name in ("scan_npz_bundle", "sink_bundle_npz"):

    @query(_name, f"WITH {_SUPPLIERS} SELECT view, sample_id, feature, x, label FROM sup", "x", "label")
    def _(spark, sf, name=_name):
        path = sinks.workspace(spark, name) + "/suppliers.npz"
        sinks.write_npz(_suppliers(spark, sf), path, {"dataset": "suppliers"})
        return readers.read_npz_views(spark, path).select("view", "sample_id", "feature", "x", "label")


_LABELS = "code AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS label FROM (SELECT DISTINCT c_mktsegment FROM customer))"


@query(
    "scan_raw_transposed_matrix",
    f"""WITH {_LABELS} SELECT CAST(c_custkey AS VARCHAR) AS sample_id, feature, CAST(x AS DOUBLE) AS x, label FROM (
    SELECT c_custkey, label, CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal AS balance FROM customer JOIN code USING (c_mktsegment)) UNPIVOT (x FOR feature IN (nation, balance))""",
    "x",
    "label",
)
def _(spark, sf):
    """Samples in rows under names in lower case; ids by a lookup, labels as codes."""
    c = fx.table(spark, sf, "customer")
    path = sinks.workspace(spark, "transposed") + ".csv"
    sinks.write_table(c.select(F.lower("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")), path)
    values = readers.with_lookup(readers.read_wide_matrix(spark, path, "name", features_in_rows=False), c, "c_name", "c_custkey")
    labels = c.join(F.broadcast(readers.label_codes(c, "c_mktsegment")), "c_mktsegment").select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("code").alias("label"))
    return values.join(labels, "sample_id")


_TISSUE = "'XX-00-000' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '-' || CAST(s_suppkey % 2 AS VARCHAR) || '1'"


@query(
    "scan_raw_xena_matrix",
    f"""SELECT {_TISSUE} AS sample_id, feature, CAST(x AS DOUBLE) AS x, CASE s_suppkey % 2 WHEN 0 THEN 'tumour' ELSE 'normal' END AS label
    FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (x FOR feature IN (nation, balance))""",
    "x",
)
def _(spark, sf):
    """Features in rows, samples in columns of TSV files; the tissue is read from the id, for want of a subtype column.

    Ids of long keys are cut to the id's width and recur, as columns of their own.
    """
    s = fx.table(spark, sf, "supplier")
    sample = F.concat(F.lit("XX-00-000"), F.lpad(F.col("s_suppkey").cast("string"), 3, "0"), F.lit("-"), (F.col("s_suppkey") % 2).cast("string"), F.lit("1"))
    path = sinks.workspace(spark, "xena")
    samples = s.select("s_suppkey", sample.alias("id"), F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").cast("double").alias("balance"))
    sinks.write_wide_rows(samples, path, "s_suppkey", "id", ["nation", "balance"])
    values = readers.read_wide_rows(spark, path, "feature").filter("x is not null")
    return values.withColumn("label", readers.tissue_of(F.col("sample_id")))


@query(
    "scan_raw_multimodal_semantic_filters",
    """WITH v AS (
      SELECT 'taxa' AS view, o_custkey AS sample_id, 'k__X|s__' || o_orderpriority AS feature, count(*) AS x FROM orders GROUP BY ALL
      UNION ALL SELECT 'genes', o_custkey, o_orderstatus, count(*) FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL
      UNION ALL SELECT 'rare', c_custkey, 'balance', c_acctbal FROM customer WHERE c_custkey <= 3),
    s AS (SELECT sample_id FROM v WHERE view <> 'rare' GROUP BY sample_id HAVING count(DISTINCT view) = 2)
    SELECT view, sample_id, feature, CAST(x AS DOUBLE) AS x FROM v SEMI JOIN s USING (sample_id) WHERE view <> 'rare'""",
    "x",
    "sample_id",
)
def _(spark, sf):
    """Modalities with features of no interest beside those that stay; samples that the kept views share."""
    o = fx.table(spark, sf, "orders")
    count = lambda view, feature: o.groupBy(F.lit(view).alias("view"), F.col("o_custkey").alias("sample_id"), feature.alias("feature")).agg(F.count("*").cast("double").alias("x"))
    taxa = count("taxa", F.concat(F.lit("k__X|s__"), "o_orderpriority")).unionByName(count("taxa", F.lit("k__X|g__Y"))).unionByName(count("taxa", F.lit("k__X|s__Z|t__W")))
    genes = count("genes", F.when(F.col("o_orderstatus") == "P", "UNGROUPED").otherwise(F.col("o_orderstatus"))).unionByName(count("genes", F.concat(F.col("o_orderstatus"), F.lit("|g__Y"))))
    rare = fx.table(spark, sf, "customer").filter("c_custkey <= 3").select(F.lit("rare").alias("view"), F.col("c_custkey").alias("sample_id"), F.lit("balance").alias("feature"), F.col("c_acctbal").cast("double").alias("x"))
    species = taxa.filter(F.col("feature").contains("s__") & ~F.col("feature").contains("t__"))
    whole = genes.filter((F.col("feature") != "UNGROUPED") & ~F.col("feature").contains("|"))
    return readers.views_with_common_samples(species.unionByName(whole).unionByName(rare), 10)


@query("scan_biom", "SELECT o_orderpriority AS sample_id, o_orderstatus AS feature, CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY ALL", "x")
def _(spark, sf):
    """A sparse count table written in the format's JSON form."""
    n = fx.table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    ids = lambda c: F.sort_array(F.collect_set(c))
    one = n.agg(ids("o_orderstatus").alias("r"), ids("o_orderpriority").alias("c"), F.collect_list(F.struct("o_orderstatus", "o_orderpriority", "n")).alias("cells"))
    place = lambda xs, x: (F.array_position(F.col(xs), x) - 1).cast("double")
    data = F.transform("cells", lambda t: F.array(place("r", t["o_orderstatus"]), place("c", t["o_orderpriority"]), t["n"].cast("double")))
    path = sinks.workspace(spark, "biom")
    one.select(F.transform("r", lambda x: F.struct(x.alias("id"))).alias("rows"), F.transform("c", lambda x: F.struct(x.alias("id"))).alias("columns"), F.lit("sparse").alias("matrix_type"), data.alias("data")).coalesce(1).write.json(path)
    return readers.read_biom(spark, path)


@query("scan_stub_loaders", "SELECT * FROM (VALUES ('csv', NULL), ('nci60', 'unsupported source: nci60'), ('arabidopsis', 'unsupported source: arabidopsis')) t(source, error)")
def _(spark, sf):
    return readers.source_status(spark, ["csv", "nci60", "arabidopsis"])


_SPLITS = "sp AS (SELECT r AS repeat, CAST(vec_id AS VARCHAR) AS sample_id, (vec_id * (r + 3)) % 5 AS fold, label FROM embeddings, range(0, 3) t(r))"


def _written_splits(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), "vec_id", "label", F.explode(F.array(*map(F.lit, range(3)))).alias("repeat"))
    path = sinks.workspace(spark, "splits")
    sinks.write_splits(e.select("repeat", "sample_id", (F.col("vec_id") * (F.col("repeat") + 3) % 5).alias("fold"), "label"), path)
    return path


@query("scan_json_artifact", f"WITH {_SPLITS} SELECT repeat, sample_id, fold, label FROM sp", "", "repeat fold label")
def _(spark, sf):
    return readers.read_splits(spark, _written_splits(spark, sf) + "/json")


@query("sink_split_artefact", f"WITH {_SPLITS} SELECT repeat, sample_id, fold, label FROM sp", "", "repeat fold label")
def _(spark, sf):
    return readers.read_table(spark, _written_splits(spark, sf) + "/table/*.parquet")


def _prediction_files(spark, sf):
    """Files importance__{dataset}__{view} of two models, one of them in a folder that doesn't belong."""
    rows = fx.table(spark, sf, "lineitem").select(F.explode(F.array(F.lit("rf"), F.lit("xgb"))).alias("model"), "l_linestatus", "l_returnflag", "l_quantity")
    root = sinks.workspace(spark, "predictions")
    named = rows.withColumn("name", F.concat(F.lit("importance__"), "l_linestatus", F.lit("__"), "l_returnflag"))
    sums = named.groupBy("model", "name").agg(F.sum("l_quantity").cast("double").alias("total"))
    for model in ("rf", "xgb"):
        for part in (sums.filter(F.col("model") == model).drop("model"),):
            part.repartition("name").write.partitionBy("name").option("header", True).csv(f"{root}/{model}")
    return root


@query("scan_discover_pred_files", "SELECT DISTINCT model, l_linestatus AS dataset, l_returnflag AS view FROM lineitem, (VALUES ('rf'), ('xgb')) m(model)")
def _(spark, sf):
    root = _prediction_files(spark, sf)
    files = readers.list_files(spark, root, "*.csv")
    found = readers.with_path_keys(files, r"/([^/]+)/name=importance__([^_/]+)__([^_/]+)/", ["model", "dataset", "view"], "path")
    return found.select("model", "dataset", "view").distinct()


@query("scan_glob_union_with_filename_keys", "SELECT l_linestatus AS dataset, l_returnflag AS view, CAST(sum(l_quantity) AS DOUBLE) AS total FROM lineitem GROUP BY ALL", "total")
def _(spark, sf):
    root = _prediction_files(spark, sf)
    rows = spark.read.option("header", True).schema("total double").csv(f"{root}/rf/name=importance__*__*")
    return readers.with_path_keys(rows, r"importance__([^_/]+)__([^_/]+)/", ["dataset", "view"]).select("dataset", "view", "total")


@query("scan_discover_bundles", "SELECT l_linestatus AS dataset, l_returnflag AS view, count(DISTINCT l_orderkey) AS n_samples, 2 AS n_features FROM lineitem WHERE l_linestatus IN ('O') GROUP BY ALL", "", "n_samples n_features")
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("dataset"), F.col("l_returnflag").alias("view"), F.col("l_orderkey").alias("sample_id"), F.col("l_tax").cast("double").alias("tax"), F.col("l_discount").cast("double").alias("discount"))
    path = sinks.workspace(spark, "bundles")
    sinks.write_values(li.unpivot(["dataset", "view", "sample_id"], ["tax", "discount"], "feature", "x"), path)
    return readers.discover_bundles(spark, path, ["O"])


@query("scan_gunzip_unzip", "SELECT r_regionkey || ',' || r_name AS line, 'region.csv' AS member, row_number() OVER (ORDER BY r_regionkey) - 1 AS line_no FROM region", "", "line_no")
def _(spark, sf):
    """A zip archive; gzip files are read by Spark's own codec (scan_csv_gz)."""
    lines = [f"{r.r_regionkey},{r.r_name}" for r in fx.table(spark, sf, "region").orderBy("r_regionkey").collect()]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("region.csv", "\n".join(lines) + "\n")
    path = sinks.workspace(spark, "zip") + "/region.zip"
    sinks._put(spark, path, buffer.getvalue())
    return readers.read_zip_lines(spark, path).select("line", "member", "line_no")


@query("scan_chunked_stream", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, avg({c}) AS mean, var_pop({c}) AS variance, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in ("l_quantity", "l_partkey", "l_suppkey")), "mean variance min max", "n")
def _(spark, sf):
    columns = ["l_quantity", "l_partkey", "l_suppkey"]  # whole numbers: no mean lies on an edge of rounding
    path = sinks.workspace(spark, "chunks") + ".csv"
    sinks.write_table(fx.table(spark, sf, "lineitem").select(*columns), path)
    return readers.chunked_moments(readers.read_delimited(spark, path), columns, 1000)


@query("sink_manifest", "SELECT 'profile' AS phase, 'region' AS input, 2 AS run UNION ALL SELECT 'rank', 'nation', 1", "", "run")
def _(spark, sf):
    path = sinks.workspace(spark, "runs")
    for phase, name, run in (("profile", "nation", 1), ("rank", "nation", 1), ("profile", "region", 2)):
        sinks.write_manifest(spark, path, phase, [name], [], {"run": run})
    return sinks.latest_manifest(spark, path).select("phase", F.col("inputs")[0].alias("input"), F.get_json_object("settings", "$.run").cast("long").alias("run"))


@query("sink_sha256", "SELECT sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS sha256, CAST(sum(length(c_name) + 1) AS BIGINT) AS length FROM customer", "", "length")
def _(spark, sf):
    path = sinks.workspace(spark, "hashed")
    fx.table(spark, sf, "customer").coalesce(1).sortWithinPartitions("c_custkey").select("c_name").write.text(path)
    return readers.file_hashes(spark, f"{path}/*.txt").select("sha256", "length")


@query("sink_figure_stage", "SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256, true AS same FROM nation")
def _(spark, sf):
    path = sinks.workspace(spark, "figures")
    fx.table(spark, sf, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(f"{path}/in")
    return sinks.stage_files(spark, f"{path}/in/*.txt", f"{path}/staged").select("sha256", "same")


@query("fn_html_error_probe", "SELECT 'csv' AS kind, false AS looks_like_html UNION ALL SELECT 'html', true")
def _(spark, sf):
    """Of a page as it is and a table."""
    root = sinks.workspace(spark, "probe")
    page = fx.table(spark, sf, "pages").filter("lower(html) like '%<html%'").agg(F.min_by("html", "page_id").alias("html"))
    page.coalesce(1).write.text(f"{root}/html")
    fx.table(spark, sf, "region").coalesce(1).write.csv(f"{root}/csv")
    files = readers.magic_bytes(spark, f"{root}/*/part-*")
    return files.select(F.when(F.col("path").endswith(".csv"), "csv").otherwise("html").alias("kind"), "looks_like_html")


@query("fn_schema_verify", "SELECT * FROM (VALUES ('n_comment', 'string', NULL, false), ('n_name', 'string', 'string', true), ('n_nationkey', 'string', 'bigint', false), ('n_regionkey', NULL, 'bigint', true)) t(\"column\", expected, found, ok)")
def _(spark, sf):
    path = sinks.workspace(spark, "schema") + ".parquet"
    sinks.write_table(fx.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long")), path)
    return readers.schema_report(readers.read_table(spark, path), "n_nationkey string, n_name string, n_comment string")


@query("fn_now_iso", "SELECT true AS well_formed, true AS recent")
def _(spark, sf):
    """The stamp itself never is in a result."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return spark.range(1).select(stamp.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$").alias("well_formed"), (F.unix_timestamp() - F.unix_timestamp(F.to_timestamp(stamp)) < 60).alias("recent"))


@query("shape_flatten_manifest", "SELECT r_name AS dataset, n_name AS view, n_nationkey AS n_samples FROM nation JOIN region ON n_regionkey = r_regionkey", "", "n_samples")
def _(spark, sf):
    """Manifests in four layouts: a list of views, a map of views, views below 'datasets', and flat keys dataset/view."""
    n = fx.table(spark, sf, "nation").join(fx.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = n.groupBy("r_regionkey", "r_name").agg(F.collect_list(F.struct(F.col("n_name").alias("view"), F.col("n_nationkey").cast("long").alias("n_samples"))).alias("views"))
    as_map = F.map_from_entries(F.transform("views", lambda v: F.struct(v["view"], F.struct(v["n_samples"].alias("n_samples")))))
    flat = F.map_from_entries(F.transform("views", lambda v: F.struct(F.concat("r_name", F.lit("/"), v["view"]), v["n_samples"])))
    kind = F.col("r_regionkey") % 4
    manifest = (
        F.when(kind == 0, F.to_json(F.struct(F.col("r_name").alias("dataset"), "views")))
        .when(kind == 1, F.to_json(F.struct(F.col("r_name").alias("dataset"), as_map.alias("views"))))
        .when(kind == 2, F.to_json(F.struct(F.create_map("r_name", as_map).alias("datasets"))))
        .otherwise(F.to_json(F.struct(flat.alias("n_samples"))))
    )
    return profile.flatten_manifests(by.select(manifest.alias("manifest")), "manifest")


@query("gen_scenario", "SELECT * FROM (VALUES ('anti_aligned', 1.0, true), ('coupled', 1.0, true), ('decoupled', 1.0, true), ('short', 0.5, false)) t(scenario, share, valid)", "share")
def _(spark, sf):
    rows = [(s.name, sum(k[0] for k in s.kinds), True) for s in simulate.SCENARIOS.values()]
    try:
        simulate.Scenario("short", ((0.5, 1.0, 1.0),))
    except ValueError:
        rows.append(("short", 0.5, False))
    return spark.createDataFrame(rows, "scenario string, share double, valid boolean")


_UNIT = "CAST(CAST('0x' || substr(md5(s || '|' || feature), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


@query(
    "gen_cap_seed",
    f"""WITH {fx.FEATURES_SQL},
    d AS (SELECT s, feature, v_total, row_number() OVER (PARTITION BY s ORDER BY {_UNIT}, feature) AS r FROM vp, range(0, 4) t(s)),
    k AS (SELECT s, feature, row_number() OVER (PARTITION BY s ORDER BY v_total DESC, feature) AS v FROM d WHERE r <= 48),
    f AS (SELECT s, feature FROM k WHERE v <= 8)
    SELECT a.s AS a, b.s AS b, count(*) FILTER (a.feature = b.feature) / (16.0 - count(*) FILTER (a.feature = b.feature)) AS jaccard FROM f a JOIN f b ON a.s < b.s GROUP BY ALL""",
    "jaccard",
    "a b",
)
def _(spark, sf):
    """How far the top features agree when another seed draws the features under the cap."""
    v = fx.features(spark, sf).select("feature", "v_total").withColumn("seed", F.explode(F.array(*map(F.lit, range(4)))))
    drawn = ranking.ranked(v.withColumn("u", -fx.resample.unit(F.col("seed").cast("string"), F.col("feature"))), ["seed"], "u", out="draw").filter("draw <= 48")
    top = ranking.ranked(drawn, ["seed"], "v_total", out="v").withColumn("flag", F.col("v") <= 8)
    a, b = (top.filter("flag").select(F.col("seed").alias(n), "feature") for n in ("a", "b"))
    both = a.join(b, "feature").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(i, j) for i in range(4) for j in range(i + 1, 4)], "a int, b int")
    return every.join(both, ["a", "b"], "left").select("a", "b", (F.coalesce("n", F.lit(0)) / (16 - F.coalesce("n", F.lit(0)))).alias("jaccard"))


@query("gen_runtime_bench", "SELECT * FROM (VALUES ('saf', 3, true), ('vad', 3, true)) t(step, runs, measured)", "", "runs")
def _(spark, sf):
    """The times themselves never are in a result."""
    steps = {"vad": lambda: overlap.k_grid(fx.vp(spark, sf), fx.VIEW, "v_rank", "eta_rank", [10]), "saf": lambda: ranking.ranked(moments.eta2(fx.emb(spark, sf), fx.VIEW), fx.VIEW, "v_between")}
    return profile.timed(spark, steps, 3).select("step", "runs", (F.col("median_seconds") > 0).alias("measured"))


_SHAP = "SELECT n_nationkey AS r, i, sin(n_nationkey * 31 + i) AS v FROM nation, range(0, 12) t(i)"


@query("ml_shap_resolver", f"SELECT layout, i AS feature_ord, avg(abs(v)) AS mean_abs FROM ({_SHAP}), (VALUES ('repeats_first'), ('features_first'), ('mean_only')) t(layout) GROUP BY ALL", "mean_abs", "feature_ord")
def _(spark, sf):
    """Importances by repeat in three layouts of the same numbers."""
    rows = fx.table(spark, sf, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).withColumn("v", F.abs(F.sin((F.col("n_nationkey") * 31 + F.col("i")).cast("double"))))
    grid = lambda outer, inner: rows.groupBy(outer).agg(F.transform(F.sort_array(F.collect_list(F.struct(inner, "v"))), lambda x: x["v"]).alias("x")).agg(F.transform(F.sort_array(F.collect_list(F.struct(outer, "x"))), lambda x: x["x"]).alias("x"))
    mean = rows.groupBy("i").agg(F.avg("v").alias("v")).agg(F.array(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])).alias("x"))
    every = grid("n_nationkey", "i").withColumn("layout", F.lit("repeats_first")).unionByName(grid("i", "n_nationkey").withColumn("layout", F.lit("features_first"))).unionByName(mean.withColumn("layout", F.lit("mean_only")))
    return profile.importance_by_feature(every, "layout", "x", 12)



