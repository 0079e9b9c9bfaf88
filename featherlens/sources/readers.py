"""Readers of tables and matrices; every path is read by Spark, so any store it knows will do."""

from __future__ import annotations

import io
import re
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def separator(spark: SparkSession, path: str) -> str:
    """Tab if the first line has one, else comma."""
    line = spark.read.text(path).limit(1).collect()
    return "\t" if line and "\t" in line[0][0] else ","


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV or TSV, gzip or not; rows that don't fit the schema keep what parses and their text in _corrupt."""
    options = {"header": True, "sep": separator(spark, path), "mode": "PERMISSIVE"}
    if schema is None:
        return spark.read.options(**options).csv(path)
    full = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).add("_corrupt", T.StringType())
    return spark.read.options(**options, columnNameOfCorruptRecord="_corrupt").schema(full).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: parquet, json, or delimited text."""
    bare = re.sub(r"\.gz$", "", path)
    if bare.endswith(".parquet"):
        return spark.read.parquet(path)
    if bare.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if bare.endswith((".csv", ".tsv", ".txt")):
        return read_delimited(spark, path)
    raise ValueError(f"unknown table format: {path}")


def with_filename_keys(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Columns from the groups of pattern in each row's file name."""
    f = F.col("_metadata.file_name")
    return df.select("*", *[F.regexp_extract(f, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def read_wide_matrix(spark: SparkSession, path: str, key: str, features_in_rows: bool = True) -> DataFrame:
    """A wide file as (sample_id, feature, x), whichever axis its rows are; values that aren't numbers are NULL."""
    wide = read_delimited(spark, path)
    rest = [c for c in wide.columns if c != key]
    names = ("feature", "sample_id") if features_in_rows else ("sample_id", "feature")
    long = wide.withColumnRenamed(key, names[0]).unpivot([names[0]], rest, names[1], "raw")
    return long.select("sample_id", "feature", F.col("raw").try_cast("double").alias("x"))


def read_wide_rows(spark: SparkSession, path: str, key: str, sep: str = "\t") -> DataFrame:
    """Wide files with a feature a line and samples in columns as (sample_id, feature, x); values that aren't numbers are NULL.

    A file's header is its line that starts with key. Lines become arrays, never columns, so samples may be many and a name may
    recur: each of its columns gives its own rows. Fields have no quotes.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", re.escape(sep), -1).alias("cells"))
    rest = F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    head = lines.filter(F.col("cells")[0] == key).select("file", rest.alias("names"))
    rows = lines.filter(F.col("cells")[0] != key).select("file", F.col("cells")[0].alias("feature"), rest.alias("raw"))
    cell = rows.join(head, "file").select("feature", F.explode(F.arrays_zip("names", "raw")).alias("z"))
    return cell.select(F.col("z.names").alias("sample_id"), "feature", F.col("z.raw").try_cast("double").alias("x"))


def read_npz_views(spark: SparkSession, path: str) -> DataFrame:
    """Named-array bundles (X_{view}, features_{view}, y, sample_ids) as (path, view, sample_id, feature, x, label); no pickles."""

    def load(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                ids, y = z["sample_ids"].astype(str), z["y"]
                for k in z.files:
                    if not k.startswith("X_"):
                        continue
                    x, view = z[k].astype(np.float64), k[2:]
                    have = f"features_{view}" in z.files
                    feats = z[f"features_{view}"].astype(str) if have else np.array([f"f{i}" for i in range(x.shape[1])])
                    for a in range(0, len(ids), 256):
                        part = x[a : a + 256]
                        n = len(part)
                        flat = part.ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * part.size), pa.array([view] * part.size), pa.array(np.repeat(ids[a : a + n], x.shape[1])), pa.array(np.tile(feats, n)), pa.array(flat, mask=~np.isfinite(flat)), pa.array(np.repeat(y[a : a + n].astype(np.int64), x.shape[1]))],
                            ["path", "view", "sample_id", "feature", "x", "label"],
                        )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(load, "path string, view string, sample_id string, feature string, x double, label long")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """A split artefact in JSON as (repeat, sample_id, fold, label)."""
    schema = "y array<long>, sample_ids array<string>, groups array<string>, fold_ids array<array<int>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    one = raw.select("sample_ids", "y", F.posexplode("fold_ids").alias("repeat", "folds"))
    return one.select("repeat", F.explode(F.arrays_zip("sample_ids", "folds", "y")).alias("z")).select("repeat", F.col("z.sample_ids").alias("sample_id"), F.col("z.folds").alias("fold"), F.col("z.y").alias("label"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256, is_gzip, looks_like_error of each file."""
    f = spark.read.format("binaryFile").load(path)
    head = F.lower(F.decode(F.substring("content", 1, 512), "ISO-8859-1"))
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"), (F.hex(F.substring("content", 1, 2)) == "1F8B").alias("is_gzip"), (head.contains("<html") | head.contains("accessdenied")).alias("looks_like_error"))


def magic_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path, is_gzip, looks_like_html of each file, from its first bytes."""
    head = F.col("content").substr(1, 512)
    text = F.lower(head.cast("string"))
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", (F.hex(F.col("content").substr(1, 2)) == "1F8B").alias("is_gzip"), (text.contains("<html") | text.contains("<!doctype")).alias("looks_like_html"))


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length of all files under root whose name fits glob; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")


def with_path_keys(df: DataFrame, pattern: str, names: list[str], path: str = "_metadata.file_path") -> DataFrame:
    """Columns from the groups of pattern in each row's path, folders included."""
    return df.select("*", *[F.regexp_extract(F.col(path), pattern, i + 1).alias(n) for i, n in enumerate(names)])


def discover_predictions(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """model, dataset, view of prediction files importance__{dataset}__{view} below a folder named after its model, in order."""
    found = with_path_keys(list_files(spark, root, glob), r"/([^/]+)/importance__([^_/]+)__([^_/]+)/", ["model", "dataset", "view"], "path")
    return found.filter("model <> ''").select("model", "dataset", "view").distinct().orderBy("model", "dataset", "view")


def discover_bundles(spark: SparkSession, path: str, datasets: list[str] | None = None) -> DataFrame:
    """dataset, view, n_samples, n_features of a matrix stored by dataset and view; datasets: these only (partitions pruned)."""
    values = spark.read.parquet(path)
    if datasets is not None:
        values = values.filter(F.col("dataset").isin(datasets))
    return values.groupBy("dataset", "view").agg(F.count_distinct("sample_id").alias("n_samples"), F.count_distinct("feature").alias("n_features"))


def read_zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, member, line_no, line of the text files in zip archives; an archive is unpacked in one task, line by line."""

    def unpack(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        with z.open(member) as f:
                            rows = []
                            for i, line in enumerate(io.TextIOWrapper(f, "utf-8", "replace")):
                                rows.append((name, member, i, line.rstrip("\r\n")))
                                if len(rows) == 10_000:
                                    yield _batch(rows)
                                    rows = []
                            if rows:
                                yield _batch(rows)

    def _batch(rows):
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "member", "line_no", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(unpack, "path string, member string, line_no long, line string")


def read_biom(spark: SparkSession, path: str) -> DataFrame:
    """A sparse table in BIOM's JSON form as (sample_id, feature, x) of its non-zero cells."""
    schema = "rows array<struct<id: string>>, columns array<struct<id: string>>, matrix_type string, data array<array<double>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    cell = F.explode("data").alias("cell")
    at = lambda c, i: F.element_at(F.col(c), F.col("cell")[i].cast("int") + 1)["id"]
    return raw.filter("matrix_type = 'sparse'").select("rows", "columns", cell).select(at("columns", 1).alias("sample_id"), at("rows", 0).alias("feature"), F.col("cell")[2].alias("x"))


def with_lookup(values: DataFrame, lookup: DataFrame, name: str, key: str) -> DataFrame:
    """values with sample_id replaced by lookup's key where its name, in upper case, is the sample's; others are left out.

    lookup has one key a name; a sample's name may recur.
    """
    names = lookup.select(F.upper(F.col(name)).alias("_name"), F.col(key).cast("string").alias("_id"))
    return values.join(names, F.upper("sample_id") == F.col("_name")).drop("sample_id", "_name").withColumnRenamed("_id", "sample_id")


def label_codes(labels: DataFrame, column: str) -> DataFrame:
    """label text -> code, from 0 in alphabetical order."""
    rows = labels.select(column).dropna().distinct()
    return rows.agg(F.sort_array(F.collect_list(column)).alias("all")).select(F.posexplode("all").alias("code", column))


def tissue_of(sample_id) -> object:
    """'tumour' for 0 in place 14 of the id, 'normal' for 1, else NULL."""
    c = F.substring(sample_id, 14, 1)
    return F.when(c == "0", "tumour").when(c == "1", "normal")


def views_with_common_samples(values: DataFrame, least: int) -> DataFrame:
    """values of the samples that all kept views share; views are dropped, smallest first, while fewer than least are shared.

    Views are few: their sample sets' sizes for every suffix of the order by size are one aggregate.
    """
    pairs = values.select("view", "sample_id").distinct()
    sizes = pairs.groupBy("view").agg(F.count("*").alias("n"))
    order = {r.view: i for i, r in enumerate(sorted(sizes.collect(), key=lambda r: (r.n, r.view)))}  # one row a view
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("view")) if order else F.lit(0)
    held = pairs.withColumn("rank", rank).groupBy("sample_id").agg(F.collect_set("rank").alias("ranks"))
    for first in range(len(order)):
        wanted = F.array(*[F.lit(i) for i in range(first, len(order))])
        common = held.filter(F.size(F.array_except(wanted, "ranks")) == 0)
        if common.limit(least).count() >= least:
            kept = [v for v, i in order.items() if i >= first]
            return values.filter(F.col("view").isin(kept)).join(common.select("sample_id"), "sample_id", "left_semi")
    return values.limit(0)


SOURCES = ("csv", "tsv", "parquet", "json", "npz", "biom", "zip")


def source_status(spark: SparkSession, names: list[str]) -> DataFrame:
    """source, error: NULL, or what reading it would say."""
    rows = [(n, None if n in SOURCES else f"unsupported source: {n}") for n in names]
    return spark.createDataFrame(rows, "source string, error string")


def schema_report(df: DataFrame, schema: str) -> DataFrame:
    """column, expected, found, ok: a table against the columns and types that it should have."""
    want, have = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(schema)}, dict(df.dtypes)
    rows = [(n, want.get(n), have.get(n), want.get(n) is None or want.get(n) == have.get(n)) for n in sorted({*want, *have})]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, found string, ok boolean")


def chunked_moments(df: DataFrame, columns: list[str], chunk: int = 50_000) -> DataFrame:
    """feature, n, mean, variance, min, max of a stream of rows read in chunks, whose partial moments are merged.

    Each task folds its chunks into one row a column; the rows are merged by an aggregate.
    """
    names = list(columns)

    def fold(batches):
        n, mean, m2 = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        lo, hi = np.full(len(names), np.inf), np.full(len(names), -np.inf)
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                part = batch.slice(a, chunk)
                for i in range(len(names)):
                    x = part.column(i).drop_null().to_numpy(zero_copy_only=False)
                    x = x[np.isfinite(x)]
                    if len(x):
                        gap, total = x.mean() - mean[i], n[i] + len(x)
                        m2[i] += ((x - x.mean()) ** 2).sum() + gap * gap * n[i] * len(x) / total
                        mean[i] += gap * len(x) / total
                        n[i], lo[i], hi[i] = total, min(lo[i], x.min()), max(hi[i], x.max())
        seen = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.array(names)[seen]), pa.array(n[seen].astype(np.int64)), *(pa.array(v[seen]) for v in (mean, m2, lo, hi))], ["feature", "n", "mean", "m2", "lo", "hi"])

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(fold, "feature string, n long, mean double, m2 double, lo double, hi double")
    total = parts.groupBy("feature").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("inside"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("square"), F.min("lo").alias("min"), F.max("hi").alias("max")
    )
    variance = (F.col("inside") + F.col("square") - F.col("n") * F.col("mean") * F.col("mean")) / F.nullif(F.col("n"), F.lit(0))
    return total.select("feature", "n", "mean", variance.alias("variance"), "min", "max")
