"""Writers: tables, bundles, manifests, and work lists that skip what is done."""

from __future__ import annotations

import io
import json
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By suffix: .csv.gz, .csv, .json, else Parquet."""
    w = df.write.mode(mode)
    if path.endswith((".csv.gz", ".csv")):
        w.option("header", True).option("compression", "gzip" if path.endswith(".gz") else "none").csv(path)
    elif path.endswith(".json"):
        w.json(path)
    else:
        w.parquet(path)


def write_wide_rows(samples: DataFrame, path: str, order: str, name: str, features: list[str], key: str = "feature", columns: int = 10_000) -> None:
    """Tab-separated files of a line a feature and a column a row of samples, of about so many columns each, under a header each.

    order tells the rows apart and orders a file's columns; names may recur.
    """
    files = max(1, -(-samples.count() // columns))
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (name, *features)]
    held = samples.select(F.pmod(F.xxhash64(order), F.lit(files)).alias("file"), F.struct(order, F.array(*fields).alias("f")).alias("s"))
    line = lambda i, first: F.array_join(F.concat(F.array(F.lit(first)), F.transform("all", lambda s: s["f"][i])), "\t")
    by_file = held.groupBy("file").agg(F.sort_array(F.collect_list("s")).alias("all"))
    lines = by_file.select("file", F.explode(F.array(*[line(i, first) for i, first in enumerate([key, *features])])).alias("value"))
    lines.write.mode("overwrite").partitionBy("file").text(path)


def write_values(values: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The long matrix by dataset and view, so that readers prune to the views they ask for; x is stored as float."""
    values.withColumn("x", F.col("x").cast("float")).write.mode(mode).partitionBy("dataset", "view").parquet(path)


def write_manifest(spark: SparkSession, path: str, phase: str, inputs: list[str], outputs: list[str], settings: dict) -> None:
    """One row a run, appended."""
    row = [(phase, inputs, outputs, json.dumps(settings, sort_keys=True))]
    df = spark.createDataFrame(row, "phase string, inputs array<string>, outputs array<string>, settings string").withColumn("written_at", F.current_timestamp())
    df.coalesce(1).write.mode("append").json(path)


def latest_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each phase: phase, inputs, outputs, settings."""
    rows = spark.read.schema("phase string, inputs array<string>, outputs array<string>, settings string, written_at timestamp").json(path)
    last = rows.groupBy("phase").agg(F.max_by(F.struct("inputs", "outputs", "settings"), "written_at").alias("r"))
    return last.select("phase", "r.*")


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    """A file of its own in any store that Spark writes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(content)
    finally:
        out.close()


#: Cells of a bundle in one file, which the driver writes; larger matrices go to write_values.
MAX_BUNDLE_CELLS = 5_000_000


def write_npz(values: DataFrame, path: str, info: dict) -> None:
    """One named-array bundle of (view, sample_id, feature, x, label): X_{view}, features_{view}, y, sample_ids, info."""
    if (cells := values.count()) > MAX_BUNDLE_CELLS:
        raise ValueError(f"{cells} cells are too many for one bundle file; write_values keeps them as a table")
    rows = values.select("view", F.col("sample_id").cast("string"), "feature", "x", "label").toArrow().to_pandas()
    labels = rows.groupby("sample_id")["label"].first().sort_index()
    arrays = {"y": labels.to_numpy(np.int32), "sample_ids": labels.index.to_numpy(str), "info": np.array(json.dumps(info, sort_keys=True))}
    for view, part in rows.groupby("view"):
        wide = part.pivot_table(index="sample_id", columns="feature", values="x", dropna=False).reindex(labels.index)
        arrays[f"X_{view}"], arrays[f"features_{view}"] = wide.to_numpy(np.float32), wide.columns.to_numpy(str)
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **arrays)
    _put(values.sparkSession, path, buffer.getvalue())


def write_splits(folds: DataFrame, path: str) -> None:
    """Folds (repeat, sample_id, fold, label) as a table below path, and as the JSON artefact that read_splits takes.

    The artefact is one row by its format: a list of folds a repeat, in the order of the sample ids.
    """
    folds.write.mode("overwrite").parquet(f"{path}/table")
    by_repeat = folds.groupBy("repeat").agg(F.sort_array(F.collect_list(F.struct(F.col("sample_id").cast("string").alias("s"), F.col("fold").cast("int").alias("f"), F.col("label").cast("long").alias("y")))).alias("z"))
    one = by_repeat.agg(F.sort_array(F.collect_list(F.struct("repeat", "z"))).alias("r"))
    out = one.select(F.col("r")[0]["z"]["y"].alias("y"), F.col("r")[0]["z"]["s"].alias("sample_ids"), F.transform("r", lambda r: r["z"]["f"]).alias("fold_ids"))
    out.coalesce(1).write.mode("overwrite").json(f"{path}/json")


def stage_files(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copies the files under source to target by name: name, length, sha256, same (the copy has the same hash)."""
    conf = spark._jsc.hadoopConfiguration()
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = spark.read.format("binaryFile").load(source).select(F.col("path"), "length", F.sha2("content", 256).alias("sha256"))
    for (p,) in files.select("path").collect():  # a row a file
        a, b = path(p), path(f"{target}/{p.rsplit('/', 1)[1]}")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
    name = F.element_at(F.split("path", "/"), -1)
    copies = spark.read.format("binaryFile").load(target).select(name.alias("name"), F.sha2("content", 256).alias("copied"))
    return files.select(name.alias("name"), "length", "sha256").join(copies, "name", "left").select("name", "length", "sha256", F.col("sha256").eqNullSafe(F.col("copied")).alias("same"))


def remaining(work: DataFrame, done_path: str, keys: list[str]) -> DataFrame:
    """The units of work that have no output yet."""
    spark = work.sparkSession
    return work.join(spark.read.parquet(done_path).select(*keys).distinct(), keys, "left_anti") if exists(spark, done_path) else work


def workspace(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share; without one, a temporary folder if the master is local, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="featherlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
