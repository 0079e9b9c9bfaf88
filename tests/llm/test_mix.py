import duckdb
import pandas as pd
from pyspark.sql import functions as F

from featherlens.llm import mix, queries


def oracle(docs):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    return con.execute(queries.OP8_SQL).fetchall()


def test_against_sql(spark):
    docs = [(i, "w " * (i % 23), ["en", "de", "fr", "es", "it"][i % 5], f"src{i % 11 if i % 3 else 0}") for i in range(700)]
    docs += [(1, "a b", "en", "src0"), (1, "a b", "en", "src0"), (900, None, "xx", "odd"), (901, "", "en", "src1"), (902, "very " * 40000, "es", "src5"), (903, " x\ty\x0b", "de", "src9")]
    df = spark.createDataFrame([(*d, 4, "q") for d in docs], "doc_id long, text string, lang string, source string, n_chars int, budget string")
    got = mix.mixture(df)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, oracle(docs)))
    wide = mix.mix(df)
    assert wide.columns == df.columns
    counts = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {r.doc_id: r.n for r in wide.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == counts


def test_callers_columns_stay(spark):
    df = spark.createDataFrame([(i, "a b", "en", "s1", i, "x") for i in range(40)], "doc_id long, text string, lang string, source string, __times int, __epoch string").withColumnRenamed("__epoch", "id")
    got = mix.mix(df)
    assert got.columns == df.columns and all(r["__times"] == r.doc_id and r.id == "x" for r in got.collect())


def test_budgets(spark):
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 1000), ("web", "de", "a", 10), ("books", "en", "a", 5000), ("code", "en", "z", 0)]
    rows = {(r.domain, r.lang, r.source): r for r in mix.allocate(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")).collect()}
    assert all(r.budget <= 2 * r.tokens and r.remainder < max(1, r.tokens) for r in rows.values())
    # web wants 5/10 of 3666 and has room for 2220; code has nothing, so its share goes to its siblings
    assert rows["web", "de", "a"].budget == 20 and rows["web", "en", "a"].budget == 200
    assert 3666 - 5 <= sum(r.budget for r in rows.values()) <= 3666


def test_nulls_and_empty(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert mix.mixture(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a b c", None, None), (2, None, None, "s"), (3, "a", "en", None)], schema)
    assert {r.source for r in mix.mixture(df).collect()} <= {"(none)", "s"}
    assert set(mix.mix(df).columns) == set(df.columns)
