import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from featherlens.llm import mix, quality, queries, shard

from .test_classifiers import made
from .test_decontaminate import brute
from .test_simhash import brute_components, brute_fp


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = random.Random(21)
    docs, labels = made(260)
    bench = [(i, " ".join(f"bench{rng.randrange(200)}" for _ in range(20))) for i in range(4)]
    docs += [(1000 + i, docs[i][1]) for i in range(40)] + [(1100 + i, docs[60 + i][1] + " " + bench[i % 4][1]) for i in range(20)] + [(1200 + i, docs[100 + i][1] + " tail") for i in range(20)]
    docs += [(2000, None), (2001, "")]
    rows = [(d, t, ["en", "de", "fr"][d % 3], f"src{d % 7}", len(t or "")) for d, t in docs]
    path = tmp_path_factory.mktemp("sf")
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(path / "documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(path / "labels.parquet")
    pd.DataFrame(bench, columns=["item_id", "text"]).to_parquet(path / "benchmark.parquet")
    return rows, labels, bench, f"file://{path}"


def plain(rows, labels, bench):
    """The stages one by one, without Spark."""
    known = {d: q for d, q, _ in labels if zlib.crc32(str(d).encode()) % 3 != 1}
    sample = sorted((str(r[0]), (r[1] or "").encode(), known[r[0]]) for r in rows if r[0] in known)
    counts = {y: sum(q == y for q in known.values()) for y in (0, 1)}
    model = quality.Neighbours([(quality.packed_terms(t), y) for _, t, y in sample], counts)
    rows = [r for r, s in zip(rows, model.scores([(r[1] or "").encode() for r in rows]), strict=True) if s >= 0.5]
    rows = [r for r, c in zip(rows, brute_components([(r[0], brute_fp(r[1])) for r in rows]), strict=True) if r[0] == c]
    bad = {r[0] for r in brute([r[:2] for r in rows], bench) if r[-1]}
    rows = [r for r in rows if r[0] not in bad]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    copies = [r[0] for r in con.execute(queries.OP8_SQL).fetchall()]
    by = {r[0]: r for r in rows}
    mixed = sorted((by[d] for d in copies), key=lambda r: (r[0], zlib.crc32((r[1] or "").encode())))
    at = shard.permute(np.arange(len(mixed)), len(mixed))
    return [(*r, int(p % 8), int(p // 8)) for r, p in zip(mixed, at, strict=True)]


def test_against_plain_version(spark, tables):
    rows, labels, bench, path = tables
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    # copies of one document are alike, so which of their places is whose doesn't count
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows, labels, bench)))


def test_stages_keep_columns(spark, tables):
    *_, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and 0 < out.count() < docs.count() * mix.MAX_EPOCHS
        empty = stage(spark, docs.limit(0), path)
        assert empty.columns == docs.columns and empty.count() == 0
