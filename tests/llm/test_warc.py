import hashlib

import pytest

from featherlens.llm import warc


def brute(data):
    out = []
    for p, _, h in data:
        b = (h or "").encode()
        same = [q for q, _, g in data if (g or "").encode() == b and q is not None]
        first = min(same, default=None)
        again = len(b) >= 100 and sum((g or "").encode() == b for _, _, g in data) > 1 and first is not None and p != first
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    long = "<p>é\r\n\r\nWARC/1.1</p>" * 20
    data = [(5, "http://a/1", long), (3, "http://a/2\r\nX: y", long), (9, None, long), (None, "u", long), (3, "u", long), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "", ""), (10, "http://b", "x" * 3_000_000), (11, "u", "y" * 99), (12, "u", "y" * 99), (13, "u", "z" * 100), (14, "u", "z" * 100), (None, "u", "n" * 200), (None, "u", "n" * 200)]
    df = spark.createDataFrame([(*r, 1) for r in data], "page_id long, url string, html string, digest int").repartition(3)
    index = warc.write(df)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = warc.read(index, payload=True)
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == brute(data)
    by = {(p, h) for p, _, h in data}
    assert all((r.page_id, r.html) in by or r.html == "" for r in got.collect() if r.record_type == "response")
    some = warc.read(index.filter("page_id in (10, 3)")).collect()
    assert sorted(r.page_id for r in some) == [3, 3, 10]


def test_plan_without_broadcast(spark):
    data = [(i % 9 if i % 7 else None, "u", ["x" * 200, "y" * 300, None, f"{i}" * 90][i % 4], i) for i in range(60)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, n int")
    rows = [sorted(map(str, warc.plan(df, bound).select("page_id", "html", "first").collect())) for bound in (1000, 0)]
    assert rows[0] == rows[1] and len(rows[0]) == 60


def test_addresses(tmp_path):
    assert warc.store(f"file://{tmp_path}")[1] == str(tmp_path)
    with pytest.raises(RuntimeError, match="abc://"):
        warc.store("abc://host/folder")


def test_ranges_join():
    r = list(warc.ranges(iter([("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP_BYTES + 1, 5), ("b", 0, 1)])))
    assert [(x[0], x[1], x[2], len(x[3])) for x in r] == [("a", 0, 20, 2), ("a", 20 + warc.GAP_BYTES + 1, 25 + warc.GAP_BYTES + 1, 1), ("b", 0, 1, 1)]


def test_empty(spark):
    index = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(index).count() == 0
