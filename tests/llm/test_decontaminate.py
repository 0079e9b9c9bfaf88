import hashlib
import random
import re

from pyspark.sql import functions as F

from featherlens.llm import decontaminate

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench):
    out = []
    items = {}
    for i, t in bench:
        if i is not None and t is not None:
            items.setdefault(str(i), []).append(words(t))
    for d, t in docs:
        w, hit, met = words(t), set(), set()
        for i, texts in items.items():
            for b in texts:
                if not b:
                    continue
                size = min(13, len(b))
                wins = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)}
                for k in range(len(w) - size + 1):
                    if tuple(w[k : k + size]) in wins:
                        hit |= set(range(k, k + size))
                        met.add(i)
        out.append((d, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def data():
    rng = random.Random(5)
    v = [f"W{i}" for i in range(40)] + ["é", "ÀB", "x-y", "3.5"]
    bench = [(i, " ".join(rng.choice(v) for _ in range(n))) for i, n in enumerate([20, 30, 13, 5, 1, 14, 0])]
    bench += [(None, "w1 w2 w3"), (8, None), (9, bench[0][1]), (2, bench[2][1])]
    docs = []
    for k in range(60):
        t = [rng.choice(v) for _ in range(rng.randrange(80))]
        if k % 2:
            b = rng.choice(bench)[1] or ""
            t[rng.randrange(len(t) + 1) : 0] = b.lower().split()[rng.randrange(3) :]
        docs.append((k, rng.choice([" ", ", ", "\n- "]).join(t)))
    docs += [(None, "w1 w2"), (100, None), (101, ""), (102, "..."), (3, docs[3][1]), (103, "zz " * 50000 + bench[1][1])]
    return docs, bench


def test_against_brute_force(spark):
    docs, bench = data()
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_hit int, __row string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    for bound in (1 << 20, 0):
        got = decontaminate.contamination(d, b, max_bytes=bound)
        assert sorted(map(tuple, got.collect()), key=str) == want
    wide = d.withColumns({"__hit": F.lit("mine"), "row": F.lit(4), "spans": F.lit(5)})
    texts = []
    for bound in (1 << 20, 0):
        kept = decontaminate.drop_contaminated(wide, b, max_bytes=bound)
        assert kept.columns == wide.columns and kept.count() == sum(not r[-1] for r in want)
        cleaned = decontaminate.remove_spans(wide, b, max_bytes=bound)
        assert cleaned.columns == wide.columns and {r["__hit"] for r in cleaned.collect()} == {"mine"}
        texts.append(sorted(str(r.text) for r in cleaned.collect()))
    assert len(texts[0]) == len(docs) and texts[0] == texts[1]
    one = spark.createDataFrame([(1, "Keep, this! " + bench[1][1] + " And THIS.")], "doc_id long, text string")
    assert decontaminate.remove_spans(one, b).first().text == "Keep, this!  And THIS."


def test_digests_are_verified(spark, monkeypatch):
    """With digests that all collide, the words still decide."""
    monkeypatch.setattr(decontaminate, "_digest", lambda words: b"same")
    docs, bench = data()
    docs = [r for r in docs if len(r[1] or "") < 2000]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), max_bytes=0)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, bench)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(d, b).count() == 0
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for bound in (1 << 20, -1):
        assert [tuple(r)[:4] for r in decontaminate.contamination(d, b, max_bytes=bound).collect()] == [(1, 2, 0, 0)]
