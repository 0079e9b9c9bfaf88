"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bandjoin, chat, decontaminate, jaccard, lexical, lm, mix, quality, shard, simhash, topk, toxicity, warc
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_digest(table(spark, sf_dir, "documents"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixture(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op13_bandjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bandjoin.band_join(table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_simhash": op2_simhash,
        "op3_shard": op3_shard,
        "op4_lm": op4_lm,
        "op5_chat": op5_chat,
        "op6_decontaminate": op6_decontaminate,
        "op7_topk": op7_topk,
        "op8_mix": op8_mix,
        "op9_warc": op9_warc,
        "op10_toxicity": op10_toxicity,
        "op11_lexical": op11_lexical,
        "op12_jaccard": op12_jaccard,
        "op13_bandjoin": op13_bandjoin,
    }


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS size, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT doc_id, i, size, array_to_string(ws[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(ws) >= size)),
hits AS (SELECT doc_id, i, dw.size AS size, item_id FROM dw JOIN bw USING (win) WHERE dw.size = bw.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(met.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(met.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)
"""

OP7_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _shared(level: str, rows: str, parents: str, child: str) -> str:
    """Water-filling of one level: rows has cap, weight and parent_budget."""
    by = f"PARTITION BY {parents}" if parents else ""
    order = f"{by} ORDER BY cap / nullif(CAST(weight AS DOUBLE), 0) ASC NULLS LAST, {child}"
    return f"""
{level}_a AS (SELECT *, CAST(parent_budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS l,
  CAST(sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS r FROM ({rows})),
{level}_b AS (SELECT *, coalesce(cap * r <= weight * l, cap = 0) AS is_full FROM {level}_a),
{level}_c AS (SELECT *, max(CASE WHEN NOT is_full THEN {{'q': l / nullif(r, 0), 'l': l, 'r': r}} END) OVER ({by}) AS top FROM {level}_b),
{level} AS (SELECT * EXCLUDE (l, r, is_full, top), CASE WHEN is_full THEN cap ELSE coalesce(CAST(floor(CAST(weight AS DOUBLE) * top.l / nullif(top.r, 0)) AS BIGINT), 0) END AS budget FROM {level}_c)"""


def _weights(column: str, weights: dict[str, int]) -> str:
    return f"CAST(CASE {column} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())} ELSE {mix.OTHER_WEIGHT} END AS BIGINT)"


OP8_SQL = rf"""
WITH n AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '(none)') AS id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS tokens,
    coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % 3 AS m FROM documents),
d AS (SELECT *, CASE m WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'web' END AS domain FROM n),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {mix.MAX_EPOCHS} AS BIGINT) AS cap FROM d GROUP BY ALL),
total AS (SELECT CAST(floor(sum(tokens) * {mix.BUDGET_TENTHS} / 10) AS BIGINT) AS b FROM leaf),
{_shared("l1", f"SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {_weights('domain', mix.DOMAIN_WEIGHTS)} AS weight, any_value(b) AS parent_budget FROM leaf, total GROUP BY domain", "", "domain")},
{_shared("l2", f"SELECT * FROM (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, {_weights('lang', mix.LANG_WEIGHTS)} AS weight FROM leaf GROUP BY domain, lang) JOIN (SELECT domain, budget AS parent_budget FROM l1) USING (domain)", "domain", "lang")},
{_shared("l3", "SELECT *, CAST(1 AS BIGINT) AS weight FROM leaf JOIN (SELECT domain, lang, budget AS parent_budget FROM l2) USING (domain, lang)", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, tokens AS supply, budget, CAST(coalesce(budget // nullif(tokens, 0), 0) AS INTEGER) AS epochs FROM l3),
k AS (SELECT d.*, budget, epochs, budget - epochs * supply AS remainder, md5('{mix.SEED}|' || epochs || '|' || id) AS key FROM d JOIN plan USING (domain, lang, source)),
o AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) - sum(tokens) OVER (PARTITION BY domain, lang, source, key) AS earlier FROM k)
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(0, epochs + CASE WHEN earlier < remainder THEN 1 ELSE 0 END)) AS INTEGER) AS epoch, budget AS leaf_budget FROM o
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, body, strlen(body) AS n, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM q
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS ws FROM documents),
c AS (SELECT count(*) FILTER (len(ws) > 0) AS docs, CAST(sum(len(ws)) AS BIGINT) AS total FROM d),
tf AS (SELECT k, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*) AS tf FROM (SELECT k, doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS t FROM d) GROUP BY k, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT DISTINCT q, item_id, t FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS t FROM benchmark)),
s AS (
  SELECT q, any_value(item_id) AS item_id, k, any_value(doc_id) AS doc_id,
    CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN df USING (t) JOIN tf USING (t), c GROUP BY q, k),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT k, array_to_string(ws[i : i + 2], ' ') AS s FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
shared AS (SELECT a.k AS a, b.k AS b, count(*) AS met FROM s AS a JOIN s AS b USING (s) WHERE a.k <> b.k GROUP BY a.k, b.k),
links AS (SELECT a, b FROM shared JOIN n AS x ON x.k = a JOIN n AS y ON y.k = b WHERE 100 * met >= 90 * (x.n + y.n - met)),
reach AS (SELECT k, k AS other FROM w UNION SELECT reach.k, links.b FROM reach JOIN links ON reach.other = links.a),
firsts AS (SELECT reach.k AS k, min(w.doc_id) AS component_id FROM reach JOIN w ON w.k = reach.other GROUP BY reach.k)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w JOIN firsts USING (k) LEFT JOIN n USING (k)
"""

# CRC-32: 8 shifts a byte by the reflected polynomial 0xEDB88320
OP13_SQL = """
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS t),
l AS (
  SELECT sale_id, line_no, item_id AS line_item_id, (2 * CAST(floor(100 * amount + 0.5) AS BIGINT) + quantity) // (2 * quantity) AS u, concat(sale_id, ',', line_no, ',', item_id) AS s
  FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity IS NOT NULL AND amount IS NOT NULL),
sums AS (
  SELECT s, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(s, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT s FROM l), bits),
i AS (SELECT item_id, CAST(floor(100 * price + 0.5) AS BIGINT) AS p FROM items),
pairs AS (
  SELECT item_id, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, crc FROM i, l JOIN sums USING (s)
  WHERE p IS NOT NULL AND u BETWEEN p - greatest(100, p // 999 + 1) AND p + greatest(100, p // 999 + 1) AND line_item_id <> item_id AND (abs(u - p) <= 100 OR 1000 * abs(u - p) <= greatest(u, p))),
total AS (SELECT item_id, count(*) AS n_pairs, CAST(sum(gap) AS BIGINT) AS gap_sum, CAST(sum(crc) AS BIGINT) AS lines_crc FROM pairs GROUP BY item_id),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS r FROM pairs QUALIFY r <= 2)
SELECT i.item_id, CAST(coalesce(r, 0) AS INTEGER) AS rank, gap, u, sale_id, CAST(line_no AS BIGINT) AS line_no, line_item_id,
  coalesce(n_pairs, 0) AS n_pairs, coalesce(gap_sum, 0) AS gap_sum, coalesce(lines_crc, 0) AS lines_crc
FROM i LEFT JOIN total USING (item_id) LEFT JOIN top USING (item_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": OP6_SQL, "op7_topk": OP7_SQL, "op8_mix": OP8_SQL, "op9_warc": OP9_SQL, "op11_lexical": OP11_SQL, "op12_jaccard": OP12_SQL, "op13_bandjoin": OP13_SQL}
