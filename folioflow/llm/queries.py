"""One query for each operator, over its whole table with production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, exact_dedup, filter_audit, jaccard_join, language_model, license_scan, packing, repeats, sharding, toxicity, url_filter, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


#: The rules of op8.
URL_RULES = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_of(URL_RULES))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_model.score_documents(table(spark, sf_dir, "documents"))
    by_order = [F.element_at("by_order", n).alias(f"n_order_{n}") for n in range(1, language_model.ORDER + 1)]
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"), *by_order)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: tuple[Query, ...] = (
    op1_exact_dedup, op2_decontaminate, op3_repeats, op4_packing, op5_jaccard_join, op6_sharding, op7_toxicity, op8_url_filter, op9_language_model, op10_license_scan, op11_embedding_dedup, op12_whitening, op13_filter_audit,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, sha256({NORMAL}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


WORDS = f"regexp_extract_all({NORMAL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Pairs by shared runs of five words, then classes as the smallest row that links reach.
OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
runs AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM d, unnest(range(1, len(ws) - 3)) t(i) WHERE len(ws) >= 5
    UNION SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4
),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS same FROM runs GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM runs a JOIN runs b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, x.same AS sa, y.same AS sb FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM reach GROUP BY 1),
counts AS (SELECT a AS doc_id, count(*) AS n_links, count(DISTINCT sb) FILTER (WHERE sb <> sa) AS n_set_links, min(b) FILTER (WHERE sb = sa) AS copy FROM links GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(copy, doc_id)) AS set_id, class_id, class_size, coalesce(n_links, 0) AS n_links, coalesce(n_set_links, 0) AS n_set_links, doc_id = class_id AS kept
FROM classes LEFT JOIN counts USING (doc_id)
"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, w, lag(w) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS c FROM g GROUP BY 1),
c2 AS (SELECT w1, w, count(*) AS c FROM g WHERE w1 IS NOT NULL GROUP BY 1, 2),
c3 AS (SELECT w2, w1, w, count(*) AS c FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT count(*) AS n FROM g),
s AS (
    SELECT doc_id, CASE WHEN c3.c > 1 THEN 3 WHEN c2.c > 1 THEN 2 ELSE 1 END AS used,
        CASE WHEN c3.c > 1 THEN ln(c3.c - 1) - ln(before.c - 1)
             ELSE (CASE WHEN c2.c > 1 THEN ln(c2.c - 1) - ln(one.c - 1) ELSE ln(greatest(c1.c - 1, 0.5)) - ln(n - 1) + (CASE WHEN g.w1 IS NULL THEN 0 ELSE ln(0.4) END) END) + (CASE WHEN g.w2 IS NULL THEN 0 ELSE ln(0.4) END) END AS p
    FROM g JOIN c1 USING (w) LEFT JOIN c2 ON c2.w1 = g.w1 AND c2.w = g.w LEFT JOIN c1 one ON one.w = g.w1 LEFT JOIN c3 ON c3.w2 = g.w2 AND c3.w1 = g.w1 AND c3.w = g.w LEFT JOIN c2 before ON before.w1 = g.w2 AND before.w = g.w1, n
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(sum(p), 0), 6) AS log_score, round(sum(p) / nullif(len(ws), 0), 6) AS mean_log_score,
    count(*) FILTER (WHERE used = 1) AS n_order_1, count(*) FILTER (WHERE used = 2) AS n_order_2, count(*) FILTER (WHERE used = 3) AS n_order_3
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, ws
"""


#: Every string of 100 bytes that starts earlier; the runs they cover; what lies between the runs.  Bytes as two hex digits.
OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 99, 200)) AS p, h FROM d WHERE len(h) >= 200),
short AS (SELECT doc_id, p, substr(h, 2 * p + 1, 598) AS h FROM parts),
starts AS (SELECT doc_id, p, unnest(range(0, len(h) // 2 - 99)) AS o, h FROM short),
k AS (SELECT doc_id, p + o AS i, row_number() OVER (PARTITION BY md5_number(substr(h, 2 * o + 1, 200)) ORDER BY doc_id, p + o) > 1 AS again FROM starts),
r AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM k WHERE again),
g AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY 1, 2),
cuts AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, len(h) // 2, NULL FROM d),
pieces AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b NULLS LAST), 0) AS s FROM cuts),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * s + 1, 2 * (a - s)), '' ORDER BY a, s) AS k FROM pieces JOIN d USING (doc_id) GROUP BY 1),
n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY 1)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op6_sql() -> str:
    """The table is a literal: its filling is tested by itself."""
    names = sorted(SHARDS)
    slots = ", ".join(map(str, sharding.fill(SHARDS)))
    return f"""WITH p AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents),
        t AS (SELECT [{slots}] AS of, {names} AS names) SELECT doc_id, slot, names[of[slot + 1] + 1] AS shard FROM p, t"""


def op10_sql(slack: int = 3, least: float = 0.8) -> str:
    """Votes by diagonal over pairs of positions; a group is the diagonals up to `slack` after one of them."""
    rows = ", ".join(f"({i}, '{t.label}', {t.base}, string_split('{t.text}', ' '))" for i, t in enumerate(license_scan.TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
t(template, label, base, ts) AS (VALUES {rows}),
tg AS (SELECT template, label, base, len(ts) - 1 AS n, unnest(range(1, len(ts))) AS j, ts FROM t),
pos AS (SELECT template, label, base, n, j - 1 AS j, ts[j] || ' ' || ts[j + 1] AS g FROM tg),
dg AS (SELECT doc_id, i - 1 AS i, ws[i] || ' ' || ws[i + 1] AS g FROM d, unnest(range(1, len(ws))) u(i) WHERE len(ws) > 1),
v AS (SELECT DISTINCT doc_id, template, label, base, n, i - j AS diagonal, j FROM dg JOIN pos USING (g)),
e AS (SELECT DISTINCT doc_id, template, label, base, n, diagonal FROM v),
s AS (SELECT e.doc_id, e.template, e.label, e.base, e.diagonal, count(DISTINCT v.j)::DOUBLE / e.n AS share
      FROM e JOIN v ON v.doc_id = e.doc_id AND v.template = e.template AND v.diagonal BETWEEN e.diagonal AND e.diagonal + CASE WHEN e.base THEN 0 ELSE {slack} END GROUP BY e.doc_id, e.template, e.label, e.base, e.diagonal, e.n),
f AS (SELECT doc_id, max(share) AS score, count(*) FILTER (WHERE base AND share >= 1) AS n_base, min(diagonal) FILTER (WHERE base AND share >= 1) AS first_word, max(diagonal) FILTER (WHERE base AND share >= 1) AS last_word,
      array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base AND share >= 1)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE share >= CASE WHEN base THEN 1 ELSE {least} END)), ',') AS labels FROM s GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN f USING (doc_id)
"""


#: Masks by row, then every order step by step; no transform and no closed form: shapley counts the orders in which a mask is met first.
OP13_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT w.doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
p(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM p, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
b AS (SELECT *, list_sum(list_transform(string_split(before, ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)) AS before_mask, 1 << (ascii(own) - 65) AS own_mask FROM s),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE mask & own_mask = 0 AND mask & before_mask = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & own_mask > 0 AND mask & before_mask = 0), 0) AS removed,
      coalesce(sum(n) FILTER (WHERE mask & own_mask > 0 AND mask & before_mask > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = own_mask), 0) AS unique_fails,
      coalesce(sum(good) FILTER (WHERE mask & own_mask > 0 AND mask & before_mask = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & own_mask > 0 AND mask & before_mask = 0), 0) AS toxic_lost
      FROM c, b GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_filter_audit": OP13_SQL, "op1_exact_dedup": OP1_SQL, "op3_repeats": OP3_SQL, "op5_jaccard_join": OP5_SQL, "op6_sharding": op6_sql(), "op9_language_model": OP9_SQL, "op10_license_scan": op10_sql()}
