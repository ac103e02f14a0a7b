"""DuckDB SQL for the queries of folioflow.plans.queries, written apart from their plans."""

from __future__ import annotations

from folioflow.functions.text import INDEX_TOKEN, QUERY_TOKEN, SPACE, STOPWORDS
from folioflow.operators.answering import DECLINING, INSTRUCTIONS

NL, BLANK = "chr(10)", "chr(10) || chr(10)"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{SPACE}+'), lambda w: w <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def tidy(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace(replace({x}, chr(0), ''), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', {BLANK}, 'g')")


def content_id(x: str) -> str:
    return f"substr(sha256({x}), 1, 12)"


def windows(words_: str) -> str:
    return f"list_transform(range(0, greatest(cast(ceil((len({words_}) - 180) / 150.0) AS BIGINT), 0) + 1), lambda i: {words_}[i * 150 + 1 : i * 150 + 180])"


CHUNK_WINDOWS = f"""
w AS (SELECT doc_id, {words("text")} AS ws FROM documents),
p AS (SELECT doc_id, unnest({windows("ws")}) AS part, unnest(range(0, greatest(cast(ceil((len(ws) - 180) / 150.0) AS BIGINT), 0) + 1)) AS i FROM w WHERE len(ws) > 0),
k AS (SELECT doc_id, i, len(part) AS n, array_to_string(part, ' ') AS text FROM p WHERE len(part) >= 5),
chunks AS (SELECT 'd' || doc_id AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS word_count, text FROM k)
"""

CHUNK_PACK = f"""
lines AS (SELECT doc_id, unnest(string_split(text, {NL})) AS p, generate_subscripts(string_split(text, {NL}), 1) AS i FROM documents),
paras AS (SELECT doc_id, i, {strip("p")} AS p FROM lines WHERE {strip("p")} <> ''),
split AS (SELECT doc_id, i, p, {words("p")} AS ws FROM paras),
parts AS (
    SELECT doc_id, i, 0 AS j, p AS text, len(ws) AS n FROM split WHERE len(ws) <= 180
    UNION ALL SELECT doc_id, i, j, array_to_string(part, ' '), len(part) FROM (SELECT doc_id, i, unnest({windows("ws")}) AS part, unnest(range(0, cast(ceil((len(ws) - 180) / 150.0) AS BIGINT) + 1)) AS j FROM split WHERE len(ws) > 180)
),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS u, text, n FROM parts),
pack AS (
    SELECT doc_id, u, n AS held, 0 AS grp, n, text FROM units WHERE u = 1
    UNION ALL SELECT b.doc_id, b.u, CASE WHEN a.held + b.n > 180 THEN b.n ELSE a.held + b.n END, CASE WHEN a.held + b.n > 180 THEN a.grp + 1 ELSE a.grp END, b.n, b.text
    FROM pack a JOIN units b ON b.doc_id = a.doc_id AND b.u = a.u + 1
),
grouped AS (SELECT doc_id, grp, sum(n) AS n, string_agg(text, {BLANK} ORDER BY u) AS text FROM pack GROUP BY 1, 2),
chunks AS (SELECT 'd' || doc_id AS doc_id, 'doc-' || doc_id || '.txt' AS doc_name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS word_count, text FROM grouped WHERE n >= 5)
"""

CHUNK_ROWS = "SELECT printf('%s:%04d', doc_id, chunk_index) AS chunk_id, doc_id, chunk_index, word_count, text FROM chunks"



def folded(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({x}, ''))), '{INDEX_TOKEN}')"


STOP = ", ".join(_text(w) for w in STOPWORDS)


def surface(x: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '{QUERY_TOKEN}'), lambda t: NOT list_contains([{STOP}], t))"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"


BM25 = f"""
tok AS (SELECT doc_id AS chunk_id, unnest({folded("text")}) AS term FROM documents),
dl AS (SELECT d.doc_id AS chunk_id, count(t.term) AS dl FROM documents d LEFT JOIN tok t ON t.chunk_id = d.doc_id GROUP BY 1),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM dl),
tf AS (SELECT chunk_id, term, CAST(count(*) AS DOUBLE) AS f FROM tok GROUP BY 1, 2),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id AS query_id, strip_accents(unnest({surface("text")})) AS term FROM benchmark),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, st),
scored AS (SELECT query_id, chunk_id, round(sum(idf * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id), st @where GROUP BY 1, 2),
bm25 AS MATERIALIZED (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored)
"""

COSINE = """
near AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE @asked @where),
cosine AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM near)
"""

TWENTIETH = "q.vec_id % 20 = 0"

#: The items are asked by the vectors of their numbers.
BY_ITEM = COSINE.replace("@asked", "q.vec_id IN (SELECT item_id FROM benchmark)").replace("@where", "")

FUSED = f"""
{BM25.replace('@where', '')}, {BY_ITEM},
s AS (SELECT query_id, vec_id AS chunk_id, score, rank FROM cosine WHERE rank <= 20),
k AS (SELECT query_id, chunk_id, score, rank FROM bm25 WHERE rank <= 20),
m AS (SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.chunk_id, k.chunk_id) AS chunk_id, s.score AS semantic_score, k.score AS keyword_score, s.rank AS s_rank, k.rank AS k_rank,
      round(coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0), 9) AS score FROM s FULL JOIN k ON s.query_id = k.query_id AND s.chunk_id = k.chunk_id),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s_rank NULLS LAST, k_rank NULLS LAST, chunk_id) AS INTEGER) AS rank FROM m)
"""

HITS = f"""
{FUSED},
hits AS (SELECT CAST(f.query_id AS VARCHAR) AS query_id, f.rank, f.chunk_id, coalesce(f.semantic_score, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)) AS semantic_score,
    CASE WHEN f.chunk_id % 2 = 0 THEN d.source || ', p. ' || (f.chunk_id % 10) WHEN f.chunk_id % 3 = 0 THEN d.source || ', § part' ELSE d.source END AS citation, d.text
    FROM fused f JOIN documents d ON d.doc_id = f.chunk_id JOIN embeddings q ON q.vec_id = f.query_id LEFT JOIN embeddings v ON v.vec_id = f.chunk_id WHERE f.rank <= 5),
evidence AS (SELECT CAST(b.item_id AS VARCHAR) AS query_id, max(coalesce(h.semantic_score, 0)) FILTER (WHERE h.query_id IS NOT NULL) AS top_score, count(*) FILTER (WHERE h.semantic_score >= 0.95) = 0 AS abstained,
    coalesce(array_to_string(list_sort(list(DISTINCT h.citation) FILTER (WHERE h.semantic_score >= 0.95)), '; '), '') AS citations
    FROM benchmark b LEFT JOIN hits h ON h.query_id = CAST(b.item_id AS VARCHAR) GROUP BY b.item_id)
"""

OUTCOMES = f"""
{BM25.replace('@where', '')},
best AS (SELECT query_id, list(lower(source)) AS sources, string_agg(text, {BLANK} ORDER BY rank) AS text FROM bm25 JOIN documents ON doc_id = chunk_id WHERE rank <= 5 GROUP BY 1),
items AS (SELECT b.item_id, CASE WHEN item_id % 3 <> 0 THEN 'src' || (item_id % 10) END AS expected, CASE WHEN item_id % 4 <> 0 THEN lower(b.text) END AS keyword, item_id % 5 = 0 AS should_abstain, sources, best.text AS hit FROM benchmark b LEFT JOIN best ON query_id = item_id),
results AS (SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN expected IS NOT NULL THEN coalesce(len(list_filter(sources, lambda s: contains(s, expected))) > 0, false) END AS retrieval_hit, CASE WHEN keyword IS NOT NULL THEN contains(lower(coalesce(hit, '')), keyword) END AS keywords_found,
    should_abstain = (hit IS NULL OR {" OR ".join(f"contains(lower(coalesce(hit, '')), {_text(p)})" for p in DECLINING)}) AS abstain_correct FROM items)
"""


def embedded(name: str, key: str, rows: str) -> str:
    """Hashed vectors of texts: (key, bucket, w), w as a float of the share of the length."""
    return f"""
{name}_t AS (SELECT {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '{QUERY_TOKEN}')) AS t FROM {rows}),
{name}_c AS (SELECT {key}, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS INTEGER) AS bucket, count(*) AS n FROM {name}_t GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT {key}, bucket, CAST(CAST(n / sqrt(sum(CAST(n * n AS DOUBLE)) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS w FROM {name}_c)"""


SEARCH = f"""
{BM25.replace('@where', '')}, {embedded('dv', 'doc_id', 'documents')}, {embedded('qv', 'item_id', 'benchmark')},
dl_ AS MATERIALIZED (SELECT doc_id, list(coalesce(w, 0::DOUBLE) ORDER BY bucket) AS v FROM (SELECT doc_id, unnest(range(256)) AS bucket FROM documents) LEFT JOIN dv USING (doc_id, bucket) GROUP BY 1),
ql_ AS MATERIALIZED (SELECT item_id, list(coalesce(w, 0::DOUBLE) ORDER BY bucket) AS v FROM (SELECT item_id, unnest(range(256)) AS bucket FROM benchmark) LEFT JOIN qv USING (item_id, bucket) GROUP BY 1),
cos AS MATERIALIZED (SELECT q.item_id AS query_id, d.doc_id, round(list_inner_product(d.v, q.v), 6) AS score, printf('d%d:0000', d.doc_id) AS chunk FROM ql_ q, dl_ d),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM cos),
key AS (SELECT query_id, chunk_id AS doc_id, score, printf('d%d:0000', chunk_id) AS chunk, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, printf('d%d:0000', chunk_id)) AS rank FROM bm25),
m AS (SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.doc_id, k.doc_id) AS doc_id, k.score AS keyword_score, s.rank AS s_rank, k.rank AS k_rank,
      round(coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0), 9) AS score
      FROM (SELECT * FROM sem WHERE rank <= 20) s FULL JOIN (SELECT * FROM key WHERE rank <= 20) k ON s.query_id = k.query_id AND s.doc_id = k.doc_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s_rank NULLS LAST, k_rank NULLS LAST, printf('d%d:0000', doc_id)) AS rank FROM m)
"""


def _hits(source: str, semantic: str, keyword: str) -> str:
    return f"""WITH {SEARCH} SELECT CAST(x.query_id AS VARCHAR) AS query_id, CAST(x.rank AS INTEGER) AS rank, printf('d%d:0000', x.doc_id) AS chunk_id, 'd' || x.doc_id AS doc_id,
        d.source || CASE WHEN coalesce(d.lang, '') <> '' THEN ', § ' || d.lang ELSE '' END AS citation, x.score, {semantic} AS semantic_score, {keyword} AS keyword_score
        FROM {source} x JOIN documents d USING (doc_id) {"JOIN cos USING (query_id, doc_id)" if source == "fused" else ""} WHERE x.rank <= 5"""


STORED = f"""WITH RECURSIVE {CHUNK_PACK}, kept AS (SELECT doc_id, any_value(doc_name) AS doc_name, CAST(count(*) AS INTEGER) AS n_chunks, CAST(sum(len({folded('text')})) AS BIGINT) AS n_tokens FROM chunks GROUP BY 1)"""

KEY = strip("regexp_replace(lower(p), '\\p{Nd}+', '#', 'g')")


def _rate(measure: str) -> str:
    passed, total = f"coalesce(sum(CAST({measure} AS BIGINT)), 0)", f"count({measure})"
    return f"SELECT '{measure}' AS measure, CAST({passed} AS BIGINT) AS passed, {total} AS total, CASE WHEN {total} = 0 THEN 'n/a' ELSE CAST({passed} AS BIGINT) || '/' || {total} END AS rate FROM results"


def _mark(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' WHEN {column} THEN 'PASS' ELSE 'FAIL' END"


def oracle_sql() -> dict[str, str]:
    dirty = f"' ' || chr(9) || ' ' || replace(text, ' ', '  ' || chr(9) || ' ') || repeat({NL}, 4) || 'end ' || {NL}"
    return {
        "chunk_windows": f"WITH {CHUNK_WINDOWS} {CHUNK_ROWS}",
        "chunk_pack": f"WITH RECURSIVE {CHUNK_PACK} {CHUNK_ROWS}",
        "clean_text": f"SELECT doc_id, {tidy(f'({dirty})')} AS clean FROM documents",
        "repeat_lines": f"""
            WITH pages AS (SELECT source, doc_id, list_filter(string_split(text, {NL}), lambda p: p <> '') AS ps FROM documents),
            sizes AS (SELECT source, count(*) AS pages FROM pages GROUP BY 1),
            lines AS (SELECT source, doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, len(ps) AS n FROM pages),
            edges AS (SELECT *, {KEY} AS key, (i <= 2 OR i > n - 2) AND length(p) <= 120 AS edge FROM lines),
            runs AS (SELECT e.source, key FROM edges e JOIN sizes USING (source) WHERE edge AND pages >= 3 GROUP BY e.source, key, pages HAVING count(DISTINCT doc_id) >= 0.1::DOUBLE * pages),
            kept AS (SELECT doc_id, count(*) AS n, string_agg(p, {NL} ORDER BY i) AS text FROM edges e WHERE NOT (edge AND EXISTS (SELECT 1 FROM runs r WHERE r.source = e.source AND r.key = e.key)) GROUP BY 1)
            SELECT source AS doc_id, doc_id AS page, CAST(coalesce(n, 0) AS INTEGER) AS n_paragraphs, coalesce(text, '') AS text FROM pages LEFT JOIN kept USING (doc_id)""",
        "needs_ocr": f"SELECT doc_id, length({tidy('text')}) < 300 AS needs_ocr FROM documents",
        "doc_identity": f"SELECT doc_id, {content_id('text')} AS content_id FROM documents",
        "dedup_ingest": f"""
            SELECT doc_id, {content_id("text")} AS content_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 'duplicate' WHEN len({words("text")}) < 5 THEN 'no_text' ELSE 'indexed' END AS status FROM documents""",
        "stream_ingest": f"""
            SELECT doc_id, {content_id("text")} AS content_id, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'duplicate' WHEN len({words("text")}) < 5 THEN 'no_text' ELSE 'indexed' END AS status FROM documents""",
        "doc_catalog": f"WITH RECURSIVE {CHUNK_PACK} SELECT doc_id, doc_name, CAST(count(*) AS INTEGER) AS n_chunks FROM chunks GROUP BY 1, 2",
        "ingest_stats": f"WITH RECURSIVE {CHUNK_PACK} SELECT (SELECT count(*) FROM documents) AS n_segments, count(*) AS n_chunks, round(coalesce(avg(word_count), 0), 6) AS mean_words FROM chunks",
        "doc_text_concat": f"WITH RECURSIVE {CHUNK_PACK} SELECT doc_id, string_agg(text, {BLANK} ORDER BY chunk_index) AS text FROM chunks GROUP BY 1",
        "conversation_text": f"SELECT conv_id, string_agg(role || ': ' || text, {BLANK} ORDER BY turn, role || ': ' || text) AS text FROM conversations GROUP BY 1",
        "query_tokens": f"SELECT item_id, array_to_string({surface('text')}, ' ') AS tokens FROM benchmark",
        "bm25_topk": f"WITH {BM25.replace('@where', '')} SELECT * FROM bm25 WHERE rank <= 20",
        "bm25_doc_filter": f"WITH {BM25.replace("@where", '''WHERE chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'de')''')} SELECT * FROM bm25 WHERE rank <= 20",
        "bm25_phrases": f"""
            WITH t AS (SELECT doc_id, {folded("text")} AS ts FROM documents), p AS (SELECT item_id, {folded("text")} AS qs FROM benchmark),
            q AS (SELECT DISTINCT item_id, unnest(qs[:-2]) AS a, unnest(qs[2:]) AS b FROM p WHERE len(qs) > 1),
            adj AS (SELECT doc_id, unnest(ts[:-2]) AS a, unnest(ts[2:]) AS b FROM t WHERE len(ts) > 1)
            SELECT item_id AS query_id, a || ' ' || b AS phrase, doc_id AS chunk_id, count(*) AS f FROM q JOIN adj USING (a, b) GROUP BY 1, 2, 3""",
        "index_stats": f"WITH tok AS (SELECT doc_id, unnest({folded('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY 1",
        "cosine_topk": f"WITH {COSINE.replace('@asked', TWENTIETH).replace('@where', '')} SELECT * FROM cosine WHERE rank <= 20",
        "cosine_filtered": f"WITH {COSINE.replace('@asked', TWENTIETH).replace("@where", 'AND v.label IN (1, 3, 5)')} SELECT * FROM cosine WHERE rank <= 20",
        "hash_embed": f"""
            WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{QUERY_TOKEN}')) AS t FROM documents),
            c AS (SELECT doc_id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS INTEGER) AS bucket, count(*) AS n FROM t GROUP BY 1, 2)
            SELECT doc_id, bucket, round(n / sqrt(sum(CAST(n * n AS DOUBLE)) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""",
        "rrf_hybrid": f"WITH {FUSED} SELECT query_id, chunk_id, score, semantic_score, keyword_score, rank FROM fused WHERE rank <= 5",
        "cosine_fill": f"WITH {HITS} SELECT query_id, rank, chunk_id, semantic_score, citation FROM hits",
        "abstain": f"WITH {HITS} SELECT query_id, abstained, top_score FROM evidence",
        "citations": f"WITH {HITS} SELECT query_id, citations FROM evidence",
        "prompt_build": f"""
            WITH {HITS} SELECT query_id, {_text(INSTRUCTIONS)} || {BLANK} || 'Excerpts:' || {NL} || string_agg('[' || citation || ']' || {NL} || h.text, {BLANK} ORDER BY rank) || {BLANK} || 'Question: ' || any_value(b.text) || {NL} || 'Answer:' AS prompt
            FROM hits h JOIN benchmark b ON CAST(b.item_id AS VARCHAR) = query_id WHERE semantic_score >= 0.95 GROUP BY 1""",
        "no_answer": f"""
            SELECT doc_id, doc_id % 7 = 0 OR doc_id % 5 = 0 OR {" OR ".join(f"contains(lower(text), {_text(p)})" for p in DECLINING)} AS no_answer FROM documents""",
        "eval_outcomes": f"WITH {OUTCOMES} SELECT id, {_mark('retrieval_hit')} AS retrieval, {_mark('keywords_found')} AS keywords, {_mark('abstain_correct')} AS abstain FROM results",
        "eval_rates": f"WITH {OUTCOMES} " + " UNION ALL ".join(_rate(m) for m in ("retrieval_hit", "keywords_found", "abstain_correct")),
        "search_keyword": _hits("key", "CAST(NULL AS DOUBLE)", "x.score"),
        "search_semantic": _hits("sem", "x.score", "CAST(NULL AS DOUBLE)"),
        "search_hybrid": _hits("fused", "cos.score", "x.keyword_score"),
        "embed_passages": f"WITH {embedded('dv', 'doc_id', 'documents')} SELECT doc_id, bucket, round(w, 5) AS weight FROM dv",
        "store_ingest": f"{STORED} SELECT doc_id, doc_name, n_chunks, n_tokens FROM kept",
        "store_delete": f"{STORED} SELECT doc_id, n_chunks, n_tokens FROM kept WHERE doc_id NOT IN (SELECT 'd' || doc_id FROM labels WHERE toxic = 1)",
        "docx_sections": f"""
            WITH d AS (SELECT doc_id, doc_id // 50 AS file, lang, source, n_chars, regexp_replace(coalesce(text, ''), '[^\\t\\n\\x20-\\x{{D7FF}}\\x{{E000}}-\\x{{FFFD}}\\x{{10000}}-\\x{{10FFFF}}]', '', 'g') AS t FROM documents),
            l AS (SELECT *, list_filter(list_transform(string_split(t, {NL}), lambda x: {strip('x')}), lambda x: x <> '') AS ls FROM d)
            SELECT printf('%08d.docx', file) AS doc_name, 0 AS seg_no, 'paras 1-1' AS section, 'File ' || file AS text FROM d GROUP BY file
            UNION ALL SELECT printf('%08d.docx', file), CAST(row_number() OVER (PARTITION BY file ORDER BY doc_id) AS INTEGER), 'Document ' || doc_id,
                array_to_string(list_concat(['Document ' || doc_id], ls, [lang || ' | ' || n_chars || {NL} || source || ' | ']), {BLANK}) FROM l""",
        "extract_json": """
            SELECT CAST(event_id AS VARCHAR) AS invoice_number, json_extract_string(props, '$.k') AS vendor, CAST(NULL AS DOUBLE) AS total, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_lines,
            round(CASE WHEN event_id % 2 = 0 THEN coalesce(value, 0) ELSE 0 END, 6) AS amount FROM events""",
        "delete_doc": "SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) GROUP BY 1",
        "preview": f"""
            SELECT doc_id, replace(substr(text, 1, 220), {NL}, ' ') || CASE WHEN length(text) > 220 THEN '...' ELSE '' END AS preview, 'Doc ' || upper(substr(source, 1, 1)) || lower(substr(source, 2)) AS label, CASE WHEN doc_id % 2 = 0 THEN source ELSE '—' END AS shown FROM documents""",
    }
