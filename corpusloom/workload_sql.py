"""DuckDB statements for the registered queries, written from the definitions."""

from __future__ import annotations

from corpusloom.functions.text import ROLES
from corpusloom.workload import MD_STYLES, QUOTAS, ROLE_SAMPLES, RST_STYLES

TOKENS = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda t: lower(t))"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


CHUNKS = """chunks AS (
  SELECT doc_id::VARCHAR AS doc_id, lang AS namespace, source || '/' || doc_id || '.txt' AS file_path,
         sha256(text) AS commit_sha, doc_id::VARCHAR AS symbol, source AS heading_path, 1 AS start_line,
         (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS end_line, text
  FROM documents)"""
REQUESTS = """requests AS (
  SELECT item_id AS query_id, text AS question,
         CASE WHEN length(text) < 200 THEN ['en'] ELSE ['de', 'en', 'es', 'fr'] END AS namespaces
  FROM benchmark)"""
TOKENISED = f"""tokenised AS (
  SELECT doc_id, namespace, {TOKENS.format('text')} AS tokens FROM chunks WHERE text <> '')"""
STATS = """stats AS (
  SELECT namespace, count(*) AS n_docs, sum(len(tokens)) / count(*) AS avgdl
  FROM tokenised GROUP BY namespace)"""
TF = """tf AS (
  SELECT doc_id, namespace, dl, term, count(*) AS tf
  FROM (SELECT doc_id, namespace, len(tokens) AS dl, unnest(tokens) AS term FROM tokenised)
  GROUP BY ALL)"""
DF = "df AS (SELECT namespace, term, count(*) AS n FROM tf GROUP BY namespace, term)"
IDF = """raw AS (
  SELECT d.namespace, d.term, d.n, s.avgdl, ln(s.n_docs - d.n + 0.5::DOUBLE) - ln(d.n + 0.5::DOUBLE) AS raw
  FROM df d JOIN stats s USING (namespace)),
means AS (SELECT namespace, avg(raw) AS mean_idf FROM raw GROUP BY namespace),
idf AS (
  SELECT r.namespace, r.term, r.n, r.avgdl,
         CASE WHEN r.raw < 0 THEN 0.25::DOUBLE * m.mean_idf ELSE r.raw END AS idf
  FROM raw r JOIN means m USING (namespace))"""
BM25 = f"""query_terms AS (
  SELECT query_id, namespace, term, count(*) AS qtf
  FROM (SELECT query_id, namespace, unnest({TOKENS.format('question')}) AS term
        FROM (SELECT query_id, question, unnest(namespaces) AS namespace FROM requests))
  GROUP BY ALL),
bm25_scores AS (
  SELECT q.query_id, q.namespace, t.doc_id,
         sum(q.qtf * i.idf * t.tf * 2.5::DOUBLE
             / (t.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * t.dl / i.avgdl))) AS score
  FROM query_terms q JOIN idf i USING (namespace, term) JOIN tf t USING (namespace, term)
  GROUP BY ALL),
bm25_hits AS (
  SELECT query_id, namespace, doc_id, score, (rn - 1)::INT AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, namespace
                                     ORDER BY round(score, 9) DESC, doc_id) AS rn
        FROM bm25_scores WHERE score > 0) WHERE rn <= 50)"""
DENSE = """vectors AS (
  SELECT d.doc_id::VARCHAR AS doc_id, d.lang AS namespace, e.embedding::DOUBLE[] AS embedding
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
dense_scores AS (
  SELECT q.query_id, v.namespace, v.doc_id, list_cosine_similarity(v.embedding, q.vector) AS score
  FROM (SELECT r.query_id, unnest(r.namespaces) AS namespace, e.embedding::DOUBLE[] AS vector
        FROM requests r JOIN embeddings e ON e.vec_id = r.query_id) q
  JOIN vectors v USING (namespace)),
dense_hits AS (
  SELECT query_id, namespace, doc_id, score, (rn - 1)::INT AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, namespace
                                     ORDER BY round(score, 9) DESC, doc_id) AS rn
        FROM dense_scores) WHERE rn <= 50)"""
FUSED = """fused AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id, namespace
                                ORDER BY score DESC, min_rank, doc_id) - 1)::INT AS rank
  FROM (SELECT query_id, namespace, doc_id, sum(1::DOUBLE / (61 + rank)) AS score, min(rank) AS min_rank
        FROM (SELECT query_id, namespace, doc_id, rank FROM bm25_hits
              UNION ALL SELECT query_id, namespace, doc_id, rank FROM dense_hits)
        GROUP BY ALL))"""
CROSS = """crossed AS (
  SELECT query_id, namespace, doc_id, score, rank
  FROM (SELECT *, (row_number() OVER (PARTITION BY query_id
                                      ORDER BY score DESC, min_rank, doc_id) - 1)::INT AS rank
        FROM (SELECT f.query_id, f.doc_id, arg_min(f.namespace, list_position(r.namespaces, f.namespace)) AS namespace,
                     CASE WHEN max(len(r.namespaces)) = 1 THEN max(f.score)
                          ELSE sum(1::DOUBLE / (61 + f.rank)) END AS score,
                     min(f.rank) AS min_rank
              FROM fused f JOIN requests r USING (query_id) GROUP BY f.query_id, f.doc_id))
  WHERE rank < 50)"""

LEXICAL = (CHUNKS, REQUESTS, TOKENISED, STATS, TF, DF, IDF, BM25)
HYBRID = (*LEXICAL, DENSE, FUSED)
HYDRATED = """hydrated AS (
  SELECT c.query_id, c.rank, c.score, c.doc_id, c.namespace, h.file_path AS path, h.symbol, 'doc' AS chunk_type,
         h.text, h.heading_path, h.commit_sha, h.start_line, h.end_line
  FROM crossed c JOIN chunks h USING (namespace, doc_id))"""
SEARCH = (*HYBRID, CROSS, HYDRATED)
RELEVANT = """relevant AS (
  SELECT b.item_id AS query_id, c.namespace, c.file_path AS path, c.symbol
  FROM benchmark b JOIN chunks c ON contains(c.text, b.text))"""
METRICS = """found AS (
  SELECT h.query_id, h.rank, r.query_id IS NOT NULL AS hit
  FROM hydrated h LEFT JOIN (SELECT DISTINCT * FROM relevant) r USING (query_id, namespace, path, symbol)
  WHERE h.rank < 10),
wanted AS (SELECT query_id, count(*) AS n FROM (SELECT DISTINCT * FROM relevant) GROUP BY query_id),
metrics AS (
  SELECT q.query_id, count(f.rank)::INT AS retrieved_count,
         CASE WHEN any_value(w.n) IS NULL THEN 1 ELSE count_if(f.hit AND f.rank < 5) / any_value(w.n) END AS recall_at_5,
         CASE WHEN any_value(w.n) IS NULL THEN 1 ELSE count_if(f.hit) / any_value(w.n) END AS recall_at_10,
         CASE WHEN any_value(w.n) IS NULL THEN 1
              ELSE coalesce(1 / min(CASE WHEN f.hit THEN f.rank + 1 END), 0) END AS mrr_at_10,
         coalesce(count_if(f.hit AND f.rank < 5) / nullif(count_if(f.rank < 5), 0), 0) AS precision_at_5
  FROM requests q LEFT JOIN found f USING (query_id) LEFT JOIN wanted w USING (query_id)
  GROUP BY q.query_id)"""
EARLIER = """earlier AS (
  SELECT c.file_path, CASE WHEN l.quality = 1 THEN c.commit_sha ELSE 'older' END AS commit_sha
  FROM chunks c JOIN labels l ON l.doc_id::VARCHAR = c.doc_id
  UNION ALL SELECT 'pages/' || page_id, 'gone' FROM pages)"""
DIFF = """diff AS (
  SELECT coalesce(c.file_path, e.file_path) AS file_path, coalesce(c.commit_sha, e.commit_sha) AS commit_sha,
         CASE WHEN e.file_path IS NULL THEN 'add' WHEN c.file_path IS NULL THEN 'delete'
              WHEN {changed} THEN 'update' ELSE 'skip' END AS action
  FROM chunks c FULL JOIN earlier e ON c.file_path = e.file_path)"""
_CHANGED = DIFF.format(changed="c.commit_sha <> e.commit_sha")
NEGATIVES = """negatives AS (
  SELECT query_id, text, (rn - 1)::INT AS rank
  FROM (SELECT h.query_id, h.text, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS rn
        FROM hydrated h
        WHERE h.rank < 20 AND regexp_matches(h.text, '\\S') AND NOT EXISTS (
          SELECT 1 FROM relevant r WHERE r.query_id = h.query_id AND r.namespace = h.namespace
                                     AND r.path = h.path AND r.symbol = h.symbol))
  WHERE rn <= 3)"""
PROMPTS = """contexts AS (
  SELECT query_id, string_agg('[' || namespace || ':' || path || ':' || symbol || ']' || chr(10) || text,
                              chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM hydrated WHERE rank < 10 GROUP BY query_id)"""
ANSWERS = """answers AS (
  SELECT q.query_id,
         CASE WHEN s.n IS NULL THEN 'Nothing was found.'
              ELSE 'Hits by namespace (' || s.n || '):' || chr(10) || s.lines END AS answer
  FROM requests q LEFT JOIN (
    SELECT query_id, count(*) AS n,
           string_agg('  ' || namespace || ': ' || hits || ' chunks', chr(10) ORDER BY hits DESC, first) AS lines
    FROM (SELECT query_id, namespace, count(*) AS hits, min(rank) AS first
          FROM hydrated WHERE rank < 10 GROUP BY ALL)
    GROUP BY query_id) s USING (query_id))"""
FRAGMENTS = "list_filter(flatten(list_transform(string_split({0}, ' '), lambda w: [' ', w])), lambda x, i: i > 1)"


def _headed(suffix: str, styles) -> str:
    text = "text"
    for letters, before, after in styles:
        tail = "".join(" || chr(10)" if c == chr(10) else f" || '{c}'" for c in after)
        head = "".join(" || chr(10)" if c == chr(10) else f" || '{c}'" for c in before)
        text = rf"regexp_replace({text}, '(^|\n)([{letters}][^\n.]*)\.', '\1'{head} || '\2'{tail}, 'g')"
    return rf"""files AS (SELECT doc_id || '{suffix}' AS path, doc_id::VARCHAR AS stem, {text} AS source FROM documents),
split AS (
  SELECT path, stem, source, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS lines
  FROM (SELECT *, string_split_regex(source, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS parts
        FROM files)),
numbered AS (SELECT path, stem, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM split)"""


MD_HEADINGS = r"""headings AS (
  SELECT path, n, len(regexp_extract(line, '^(#{1,6})\s', 1)) AS level,
         trim(regexp_extract(line, '^#{1,6}\s+(.+?)\s*#*\s*$', 1)) AS title
  FROM numbered WHERE regexp_matches(line, '^(#{1,6})\s+(.+?)\s*#*\s*$'))"""
RST_HEADINGS = r"""marked AS (
  SELECT path, n, trim(line) AS title, rtrim(lead(line) OVER (PARTITION BY path ORDER BY n)) AS mark FROM numbered),
underlined AS (
  SELECT path, n, title, mark[1] AS ch FROM marked
  WHERE regexp_matches(mark, '^(={3,}|-{3,}|~{3,}|`{3,}|#{3,}|"{3,}|\*{3,}|\^{3,}|\+{3,}|:{3,}|_{3,})$')
    AND title <> '' AND length(mark) >= length(title) - 1
    AND NOT regexp_matches(title, '^(=+|-+|~+|`+|#+|"+|\*+|\^+|\++|:+|_+)$')),
headings AS (
  SELECT path, n, title, dense_rank() OVER (PARTITION BY path ORDER BY first)::INT AS level
  FROM (SELECT *, min(n) OVER (PARTITION BY path, ch) AS first FROM underlined))"""


def _sections(headings: str, suffix: str, styles) -> str:
    crumbs = ", ".join(
        f"CASE WHEN {d} > s.level THEN NULL WHEN a{d}.level = {d} THEN nullif(a{d}.title, '') END"
        for d in range(1, 7)
    )
    above = ", ".join(
        f"last_value(CASE WHEN level <= {d} THEN {{'level': level, 'title': title}} END IGNORE NULLS) "
        f"OVER (PARTITION BY path ORDER BY n) AS a{d}"
        for d in range(1, 7)
    )
    return (
        _with(_headed(suffix, styles), headings)
        + f"""SELECT s.path, s.title AS symbol, s.level::INT AS level, s.n::INT AS start_line, s.last::INT AS end_line,
          concat_ws(' > ', {crumbs}) AS heading_path,
          array_to_string(f.lines[s.n:s.last], chr(10)) AS text
        FROM (SELECT *, coalesce(lead(n) OVER (PARTITION BY path ORDER BY n) - 1, total) AS last, {above}
              FROM headings JOIN (SELECT path, len(lines) AS total FROM split) USING (path)) s
        JOIN split f USING (path)
        UNION ALL BY NAME
        SELECT path, stem AS symbol, 1 AS level, 1 AS start_line, greatest(1, len(lines))::INT AS end_line,
               stem AS heading_path, source AS text
        FROM split WHERE path NOT IN (SELECT path FROM headings)"""
    )


def _of_kind(sql: str, number: int) -> str:
    """Chunks of the documents whose number gives this remainder, as those of prose files."""
    return f"""SELECT path, 'doc' AS chunk_type, NULL::VARCHAR AS language, symbol, heading_path, level, start_line, end_line, text
      FROM ({sql}) WHERE regexp_extract(path, '^\\d+')::BIGINT % 4 = {number}"""


_WHOLE_FILES = """SELECT path, stem AS symbol, stem AS heading_path, 1 AS level, 1 AS start_line,
             greatest(1, len(lines))::INT AS end_line, source AS text FROM split"""


def _mock_vector(text: str, dim: int) -> str:
    def word(i: int) -> str:
        at = 8 * i + 1
        digits = " || ".join(f"substr(h, {at + shift}, 2)" for shift in (6, 4, 2, 0))
        return f"('0x' || {digits})::BIGINT"

    words = ", ".join(
        f"((CASE WHEN {word(i % 8)} >= 2147483648 THEN {word(i % 8)} - 4294967296 ELSE {word(i % 8)} END) "
        "/ 2147483648::DOUBLE)::FLOAT"
        for i in range(dim)
    )
    return f"[{words}]"


def _marked_roles() -> str:
    """What cleaning must give back: the text with its sample words, and the label of each role."""
    text = "text"
    for plain, markup in ROLE_SAMPLES.items():
        text = f"replace({text}, '{plain}', '{markup}')"
    for plain, markup in reversed(ROLE_SAMPLES.items()):
        text = f"replace({text}, '{markup.strip()}', '{plain.strip()}')"
    return text


_RECALL = """best_{m} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM {scores}),
top_{m} AS (
  SELECT b.query_id, c.namespace, c.file_path AS path, c.symbol
  FROM best_{m} b JOIN chunks c USING (namespace, doc_id) WHERE rn <= 10),
recalls_{m} AS (
  SELECT t.query_id, CASE WHEN any_value(w.n) IS NULL THEN 1 ELSE count(r.query_id) / any_value(w.n) END AS recall
  FROM top_{m} t LEFT JOIN (SELECT DISTINCT * FROM relevant) r USING (query_id, namespace, path, symbol)
  LEFT JOIN (SELECT query_id, count(DISTINCT (namespace, path, symbol)) AS n FROM relevant GROUP BY query_id) w
    USING (query_id)
  GROUP BY t.query_id)"""
_MOCK_SCORES = f"""mock_scores AS (
  SELECT q.query_id, c.namespace, c.doc_id, list_cosine_similarity(c.v, q.v) AS score
  FROM (SELECT doc_id, namespace, {_mock_vector("h", 16)}::DOUBLE[] AS v
        FROM (SELECT doc_id, namespace, sha256(text) AS h FROM chunks)) c
  JOIN (SELECT query_id, namespace, {_mock_vector("h", 16)}::DOUBLE[] AS v
        FROM (SELECT r.query_id, unnest(r.namespaces) AS namespace, sha256(r.question) AS h
              FROM requests r JOIN embeddings e ON e.vec_id = r.query_id)) q USING (namespace))"""

_UUID = """lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
  || substr('89ab', ((('0x' || substr(h, 17, 1))::INT) & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""

_HIT = "query_id, namespace, doc_id, round(score, 6) AS score, rank"

SQL = {
    "tokenize_docs": f"SELECT doc_id::VARCHAR AS doc_id, {TOKENS.format('text')} AS tokens FROM documents",
    "term_frequency": _with(CHUNKS, TOKENISED, TF)
    + "SELECT doc_id, term, tf::INT AS tf, dl::INT AS dl FROM tf",
    "document_frequency": _with(CHUNKS, TOKENISED, TF, DF) + "SELECT namespace, term, n FROM df",
    "namespace_stats": f"""SELECT namespace, count(*) AS n_docs, round(sum(len(tokens)) / count(*), 6) AS avgdl
      FROM (SELECT source AS namespace, {TOKENS.format('text')} AS tokens FROM documents WHERE text <> '')
      GROUP BY namespace""",
    "bm25_idf": _with(CHUNKS, TOKENISED, STATS, TF, DF, IDF)
    + "SELECT namespace, term, n, round(idf, 6) AS idf FROM idf",
    "bm25_topk": _with(*LEXICAL) + f"SELECT {_HIT} FROM bm25_hits",
    "bm25_topk_postings": _with(*LEXICAL) + f"SELECT {_HIT} FROM bm25_hits",
    "bm25_topk_block_max": _with(*LEXICAL) + f"SELECT {_HIT} FROM bm25_hits",
    "bm25_topk_by_source": _with(
        CHUNKS.replace("lang AS namespace", "source AS namespace"),
        """requests AS (SELECT item_id AS query_id, text AS question,
                               (SELECT list(DISTINCT source) FROM documents) AS namespaces FROM benchmark)""",
        *LEXICAL[2:],
    )
    + f"SELECT {_HIT} FROM bm25_hits WHERE rank < 10",
    "dense_topk": _with(REQUESTS, DENSE) + f"SELECT {_HIT} FROM dense_hits",
    "dense_topk_grid": _with(REQUESTS, DENSE) + f"SELECT {_HIT} FROM dense_hits",
    "hybrid_fusion": _with(*HYBRID) + f"SELECT {_HIT} FROM fused",
    "cross_namespace_fusion": _with(*HYBRID, CROSS) + f"SELECT {_HIT} FROM crossed",
    "rrf_variadic": _with(*HYBRID)
    + """, third AS (SELECT query_id, namespace, doc_id,
                     row_number() OVER (PARTITION BY query_id, namespace ORDER BY doc_id) - 1 AS rank FROM bm25_hits),
      lists AS (SELECT query_id, namespace, doc_id, rank, 0 AS list_no FROM bm25_hits
                UNION ALL SELECT query_id, namespace, doc_id, rank, 1 FROM dense_hits
                UNION ALL SELECT query_id, namespace, doc_id, rank, 2 FROM third),
      merged AS (SELECT query_id, namespace, doc_id, min((list_no, rank)) AS first,
                        list_reduce(list_prepend(0::DOUBLE, list(1::DOUBLE / (61 + rank) ORDER BY list_no)),
                                    lambda a, b: a + b) AS score
                 FROM lists GROUP BY ALL)
      SELECT query_id, namespace, doc_id, round(score, 6) AS score,
             (row_number() OVER (PARTITION BY query_id, namespace ORDER BY score DESC, first) - 1)::INT AS rank
      FROM merged""",
    "hybrid_search_hydrated": _with(*SEARCH)
    + """SELECT query_id, rank, round(score, 6) AS score, doc_id, namespace, path, symbol, chunk_type, text,
             heading_path, '' AS language, commit_sha, start_line::VARCHAR AS start_line, end_line::VARCHAR AS end_line
      FROM hydrated WHERE rank < 10""",
    "hydration_by_filter": _with(*SEARCH)
    + """SELECT query_id, rank, round(score, 6) AS score, doc_id, namespace, path, symbol, chunk_type, text,
             heading_path, '' AS language, commit_sha, start_line::VARCHAR AS start_line, end_line::VARCHAR AS end_line
      FROM hydrated WHERE rank < 10""",
    "hybrid_search_debug": _with(*SEARCH)
    + """SELECT r.query_id, coalesce(b.hits, []) AS bm25_top, coalesce(d.hits, []) AS dense_top, coalesce(c.hits, []) AS rrf_top
      FROM requests r JOIN embeddings e ON e.vec_id = r.query_id
      LEFT JOIN (SELECT query_id, list(namespace || '/' || doc_id ORDER BY list_position(namespaces, namespace), rank) AS hits
                 FROM bm25_hits JOIN requests USING (query_id) GROUP BY query_id) b USING (query_id)
      LEFT JOIN (SELECT query_id, list(namespace || '/' || doc_id ORDER BY list_position(namespaces, namespace), rank) AS hits
                 FROM dense_hits JOIN requests USING (query_id) GROUP BY query_id) d USING (query_id)
      LEFT JOIN (SELECT query_id, list(namespace || '/' || doc_id ORDER BY rank) AS hits FROM crossed GROUP BY query_id) c
        USING (query_id)""",
    "api_summary": _with(*SEARCH)
    + """SELECT query_id, rank, namespace, path AS file_path, symbol, heading_path, round(score, 6) AS score,
             substr(text, 1, 300) AS snippet, start_line, end_line, chunk_type
      FROM hydrated WHERE rank < 10""",
    "inspection_table": _with(*HYBRID, CROSS)
    + """SELECT query_id, rank, namespace AS ns, substr(doc_id, 1, 8) AS doc_id, round(score, 6) AS score
      FROM crossed WHERE rank < 10""",
    "rerank_identity_top10": _with(*SEARCH)
    + """SELECT query_id, doc_id, 'fusion' AS score_kind, round(score, 6) AS score, rank FROM hydrated WHERE rank < 10""",
    "rerank_overlap_top10": _with(*SEARCH)
    + f""", words AS (
        SELECT h.query_id, h.doc_id, h.rank, list_distinct({TOKENS.format("q.question")}) AS asked,
               {TOKENS.format("h.text")} AS has
        FROM hydrated h JOIN requests q USING (query_id)),
      scored AS (SELECT query_id, doc_id, rank AS before, len(list_intersect(asked, has)) / len(asked) AS score FROM words)
      SELECT query_id, doc_id, 'relevance' AS score_kind, round(score, 6) AS score, rank
      FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) - 1)::INT AS rank FROM scored)
      WHERE rank < 10""",
    "request_validation": """SELECT query_id, ['de', 'en', 'es', 'fr'] AS namespaces, top_k, false AS retrieval_only,
             CASE WHEN length(question) < 1 THEN 'question is empty'
                  WHEN length(question) > 2000 THEN 'question is longer than 2000'
                  WHEN top_k < 1 OR top_k > 50 THEN 'top_k is not in 1..50' END AS violation
      FROM (SELECT conv_id || '-' || turn AS query_id, CASE WHEN role = 'system' THEN '' ELSE text END AS question,
                   (turn * 20)::INT AS top_k FROM conversations)""",
    "relevant_chunks": _with(CHUNKS, RELEVANT) + "SELECT * FROM relevant",
    "retrieval_metrics": _with(*SEARCH, RELEVANT, METRICS)
    + """SELECT query_id, retrieved_count, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10,
             round(mrr_at_10, 6) AS mrr_at_10, round(precision_at_5, 6) AS precision_at_5 FROM metrics""",
    "evaluation_means": _with(*SEARCH, RELEVANT, METRICS)
    + """SELECT count(*) AS items, count(*) AS evaluated, 0::BIGINT AS skipped, round(avg(recall_at_5), 6) AS recall_at_5,
             round(avg(recall_at_10), 6) AS recall_at_10, round(avg(mrr_at_10), 6) AS mrr_at_10,
             round(avg(precision_at_5), 6) AS precision_at_5 FROM metrics""",
    "evaluation_with_skips": _with(*SEARCH, RELEVANT, METRICS)
    + """SELECT count(*) AS items, count(*) FILTER (NOT skip) AS evaluated, count(*) FILTER (skip) AS skipped,
             round(avg(recall_at_5) FILTER (NOT skip), 6) AS recall_at_5, round(avg(recall_at_10) FILTER (NOT skip), 6) AS recall_at_10,
             round(avg(mrr_at_10) FILTER (NOT skip), 6) AS mrr_at_10, round(avg(precision_at_5) FILTER (NOT skip), 6) AS precision_at_5
      FROM (SELECT m.*, length(q.question) % 5 = 0 AS skip FROM metrics m JOIN requests q USING (query_id))""",
    "dense_evaluation": _with(CHUNKS, REQUESTS, DENSE, RELEVANT, _RECALL.format(m="given", scores="dense_scores"))
    + "SELECT count(*) AS evaluated, round(coalesce(avg(recall), 0), 6) AS recall FROM recalls_given",
    "model_comparison": _with(
        CHUNKS, REQUESTS, DENSE, RELEVANT, _RECALL.format(m="given", scores="dense_scores"),
        _MOCK_SCORES, _RECALL.format(m="mock", scores="mock_scores"),
    )
    + """SELECT 'given' AS model, count(*) AS evaluated, round(coalesce(avg(recall), 0), 6) AS recall FROM recalls_given
      UNION ALL SELECT 'mock', count(*), round(coalesce(avg(recall), 0), 6) FROM recalls_mock""",
    "sync_plain": _with(CHUNKS, EARLIER, _CHANGED) + "SELECT * FROM diff",
    "sync_forced": _with(CHUNKS, EARLIER, DIFF.format(changed="true")) + "SELECT * FROM diff",
    "sync_restricted": _with(CHUNKS, EARLIER, _CHANGED)
    + """SELECT * FROM diff WHERE file_path IN (
        SELECT c.file_path FROM chunks c JOIN labels l ON l.doc_id::VARCHAR = c.doc_id WHERE l.toxic = 1)""",
    "ingest_counts": _with(CHUNKS, EARLIER, _CHANGED)
    + """SELECT count_if(action <> 'delete')::BIGINT AS files_seen, count_if(action IN ('add', 'update'))::BIGINT AS to_index,
             count_if(action = 'skip')::BIGINT AS files_skipped_unchanged, count_if(action = 'delete')::BIGINT AS files_deleted
      FROM diff""",
    "store_sync": _with(CHUNKS, EARLIER, _CHANGED)
    + """SELECT d.file_path AS doc_id, 'all' AS namespace, d.file_path, d.commit_sha,
             CASE WHEN d.action = 'skip' THEN 'old' ELSE c.text END AS text
      FROM diff d JOIN chunks c USING (file_path)""",
    "state_scroll": """SELECT conv_id::VARCHAR AS file_path, arg_min(sha256(text), conv_id || '-' || turn) AS commit_sha
      FROM conversations GROUP BY conv_id""",
    "point_ids": _with(CHUNKS)
    + f"""SELECT doc_id, {_UUID} AS point_id FROM (
        SELECT doc_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(
          namespace || '|' || file_path || '|' || symbol || '|' || start_line || '-' || end_line)) AS h FROM chunks)""",
    "cache_keys": """SELECT doc_id::VARCHAR AS doc_id, 'embed:bge-base-en-v1.5:' || sha256(text) AS cache_key FROM documents""",
    "mock_embeddings": f"""SELECT doc_id, {_mock_vector("h", 20)} AS embedding
      FROM (SELECT doc_id::VARCHAR AS doc_id, sha256(text) AS h FROM documents)""",
    "cache_fill": f"""SELECT 'embed:bge-base-en-v1.5:' || h AS cache_key, {_mock_vector("h", 8)} AS vector
      FROM (SELECT DISTINCT sha256(text) AS h FROM documents)
      WHERE h NOT IN (SELECT sha256(d.text) FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)""",
    "cache_lookup": """WITH texts AS (SELECT doc_id, CASE WHEN source <> 'src3' THEN text END AS text FROM documents),
      known AS (SELECT text, bool_or(doc_id % 2 = 0) AS again FROM texts JOIN embeddings ON vec_id = doc_id WHERE text IS NOT NULL GROUP BY text)
      SELECT t.doc_id::VARCHAR AS doc_id, CASE WHEN t.text IS NULL THEN NULL WHEN k.again THEN [2.0::DOUBLE] WHEN k.text IS NOT NULL THEN [1.0::DOUBLE]
             ELSE [length(t.text)::DOUBLE, 0.5::DOUBLE] END AS embedding
      FROM texts t LEFT JOIN known k ON k.text = t.text""",
    "clean_role_markup": f"SELECT doc_id::VARCHAR AS doc_id, {_marked_roles()} AS text FROM documents",
    "md_chunks": _sections(MD_HEADINGS, ".md", MD_STYLES),
    "rst_chunks": _sections(RST_HEADINGS, ".rst", RST_STYLES),
    "whole_file_chunks": _with(_headed(".txt", []))
    + """SELECT path, stem AS symbol, stem AS heading_path, 1 AS level, 1 AS start_line,
             greatest(1, len(lines))::INT AS end_line, source AS text FROM split""",
    "mixed_file_chunks": " UNION ALL ".join(
        [
            _of_kind(_sections(MD_HEADINGS, ".md", MD_STYLES), 0),
            _of_kind(_sections(RST_HEADINGS, ".rst", RST_STYLES), 1),
            _of_kind(_with(_headed(".txt", [])) + _WHOLE_FILES, 2),
            """SELECT doc_id || '.py', 'code', 'python', doc_id::VARCHAR, NULL, NULL, 1, (len(text) - len(replace(text, chr(10), '')) + 1)::INT,
                     '# ' || replace(text, chr(10), chr(10) || '# ')
              FROM documents WHERE doc_id % 4 = 3""",
        ]
    ),
    "py_ast_chunks": """WITH turns AS (
        SELECT 'c/' || conv_id || '/' || turn || '.py' AS path, turn, conv_id, role, text,
               len(text) - len(replace(text, chr(10), '')) AS breaks,
               'def turn_' || turn || '():' || chr(10) || '    return ' || repeat('"', 3) || text || repeat('"', 3) AS body
        FROM conversations)
      SELECT path, 'turn_' || turn AS symbol, 4 AS start_line, (5 + breaks)::INT AS end_line, body AS text, 'python' AS language
      FROM turns WHERE role = 'user'
      UNION ALL
      SELECT path, 'Conv' || conv_id, (8 + breaks)::INT, (9 + breaks)::INT,
             'class Conv' || conv_id || ':' || chr(10) || '    turn = ' || turn, 'python' FROM turns WHERE role = 'user'
      UNION ALL
      SELECT path, turn::VARCHAR, 1, (1 + breaks)::INT, 'def (' || text, 'python' FROM turns WHERE role <> 'user'""",
    "glob_filter": r"""SELECT * FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) AS path FROM pages)
      WHERE path = 'en' OR path LIKE 'en/%' OR regexp_matches(path, '^[^/]*/7[^/]*$')
         OR path LIKE '%.html' OR regexp_matches(path, '^d[^/]/[0-4][^/]*$')""",
    "prompt_context": _with(*SEARCH, PROMPTS)
    + """SELECT q.query_id, c.context,
             CASE WHEN c.context IS NULL THEN 'Context: none was found.' ELSE 'Context:' || chr(10) || chr(10) || c.context END
             || chr(10) || chr(10) || 'Question: ' || q.question AS user_message
      FROM requests q LEFT JOIN contexts c USING (query_id)""",
    "namespace_summary": _with(*SEARCH, ANSWERS) + "SELECT * FROM answers",
    "mock_token_stream": f"SELECT conv_id, turn, {FRAGMENTS.format('text')} AS fragments FROM conversations",
    "answer_events": _with(*SEARCH, ANSWERS)
    + f""", asked AS (SELECT q.* FROM requests q),
      tokens AS (
        SELECT query_id, unnest(parts) AS data, generate_subscripts(parts, 1) AS seq
        FROM (SELECT a.query_id, {FRAGMENTS.format("a.answer")} AS parts
              FROM answers a JOIN asked q USING (query_id) WHERE length(q.question) <= 300))
      SELECT q.query_id, 0 AS seq, 'retrieved' AS event, coalesce(h.paths, '') AS data
      FROM asked q LEFT JOIN (SELECT query_id, string_agg(path, ' ' ORDER BY rank) AS paths
                              FROM hydrated WHERE rank < 10 GROUP BY query_id) h USING (query_id)
      UNION ALL SELECT query_id, seq::INT, 'token', data FROM tokens
      UNION ALL SELECT q.query_id, (1 + coalesce(t.n, 0))::INT, 'done', ''
      FROM asked q LEFT JOIN (SELECT query_id, count(*) AS n FROM tokens GROUP BY query_id) t USING (query_id)""",
    "event_parsing": """SELECT conv_id || '-' || turn AS stream_id, 0 AS seq, role AS event, text AS data FROM conversations
      UNION ALL SELECT conv_id || '-' || turn, 1, 'done', '' FROM conversations""",
    "token_costs": f"""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'doubao-seed-2.0-pro' ELSE role END AS model,
             round(CASE WHEN role = 'assistant' THEN length(text) / 1e6 * 3.2 ELSE 0 END, 9) AS input_cost,
             round(CASE WHEN role = 'assistant' THEN len({TOKENS.format("text")}) / 1e6 * 16 ELSE 0 END, 9) AS output_cost
      FROM conversations""",
    "holdout": f"""WITH numbered AS (
        SELECT doc_id::VARCHAR AS id, lang AS stratum, count(*) OVER (PARTITION BY lang) AS n,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id::VARCHAR) - 1 AS position
        FROM documents WHERE n_chars <= 5000),
      picks AS (SELECT q.stratum, q.quota, unnest(range(q.quota)) AS i
                FROM (VALUES {", ".join(f"('{s}', {q})" for s, q in QUOTAS.items())}) q(stratum, quota))
      SELECT n.id, n.stratum FROM numbered n JOIN picks p USING (stratum)
      WHERE n.position = floor(p.i * (n.n / p.quota) + n.n / p.quota / 2)""",
    "holdout_rest": f"""WITH numbered AS (
        SELECT doc_id::VARCHAR AS id, lang AS stratum, count(*) OVER (PARTITION BY lang) AS n,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id::VARCHAR) - 1 AS position
        FROM documents),
      picks AS (SELECT q.stratum, q.quota, unnest(range(q.quota)) AS i
                FROM (VALUES {", ".join(f"('{s}', {q})" for s, q in QUOTAS.items())}) q(stratum, quota)),
      held AS (SELECT n.id FROM numbered n JOIN picks p USING (stratum)
               WHERE n.position = floor(p.i * (n.n / p.quota) + n.n / p.quota / 2))
      SELECT id, CASE WHEN id IN (SELECT id FROM held) THEN 'holdout' ELSE 'train' END AS part FROM numbered""",
    "answerable_requests": """SELECT query_id, question FROM (
        SELECT conv_id || '-' || turn AS query_id, role, CASE WHEN conv_id % 3 = 0 THEN regexp_replace(text, '\\S', '', 'g') ELSE text END AS question
        FROM conversations)
      WHERE role <> 'system' AND regexp_matches(question, '\\S')""",
    "cross_namespace_same_ids": _with(*LEXICAL)
    + """SELECT query_id, namespace, doc_id, round(score, 6) AS score, place::INT AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, doc_id) - 1 AS place
        FROM (SELECT query_id, namespace, doc_id, rank, 1::DOUBLE / (61 + rank) + 1::DOUBLE / (61 + rank) AS score
              FROM bm25_hits WHERE rank < 5))
      WHERE place < 8""",
    "golden_namespace_list": _with(REQUESTS) + "SELECT DISTINCT unnest(namespaces) AS namespace FROM requests",
    "sync_unreadable": _with(CHUNKS, EARLIER)
    + """SELECT coalesce(c.file_path, e.file_path) AS file_path, coalesce(c.commit_sha, e.commit_sha) AS commit_sha,
             CASE WHEN c.file_path IS NULL THEN 'delete' WHEN c.commit_sha IS NULL THEN 'error'
                  WHEN e.file_path IS NULL THEN 'add'
                  WHEN e.commit_sha IS NULL OR c.commit_sha <> e.commit_sha THEN 'update' ELSE 'skip' END AS action
      FROM (SELECT file_path, CASE WHEN heading_path <> 'src1' THEN commit_sha END AS commit_sha FROM chunks) c
      FULL JOIN (SELECT file_path, CASE WHEN file_path NOT LIKE 'src2/%' THEN commit_sha END AS commit_sha FROM earlier) e
        ON c.file_path = e.file_path""",
    "clean_all_roles": """SELECT doc_id::VARCHAR AS doc_id, regexp_matches(split_part(text, chr(10), 1), '(^| )\\p{L}+( |$)') AS marked,
             split_part(text, chr(10), 1) AS text FROM documents""",
    "clean_role_words": f"""SELECT doc_id::VARCHAR AS doc_id, text,
             (len(list_filter(string_split_regex(text, '[ \\n]'), lambda w: regexp_full_match(w, '\\p{{L}}+')))
              * (CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 3 END + length({list(ROLES)}[(doc_id % {len(ROLES)} + 1)::INT])
                 + CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 15 ELSE 1 END))::INT AS added
      FROM documents""",
    "hard_negative_chunks": _with(*SEARCH, RELEVANT, NEGATIVES) + "SELECT * FROM negatives",
    "contrastive_triples": _with(*SEARCH, RELEVANT, NEGATIVES)
    + """SELECT q.query_id, q.question AS query, trim(c.text, ' ' || chr(9) || chr(10) || chr(13)) AS positive, n.text AS hard_negative
      FROM requests q JOIN relevant r USING (query_id)
      JOIN chunks c ON c.namespace = r.namespace AND c.file_path = r.path AND c.symbol = r.symbol
      JOIN negatives n USING (query_id)""",
}
