"""Diff, chunk and token queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import LANGUAGES, approx_tokens, hash32, identifier_tokens, language_of, normalize
from siltstone.operators import chunks, diffs, reports, retrieval
from siltstone.plans.graphs import _LINES
from siltstone.sources.tables import table


def diff_line_numbers(spark, d):
    return diffs.patch_lines(table(spark, d, "changed_files"), "change_id").drop("text")


def diff_commentable(spark, d):
    return diffs.commentable_lines(diffs.patch_lines(table(spark, d, "changed_files"), "change_id"), "change_id")


def diff_annotated(spark, d):
    return diffs.annotate_patch(diffs.patch_lines(table(spark, d, "changed_files"), "change_id"), "change_id")


def diff_file_status(spark, d):
    """Git diffs made of the changed files, split again."""
    f = table(spark, d, "changed_files").where("path is not null and length(patch) > 0")
    s = F.lower(F.trim(F.coalesce("status", F.lit("modified"))))
    old = F.when(s == "added", "/dev/null").otherwise(F.concat(F.lit("a/"), F.coalesce("old_path", "path")))
    new = F.when(s == "removed", "/dev/null").otherwise(F.concat(F.lit("b/"), F.col("path")))
    text = F.concat(F.lit("diff --git a/"), F.coalesce("old_path", "path"), F.lit(" b/"), F.col("path"), F.lit("\n--- "), old, F.lit("\n+++ "), new, F.lit("\n"), F.col("patch"))
    return diffs.split_git_diff(f.select("change_id", text.alias("diff")), "change_id").drop("patch", "file_no")


def window_chunk_rows(spark, d):
    return chunks.window_chunks(table(spark, d, "documents").where("lang <> 'markdown'"), "doc_id").select("doc_id", "start_line", "end_line", F.length("text").alias("n_chars"))


def heading_chunk_rows(spark, d):
    return chunks.heading_chunks(table(spark, d, "documents").where("lang = 'markdown'"), "doc_id")


def chunk_files_rows(spark, d):
    return chunks.chunk_files(table(spark, d, "documents"), "doc_id")


def snippet_rebuild(spark, d):
    c = table(spark, d, "chunks").where("start_line is not null and text is not null")
    return chunks.rebuild_snippet(c, ["repo", "commit_sha", "path"], 5, 30)


def identifier_token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(identifier_tokens(F.coalesce("text", F.lit("")))).alias("n_tokens"))


def term_frequency(spark, d):
    t = retrieval.term_frequency(table(spark, d, "documents"), "doc_id")
    return t.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("n").alias("tokens"), F.max("n").alias("most"))


def document_frequency_idf(spark, d):
    docs = table(spark, d, "documents")
    idf = retrieval.inverse_frequency(retrieval.term_frequency(docs, "doc_id"), "doc_id", docs.count())
    return idf.select("token", "df", F.round("idf", 6).alias("idf"))


def hash_embedding_sparse(spark, d):
    v = retrieval.sparse_vectors(retrieval.term_frequency(table(spark, d, "findings"), "id", "title"), "id", hash32)
    return v.select("id", "term_id", F.round("weight", 6).alias("weight"))


def hash_embedding_dense(spark, d):
    v = retrieval.dense_vectors(retrieval.term_frequency(table(spark, d, "findings"), "id", "title"), "id", hash_of=hash32)
    return v.select("id", "dim", F.round("value", 6).alias("value"))


def hash_embedding_crc(spark, d):
    return retrieval.dense_vectors(retrieval.term_frequency(table(spark, d, "findings"), "id", "title"), "id")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))


def dense_topk(spark, d):
    v = _vectors(spark, d)
    return retrieval.dense_search(v.where("item % 100 = 0").select(F.col("item").alias("query"), "vector"), v, 10, 5).drop("score")


def _sparse(spark, d, k):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item"), "text")
    terms = retrieval.term_frequency(docs, "item")
    weights = terms.select("item", "token", (1 + F.log("n")).alias("weight"))
    queries = weights.where("item % 100 = 0").select(F.col("item").alias("query"), "token", "weight")
    return retrieval.sparse_search(queries, weights, retrieval.inverse_frequency(terms, "item", docs.count()), k, 5)


def sparse_topk(spark, d):
    return _sparse(spark, d, 10).drop("score")


def rrf_hybrid(spark, d):
    """Two rankings of findings per repository, fused: by confidence and by recency."""
    f = table(spark, d, "findings").select(F.col("repo").alias("query"), F.col("id").alias("item"), "confidence", "reported_at")
    by_conf = retrieval.best(f.withColumn("score", F.coalesce("confidence", F.lit(-1.0))), "query", "item", 20)
    by_time = retrieval.best(f.withColumn("score", F.unix_micros("reported_at")), "query", "item", 20)
    return retrieval.fuse([by_conf, by_time], 5)


def budget_break(spark, d):
    """Chunks of a file that fit a budget of characters, up to the first that doesn't."""
    c = table(spark, d, "chunks").where("text is not null").withColumn("n", F.length("text"))
    return c.selectExpr("chunk_id", "repo", "path", "commit_sha", "sum(n) over (partition by repo, path, commit_sha order by start_line, chunk_id rows unbounded preceding) as used").where("used <= 6000").select("chunk_id", "used")


def budget_skip(spark, d):
    """As budget_break, but a chunk that doesn't fit is left out and smaller ones after it may follow."""
    c = table(spark, d, "chunks").where("text is not null").selectExpr(
        "repo", "path", "commit_sha", "chunk_id", "length(text) as n", "row_number() over (partition by repo, path, commit_sha order by start_line, chunk_id) as pos"
    )
    return reports.fitting_blocks(c, 6000, ["repo", "path", "commit_sha"], skip=True).where("fits").select("chunk_id")


def path_language(spark, d):
    return table(spark, d, "documents").select("doc_id", language_of(F.col("path")).alias("lang_of_path"), approx_tokens(F.col("text")).alias("tokens"))


def text_normalize(spark, d):
    return table(spark, d, "findings").select("id", normalize(F.col("title")).alias("plain"))


_SPLIT = r"string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
_DOC_LINES = f"WITH s AS (SELECT doc_id, lang, {_SPLIT} AS s FROM documents WHERE length(text) > 0), l AS (SELECT doc_id, lang, CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END AS l FROM s)"
_TOK = r"""
idents AS (SELECT {key} AS key, unnest(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM {table} WHERE {text} IS NOT NULL),
parts AS (SELECT key, w, regexp_extract_all(w, '[A-Za-z][a-z0-9]*|[0-9]+') AS p FROM idents),
toks AS (SELECT key, lower(w) AS token FROM parts UNION ALL SELECT key, lower(unnest(p)) FROM parts WHERE len(p) > 1),
tf AS (SELECT key, token, count(*) AS n FROM toks GROUP BY 1, 2)"""
_DOC_TOK = _TOK.format(key="doc_id", text="text", table="documents")
_TITLE_TOK = _TOK.format(key="id", text="title", table="findings")
_H32 = "('0x' || left(md5(token), 8))::BIGINT"

QUERIES = {
    "diff_line_numbers": diff_line_numbers, "diff_commentable": diff_commentable, "diff_annotated": diff_annotated, "diff_file_status": diff_file_status, "window_chunks": window_chunk_rows,
    "heading_chunks": heading_chunk_rows, "chunk_files": chunk_files_rows, "snippet_rebuild": snippet_rebuild, "identifier_tokens": identifier_token_counts, "term_frequency": term_frequency,
    "document_frequency_idf": document_frequency_idf, "hash_embedding_sparse": hash_embedding_sparse, "hash_embedding_dense": hash_embedding_dense, "hash_embedding_crc": hash_embedding_crc,
    "dense_topk": dense_topk, "sparse_topk": sparse_topk, "rrf_hybrid": rrf_hybrid, "budget_break": budget_break, "budget_skip": budget_skip, "path_language": path_language, "text_normalize": text_normalize,
}
ORACLES = {
    "diff_line_numbers": f"WITH {_LINES} SELECT change_id, pos, hunk, kind, new_line FROM dl",
    "diff_commentable": f"WITH {_LINES} SELECT change_id, coalesce(list_sort(list(DISTINCT new_line::INT) FILTER (kind = '+')), []) AS added_lines, list_sort(list(DISTINCT new_line::INT)) AS commentable_lines FROM dl WHERE new_line IS NOT NULL GROUP BY change_id",
    "diff_annotated": f"WITH {_LINES} SELECT change_id, string_agg(lpad(coalesce(CAST(new_line AS VARCHAR), ''), 5, ' ') || ' ' || kind || text, chr(10) ORDER BY pos) AS annotated FROM dl GROUP BY change_id",
    "diff_file_status": """WITH f AS (SELECT *, lower(trim(coalesce(status, 'modified'))) AS s FROM changed_files WHERE path IS NOT NULL AND length(patch) > 0)
SELECT change_id, CASE WHEN s = 'removed' THEN coalesce(old_path, path) ELSE path END AS path,
  CASE WHEN s NOT IN ('removed', 'added') AND old_path <> path THEN old_path END AS old_path,
  CASE WHEN s IN ('removed', 'added') THEN s WHEN coalesce(old_path, path) <> path THEN 'renamed' ELSE 'modified' END AS status,
  len(list_filter(string_split(regexp_replace(patch, '\\n$', ''), chr(10)), lambda x: starts_with(x, '+'))) AS additions,
  len(list_filter(string_split(regexp_replace(patch, '\\n$', ''), chr(10)), lambda x: starts_with(x, '-'))) AS deletions FROM f""".replace("\\\\", "\\"),
    "window_chunks": _DOC_LINES + """, w AS (SELECT doc_id, l, unnest(CASE WHEN len(l) <= 80 THEN [1] ELSE list_transform(range(0, CAST(ceil((len(l) - 80) / 70.0) AS BIGINT) + 1), lambda k: 1 + k * 70) END) AS start_line FROM l WHERE lang <> 'markdown'),
c AS (SELECT doc_id, start_line, least(start_line + 79, len(l)) AS end_line, array_to_string(l[start_line:least(start_line + 79, len(l))], chr(10)) AS t FROM w)
SELECT doc_id, start_line, end_line, length(t) AS n_chars FROM c WHERE regexp_matches(t, '\\S')""".replace("\\\\", "\\"),
    "heading_chunks": _DOC_LINES + """, x AS (SELECT doc_id, len(l) AS n, l, unnest(range(1, len(l) + 1)) AS i FROM l WHERE lang = 'markdown'),
h AS (SELECT doc_id, n, i, l[i] AS line FROM x WHERE i = 1 OR regexp_matches(l[i], '^#{1,4} ')),
sec AS (SELECT doc_id, i AS first, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - 1, n) AS last, CASE WHEN regexp_matches(line, '^#{1,4} ') THEN trim(regexp_replace(line, '^#{1,4} ', '')) END AS symbol FROM h),
w AS (SELECT *, unnest(CASE WHEN last - first + 1 <= 60 THEN [first] ELSE list_transform(range(0, CAST(ceil((last - first + 1 - 60) / 55.0) AS BIGINT) + 1), lambda k: first + k * 55) END) AS start_line FROM sec)
SELECT doc_id, start_line, least(start_line + 59, last) AS end_line, symbol FROM w""",
    "snippet_rebuild": """WITH c AS (SELECT * FROM chunks WHERE start_line IS NOT NULL AND text IS NOT NULL AND start_line <= 30 AND coalesce(end_line, 1073741824) >= 5),
x AS (SELECT repo, commit_sha, path, start_line, chunk_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS s FROM c)),
y AS (SELECT repo, commit_sha, path, start_line + i - 1 AS line_no, s[i] AS line, row_number() OVER (PARTITION BY repo, commit_sha, path, start_line + i - 1 ORDER BY start_line, chunk_id) AS rn FROM x)
SELECT repo, commit_sha, path, line_no, line FROM y WHERE rn = 1 AND line_no BETWEEN 5 AND 30""",
    "identifier_tokens": f"WITH {_DOC_TOK} SELECT d.doc_id, count(t.token) AS n_tokens FROM documents d LEFT JOIN toks t ON t.key = d.doc_id GROUP BY 1",
    "term_frequency": f"WITH {_DOC_TOK} SELECT key AS doc_id, count(*) AS terms, sum(n)::BIGINT AS tokens, max(n) AS most FROM tf GROUP BY 1",
    "document_frequency_idf": f"WITH {_DOC_TOK} SELECT token, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM tf GROUP BY 1",
    "hash_embedding_sparse": f"WITH {_TITLE_TOK} SELECT key AS id, {_H32} & 2147483647 AS term_id, round(sum(1 + ln(n)), 6) AS weight FROM tf GROUP BY 1, 2",
    "hash_embedding_dense": f"""WITH {_TITLE_TOK}, h AS (SELECT key AS id, ({_H32} % 384)::INT AS dim, CASE WHEN ({_H32} >> 16) & 1 = 1 THEN -1.0 ELSE 1.0 END * (1 + ln(n)) AS w FROM tf),
v AS (SELECT id, dim, sum(w) AS value FROM h GROUP BY 1, 2 HAVING sum(w) <> 0), z AS (SELECT id, sqrt(sum(value * value)) AS norm FROM v GROUP BY 1)
SELECT id, dim, round(value / norm, 6) AS value FROM v JOIN z USING (id)""",
    "dense_topk": """WITH p AS (SELECT q.vec_id AS query, i.vec_id AS item, round(list_cosine_similarity(i.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score
  FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0)
SELECT query, item, rank FROM (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM p) WHERE rank <= 10""",
    "sparse_topk": "WITH " + _TOK.format(key="doc_id", text="text", table="documents") + """,
i AS (SELECT token, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY 1),
w AS (SELECT key, token, 1 + ln(n) AS weight FROM tf),
p AS (SELECT q.key AS query, d.key AS item, round(sum(q.weight * d.weight * i.idf), 5) AS score FROM w q JOIN w d USING (token) JOIN i USING (token) WHERE q.key % 100 = 0 GROUP BY 1, 2)
SELECT query, item, rank FROM (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM p) WHERE rank <= 10""",
    "rrf_hybrid": """WITH a AS (SELECT repo AS query, id AS item, row_number() OVER (PARTITION BY repo ORDER BY coalesce(confidence, -1) DESC, id) AS r1, row_number() OVER (PARTITION BY repo ORDER BY reported_at DESC, id) AS r2 FROM findings),
u AS (SELECT query, item, r1 AS r FROM a WHERE r1 <= 20 UNION ALL SELECT query, item, r2 FROM a WHERE r2 <= 20),
s AS (SELECT query, item, round(sum(1.0 / (2 + r - 1)), 9) AS score FROM u GROUP BY 1, 2)
SELECT query, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= 5""",
    "budget_break": "SELECT chunk_id, used::BIGINT AS used FROM (SELECT chunk_id, sum(length(text)) OVER (PARTITION BY repo, path, commit_sha ORDER BY start_line NULLS FIRST, chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM chunks WHERE text IS NOT NULL) WHERE used <= 6000",
    "budget_skip": """WITH g AS (SELECT list({'id': chunk_id, 'n': length(text)} ORDER BY start_line NULLS FIRST, chunk_id) AS r FROM chunks WHERE text IS NOT NULL GROUP BY repo, path, commit_sha),
f AS (SELECT list_reduce(list_prepend({'id': NULL::BIGINT, 'n': 0::BIGINT, 'ids': []::BIGINT[]}, list_transform(r, lambda x: {'id': x.id, 'n': x.n, 'ids': []::BIGINT[]})),
  lambda a, x: CASE WHEN a.n + x.n <= 6000 THEN {'id': NULL::BIGINT, 'n': a.n + x.n, 'ids': list_append(a.ids, x.id)} ELSE a END) AS s FROM g)
SELECT unnest(s.ids) AS chunk_id FROM f""",
    "path_language": "WITH m(s, l) AS (VALUES " + ", ".join(f"('{s}', '{l}')" for s, l in LANGUAGES.items()) + r""") SELECT doc_id, l AS lang_of_path, floor(length(text) / 4)::BIGINT AS tokens
FROM documents LEFT JOIN m ON m.s = lower(regexp_extract(path, '\.([^./]+)$', 1))""",
    "text_normalize": "SELECT id, regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g') AS plain FROM findings",
}
