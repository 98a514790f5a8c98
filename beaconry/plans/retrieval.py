"""Chunking, embedding and search queries over the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.operators import retrieval as R
from beaconry.plans.oracle_views import add_view
from beaconry.plans.registry import query
from beaconry.session import stored
from beaconry.sources import bindings as B

_WS = r"chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_BUCKETS = r"list_distinct(list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: ('0x' || substr(md5(w), 31, 2))::INT))"


def corpus(t):
    """Documents with their file name and type; the type decides which intents may search them."""
    return t.spread("documents", "doc_id", "text", "source").select(
        "doc_id", "text", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.when(F.col("doc_id") % 5 == 0, "onboarding").otherwise("policy").alias("doc_type"))


def indexed(t):
    return stored(R.index(corpus(t), ["filename", "doc_type"]), "index")


add_view("corpus", """
    SELECT doc_id, text, source || '/' || doc_id || '.txt' AS filename,
           CASE WHEN doc_id % 5 = 0 THEN 'onboarding' ELSE 'policy' END AS doc_type FROM documents""")
add_view("chunk_lists", rf"""
    WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(trim(text, {_WS}), '\n{{3,}}', chr(10)||chr(10), 'g'),
                      '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
         f AS (SELECT doc_id, list_reduce(list_transform(parts, lambda p: {{'cur': p, 'done': []::VARCHAR[]}}), lambda a, x:
                 CASE WHEN length(a.cur) + length(x.cur) + 1 <= 800
                      THEN {{'cur': trim(a.cur || ' ' || x.cur, {_WS}), 'done': a.done}}
                      WHEN a.cur <> '' THEN {{'cur': trim(trim(right(a.cur, 150), {_WS}) || ' ' || x.cur, {_WS}),
                                              'done': list_append(a.done, a.cur)}}
                      ELSE {{'cur': x.cur, 'done': a.done}} END, {{'cur': '', 'done': []::VARCHAR[]}}) AS r FROM s)
    SELECT doc_id, CASE WHEN r.cur <> '' THEN list_append(r.done, r.cur) ELSE r.done END AS parts FROM f""")
add_view("chunk_rows", """
    SELECT doc_id, CAST(unnest(generate_series(1, len(parts))) - 1 AS INT) AS chunk_index, unnest(parts) AS chunk_text FROM chunk_lists""")
add_view("chunk_vectors", f"""
    SELECT c.doc_id, c.chunk_index, c.chunk_text, d.filename, d.doc_type, {_BUCKETS.format('chunk_text')} AS v
    FROM chunk_rows c JOIN corpus d USING (doc_id)""")
add_view("chunk_buckets", "SELECT doc_id, chunk_index, len(v) AS n, unnest(v) AS b FROM chunk_vectors")
add_view("question_vectors", f"SELECT conv_id, turn, question, {_BUCKETS.format('question')} AS v FROM questions")
add_view("question_hits", """
    WITH q AS (SELECT conv_id, turn, len(v) AS n, unnest(v) AS b FROM question_vectors),
         s AS (SELECT conv_id, turn, doc_id, chunk_index, COUNT(*) / sqrt(ANY_VALUE(q.n)::DOUBLE * ANY_VALUE(c.n)) AS score
               FROM q JOIN chunk_buckets c USING (b) GROUP BY 1, 2, 3, 4)
    SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, doc_id, chunk_index) AS INT) AS place
    FROM s QUALIFY place <= 5""")


@query("doc_id", "SELECT page_id, substr(md5(url), 1, 12) AS doc_id FROM pages")
def _doc_id(t):
    return t.pages.select("page_id", R.doc_id(F.col("url")).alias("doc_id"))


@query("chunk_sentences", "SELECT doc_id, chunk_index, chunk_text FROM chunk_rows")
def _chunks(t):
    return R.chunks(t.spread("documents", "doc_id", "text"))


@query("ingest_report", """
    WITH c AS (SELECT doc_id, COUNT(*) AS n FROM chunk_rows GROUP BY 1)
    SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS chunk_count, n IS NOT NULL AS success,
           CASE WHEN n IS NULL THEN 'empty document' ELSE '' END AS message FROM documents LEFT JOIN c USING (doc_id)""")
def _ingest(t):
    return R.ingest_report(t.spread("documents", "doc_id", "text"), "doc_id")


@query("embed_hash", f"""
    WITH v AS (SELECT doc_id, {_BUCKETS.format('text')} AS v FROM documents)
    SELECT doc_id, CAST(len(v) AS INT) AS n_buckets, CAST(coalesce(list_sum(v), 0) AS BIGINT) AS bucket_sum,
           array_to_string(list_sort(v), ',') AS buckets,
           round(CASE WHEN len(v) = 0 THEN 0 ELSE 1 / sqrt(len(v)::DOUBLE) END, 9) AS weight FROM v""")
def _embed(t):
    v = t.spread("documents", "doc_id", "text").select("doc_id", R.hashed_buckets(F.col("text")).alias("v"))
    total = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return v.select(
        "doc_id", F.size("v").alias("n_buckets"), total.alias("bucket_sum"), F.concat_ws(",", F.col("v").cast("array<string>")).alias("buckets"),
        F.round(F.coalesce(F.try_divide(F.lit(1.0), F.sqrt(F.size("v").cast("double"))), F.lit(0.0)), 9).alias("weight"))


def centroids(t):
    """One query vector per label: the mean of its vectors, computed per dimension."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(
        F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector"))


@query("vector_topk", """
    WITH d AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings),
         m AS (SELECT label, pos, AVG(x) AS x FROM d GROUP BY 1, 2),
         c AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY 1),
         s AS (SELECT c.label, e.vec_id, list_cosine_similarity(c.v, e.embedding::DOUBLE[]) AS score FROM c, embeddings e)
    SELECT label, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INT) AS place
    FROM s QUALIFY place <= 5""")
def _vector_topk(t):
    queries = centroids(t).select(F.col("label").cast("string").alias("query_key"), "vector")
    items = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    hits = R.search(queries, items, 5, -1.0, ("vec_id",), dense=True)
    return hits.select(F.col("query_key").cast("int").alias("label"), "vec_id", F.round("score", 6).alias("score"), "place")


def question_hits(t, min_score=0.0):
    return R.search_text(B.questions(t), indexed(t), min_score=min_score)


@query("bucket_topk", """
    SELECT conv_id, turn, place, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, round(score, 9) AS score FROM question_hits""")
def _bucket_topk(t):
    return question_hits(t, 1e-9).select("conv_id", "turn", F.inline("hits")).withColumn("score", F.round("score", 9))


@query("sim_threshold", """
    SELECT conv_id, turn, place, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, round(score, 9) AS score
    FROM question_hits WHERE score >= 0.25""")
def _threshold(t):
    return question_hits(t, 0.25).select("conv_id", "turn", F.inline("hits")).withColumn("score", F.round("score", 9))


_ANSWER_TEXT = """CASE WHEN h.doc_id IS NULL THEN 'The knowledge base holds nothing on this question. Please ask the HR team.'
    ELSE 'From ' || c.filename || ':' || chr(10) || chr(10) || substr(c.chunk_text, 1, 600) || chr(10) || chr(10)
         || printf('(similarity %.2f; see the full document for details)', h.score) END"""


@query("kb_answer", f"""
    SELECT q.conv_id, q.turn, h.doc_id IS NOT NULL AS found, round(coalesce(h.score, 0), 9) AS confidence, {_ANSWER_TEXT} AS answer
    FROM questions q LEFT JOIN question_hits h ON h.conv_id = q.conv_id AND h.turn = q.turn AND h.place = 1 AND h.score >= 0.25
    LEFT JOIN chunk_vectors c ON c.doc_id = h.doc_id AND c.chunk_index = h.chunk_index""")
def _answer(t):
    index = indexed(t)
    return R.answers(R.search_text(B.questions(t), index, min_score=0.25), index).select(
        "conv_id", "turn", "found", F.round("confidence", 9).alias("confidence"), "answer")


@query("citations", """
    SELECT h.conv_id, h.turn, h.place, c.filename, c.doc_type, h.doc_id, CAST(h.chunk_index AS BIGINT) AS chunk_index,
           round(h.score, 3) AS similarity, CASE WHEN length(chunk_text) > 200 THEN substr(chunk_text, 1, 200) || '…' ELSE chunk_text END AS excerpt
    FROM question_hits h JOIN chunk_vectors c ON c.doc_id = h.doc_id AND c.chunk_index = h.chunk_index WHERE h.score >= 0.25""")
def _citations(t):
    index = indexed(t)
    return R.citations(R.search_text(B.questions(t), index, min_score=0.25), index)


@query("context_pack", """
    SELECT h.conv_id, h.turn, string_agg('[Source ' || h.place || ': ' || c.filename || ']' || chr(10) || chunk_text,
                                        chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY h.place) AS context
    FROM question_hits h JOIN chunk_vectors c ON c.doc_id = h.doc_id AND c.chunk_index = h.chunk_index WHERE h.score >= 0.25 GROUP BY 1, 2""")
def _context(t):
    index = indexed(t)
    return R.context(R.search_text(B.questions(t), index, min_score=0.25), index)


@query("index_stats", "SELECT COUNT(*) AS chunks, COUNT(DISTINCT doc_id) AS documents FROM chunk_rows")
def _stats(t):
    return R.index_stats(R.chunks(t.spread("documents", "doc_id", "text")))
