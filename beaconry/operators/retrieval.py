"""Chunking, hashed embeddings, exact top-K search and cited answers over whole corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions.scalars import strip
from beaconry.functions.sequences import lookup
from beaconry.operators.search import search
from beaconry.settings import DEFAULTS

# Lengths of excerpt and answer, rule line between sources.
EXCERPT_CHARS, ANSWER_CHARS = 200, 600
CONTEXT_RULE = "\n\n---\n\n"
NOT_FOUND = "The knowledge base holds nothing on this question. Please ask the HR team."

#: Finished chunks of a text are gathered in lists of this length, so that a long text does not copy all of them at each chunk.
CHUNKS_PER_LIST = 256


def doc_id(path: Column) -> Column:
    return F.substring(F.md5(path.cast("binary")), 1, 12)


# --------------------------------------------------------------------------------- chunking


def chunk_array(text: Column, size: int = DEFAULTS.chunk_chars, overlap: int = DEFAULTS.chunk_overlap) -> Column:
    """Array of chunks: sentences are packed up to ``size`` characters; a chunk that is full
    hands its last ``overlap`` characters to the next. A sentence is never cut."""
    state = "struct<cur: string, done: array<string>, full: array<array<string>>>"
    clean = F.regexp_replace(strip(text), r"\n{3,}", "\n\n")
    sentences = F.split(clean, r"(?U)(?<=[.!?])\s+")

    def to(cur, done, full):
        return F.struct(cur.alias("cur"), done.alias("done"), full.alias("full")).cast(state)

    def pushed(acc, cur):
        """The state after a chunk is done: it goes to the open list, and a full list to the lists."""
        return (F.when(F.size(acc["done"]) < CHUNKS_PER_LIST - 1, to(cur, F.array_append(acc["done"], acc["cur"]), acc["full"]))
                .otherwise(to(cur, F.array().cast("array<string>"),
                              F.array_append(acc["full"], F.array_append(acc["done"], acc["cur"])))))

    def step(acc, sentence):
        cur = acc["cur"]
        packed = to(strip(F.concat(cur, F.lit(" "), sentence)), acc["done"], acc["full"])
        tail = strip(F.concat(strip(F.right(cur, F.lit(overlap))), F.lit(" "), sentence))
        return (F.when(F.length(cur) + F.length(sentence) + 1 <= size, packed)
                .when(cur != "", pushed(acc, tail)).otherwise(to(sentence, acc["done"], acc["full"])))

    def finish(acc):
        done = F.when(acc["cur"] != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"])
        return F.flatten(F.array_append(acc["full"], done))

    start = to(F.lit(""), F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    return F.aggregate(sentences, start, step, finish)


def chunks(docs: DataFrame, text: str = "text", **kwargs) -> DataFrame:
    """One row per chunk with the document's other columns and ``chunk_index``."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(chunk_array(F.col(text), **kwargs)).alias("chunk_index", "chunk_text"))


def ingest_report(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Chunk count and outcome per document."""
    n = F.coalesce(F.size(chunk_array(F.col(text))), F.lit(0))
    empty = F.coalesce(strip(F.col(text)) == "", F.lit(True))
    return docs.select(key, F.when(empty, 0).otherwise(n).alias("chunk_count"), empty.alias("_empty")).select(
        key, "chunk_count", (F.col("chunk_count") > 0).alias("success"),
        F.when(F.col("_empty"), "empty document").when(F.col("chunk_count") == 0, "no chunks produced")
        .otherwise("").alias("message"))


# -------------------------------------------------------------------------------- embedding


def hashed_buckets(text: Column) -> Column:
    """Sorted distinct buckets of the lower-cased words: md5 modulo 256, its last byte."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1)))
    return F.array_sort(F.array_distinct(F.transform(
        words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 31, 2), 16, 10).cast("int"))))


# ------------------------------------------------------------------------------ exact top-K


def search_text(
    questions: DataFrame, indexed: DataFrame, text: str = "question", ids: Sequence[str] = ("conv_id", "turn"),
    k: int = DEFAULTS.top_k, min_score: float = 0.0, scope: str | None = None,
) -> DataFrame:
    """Hits of every question over indexed chunks (doc_id, chunk_index, vector).

    Questions with the same words share one search; one question may be asked by many, so
    the join back relies on the skewed-join rule, which must be switched on. A question whose ``scope`` column is
    not null sees only chunks of that doc_type.
    """
    vectors = questions.withColumns({
        "vector": hashed_buckets(F.col(text)), "_scope": F.col(scope) if scope else F.lit(None).cast("string")})
    keyed = vectors.withColumn("query_key", F.concat_ws(",", F.col("vector").cast("array<string>"), "_scope"))
    distinct = keyed.groupBy("query_key").agg(F.first("vector").alias("vector"), F.first("_scope").alias("scope"))
    items = indexed.withColumn("scope", F.col("doc_type")) if scope else indexed.select("doc_id", "chunk_index", "vector")
    hits = search(distinct, items, k, min_score)
    packed = hits.groupBy("query_key").agg(F.sort_array(F.collect_list(  # at most k entries
        F.struct("place", "doc_id", "chunk_index", "score"))).alias("hits"))
    asked = keyed.drop("vector", "_scope")
    return lookup(asked, packed, ["query_key"]).drop("query_key")


def index(docs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Chunk table with hashed vectors; what ``sink_index`` persists."""
    return chunks(docs).select("doc_id", "chunk_index", *extra, "chunk_text", hashed_buckets(F.col("chunk_text")).alias("vector"))


def index_stats(indexed: DataFrame) -> DataFrame:
    per_doc = indexed.groupBy("doc_id").agg(F.count("*").alias("n"))
    return per_doc.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("documents"))


# ------------------------------------------------------------------------- answers and citations


def with_text(hits: DataFrame, indexed: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fetch chunk columns for hit rows. Only chunks that were hit are looked up, and a chunk hit
    by many questions is split by the skewed-join rule, which must be switched on."""
    wanted = hits.select("doc_id", "chunk_index").distinct()
    texts = indexed.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("chunk_index").cast("bigint").alias("chunk_index"), *columns).join(
        wanted, ["doc_id", "chunk_index"], "left_semi")
    return lookup(hits, texts, ["doc_id", "chunk_index"])


def citations(found: DataFrame, indexed: DataFrame, ids: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """One row per cited chunk and question: file, type, similarity and excerpt."""
    rows = found.select(*ids, F.inline("hits"))
    j = with_text(rows, indexed, ids, ["filename", "doc_type", "chunk_text"])
    long = F.length("chunk_text") > EXCERPT_CHARS
    return j.select(
        *ids, "place", "filename", "doc_type", "doc_id", "chunk_index", F.round("score", 3).alias("similarity"),
        F.when(long, F.concat(F.substring("chunk_text", 1, EXCERPT_CHARS), F.lit("…"))).otherwise(F.col("chunk_text")).alias("excerpt"),
    ).dropDuplicates([*ids, "filename", "chunk_index"])


def context(found: DataFrame, indexed: DataFrame, ids: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """Numbered sources of a question in one text; at most k chunks each."""
    rows = with_text(found.select(*ids, F.inline("hits")), indexed, ids, ["filename", "chunk_text"])
    part = F.concat(F.lit("[Source "), F.col("place").cast("string"), F.lit(": "), F.col("filename"), F.lit("]\n"), F.col("chunk_text"))
    return rows.groupBy(*ids).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("place", part.alias("t")))), lambda x: x["t"]), CONTEXT_RULE).alias("context"))


def answers(found: DataFrame, indexed: DataFrame, ids: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """Extractive answer per question: the start of the best chunk, or the fixed text."""
    best = found.withColumn("_h", F.try_element_at("hits", F.lit(1)))
    flat = best.select(*[c for c in found.columns if c != "hits"], F.col("_h.doc_id").alias("doc_id"),
                       F.col("_h.chunk_index").alias("chunk_index"), F.coalesce("_h.score", F.lit(0.0)).alias("confidence"))
    j = with_text(flat, indexed, ids, ["filename", "chunk_text"])
    hit = F.col("doc_id").isNotNull()
    text = F.concat(F.lit("From "), F.col("filename"), F.lit(":\n\n"), F.substring("chunk_text", 1, ANSWER_CHARS),
                    F.format_string("\n\n(similarity %.2f; see the full document for details)", "confidence"))
    return j.withColumns({"found": hit, "answer": F.when(hit, text).otherwise(NOT_FOUND)}).drop("chunk_text")
