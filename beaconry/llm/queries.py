"""Registered queries of this package: name -> (plan over (spark, sf_dir), checking SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beaconry.llm import (
    binarycodes, blockrank, chunkdedup, configpack, exactdedup, langid, linkgraph, mixing, nbest, paritysketch, tokens,
    toxicity, whitening,
)

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = (plan, sql)
        return plan

    return register


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.judged(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return chunkdedup.repeated_passages(docs).drop("row_key")


@query("op3_token_blocks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokens.tokens_round_trip(docs, _tokenizer("word_bpe_49k.json"), end_id=2, vocabulary=49_408)


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         length(text) AS chars FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((CAST(('0x' || substring(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE + 0.5)
        / 4503599627370496.0)
    / greatest(greatest(0.1::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE + abs(coalesce(chars::DOUBLE / greatest(size, 1), 0.0::DOUBLE) - 7.0::DOUBLE)
        / 7.0::DOUBLE)), 0.01::DOUBLE) AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS n FROM s),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM n),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, n ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN level >= cap / weight THEN cap ELSE weight * (
        SELECT arg_min(b.level, b.cap / b.weight) FROM l b WHERE b.level < b.cap / b.weight) END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
        CAST(round(e.target) AS BIGINT) - e.epochs * e.source_size
        - (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size) AS left_over
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, left_over)) AS BIGINT) AS taken FROM r
"""


@query("op5_source_mix", _MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return langid.predict(docs, langid.learn(docs))


@query("op7_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exactdedup.exact_duplicates(docs).drop("row_key")


_REACHABLE = """
reach AS (
  SELECT a AS node, a AS seen FROM links UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
lowest AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
"""


@query("op8_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [list_aggregate(words, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i+4], 'string_agg', ' '))) END AS grams
  FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
""" + _REACHABLE + """
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, coalesce(least(component_id, s.doc_id), s.doc_id) AS component_id
FROM s LEFT JOIN lowest ON lowest.node = s.doc_id
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return paritysketch.jaccard_components(docs).drop("row_key")


@query("op9_binary_codes", """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
""" + _REACHABLE + """,
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT m.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links,
       coalesce(least(component_id, m.vec_id), m.vec_id) AS component_id,
       coalesce(least(component_id, m.vec_id), m.vec_id) = m.vec_id AS kept
FROM embeddings m LEFT JOIN n ON n.a = m.vec_id LEFT JOIN lowest ON lowest.node = m.vec_id
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binarycodes.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("row_key")


@query("op10_pieces")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return nbest.segment(docs, _tokenizer("piece_bpe_32k.model"), with_ids=False)


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_block_rank", f"""
WITH d AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM d),
c AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf, CAST(any_value(n) AS BIGINT) AS n FROM p GROUP BY 1, 2),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS every FROM d WHERE len(t) > 0),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * (SELECT docs FROM g) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM c GROUP BY 1),
q AS (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // every)))) AS BIGINT) AS score
      FROM q JOIN c USING (term) JOIN f USING (term), g GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockrank.rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op12_config_pack")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configpack.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("word_bpe_49k.json"), end_id=1)


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
