"""Language identification, words first and character n-grams for the rest.

Words are lower-cased runs of letters. A known word scores by its log frequency in each language. An unseen word falls back to the longest
n (4, 3, 2, 1) of which any n-gram of ``^word$`` is known, and scores by the mean over those.
A document's score per language is the sum over its words; the prediction is the largest.

Learning reads a bounded sample: at most about DOCS_PER_LANG documents of each language, drawn by a hash
of the id (all documents of a language that has fewer). The model keeps the most frequent WORDS_PER_LANG words
and GRAMS_PER_LANG n-grams of each length and language, so it is small enough to send to every task.

Defined cases: null text, or text without a letter: ``und`` with score 0; no learnable row at all: ``und``
for every document; equal scores go to the first language by code point; a language whose value is null is
not learned. Very long texts are read whole, word by word. Repeated rows are predicted alike.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.common import coded_words, held_out, sums_by_row, text_parts

DOCS_PER_LANG = 10_000
WORDS_PER_LANG = 20_000
GRAMS_PER_LANG = 10_000
MAX_LANGS = 500
LONGEST = 4
_MEMO_WORDS = 200_000
_FLUSH = 200_000
_BETWEEN_WORDS = r"[^\p{L}\p{M}]+"


def words_of(texts: pa.Array) -> pa.ListArray:
    """Lower-cased runs of letters of each text."""
    return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), pattern=_BETWEEN_WORDS, replacement=" "))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def flush():
        langs, words, n = [], [], []
        for lang, c in counts.items():
            c.pop("", None)
            langs += [lang] * len(c)
            words += c.keys()
            n += c.values()
        counts.clear()
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())],
                               names=["lang", "word", "n"])

    for batch in batches:
        for start, part in text_parts(batch.column(1)):
            lang = batch.column(0).slice(start, len(part)).dictionary_encode()
            distinct, at, offsets = coded_words(words_of(part))
            of_word = np.repeat(lang.indices.to_numpy(), np.diff(offsets))
            pairs, n = np.unique(of_word.astype(np.int64) * max(len(distinct), 1) + at, return_counts=True)
            names = lang.dictionary.to_pylist()
            for pair, k in zip(pairs.tolist(), n.tolist()):
                i, w = divmod(pair, max(len(distinct), 1))
                counts.setdefault(names[i], Counter())[distinct[w]] += k
            if sum(map(len, counts.values())) > _FLUSH:
                yield flush()
    yield flush()


def _most_frequent(counts: DataFrame, keys: list[str], item: str, keep: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), item)
    return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def learn(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> dict:
    """The model, from rows with a non-null lang that are not held out."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(
        F.desc("count"), "lang").limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return {"langs": [], "words": {}, "grams": [{} for _ in range(LONGEST)]}
    langs = sorted(sizes)
    shares = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, docs_per_lang / sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < shares[F.col("lang")]).select("lang", "text")
    words = sample.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    # a word has at least one letter, so the marked word has at least three characters
    grams = words.select("lang", "n", F.explode(F.flatten(F.array(*[
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - size + 1, F.lit(1))),
                    lambda i, size=size: F.substring(marked, i, F.lit(size)))
        for size in range(1, LONGEST + 1)]))).alias("gram"))
    grams = grams.withColumn("size", F.length("gram")).groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    known = _most_frequent(words, ["lang"], "word", WORDS_PER_LANG).collect()
    parts = _most_frequent(grams, ["lang", "size"], "gram", GRAMS_PER_LANG).collect()
    at = {lang: i for i, lang in enumerate(langs)}

    def logs(rows_):
        totals, table = np.zeros(len(langs)), {}
        for item, lang, n in rows_:
            table.setdefault(item, np.zeros(len(langs)))[at[lang]] += n
            totals[at[lang]] += n
        low = totals + 0.5 * max(1, len(table))
        return {item: np.log((v + 0.5) / low).astype(np.float32) for item, v in table.items()}

    return {"langs": langs, "words": logs((r["word"], r["lang"], r["n"]) for r in known),
            "grams": [logs((r["gram"], r["lang"], r["n"]) for r in parts if r["size"] == k)
                      for k in range(1, LONGEST + 1)]}


class Scorer:
    """Scores texts; remembers a bounded number of words."""

    def __init__(self, model: dict) -> None:
        self.langs, self.known, self.grams = model["langs"], model["words"], model["grams"]
        self.nothing = np.zeros(len(self.langs), np.float32)
        self.memo: dict[str, np.ndarray] = {}

    def backoff(self, word: str) -> np.ndarray:
        marked = f"^{word}$"
        for size in range(LONGEST, 0, -1):
            known = self.grams[size - 1].get
            found = [v for v in map(known, [marked[i: i + size] for i in range(len(marked) - size + 1)]) if v is not None]
            if found:
                return sum(found[1:], found[0]) / np.float32(len(found))
        return self.nothing

    def word_vector(self, word: str) -> np.ndarray:
        if not word:
            return self.nothing
        known = self.known.get(word)
        return self.backoff(word) if known is None else known

    def predict(self, texts: pa.Array) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for _, part in text_parts(texts):
            distinct, at, offsets = coded_words(words_of(part))
            if len(self.memo) > _MEMO_WORDS:
                self.memo.clear()
            known = list(map(self.memo.get, distinct))
            for i, v in enumerate(known):
                if v is None:
                    known[i] = self.memo[distinct[i]] = self.word_vector(distinct[i])
            table = np.array(known, np.float32).reshape(len(distinct), len(self.langs))
            letters = np.fromiter((any(map(str.isalpha, w)) for w in distinct), bool, len(distinct))
            some = sums_by_row(letters[at], offsets)
            totals = sums_by_row(table[at], offsets) if self.langs else np.zeros((len(part), 1))
            for total, letter in zip(totals, some):
                if not self.langs or not letter:
                    out.append(("und", 0.0))
                    continue
                best = int(np.argmax(total))
                out.append((self.langs[best], 1.0 / float(np.exp(np.clip(total - total[best], -700, 0)).sum())))
        return out


_scorers: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if key not in _scorers:  # one model at a time in a worker
                _scorers.clear()
                _scorers[key] = Scorer(shared.value)
            scorer = _scorers[key]
            found = scorer.predict(batch.column(2))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                 pa.array([min(1.0, max(0.0, f[1])) if math.isfinite(f[1]) else 0.0 for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(score, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
