"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, maps look-alike letters to Latin ones and digits or signs used as letters to those
letters (i, l and 1 become one class), keeps the letters and marks of all other scripts, and turns everything else into single
spaces. Characters of scripts written without spaces between words are marked one by one. Lexicon entries are
word beginnings, whole words, or one to four marked characters anywhere in a run, with weights; a hit inside an exception phrase does not count. The sum of
weights is divided by a power of the number of words, and set against a fitted threshold:
score = r / (r + threshold).

Learning reads a bounded sample of labelled rows (LABELLED_ROWS, drawn by a hash of the id), one copy of each
text. A beginning of 4 to 10 letters (from 2 syllables in Hangul), a whole word of any length or a run of marked characters enters the lexicon if its toxic documents are more than chance allows
given all candidates and it is almost never seen in clean ones; shorter beginnings come first and stand for
all that they begin, written as the longest beginning that is found as often. Of those, only terms stay that are the
best evidence of some documents or are found in a twentieth of the toxic ones. Words that begin alike but are found in clean documents become exceptions. The power of the
length and the threshold are chosen by error on the sample.

Defined cases: null or empty text scores 0; without toxic or without clean labels the lexicon is empty and all
scores are 0; rows with a null label are not learned from; long texts are matched whole. Terms and exceptions beyond
``max_terms`` and ``max_exceptions`` (those with the least evidence) are left out, and the model says how many.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import MEMO_CHARS, coded_words, free_name, held_out, sums_by_row, text_parts, worker_model
from beaconry.session import stored

LABELLED_ROWS = 50_000
MAX_TERMS = 20_000
MAX_EXCEPTIONS = 20_000
SHORTEST, LONGEST = 4, 10
SHORTEST_HANGUL = 2
LONGEST_RUN = 4
#: Put before every character of a script without spaces between words; str.split parts there.
MARK = "\x1f"
POWERS = (0.25, 0.5, 0.75, 1.0)
_BINS_PER_OCTAVE = 16
_FLUSH = 200_000
_MEMO_WORDS = 150_000

#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans(
    "авекмнорстухіѕјԁԛԝһӏαβεικνορτυχγωøłđ", "abekmhopctyxisjdqwhiabeikvoptuxywold") | str.maketrans(
    {"ß": "ss", "æ": "ae", "œ": "oe"})
#: Digits and signs written for letters.
_SUBSTITUTES = str.maketrans("013456789@$l", "oieasbtbgasi")
_BREAK = re.compile(r"[^a-z]+")
_BREAK_ANY = regex.compile(r"[^\p{L}\p{M}\x1f]+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+")
_ACCENTS = re.compile("[\u0300-\u036f]+")


def fold(text: str) -> str:
    """`` word word `` in folded letters, with a space at both ends."""
    text = text.lower()
    if text.isascii():
        return f" {_BREAK.sub(' ', text.translate(_SUBSTITUTES)).strip()} "
    text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text.replace(MARK, " ").translate(_LOOKALIKES))).lower()
    text = unicodedata.normalize("NFC", text).translate(_SUBSTITUTES)
    text = _UNSPACED.sub(lambda run: f" {MARK}{MARK.join(run[0])} ", text)
    return f" {_BREAK_ANY.sub(' ', text).strip(' ')} "


def fold_phrase(text: str) -> str:
    """An exception as it is looked for: whole words, or marked characters wherever they stand."""
    folded = fold(text)
    return folded.strip(" ") if MARK in folded else folded


def _units(token: str) -> Iterator[str]:
    """The folded words of a token, and for marked runs all stretches of one to LONGEST_RUN characters."""
    for word in fold(token).split(" "):
        if word.startswith(MARK):
            chars = word[1:].split(MARK)
            for size in range(1, LONGEST_RUN + 1):
                for i in range(len(chars) - size + 1):
                    yield MARK + MARK.join(chars[i: i + size])
        elif word:
            yield word


class Matcher:
    """Sum of weights of the lexicon hits in a text, and its number of words."""

    def __init__(self, terms: dict[str, float], exceptions: list[str]) -> None:
        self.auto = ahocorasick.Automaton()
        for term, weight in terms.items():
            self.auto.add_word(term, (len(term), weight))
        for phrase in exceptions:
            self.auto.add_word(phrase, (len(phrase), None))
        if len(self.auto):
            self.auto.make_automaton()
        self.memo: dict[str, tuple[int, bool]] = {}

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of hits that count: outside exceptions, one (the longest) for each word start."""
        found, safe = {}, []
        for end, (size, weight) in self.auto.iter(folded) if len(self.auto) else ():
            start = end + 1 - size
            if weight is None:
                safe.append((start, end + 1))
            elif start not in found or found[start][0] < end + 1:
                found[start] = (end + 1, weight)
        return [(s, e, w) for s, (e, w) in found.items() if not any(a <= s and e <= b for a, b in safe)]

    def measure(self, text: str | None) -> tuple[float, int]:
        """Sum of weights and number of words of one text."""
        folded = fold(text or "")
        return sum(w for _, _, w in self.hits(folded)), len(folded.split())

    def measure_all(self, texts: pa.Array) -> list[tuple[float, int]]:
        """The same for many texts: every distinct word is folded and matched once, and only texts with a hit are read whole.

        A lexicon entry lies within a word, so a text without a hit in any of its words has none; exceptions
        may span words, so they are left to the second look.
        """
        out: list[tuple[float, int]] = []
        for _, part in text_parts(texts):
            distinct, at, offsets = coded_words(pc.ascii_split_whitespace(part))
            if len(self.memo) > _MEMO_WORDS:
                self.memo.clear()
            known = list(map(self.memo.get, distinct))
            for i, v in enumerate(known):
                if v is None:
                    folded = fold(distinct[i])
                    known[i] = (len(folded.split()), any(weight is not None for _, (_, weight) in self.auto.iter(folded)) if len(
                        self.auto) else False)
                    if len(distinct[i]) <= MEMO_CHARS:
                        self.memo[distinct[i]] = known[i]
            table = np.array(known, np.float64).reshape(len(distinct), 2)
            sums = sums_by_row(table[at], offsets)
            for row, (n, hits) in enumerate(sums.tolist()):
                out.append((self.measure(part[row].as_py()) if hits else (0.0, int(n))))
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def flush():
        words = list({**toxic, **clean})
        out = pa.record_batch([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()),
                               pa.array([clean[w] for w in words], pa.int64())], names=["word", "toxic", "clean"])
        toxic.clear()
        clean.clear()
        return out

    for batch in batches:
        for start, part in text_parts(batch.column(0)):
            labels = batch.column(1).slice(start, len(part)).to_numpy(zero_copy_only=False).astype(bool)
            distinct, at, offsets = coded_words(pc.ascii_split_whitespace(part))
            folds = [list(_units(d)) for d in distinct]
            for a, b, bad in zip(offsets[:-1].tolist(), offsets[1:].tolist(), labels.tolist()):
                (toxic if bad else clean).update({w for i in set(at[a:b].tolist()) for w in folds[i]})
            if len(toxic) + len(clean) > _FLUSH:
                yield flush()
    yield flush()


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS) -> DataFrame:
    """text, toxic of at most about ``bound`` labelled rows that are not held out, one row for each text."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = labels.count()
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = labels.where(draw < min(1.0, bound / max(n, 1))).distinct()
    # at most the documented bound of (id, label) rows, whatever the size of the tables
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return stored(rows.groupBy(F.sha2("text", 256).alias("_h")).agg(
        F.max("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxsample")


def learn(
    docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), bound: int = LABELLED_ROWS,
    max_terms: int = MAX_TERMS, max_exceptions: int = MAX_EXCEPTIONS,
) -> dict:
    """The model: terms with weights, exceptions, power of the length, threshold, and numbers of terms and exceptions left out."""
    sample = labelled_sample(docs, labels, bound)
    seen = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = seen.get(1, 0), seen.get(0, 0)
    blank = {"terms": {}, "exceptions": [], "power": 1.0, "threshold": 1.0, "terms_left_out": 0, "exceptions_left_out": 0}
    if not n_toxic or not n_clean:
        return blank
    words = stored(sample.mapInArrow(_count_words, "word string, toxic bigint, clean bigint").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxwords")
    shortest = F.when(F.col("word").rlike(r"\p{IsHangul}"), SHORTEST_HANGUL).otherwise(SHORTEST)
    sizes = F.when(F.col("word").startswith(MARK) | (F.length("word") < shortest), F.array().cast("array<int>")).otherwise(
        F.sequence(shortest, F.least(F.length("word"), F.lit(LONGEST))))
    whole = F.when(F.col("word").startswith(MARK), F.col("word")).otherwise(F.concat(F.lit(" "), F.col("word"), F.lit(" ")))
    starts = words.select("toxic", "clean", F.explode(F.array_append(
        F.transform(sizes, lambda k: F.concat(F.lit(" "), F.substring(F.col("word"), F.lit(1), k))), whole)).alias("term"))
    starts = starts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 3")
    base = n_toxic / (n_toxic + n_clean)
    n_terms = max(words.count() * 4, 2)
    # log of the chance of so many toxic among all, by relative entropy; corrected for the number of candidates
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    surprise = (F.col("toxic") + F.col("clean")) * (
        share * F.log(share / base) + (1 - share) * F.log((1 - share + 1e-12) / (1 - base)))
    able = stored(starts.where((share >= 0.9) & (surprise > math.log(n_terms) + 2)).withColumn("evidence", surprise), "toxterms")
    good = able.orderBy(F.desc("evidence"), "term").limit(max_terms).collect()
    terms_left_out = able.count() - len(good)
    weight = {r["term"]: math.log((r["toxic"] + 0.5) / (n_toxic + 1)) - math.log((r["clean"] + 0.5) / (n_clean + 1))
              for r in good}
    terms = {t: w for t, w in weight.items() if not any(t[:k] in weight for k in range(2, len(t)))}
    toxic = {r["term"]: r["toxic"] for r in good}
    longer: dict[str, list[str]] = {}
    for t in sorted(toxic):
        if not t.startswith(MARK) and not t.endswith(" "):
            longer.setdefault(t[:-1], []).append(t)
    terms = {_longest_alike(t, toxic, longer): w for t, w in terms.items()}
    terms = _needed(sample, terms, {r["term"]: r["evidence"] for r in good}, {t for t in terms if toxic[t] >= n_toxic / 20})
    if not terms:
        return blank
    spark = docs.sparkSession
    listed = spark.createDataFrame([(t,) for t in terms], "term string")
    clean_words = words.where("clean >= 2 and toxic <= clean").select("word", "clean", F.explode(F.transform(
        sizes, lambda k: F.concat(F.lit(" "), F.substring(F.col("word"), F.lit(1), k)))).alias("term"))
    safe = stored(clean_words.select("word", "clean", "term").join(F.broadcast(listed), "term").groupBy("word").agg(
        F.max("clean").alias("clean")), "toxsafe")
    learned = [f" {r['word']} " for r in safe.orderBy(F.desc("clean"), "word").limit(max_exceptions).collect()]
    model = {"terms": terms, "exceptions": learned + [fold_phrase(x) for x in exceptions],
             "terms_left_out": terms_left_out, "exceptions_left_out": safe.count() - len(learned)}
    return model | _fit_threshold(sample, model)


def _longest_alike(term: str, toxic: dict[str, int], longer: dict[str, list[str]]) -> str:
    """The longest beginning that is found as often as ``term``: it says the same and fits less by chance."""
    longest = term
    while True:
        more = [t for t in longer.get(longest, ()) if toxic[t] == toxic[term]]
        if not more:
            return longest
        longest = more[0]


def _needed(sample: DataFrame, terms: dict[str, float], evidence: dict[str, float], sure: set[str]) -> dict[str, float]:
    """Terms that are the best evidence of at least three toxic documents, and those that are ``sure`` by their number.

    Words that near copies of one toxic document happen to share look toxic too, but those documents have better terms.
    """
    ranks = {t: i for i, t in enumerate(sorted(terms, key=lambda t: (-evidence[t], t)))}

    def credit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, counts = Matcher(terms, []), Counter()
        for batch in batches:
            for text, (total, _) in zip(batch.column(0), matcher.measure_all(batch.column(0))):
                if total:
                    folded = fold(text.as_py())
                    counts[min(ranks[folded[a:b]] for a, b, _ in matcher.hits(folded))] += 1
        yield pa.record_batch([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["rank", "n"])

    rows = sample.where("toxic = 1").select("text").mapInArrow(credit, "rank bigint, n bigint").groupBy("rank").agg(
        F.sum("n").alias("n")).where("n >= 3").collect()
    kept = {r["rank"] for r in rows}
    return {t: w for t, w in terms.items() if ranks[t] in kept or t in sure}


def _fit_threshold(sample: DataFrame, model: dict) -> dict:
    terms, exceptions = model["terms"], model["exceptions"]

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, counts = Matcher(terms, exceptions), Counter()
        for batch in batches:
            for (total, n), label in zip(matcher.measure_all(batch.column(0)), batch.column(1).to_pylist()):
                for i, p in enumerate(POWERS):
                    counts[i, math.floor(math.log2(total / max(n, 1)**p) * _BINS_PER_OCTAVE) if total > 0 else None, label] += 1
        keys = list(counts)
        yield pa.record_batch([pa.array([k[j] for k in keys], pa.int64()) for j in range(3)]
                              + [pa.array([counts[k] for k in keys], pa.int64())], names=["power", "bin", "label", "n"])

    rows = sample.mapInArrow(bins, "power bigint, bin bigint, label bigint, n bigint").groupBy(
        "power", "bin", "label").agg(F.sum("n").alias("n")).collect()
    best = None
    for i, p in enumerate(POWERS):
        per: dict[int, list[int]] = {}
        missed = 0
        for r in rows:
            if r["power"] == i and r["bin"] is not None:
                per.setdefault(r["bin"], [0, 0])[r["label"]] += r["n"]
            elif r["power"] == i and r["label"] == 1:
                missed += r["n"]
        order = sorted(per)
        clean_above, toxic_below = sum(per[b][0] for b in order), missed
        cuts = [(clean_above + toxic_below, order[0] - _BINS_PER_OCTAVE)] if order else []
        for b, nxt in zip(order, [*order[1:], (order[-1] if order else 0) + 2]):
            clean_above -= per[b][0]
            toxic_below += per[b][1]
            cuts.append((clean_above + toxic_below, (b + 1 + nxt) / 2))
        for errors, cut in cuts[:1] + cuts[1:]:
            if best is None or errors < best[0]:
                best = (errors, p, 2.0 ** (cut / _BINS_PER_OCTAVE))
    return {"power": best[1], "threshold": best[2]} if best else {"power": 1.0, "threshold": 1.0}


def score(docs: DataFrame, model: dict, name: str = "_toxicity") -> DataFrame:
    """All columns of ``docs`` and a struct ``name`` (score, n_words)."""
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score: double, n_words: bigint>")
    def measure(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = shared.value
        for texts in parts:
            found = worker_model(key, lambda: Matcher(fitted["terms"], fitted["exceptions"])).measure_all(texts)
            ratio = np.maximum([w / max(n, 1) ** fitted["power"] for w, n in found], 0.0)
            yield pa.StructArray.from_arrays([pa.array(ratio / (ratio + fitted["threshold"]), pa.float64()),
                                              pa.array([n for _, n in found], pa.int64())], names=["score", "n_words"])

    return docs.withColumn(name, measure(F.col("text")))


def judged(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words for every row."""
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity.score").alias("score"),
        (F.col("_toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.col("_toxicity.n_words").alias("n_words"))


def drop_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """Documents below a score of 0.5, with all their columns."""
    name = free_name(docs, "_toxicity")
    return score(docs, model, name).where(F.col(f"{name}.score") < 0.5).drop(name)
