"""Language identification by word-first backoff.

Learning counts words by language over all learned documents, and from these the character n-grams of a word between two spaces
by language, up to ``longest``. A known word scores log(count / words of the language) for each language. A word
that no language has scores the mean of its character n-grams of the greatest length of which any is known, shorter ones
only where none is; a word without any known character scores nothing. Where a language lacks a word or n-gram that another has, it
counts as seen half a time in the largest language. A document's language has the largest sum over all words; ties go to
the first name, and without any score the language with most learned words is taken. Scores are whole millionths, so that sums do not
depend on their order.

A word is a run of letters in lower case; runs of more than 40 are cut. The most frequent learned words, as many as ``HEAD_CELLS`` allows, go
to every executor; documents are read once, and of each only the words beyond go on. Of these each distinct one is looked up or backed
off once, and those in many documents are broadcast, again up to ``HEAD_CELLS``, so that no frequent word is a join key. This decides where a
score is found, never what it is.

score is the share of the best language in the geometric mean over a document's words, from 0 to 1. Null texts and texts without letters are
``und`` with score 0, and so is everything if nothing was learned. Rows without language are not learned. Repeated rows count and are
scored one by one; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import materialize, table

#: Runs of letters (and numbers that are no digits).
WORD = re.compile(r"[^\W\d_]{1,40}").findall
GAP = re.compile(r"[\W\d_]").search
#: Characters of a text worked on at once, and different words a task counts before it sends its sums on.
CHUNK, PORTION = 1 << 20, 200_000
#: Values (a language's score of a word) that are sent to every executor.
HEAD_CELLS = 1_000_000
MAX_LANGUAGES = 1000
MICRO = 1_000_000


@dataclass
class Model:
    """languages by name; words and grams (of each: name, and n0, n1, ...: how often each language has it), and the words of each language."""

    languages: list[str]
    words: DataFrame | None
    grams: DataFrame | None
    totals: list[int]
    longest: int


def word_lists(text: str) -> Iterator[list[str]]:
    at = 0
    while at < len(text):
        gap = GAP(text, at + CHUNK) if at + CHUNK < len(text) else None
        end = gap.end() if gap else len(text)
        yield WORD(text[at:end].lower())
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Counter] = {}

    def summed() -> pa.RecordBatch:
        words = [w for c in held.values() for w in c]
        which = np.repeat(np.array(list(held), np.int32), [len(c) for c in held.values()])
        times = np.fromiter((n for c in held.values() for n in c.values()), np.int64, len(words))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(which), pa.array(times)], ["word", "language", "n"])

    for batch in batches:
        for text, language in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            counter = held.setdefault(language, Counter())
            for words in word_lists(text.as_py() or ""):
                counter.update(words)
            if sum(map(len, held.values())) >= PORTION:
                yield summed()
    yield summed()


def _counts(languages: list[str]) -> list[str]:
    return [f"n{i}" for i in range(len(languages))]


def _grams(word: Column, n: int) -> Column:
    """The n-grams of a word between two spaces, for n = 1 without these."""
    padded = word if n == 1 else F.concat(F.lit(" "), word, F.lit(" "))
    last = F.length(padded) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4) -> Model:
    """A model of all rows of docs that have a language."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null")
    languages = sorted(r.lang for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"at most {MAX_LANGUAGES} languages")
    if not languages:
        return Model([], None, None, [], longest)
    names = _counts(languages)
    index = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1
    counted = rows.where("text is not null").select("text", index.alias("language")).mapInArrow(_count, "word string, language int, n long")
    words = materialize(counted.groupBy("word").agg(*[F.sum(F.when(F.col("language") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(names)]), "language-words")
    every = F.concat(*[_grams(F.col("word"), n) for n in range(1, longest + 1)])
    grams = materialize(words.select(F.explode(every).alias("gram"), *names).groupBy("gram").agg(*[F.sum(c).alias(c) for c in names]), "language-grams")
    totals = words.agg(*[F.sum(c) for c in names]).first()
    return Model(languages, words, grams, [t or 0 for t in totals], longest)


def _score(count: Column, total: int, largest: int) -> Column:
    """Millionths of log(count / total)."""
    rest = math.log(0.5 / max(largest, 1))
    return F.round(F.when(count > 0, F.log(count / F.lit(float(max(total, 1))))).otherwise(rest) * MICRO).cast("long")


def _scored(df: DataFrame, totals: list[int]) -> list[Column]:
    return [_score(F.col(f"n{i}"), t, max(totals)).alias(f"s{i}") for i, t in enumerate(totals)]


def _rank(of: Column) -> Column:
    """Eighths of a power of two, for thresholds."""
    return F.floor(F.log2(of) * 8)


def _most(df: DataFrame, of: Column, cells: int) -> int:
    """The least rank such that the rows from it on have at most so many cells."""
    sizes = sorted(((r.rank, r.n) for r in df.groupBy(_rank(of).alias("rank")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 8 * 63 rows
    least, rows = 1 << 20, 0
    for rank, n in sizes:
        if (rows := rows + n) * cells > HEAD_CELLS:
            break
        least = rank
    return least


def _look_up(held, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, scores = held.value
        place = dict(zip(words, range(len(words)), strict=True)).get
        for batch in batches:
            letters, sums, tails = [], np.zeros((batch.num_rows, width), np.int64), []
            for k, text in enumerate(batch.column(2)):
                found, tail = False, Counter()
                for said in word_lists(text.as_py() or ""):
                    found = found or any(map(str.isalpha, said)) or any(c.isalpha() for w in said for c in w)
                    at = np.fromiter((place(w, -1) for w in said), np.int64, len(said))
                    sums[k] += scores[at[at >= 0]].sum(0)
                    tail.update(said[i] for i in np.flatnonzero(at < 0).tolist())
                letters.append(found)
                tails.append(tail)
            names = [w for t in tails for w in t]
            times = np.fromiter((n for t in tails for n in t.values()), np.int64, len(names))
            items = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(times)], ["word", "times"])
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tails])])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(sums.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(letters), lists, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)], ["doc_id", "tag", "letters", "sums", "tail"])

    return run


def _backed_off(unseen: DataFrame, model: Model) -> DataFrame:
    """word, s0, s1, ... of words that no language has but whose n-grams are known."""
    columns = [f"s{i}" for i in range(len(model.languages))]
    size = F.length("gram")
    lengths = range(1, model.longest + 1)
    sums = {n: t for n, *t in model.grams.groupBy(size).agg(*[F.sum(c) for c in _counts(model.languages)]).collect()}  # a row a length
    pick = lambda i: F.coalesce(*[F.when(size == n, _score(F.col(f"n{i}"), sums[n][i], max(sums[n]))) for n in lengths if n in sums])
    if not sums:
        return unseen.select("word", *[F.lit(0).cast("long").alias(c) for c in columns]).limit(0)
    known = materialize(model.grams.select("gram", size.alias("size"), *[pick(i).alias(c) for i, c in enumerate(columns)]), "gram-scores")
    few = known.count() * len(columns) <= HEAD_CELLS

    def at(rows: DataFrame, sizes: range) -> DataFrame:
        grams = rows.select("word", F.explode(F.concat(*[_grams(F.col("word"), n) for n in sizes])).alias("gram"))
        side = known.where(F.col("size").isin(list(sizes)))
        hit = grams.join(F.broadcast(side) if few else side, "gram").groupBy("word", "size").agg(*[F.round(F.avg(c)).cast("long").alias(c) for c in columns])
        return hit.groupBy("word").agg(F.max_by(F.struct(*columns), "size").alias("s")).select("word", "s.*")

    # Nearly all words have one of the longest n-grams. Shorter ones, of which a few are in most words, are looked up for the others only.
    first = materialize(at(unseen, range(model.longest, model.longest + 1)), "backoff")
    if model.longest == 1:
        return first
    return first.unionByName(at(unseen.join(first, "word", "left_anti"), range(1, model.longest)))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", tag: Column | None = None) -> DataFrame:
    """doc_id, tag (any column of docs, to be carried on), lang_pred and score of each row."""
    spark, k = docs.sparkSession, len(model.languages)
    slim = docs.select(F.col(doc_id).alias("doc_id"), (F.lit(None).cast("string") if tag is None else tag).alias("tag"), F.col(text).cast("string").alias("text"))
    if not k:
        return slim.select("doc_id", "tag", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    columns = [f"s{i}" for i in range(k)]
    all_of = sum((F.col(c) for c in _counts(model.languages)), F.lit(0))
    least = _most(model.words, all_of, k + 1)
    head = model.words.where(_rank(all_of) >= least).select("word", *_scored(model.words, model.totals), F.lit(1).cast("long").alias("counted")).toArrow()
    matrix = np.stack([head[c].to_numpy() for c in (*columns, "counted")], axis=1)
    held = spark.sparkContext.broadcast((head["word"].to_pylist(), matrix))
    schema = slim.select("doc_id", "tag").schema.add("letters", "boolean").simpleString()[len("struct<") : -1]
    found = slim.mapInArrow(_look_up(held, k + 1), schema + ",sums:array<bigint>,tail:array<struct<word:string,times:bigint>>")
    # Rows may be equal, so each gets a key, which is written with what was found.
    keyed = materialize(found.withColumn("key", F.monotonically_increasing_id()), "languages")
    tail = keyed.select("key", F.explode("tail").alias("t")).select("key", "t.*")
    words = materialize(tail.groupBy("word").agg(F.count("*").alias("docs")), "tail-words")
    known = words.join(model.words, "word").select("word", "docs", *_scored(model.words, model.totals))
    unseen = words.join(model.words, "word", "left_anti")
    rest = unseen.join(_backed_off(unseen.select("word"), model), "word")
    scored = materialize(known.unionByName(rest), "tail-scores")
    often = _most(scored, F.col("docs"), k + 1)
    hot = scored.where(_rank(F.col("docs")) >= often).select("word", *columns)
    cold = scored.where(_rank(F.col("docs")) < often).select("word", *columns)
    near = tail.join(F.broadcast(hot), "word", "left")
    pairs = near.where("s0 is not null").select("key", "times", *columns).unionByName(near.where("s0 is null").select("key", "word", "times").join(cold, "word").select("key", "times", *columns))
    sums = pairs.groupBy("key").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in columns], F.sum("times").alias("counted"))
    both = keyed.select("key", "doc_id", "tag", "letters", "sums").join(sums, "key", "left")
    total = F.array(*[F.col("sums")[i] + F.coalesce(c, F.lit(0)) for i, c in enumerate([*columns, "counted"])])
    rows = both.select("doc_id", "tag", "letters", F.slice(total, 1, k).alias("s"), F.element_at(total, k + 1).alias("n"))
    share = 1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp((x - F.array_max("s")) / (F.col("n") * MICRO)))
    most = min(range(k), key=lambda i: (-model.totals[i], i))
    best = F.when(F.col("n") > 0, F.array_position("s", F.array_max("s")).cast("int")).otherwise(most + 1)
    names = F.array(*map(F.lit, model.languages))
    return rows.select(
        "doc_id", "tag", F.when(F.col("letters"), F.element_at(names, best)).otherwise("und").alias("lang_pred"),
        F.when(~F.col("letters"), 0.0).when(F.col("n") > 0, share).otherwise(1.0 / k).alias("score"),
    )


def held_out(doc_id: Column) -> Column:
    """A third of the documents, by id; not those without."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model, tag=held_out(F.col("doc_id"))).withColumnRenamed("tag", "held_out")
