"""Operator 1: language identification by bit-sliced Bloom filters of n-grams.

One filter per language, stored bit-sliced: row r of the table is a bitmask (a word
for every 64 languages) whose bit L says that row r is set in the filter of language L.  The AND of the rows of
an n-gram is the mask of all languages that contain it, so a single probe answers
for all of them.  A text's n-grams (runs of ``n`` bytes of its lower-cased UTF-8)
are probed and counted per language; each count is corrected for the filter's
false positives, (hits - total * fpr) / (1 - fpr), and the language with the
largest corrected count wins.

Training uses a sample of about ``train_docs`` labelled rows of each language (all of
a rarer one; rows are chosen by a hash of doc_id and text) and keeps the ``grams`` most
frequent of its telling n-grams, so the model grows with the number of languages only
(8 bytes for each of ``rows`` rows and 64 languages) and is broadcast.  An n-gram belongs
to a language if it is at least 1/``ratio`` as frequent there as in the language where
it is most frequent.

Prediction is one narrow pass that sees the text only.  Null texts and texts
without a letter are ``und`` with score 0; ties go to the language that sorts
first; a text that hits no filter takes the first language with score 0.
Rows without a doc_id are not held out.  Very long texts are probed in parts of
bounded size.  Repeated rows and other columns, also of clashing names, need nothing
special; an empty training table gives ``und`` for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship, text_bytes, tidy, where_text

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Bytes of text that are probed at once.
PART = 1 << 20
#: Parts in which the n-grams of a language are ranked first.
PARTS = 32


def text_grams(text: bytes, n: int, first: bool = True, last: bool = True) -> np.ndarray:
    """The ``n``-byte runs of a lower-cased text, as integers in order; a space counts
    before its ``first`` and after its ``last`` part."""
    b = np.frombuffer(b" " * first + text + b" " * last, np.uint8)
    if len(b) < n:
        return np.empty(0, np.uint64)
    out = b[: len(b) - n + 1].astype(np.uint64)
    for i in range(1, n):
        out = (out << np.uint64(8)) | b[i : len(b) - n + 1 + i]
    return out


def lowered(text: bytes) -> tuple[bytes, bool]:
    """Lower-cased UTF-8, and whether the text has a letter."""
    decoded = text.decode("utf-8", "replace")
    return decoded.lower().encode(), any(map(str.isalpha, decoded))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    n: int
    table: np.ndarray  # [row, word]: uint64 bitmasks of 64 languages each
    fpr: np.ndarray  # of each language's filter

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], n: int, rows: int, hashes: int) -> "LanguageModel":
        languages = tuple(sorted(grams))
        table = np.zeros((rows, -(-max(1, len(languages)) // 64)), np.uint64)
        filled = np.zeros(len(languages))
        for number, language in enumerate(languages):
            own = np.zeros(rows, bool)
            for row in _rows(grams[language], rows, hashes):
                own[row] = True
            table[own, number // 64] |= np.uint64(1 << number % 64)
            filled[number] = own.mean()
        return cls(languages, n, table, filled**hashes)

    def masks(self, grams: np.ndarray, hashes: int = 3) -> np.ndarray:
        """For each n-gram the bitmask of all languages that contain it, as words."""
        found = None
        for row in _rows(grams, len(self.table), hashes):
            found = self.table[row] if found is None else found & self.table[row]
        return found

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        out: list = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        which = np.zeros(len(texts), bool)
        hits, sizes = np.zeros((len(self.languages), len(texts)), np.int64), np.zeros(len(texts), np.int64)
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0
        for i, text in enumerate(texts):
            if text is None:
                continue
            text, which[i] = lowered(text)
            if not which[i]:
                continue
            for at in range(0, max(1, len(text) - self.n + 3), PART):
                grams = text_grams(text[at : at + PART + self.n - 1], self.n, at == 0, at + PART + self.n - 1 > len(text))
                if len(grams):
                    waiting.append((i, grams))
                    held += len(grams)
                if held >= PART:
                    self._count(waiting, hits, sizes)
                    waiting, held = [], 0
        self._count(waiting, hits, sizes)
        fpr = np.minimum(self.fpr, 0.999)[:, None]
        shares = np.clip((hits - sizes * fpr) / (1 - fpr) / np.maximum(sizes, 1), 0, 1)
        best = shares.argmax(axis=0)
        for i in np.flatnonzero(which):
            out[i] = (self.languages[best[i]], float(shares[best[i], i]))
        return out

    def _count(self, parts: list[tuple[int, np.ndarray]], hits: np.ndarray, sizes: np.ndarray) -> None:
        """Add the popcounts of each language over the n-grams of texts."""
        if not parts:
            return
        own = np.array([i for i, _ in parts])
        counts = np.array([len(g) for _, g in parts])
        starts = np.cumsum(counts) - counts
        np.add.at(sizes, own, counts)
        masks = self.masks(np.concatenate([g for _, g in parts]))
        for number in range(len(self.languages)):
            found = (masks[:, number // 64] >> np.uint64(number % 64) & np.uint64(1)).astype(np.int64)
            np.add.at(hits[number], own, np.add.reduceat(found, starts))


def _rows(grams: np.ndarray, rows: int, hashes: int) -> Iterator[np.ndarray]:
    bits = np.uint64(64 - (rows - 1).bit_length())
    for k in range(hashes):
        x = (grams ^ (grams >> np.uint64(13))) * _ODD[k]
        x ^= x >> np.uint64(31)
        yield ((x * _ODD[(k + 1) % 3]) >> bits).astype(np.int64)


def train(
    labelled: DataFrame,
    *,
    train_docs: int = 5_000,
    grams: int = 6000,
    n: int = 4,
    rows: int = 1 << 18,
    ratio: float = 3.0,
    hashes: int = 3,
) -> LanguageModel:
    """Fit the filters on (doc_id, text, lang); rows with null text or lang are left out."""
    ship(labelled.sparkSession)
    usable = labelled.where("text is not null and lang is not null")
    sizes = materialize(usable.groupBy("lang").agg(F.count("*").alias("n_docs")), "language-sizes")
    share = F.lit(float(train_docs)) / F.col("n_docs") * F.lit(float(1 << 30))
    number = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("train")), F.lit(1 << 30))
    # a row per language: small at any size of the corpus
    sample = usable.join(F.broadcast(sizes), "lang").where(number < share)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text_grams(lowered(text)[0], n))
            for lang, parts in texts.items():
                found, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found)), pa.array(found.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "c"]
                )

    counted = sample.select(text_bytes().alias("text"), "lang").mapInArrow(tidy(count), "lang string, gram long, c long")
    counted = materialize(counted.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "gram-counts")
    totals = counted.groupBy("lang").agg(F.sum("c").alias("total"))
    shares = counted.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("c") / F.col("total")).alias("f"))
    telling = shares.join(shares.groupBy("gram").agg(F.max("f").alias("top")), "gram").where(F.col("f") * ratio >= F.col("top"))
    # of each language the most frequent ones, first by part of the grams: no task ranks a whole language
    first = Window.partitionBy("lang", "part").orderBy(F.desc("f"), "gram")
    telling = telling.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS))).withColumn("place", F.row_number().over(first)).where(F.col("place") <= grams)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("f"), "gram"))
    telling = telling.select("lang", "gram", "f").withColumn("place", place).where(F.col("place") <= grams)
    chosen = {r["lang"]: np.empty(0, np.uint64) for r in sizes.select("lang").collect()}
    # a row of ``grams`` numbers at most for each language
    for r in telling.groupBy("lang").agg(F.sort_array(F.collect_list("gram")).alias("grams")).toLocalIterator():
        chosen[r["lang"]] = np.array(r["grams"], np.int64).astype(np.uint64)
    return LanguageModel.build(chosen, n, rows, hashes)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # fixed size: 8 bytes a row of the table

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: LanguageModel, least_score: float) -> DataFrame:
    """The rows whose text has a letter and a language with at least ``least_score``;
    columns as they were.  The decision is made for each row from its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    good = lambda texts: [name != "und" and score >= least_score for name, score in shared.value.predict(texts)]
    return where_text(docs, lambda: good)


def held_out() -> "F.Column":
    """Whether a row is kept from training: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
