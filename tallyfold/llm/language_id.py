"""Language identification: known words first, shorter and shorter character n-grams for the rest.

A word that was seen in learning adds its log frequency in each language. An unseen word is
covered from left to right by the longest known n-grams (``MAX_GRAM`` characters down to 1),
each of which adds its log frequency; a character never seen adds nothing.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import held_out, map_texts, sample_by_class
from tallyfold.sources.shared import settle

WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
MAX_GRAM = 4
DOCS_PER_LANGUAGE = 1000
MODEL_ENTRIES = 100_000
UNKNOWN = "und"
CACHED_WORDS = 300_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, with the marks that follow a letter. Number signs and marks
    alone are no words."""
    return WORDS.findall((text or "").lower())


def grams_of(word: str) -> list[str]:
    """All n-grams of ^word$."""
    framed = f"^{word}$"
    return [
        framed[i : i + n] for n in range(1, MAX_GRAM + 1) for i in range(len(framed) - n + 1)
    ]


COUNTS = "lang string, item string, n bigint"


def _counts(counts: Counter) -> pa.RecordBatch:
    columns = {
        "lang": pa.array([k[0] for k in counts], pa.string()),
        "item": pa.array([k[1] for k in counts], pa.string()),
        "n": pa.array(counts.values(), pa.int64()),
    }
    return pa.RecordBatch.from_pydict(columns)


@dataclass
class Model:
    """Log frequencies; rows of ``values`` by word and by gram, columns by language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    values: np.ndarray
    prior: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        per_language: int = DOCS_PER_LANGUAGE, entries: int = MODEL_ENTRIES) -> Model:
    """Learn from about ``per_language`` documents of each language, whole, chosen by a hash
    of the key; rows without language, key or text teach nothing. The words and n-grams are
    counted in tasks; the ``entries`` most frequent of each kind that occur twice at least
    form the model, whose size is so bounded. Languages must be few."""
    known = docs.select(key, F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        "lang is not null and text is not null"
    )
    sample = sample_by_class(known, key, "lang", per_language, "language").select("lang", "text")

    def words(batches):
        for batch in batches:
            counts = Counter()
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[language, None] += 1
                counts.update((language, w) for w in words_of(body))
            yield _counts(counts)

    def grams(batches):
        for batch in batches:
            counts = Counter()
            for language, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for gram in grams_of(word):
                    counts[language, gram] += n
            yield _counts(counts)

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("lang", "item").agg(F.sum("n").alias("n"))

    # a null item counts documents
    by_word = settle(summed(sample.mapInArrow(words, COUNTS)))
    by_gram = summed(by_word.filter("item is not null").mapInArrow(grams, COUNTS))
    kinds = {
        "d": by_word.filter("item is null"),
        "w": by_word.filter("item is not null"),
        "g": by_gram,
    }
    by_language = F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")
    rows = {
        kind: counts.groupBy("item")
        .agg(F.sum("n").alias("total"), by_language)
        .filter(F.lit(kind == "d") | (F.col("total") > 1))
        .orderBy(F.desc("total"), "item")
        .limit(entries)
        .select("item", "by")
        .collect()
        for kind, counts in kinds.items()
    }
    docs_of = rows["d"][0]["by"] if rows["d"] else {}
    languages = sorted(docs_of)
    column = {language: i for i, language in enumerate(languages)}
    items = [*rows["w"], *rows["g"]]
    counts = np.zeros((len(items), len(languages)))
    for i, row in enumerate(items):
        for language, n in row["by"].items():
            counts[i, column[language]] = n
    n_words = len(rows["w"])
    values = np.zeros_like(counts, dtype=np.float32)
    for part in (slice(0, n_words), slice(n_words, None)):
        if len(counts[part]):
            smooth = counts[part] + 0.5
            values[part] = np.log(smooth / smooth.sum(axis=0))
    seen = np.array([docs_of[x] for x in languages], float)
    return Model(
        languages,
        {r["item"]: i for i, r in enumerate(rows["w"])},
        {r["item"]: n_words + i for i, r in enumerate(rows["g"])},
        values,
        np.log(seen / seen.sum()) if len(seen) else seen,
    )


class Scorer:
    """Posteriors of lists of texts; what an unseen word adds is kept for its next use."""

    def __init__(self, model: Model):
        self.model = model
        self.unseen: dict[str, np.ndarray] = {}

    def _backed_off(self, word: str) -> np.ndarray:
        if word not in self.unseen:
            if len(self.unseen) > CACHED_WORDS:
                self.unseen.clear()
            m, framed, at = self.model, f"^{word}$", 0
            total = np.zeros(len(m.languages))
            while at < len(framed):
                for n in range(min(MAX_GRAM, len(framed) - at), 0, -1):
                    row = m.grams.get(framed[at : at + n])
                    if row is not None:
                        total += m.values[row]
                        break
                at += n
            self.unseen[word] = total
        return self.unseen[word]

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        m = self.model
        if not words or not m.languages:
            return UNKNOWN, 0.0
        rows = list(map(m.words.get, words))
        known = [r for r in rows if r is not None]
        total = m.prior + m.values[known].sum(axis=0, dtype=np.float64)
        if len(known) < len(words):
            for word, row in zip(words, rows):
                if row is None:
                    total = total + self._backed_off(word)
        odds = np.exp(total - total.max())
        best = int(np.argmax(odds))
        return m.languages[best], float(odds[best] / odds.sum())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Replace the text by ``lang_pred`` and ``score`` (posterior of that language).

    ``und`` and 0 where the text is null, empty or without a letter, or nothing was learnt.
    Ties go to the first language in order. Repeated rows get the same answer each; texts
    are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list[Scorer] = []

    def scored(texts):
        if not made:
            made.append(Scorer(shared.value))
        answers = [made[0](t) for t in texts]
        return {
            "lang_pred": pa.array([a for a, _ in answers], pa.string()),
            "score": pa.array([b for _, b in answers], pa.float64()),
        }

    return map_texts(docs, text, "lang_pred string, score double", scored)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the rows that aren't held out."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
