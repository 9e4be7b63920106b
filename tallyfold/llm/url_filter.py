"""URL filter: rules first, then a naive Bayes model of the words in host and path.

Host names are words run together. Their labels are cut into words by Viterbi under a
unigram model; a multinomial naive Bayes model, learnt from the addresses that a rule judges,
then scores the words of host and path where no rule fits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import map_texts
from tallyfold.sources.shared import settle

Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
VOCABULARY = 50_000
MIN_COUNT = 2
LONGEST_WORD = 24
CACHED_LABELS = 100_000
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, the first of equals; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, text).otherwise(found)
    return found


@dataclass
class Unigrams:
    """Log probabilities of words; an unknown piece costs more the longer it is."""

    words: dict[str, float] = field(default_factory=dict)
    unknown: float = math.log(1e-9)
    known: dict[str, list[str]] = field(default_factory=dict, repr=False)

    def split(self, label: str) -> list[str]:
        """The most probable split; the shorter last word wins a tie. Digits stay together."""
        if label not in self.known:
            if len(self.known) > CACHED_LABELS:
                self.known.clear()
            parts = re.findall(r"\d+|\D+", label)
            self.known[label] = [w for part in parts for w in self._viterbi(part)]
        return self.known[label]

    def _viterbi(self, text: str) -> list[str]:
        if text.isdigit():
            return ["<digits>"]
        best, cut = [0.0], [0]
        for end in range(1, len(text) + 1):
            score, start = max(
                (best[s] + self._cost(text[s:end]), s) for s in range(max(0, end - LONGEST_WORD), end)
            )
            best.append(score)
            cut.append(start)
        words, end = [], len(text)
        while end:
            words.append(text[cut[end] : end])
            end = cut[end]
        return words[::-1]

    def _cost(self, word: str) -> float:
        return self.words.get(word) or self.unknown - 2.0 * len(word)


def words_of(host: str, path: str, unigrams: Unigrams) -> list[str]:
    """The words of host (``h:``) and path (``p:``), lower-cased, each as often as it stands there."""
    hosts = [w for label in re.findall(r"\w+", host) for w in unigrams.split(label)]
    paths = [w for label in re.findall(r"\w+", path.lower()) for w in unigrams.split(label)]
    return [f"h:{w}" for w in hosts] + [f"p:{w}" for w in paths]


@dataclass
class Model:
    """Unigrams, log odds of blocking of each word, and of an address without words."""

    unigrams: Unigrams
    odds: dict[str, float]
    prior: float

    def score(self, host: str, path: str) -> float:
        z = self.prior + sum(self.odds.get(w, 0.0) for w in words_of(host, path, self.unigrams))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def learn_words(pages: DataFrame, html: str = "html", size: int = VOCABULARY) -> Unigrams:
    """Count the words of all pages' titles; the ``size`` most frequent ones that occur twice
    at least are the model."""
    title = F.regexp_extract(F.lower(F.coalesce(F.col(html), F.lit(""))), r"(?s)<title[^>]*>(.*?)</title", 1)
    words = pages.select(F.explode(F.regexp_extract_all(title, F.lit(r"(\p{L}{2,})"), F.lit(1))).alias("word"))
    rows = (
        words.groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") >= MIN_COUNT) & (F.length("word") <= LONGEST_WORD))
        .orderBy(F.desc("n"), "word")
        .limit(size)
        .collect()
    )
    total = sum(r["n"] for r in rows) + 1
    return Unigrams({r["word"]: math.log(r["n"] / total) for r in rows}, math.log(0.1 / total))


def _pairs(judged: DataFrame) -> DataFrame:
    """host and path as one text column, for the mapping over batches."""
    return judged.withColumn("_address", F.concat("host", F.lit("\n"), "path"))


def fit(judged: DataFrame, unigrams: Unigrams, size: int = VOCABULARY) -> Model:
    """Naive Bayes over all rows of (host, path, verdict) with a verdict, equal addresses
    counted together. The ``size`` most frequent words are the model."""
    distinct = (
        judged.filter(F.col("verdict").isNotNull())
        .groupBy("host", "path", "verdict")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = {r["verdict"]: r["n"] for r in distinct.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    shared = judged.sparkSession.sparkContext.broadcast(unigrams)

    def split(texts):
        found = [words_of(*t.split("\n", 1), shared.value) for t in texts]
        return {"words": pa.array(found, pa.list_(pa.string()))}

    block = F.col("verdict") == "block"
    rows = (
        map_texts(_pairs(distinct).select("_address", "verdict", "n"), "_address", "words array<string>", split)
        .select(F.explode("words").alias("word"), "verdict", "n")
        .groupBy("word")
        .agg(
            F.sum(F.when(block, F.col("n")).otherwise(0)).alias("bad"),
            F.sum(F.when(block, 0).otherwise(F.col("n"))).alias("good"),
        )
        .orderBy(F.desc(F.col("bad") + F.col("good")), "word")
        .limit(size)
        .collect()
    )
    bad = sum(r["bad"] + 1 for r in rows) or 1
    good = sum(r["good"] + 1 for r in rows) or 1
    odds = {r["word"]: math.log((r["bad"] + 1) / bad) - math.log((r["good"] + 1) / good) for r in rows}
    prior = math.log((counts.get("block", 0) + 1) / (counts.get("allow", 0) + 1))
    return Model(unigrams, odds, prior)


def judge(
    pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id",
    rules: Sequence[Rule] = RULES, threshold: float = THRESHOLD,
) -> DataFrame:
    """key, host, path, rule, verdict, score for every row.

    A null address, or one without ``://``, has an empty host and path, which no rule fits;
    it scores as the prior. ``score``: the model's probability of blocking, given where no
    rule fits. Equal addresses are scored once a batch; repeated rows are judged alike.
    """
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    fit_rule = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("_rule", fit_rule).select(key, "host", "path", "_rule.rule", "_rule.verdict")
    judged = settle(rows)
    model = fit(judged, learn_words(pages, html))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def scored(texts):
        known: dict = {}
        for t in texts:
            if t is not None and t not in known:
                known[t] = shared.value.score(*t.split("\n", 1))
        return {"score": pa.array([None if t is None else known[t] for t in texts], pa.float64())}

    address = F.when(F.col("rule").isNull(), F.concat("host", F.lit("\n"), "path"))
    result = map_texts(judged.withColumn("_address", address), "_address", "score double", scored)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return result.withColumn("verdict", F.coalesce("verdict", by_model)).select(
        key, "host", "path", "rule", "verdict", "score"
    )
