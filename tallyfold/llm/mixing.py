"""Mixing by soft membership, in DataFrame operations only.

A naive Bayes classifier learnt from a labelled table gives each document a posterior over
domains. Nonnegative document rates are then fitted by projected-gradient least squares, so
that the expected tokens of each domain, sum of rate x tokens x posterior, meet the targets.
Each step needs one pass that sums a number for each domain.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import hash_share, held_out, sample_by_class
from tallyfold.sources.shared import settle

DOMAINS = ("clean", "poor", "toxic")
TARGETS = {"clean": 0.94, "poor": 0.04, "toxic": 0.02}
DOCS_PER_DOMAIN = 2000
VOCABULARY = 4000
TOLD_APART = 25.0
MOST_RATE = 4.0
PULL = 1e-3
STEPS = 25
CLOSE = 1e-5


def domain_of_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, domain: toxic, else poor (quality 0), else clean; the worst of repeated rows.
    Rows without a key, or without either label, teach nothing."""
    worst = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(
        F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0
    )
    return (
        labels.select(F.col(key), worst.alias("w"))
        .filter(F.col(key).isNotNull() & F.col("w").isNotNull())
        .groupBy(key)
        .agg(F.max("w").alias("w"))
        .select(key, F.element_at(F.array(*map(F.lit, DOMAINS)), F.col("w") + 1).alias("domain"))
    )


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")


def _features(text: Column) -> Column:
    """The distinct words, the share of marks and the share of capitals, both in steps."""
    n = F.greatest(F.length(text), F.lit(1))

    def share(name: str, counted: str) -> Column:
        found = F.regexp_count(text, F.lit(counted)) / n
        return F.concat(F.lit(name), F.floor(F.sqrt(found) * 20).cast("string"))

    return F.array_union(
        F.array_distinct(_words(text)),
        F.array(share("#marks ", r"\p{Punct}"), share("#capitals ", r"\p{Lu}")),
    )


def fit_words(docs: DataFrame, labelled: DataFrame, key: str, text: str, domains: Sequence[str],
              per_domain: int = DOCS_PER_DOMAIN, size: int = VOCABULARY) -> tuple[DataFrame, list[float]]:
    """(word, and its weight for each domain), and the domains' log odds without any word.

    Learnt from about ``per_domain`` labelled documents of each domain, whole, chosen by a
    hash of the key. The words that tell the domains apart beyond chance are kept (a
    chi-square of ``TOLD_APART`` at least), the ``size`` best of them.
    """
    counts = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    total = sum(counts.values())
    sample = sample_by_class(labelled, key, "domain", per_domain, "mixing")
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(sample), key)
    per_word = settle(
        rows.select("domain", F.explode(_features(F.col("_t"))).alias("word"))
        .groupBy("word")
        .agg(*[F.sum((F.col("domain") == d).cast("bigint")).alias(d) for d in domains])
    )
    docs_of = rows.groupBy("domain").count().collect()
    n_docs = {r["domain"]: r["count"] for r in docs_of}
    share = [(F.col(d) + 0.5) / F.lit(n_docs.get(d, 0) + 1.0) for d in domains]
    lacks = [F.log(1 - s) for s in share]
    seen = reduce(lambda a, b: a + b, [F.col(d) for d in domains])
    weights = [(F.log(s) - lack).alias(f"w{i}") for i, (s, lack) in enumerate(zip(share, lacks))]
    weights += [lack.alias(f"b{i}") for i, lack in enumerate(lacks)]
    expected = [seen * F.lit(n_docs.get(d, 0) / max(1, sum(n_docs.values()))) for d in domains]
    chi = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.try_divide((F.col(d) - e) * (F.col(d) - e), e), F.lit(0.0)) for d, e in zip(domains, expected)],
    )
    words = (
        per_word.select("word", *weights, chi.alias("told"))
        .filter(F.col("told") >= TOLD_APART)
        .orderBy(F.desc("told"), "word")
        .limit(size)
        .drop("told")
    )
    words = settle(words)
    none = words.agg(*[F.coalesce(F.sum(f"b{i}"), F.lit(0.0)) for i in range(len(domains))]).first()
    start = [
        math.log((counts.get(d, 0) + 1) / (total + len(domains))) + lack for d, lack in zip(domains, none)
    ]
    return words.select("word", *[f"w{i}" for i in range(len(domains))]), start


def posteriors(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text",
               domains: Sequence[str] = DOMAINS) -> DataFrame:
    """key, text_key, n_rows, n_tokens and p0, p1, ... for each distinct (key, text).

    Each word of the model counts, by its presence or absence (Bernoulli): the weights of
    those a document has are added to the log odds of a document that has none.
    """
    words, start = fit_words(docs, labelled, key, text, domains)
    body = F.coalesce(F.col(text), F.lit(""))
    # first one row for each document: what stands beside an explode is made for each word
    whole = docs.select(
        F.col(key).alias("key"),
        F.xxhash64(text).alias("text_key"),
        F.size(_words(body)).cast("bigint").alias("n_tokens"),
        _features(body).alias("features"),
    )
    rows = whole.select("key", "text_key", "n_tokens", F.posexplode("features").alias("pos", "word"))
    names = [f"w{i}" for i in range(len(domains))]
    summed = (
        rows.join(F.broadcast(words), "word", "left")
        .groupBy("key", "text_key", "n_tokens")
        .agg(
            F.sum((F.col("pos") == 0).cast("bigint")).alias("n_rows"),
            *[F.coalesce(F.sum(w), F.lit(0.0)).alias(w) for w in names],
        )
    )
    logits = [F.lit(s) + F.col(w) / F.col("n_rows") for s, w in zip(start, names)]
    most = F.greatest(*logits) if len(logits) > 1 else logits[0]
    odds = summed.select(
        "key", "text_key", "n_rows", "n_tokens", *[F.exp(x - most).alias(f"o{i}") for i, x in enumerate(logits)]
    )
    total = reduce(lambda a, b: a + b, [F.col(f"o{i}") for i in range(len(domains))])
    return odds.select(
        "key", "text_key", "n_rows", "n_tokens",
        *[F.round(F.col(f"o{i}") / total, 9).alias(f"p{i}") for i in range(len(domains))],
    )


def _weights(names: Sequence[str], targets: Mapping[str, float]) -> list[float]:
    given = [max(0.0, float(targets.get(d, 0.0))) for d in names]
    total = sum(given)
    if total <= 0:
        raise ValueError("no domain has a positive target")
    return [g / total for g in given]


def fit_rates(rows: DataFrame, targets: Sequence[float], most: float = MOST_RATE,
              pull: float = PULL, steps: int = STEPS) -> tuple[Column, list[dict]]:
    """The rate as a column of ``rows``, and the residuals of each step.

    Minimises, over rates from 0 to ``most``, the sum over domains k of (S_k - T_k)^2 / m_k
    and ``pull`` times the tokens' squared distance from rate 1; S_k: expected tokens of the
    domain, T_k: its target, m_k: what it has, all as shares of all tokens. Divided by a
    document's share of tokens, the gradient is 2 (sum p_k (S_k - T_k) / m_k + pull (r - 1)),
    and its slope is 2 (1 + pull) at most, which gives the step. A step needs the K sums
    only, and the rate is made again from the steps so far. A domain without tokens
    can't be met and has no pull.
    """
    tokens = F.col("n_tokens") * F.col("n_rows")
    p = [F.col(f"p{i}") for i in range(len(targets))]

    def sums(rate: Column) -> list[float]:
        found = rows.agg(*[F.sum(tokens * rate * x).alias(f"s{i}") for i, x in enumerate(p)]).first()
        return [float(x or 0.0) for x in found]

    step = 1.0 / (2 * (1 + pull))
    inertia = 2 * step * pull
    pushes: list[list[float]] = []

    def rate() -> Column:
        # the steps are data, not nested expressions, whose analysis takes ever longer
        if not pushes:
            return F.lit(1.0)
        made = F.array(*[F.array(*map(F.lit, push)) for push in pushes])

        def moved(r: Column, push: Column) -> Column:
            slope = reduce(lambda a, b: a + b, [x * F.get(push, F.lit(i)) for i, x in enumerate(p)])
            return F.least(F.lit(most), F.greatest(F.lit(0.0), r * (1 - inertia) + inertia - slope))

        return F.aggregate(made, F.lit(1.0), moved)

    have = sums(rate())
    total = sum(have)
    history: list[dict] = []
    if not total:
        return rate(), history
    mass = [h / total for h in have]
    now = have
    last: list[float] | None = None
    for _ in range(steps):
        off = [s / total - t for s, t in zip(now, targets)]
        history.append({"off": off})
        if last is not None and max(abs(a - b) for a, b in zip(off, last)) < CLOSE:
            break
        last = off
        pushes.append([2 * step * o / m if m > 0 else 0.0 for o, m in zip(off, mass)])
        now = sums(rate())
    return rate(), history


def document_rates(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    key: str = "doc_id",
    text: str = "text",
    most: float = MOST_RATE,
) -> DataFrame:
    """key, text_key, n_rows, n_tokens, p_<domain>..., rate, copies for each distinct (key, text).

    ``copies``: how often a row is taken, its rate rounded up or down by a hash of the key,
    so that the mean over documents is the rate. Null and empty texts have no tokens; they
    get a rate but move no total. Without labels all posteriors are equal; without documents
    the result is empty.
    """
    names = list(DOMAINS)
    labelled = domain_of_labels(labels.filter(~held_out(F.col(key))), key)
    rows = settle(posteriors(docs, labelled, key, text, names))
    rate, _ = fit_rates(rows, _weights(names, targets), most)
    fitted = rows.withColumn("rate", F.round(rate, 6))
    share = F.coalesce(hash_share(F.col("key"), "copies"), hash_share(F.col("text_key"), "copies"))
    whole = F.floor("rate")
    return fitted.select(
        F.col("key").alias(key),
        "text_key",
        "n_rows",
        "n_tokens",
        *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(names)],
        "rate",
        (whole + (share < F.col("rate") - whole).cast("int")).cast("int").alias("copies"),
    )


def mix(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row as many times as its ``copies``, with the columns of ``docs``."""
    rates = document_rates(docs, labels, key=key, text=text).select(
        F.col(key).alias("_mix_key"), F.col("text_key").alias("_mix_text"), F.col("copies").alias("_mix_copies")
    )
    # the row goes along as one value, so none of its columns can be taken for one of these
    marked = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.xxhash64(text).alias("_own"))
    return (
        marked.join(rates, F.col("_key").eqNullSafe(F.col("_mix_key")) & (F.col("_own") == F.col("_mix_text")))
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_mix_copies"))))
        .select("_row.*")
    )


def mixing_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of the documents: doc_id, n_tokens, posteriors, rate, copies."""
    rates = document_rates(docs, labels)
    return rates.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_rows"))).drop("_row", "n_rows", "text_key")
