"""Quality, token counts, language, sharding, URLs and chat on small tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import chat, language_id, mixing, quality, sharding, token_counts, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, shard string"


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", 0, "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t"),
    (4, "word " * 50_000),
    (5, "same text here"),
    (5, "same text here"),
    (None, "no id"),
    (7, "a" * 100_000),
]


# --- token counts ------------------------------------------------------------------------


def library_counts(texts):
    tokenizers = pytest.importorskip("tokenizers")
    names = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(names.path(token_counts.TOKENIZER))
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def counter():
    names = pytest.importorskip("public_tokenizers")
    return token_counts.Counter(names.path(token_counts.TOKENIZER))


def test_token_counts_are_the_librarys():
    dice = random.Random(5)
    letters = "aabcdelmnrstvSTRE'''   .,!1٣éÀßΣ\n\t<|>-"
    texts = [None, "", "it's we'll they'd I'M x'rex 'r 'v' 'l '1 ''s !'s", "<|endoftext|> a<|startoftext|>b<|endoftext|", "ΑΣ ΣΑΣ İ ①²½"]
    texts += ["e\u0301 x\u2003y\x1cz\x85", "😀👍🏽 日本語", "ab" * 3000, "'" * 77]
    texts += ["".join(dice.choice(letters) for _ in range(dice.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(chr(dice.randint(97, 122)) for _ in range(dice.randint(1, 14))) for _ in range(1500)]
    assert counter()(texts).tolist() == library_counts(texts)


def test_states_are_forgotten_without_a_trace():
    few = counter()
    few.known.merger.max_states = 50
    texts = ["antidisestablishmentarianism unhappily running", "tokenization's transducer"]
    assert few(texts).tolist() == library_counts(texts)


def test_state_maps_compose():
    import numpy as np

    step, emit = token_counts.splitter()
    kinds = np.random.default_rng(0).integers(0, 10, (37, 5)).astype(np.uint8)
    maps = token_counts.scan(token_counts.state_maps(kinds, step))
    for entry in range(7):
        state = entry
        for row, got in zip(kinds, maps[:, entry]):
            for kind in row:
                state = step[state, kind]
            assert state == got


def test_token_report(spark):
    rows = token_counts.token_report(docs_of(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["n_bytes"] == by_id[1]["n_tokens"] == by_id[3]["n_tokens"] == 0
    assert by_id[4]["n_tokens"] == 50_000 and by_id[4]["over_limit"]
    assert by_id[7]["n_tokens"] == library_counts(["a" * 100_000])[0]
    assert token_counts.token_report(docs_of(spark, [])).collect() == []


# --- quality -----------------------------------------------------------------------------


def corpus(n=400):
    dice = random.Random(3)
    good, bad = "river stone lamp quiet garden north".split(), "cheap$$$ click### buy*** now!!".split()
    out = []
    for i in range(n):
        y = int(dice.random() < 0.7)
        out.append((i, " ".join(dice.choice(good + ["the", "and"] if y else bad + ["the", "and"]) for _ in range(30)), y))
    return out


def test_quality_learns_and_keeps_good_rows(spark):
    rows = corpus()
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(spark, [(i, t) for i, t, _ in rows] + ODD)
    out = quality.quality_report(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth and r["doc_id"] > 10]
    assert held and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    kept = quality.keep(docs, quality.fit(docs, quality.learnable(labels)))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, _, y in rows if y and i > 10}


@pytest.mark.parametrize("labelled", [[], [(5, 1, 0)]])
def test_quality_without_two_classes(spark, labelled):
    labels = spark.createDataFrame(labelled, "doc_id bigint, quality int, toxic int")
    scores = {r["score"] for r in quality.quality_report(docs_of(spark, ODD), labels).collect()}
    assert len(scores) == 1 and 0.5 <= scores.pop() < 1


def test_dual_coordinate_descent_meets_the_optimality_conditions():
    import numpy as np

    r = np.random.default_rng(2)
    x = r.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.3 * r.normal(size=60) > 0, 1, -1)
    rows = [(np.arange(5), v) for v in x]
    w = quality.dual_coordinate_descent(rows, y, 5, np.ones(60), rounds=2000)

    def loss(w):
        return w @ w / 2 + np.maximum(0, 1 - y * (x @ w[:5] + w[5])).sum()

    best = loss(w)
    assert all(loss(w + 0.02 * r.normal(size=6)) >= best - 1e-2 for _ in range(300))


# --- language ----------------------------------------------------------------------------


def test_letters_are_words_and_number_signs_are_not():
    assert language_id.words_of("²½Ⅷ ① ٣ 12 _ \u0301") == []
    assert language_id.words_of("x²y ABC1de") == ["x", "y", "abc", "de"]
    assert language_id.words_of("cafe\u0301 नमस्ते") == ["cafe\u0301", "नमस्ते"]


def test_rows_of_one_key_spread_over_buckets(spark):
    rows = [(7 if i % 3 else i, f"text {i}") for i in range(900)] + [(None, None)] * 3
    out = sharding.assign(docs_of(spark, rows)).collect()
    for shard in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    one = spark.range(900).selectExpr("7 as k", "id as size", "0 as shard")
    numbered = sharding.numbered(one, "shard", "k", ("k", "size"))
    digits = F.substring(F.md5(F.concat_ws("|", "k", "k", "size")), 1, sharding.BUCKET_DIGITS)
    assert numbered.groupBy(digits).count().agg(F.max("count")).first()[0] < 10
    assert [r["slot"] for r in numbered.orderBy("slot").collect()] == list(range(900))


def test_language(spark):
    dice = random.Random(9)
    words = {"en": "the house and of with water".split(), "de": "das haus und von mit wasser".split()}
    rows = [(i, " ".join(dice.choices(words[g], k=20)), g) for i in range(200) for g in [dice.choice(["en", "de"])]]
    rows += [(900, "12 34 !!", "en"), (901, None, None), (902, "", "de"), (903, "WATERHOUSE", None), (None, "das haus", "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("lang_pred", F.lit(1))
    out = {r["doc_id"]: r for r in language_id.language_report(docs).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["lang_pred"] == g for i, _, g in rows[:200])
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and out[901]["score"] == 0
    assert out[903]["lang_pred"] == "en" and out[None]["lang_pred"] == "de" and not out[None]["held_out"]
    nothing = language_id.language_report(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert language_id.language_report(docs.limit(0)).count() == 0


def test_unseen_words_back_off_to_shorter_grams():
    import numpy as np

    grams = {"^ab": 0, "a": 1, "b": 2, "$": 3}
    model = language_id.Model(["x", "y"], {}, grams, np.array([[5, 1], [0, 1], [1, 3], [0, 0]], np.float32), np.zeros(2))
    assert language_id.Scorer(model)._backed_off("abb").tolist() == [6.0, 4.0]


# --- sharding ----------------------------------------------------------------------------


def shard_by_hand(key, weights):
    import math

    text = "" if key is None else str(key)

    def cost(s):
        bits = int(hashlib.md5(f"{s}:{text}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / (1 << 52)) / weights[s]

    return min((s for s in range(len(weights)) if weights[s] > 0), key=cost)


def test_sharding(spark):
    texts = ODD + [(i, "t") for i in range(100, 1100)]
    out = sharding.assign(docs_of(spark, texts)).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r["shard"] == shard_by_hand(r["doc_id"], [1.0] * 8)
        assert r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[1]["size"] == 1 and by_id[1]["text_crc32"] == 0
    assert by_id[5]["text_crc32"] == zlib.crc32(b"same text here") and by_id[5]["size"] == 15
    assert sharding.assign(docs_of(spark, [])).collect() == []
    assert sharding.with_shard(docs_of(spark, texts)).columns == docs_of(spark, []).columns


def test_weighted_shards(spark):
    rows = spark.range(4000).withColumn("text", F.lit("t"))
    n = {r["shard"]: r["count"] for r in sharding.assign(rows, "id", weights=(1, 3, 0)).groupBy("shard").count().collect()}
    assert set(n) == {0, 1} and 0.7 < n[1] / 4000 < 0.8
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), (0, 0))


# --- URLs --------------------------------------------------------------------------------

URLS = [
    (0, "HTTP://WWW.Example.COM/en/1?x#y", "<title>Cheap pills</title>"),
    (1, "https://m.example.com/en/2", "<TITLE>win casino</TITLE>"),
    (2, "https://a.net/es/", None),
    (3, "https://a.net/fr", ""),
    (4, "no scheme", "x"),
    (5, None, None),
    (6, "http://host.com", "<title>casino win pills</title>"),
    (7, "x://notexample.com/en/#://y.net/es/", "<title>casino win cheap</title>"),
    (8, "https://winpills.org/EN/a-b", "<title>win pills cheap</title>"),
    (8, "https://winpills.org/EN/a-b", "<title>win pills cheap</title>"),
    (9, "a://?q", "z"),
    (10, "://net/es/\nx", ""),
]


def test_urls(spark):
    pages = spark.createDataFrame(URLS, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    out = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    got = {i: (r["host"], r["path"], r["rule"]) for i, r in out.items()}
    assert got == {
        0: ("www.example.com", "/en/1", "www.example.com/en/"),
        1: ("m.example.com", "/en/2", "example.com/en/"),
        2: ("a.net", "/es/", "net/es/"),
        3: ("a.net", "/fr", None),
        4: ("", "", None),
        5: ("", "", None),
        6: ("host.com", "", None),
        7: ("notexample.com", "/en/", "com/"),
        8: ("winpills.org", "/EN/a-b", None),
        9: ("", "", None),
        10: ("net", "/es/\nx", "net/es/"),
    }
    assert [out[i]["verdict"] for i in (0, 1, 2, 7, 10)] == ["allow", "block", "block", "allow", "block"]
    assert all(r["verdict"] in ("allow", "block") and (r["rule"] is None) == (r["score"] is not None) for r in out.values())
    assert url_filter.judge(pages).count() == len(URLS)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_hosts_are_cut_into_words():
    import math

    words = url_filter.Unigrams({w: math.log(p) for w, p in (("free", 0.1), ("bets", 0.1), ("be", 0.01), ("freeb", 0.001))})
    assert words.split("freebets") == ["free", "bets"]
    assert words.split("bets24") == ["bets", "<digits>"]
    assert "".join(words.split("xqz")) == "xqz"


# --- chat --------------------------------------------------------------------------------


def digest_by_hand(rows):
    turns, loss = hashlib.sha256(), hashlib.sha256()
    for role, text in rows:
        turns.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
    return len(rows), turns.hexdigest(), sum(len(t) for r, t in rows if r == "assistant"), loss.hexdigest()


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    bad = ["\\", "<", "<|", "\\<|", "<\\|im_end|>", "<|im_end|>\n", "|>", "é😀", "", None, "x" * 50_000, "\\n", "n\n"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(bad)]
    rows += [(2, 0, "assistant", t) for t in ("b", "a", "a")] + [(2, None, None, "first")]
    rows += [(3, 1, "user\n<|im_end|>", "t"), (None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("n_turns", F.lit(0))
    turns = turns.select("conv_id", "turn", "role", "text").unionByName(chat.planted_turns(spark))
    want = {
        1: [(r, t or "") for _, _, r, t in rows[: len(bad)]],
        2: [("", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")],
        3: [("user\n<|im_end|>", "t")],
        None: [("assistant", "x")] * 2,
        -1: [("user", said), ("assistant", said)],
    }
    out = {r["conv_id"]: r for r in chat.format_report(turns).collect()}
    assert {i: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for i, r in out.items()} == {
        i: digest_by_hand(v) for i, v in want.items()
    }
    whole = {r["conv_id"]: r for r in chat.formatted(turns).collect()}
    assert all(len(whole[i]["formatted"]) == out[i]["formatted_chars"] for i in want)
    learnt = "".join(whole[-1]["formatted"][s["from"] : s["to"]] for s in whole[-1]["loss"])
    assert chat.unguard(learnt) == said
    assert chat.format_report(turns.limit(0)).count() == 0


def render(template, rows):
    out = []
    chat.compile_template(template)(rows, lambda t, learnt: out.append((t, learnt)))
    return out


def test_templates():
    rows = [{"role": "a", "text": " x "}, {"role": "b", "text": None}]
    assert render("{% for r in rows %}{% if r.role == 'a' %}{{ r.text | trim | upper }}{% elif r.text %}no{% else %}-{% endif %}{% endfor %}", rows) == [("X", False), ("-", False)]
    assert chat.fold(chat.parse("a{{ 'b' ~ 1 }}{% if not 1 == 2 and true_ or 'x' %}c{% endif %}")) == (
        "block", [("text", "ab1"), ("if", [(("or", ("name", "true_"), ("const", "x")), [("text", "c")])])])
    assert chat.fold(chat.parse("{% if 'x' == 'y' %}1{% else %}2{% endif %}{# note #}3")) == ("block", [("text", "23")])
    assert render("{% set s = 'q' %}{% generation %}{{ s }}{% endgeneration %}", []) == [("q", True)]
    for bad in ("{{ a( }}", "{% for x %}", "{{ x | eval }}", "{% endif %}", "{% while 1 %}", "{{ 'a }}", "{{ (x }}", "{% if 1 %}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    for bad in ("{{ nothing }}", "{{ rows.__class__ }}"):
        with pytest.raises(chat.TemplateError):
            render(bad, [])


# --- mixing ------------------------------------------------------------------------------


def test_mixing_meets_its_targets(spark):
    dice = random.Random(4)
    base = "river stone lamp quiet garden north tree house".split()
    rows, labels = [], []
    for i in range(600):
        kind = dice.choice(["clean"] * 6 + ["toxic"] * 2 + ["poor"] * 2)
        extra = {"clean": ["sun"], "toxic": ["awful", "nasty"], "poor": ["###", "***"]}[kind]
        rows.append((i, " ".join(dice.choices(base, k=20) + extra * 4)))
        labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    docs = docs_of(spark, rows + [r for r in ODD if r[0] != 4])
    marked = spark.createDataFrame(labels + [(None, 1, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")
    rates = mixing.document_rates(docs, marked).collect()
    total = sum(r["n_tokens"] * r["n_rows"] for r in rates)
    assert all(0 <= r["rate"] <= mixing.MOST_RATE for r in rates)
    for d in mixing.DOMAINS:
        share = sum(r["n_tokens"] * r["n_rows"] * r["rate"] * r[f"p_{d}"] for r in rates) / total
        assert abs(share - mixing.TARGETS[d]) < 0.02, d
    out = mixing.mixing_report(docs, marked)
    assert out.count() == docs.count()
    mixed = mixing.mix(docs, marked)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] * r["n_rows"] for r in rates)
    assert mixing.mix(docs.limit(0), marked).count() == 0
    assert mixing.mixing_report(docs, marked.limit(0)).count() == docs.count()


def test_mixing_runs_no_python_on_the_executors(spark):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1)], "doc_id bigint, quality int, toxic int")
    plan = mixing.mix(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
