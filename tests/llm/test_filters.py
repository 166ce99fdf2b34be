"""Quality rules, site classifier, language identification, mixing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import lang_id, mixing, quality_rules, site_quality
from cohortlab.llm.queries import ORACLE, QUERIES

from ..oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_quality_rules", "op9_mixing"])
def test_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(SF), ORACLE[name])


def counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_base_counts(spark, docs, no_labels, empty):
    more = ["a b c a b c d", "a a a a", "x\nx\n\nx\ny", "# * $ % & | < >", "a b c x a b c y b c x"]
    df = docs.unionByName(spark.createDataFrame([(100 + i, t, "en", "s", 0, "", 0) for i, t in enumerate(more)], docs.schema))
    got = {r.doc_id: r for r in quality_rules.quality_rules(df, no_labels).collect()}
    for r in df.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == counts(r.text), r.text
        n, rep = g.n_words, g.n_repeat_words
        assert g.base_failed == (n < 50 or 100 * rep > 50 * n) and g.kept == (not g.base_failed)
    assert quality_rules.quality_rules(empty, no_labels).count() == 0
    assert quality_rules.filter_documents(df, no_labels).columns == df.columns


@pytest.mark.parametrize("n, k, p", [(10, 0, 0.1), (100, 3, 0.05), (5000, 20, 0.004), (50, 40, 0.1)])
def test_binomial_bound_is_exact(spark, n, k, p):
    got = spark.sql(f"select {quality_rules.binomial_tail('k', 'n', p)} as t from (select {k} as k, {n} as n)").first().t
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
    assert got == pytest.approx(1.0 if k > n * p else want, rel=1e-9)


def test_cutoffs_hold_the_risk(spark):
    n = 6000
    scored = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("stratum"), F.lit(False).alias("base_failed"), (F.col("id") / n).alias("r"))
    labels = scored.select("doc_id", F.when(F.col("r") < 0.75, 1).otherwise(0).alias("quality"))
    grid = {"r": tuple(x / 20 for x in range(19, 0, -1))}
    got = {r.stratum: r.cutoff for r in quality_rules.choose_cutoffs(scored, labels, alpha=0.1, delta=0.05, cutoffs=grid).collect()}
    assert got == {"a": 0.7, "b": 0.7}  # 0.65 would lose 13 %; 0.7 loses 6.7 %
    few = labels.where("doc_id < 20")
    assert quality_rules.choose_cutoffs(scored, few, alpha=0.1, delta=0.05, cutoffs=grid).count() == 0


def test_cutoffs_take_effect_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op1_quality_rules"](spark, sf)
    assert_same(got, connect(sf), ORACLE["op1_quality_rules"])
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert sum(r.rejected_by is not None for r in rows if r.quality == 0) > 10
    assert not any(r.rejected_by for r in rows if r.quality == 1 and r.stratum == "en")


def test_a_labelled_document_is_one_trial(spark):
    one = spark.createDataFrame([(1, "a", False, 0.0)], "doc_id long, stratum string, base_failed boolean, r double")
    many = one.crossJoin(spark.range(500)).drop("id")
    labels = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, quality int")
    assert quality_rules.choose_cutoffs(many, labels, cutoffs={"r": (0.5,)}).count() == 0
    trials = spark.range(500).selectExpr("id as doc_id", "'a' as stratum", "false as base_failed", "0d as r")
    assert quality_rules.choose_cutoffs(trials, trials.selectExpr("doc_id", "1 as quality"), cutoffs={"r": (0.5,)}).count() == 1


def test_site_classifier(spark, docs, no_labels, empty):
    big, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = site_quality.classify(big, labels).join(labels, "doc_id")
    rates = {(r.quality, r.toxic): r.k for r in got.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rates[1, 0] > 0.97 and rates[0, 0] < 0.1
    assert site_quality.classify(docs, no_labels).where("kept").count() == docs.where("length(trim(replace(replace(text, '\n', ''), '\t', ''))) > 0").count()
    assert site_quality.classify(empty, no_labels).count() == 0
    assert site_quality.filter_documents(docs, no_labels).columns == docs.columns


def test_regression_equals_a_dense_solution():
    rng = np.random.default_rng(3)
    sets = [sorted(rng.choice(30, 5, replace=False).tolist()) for _ in range(200)]
    form, y = rng.normal(size=(200, 3)), rng.integers(0, 2, 200).astype(float)
    w = site_quality.fit_regression(form, site_quality._Sparse(sets, 30), y)
    dense = np.hstack([form, np.array([[float(i in x) for i in range(30)] for x in map(set, sets)]), np.ones((200, 1))])
    p = 1 / (1 + np.exp(-dense @ w))
    assert np.abs(dense.T @ (y - p) - np.append(np.ones(33), 1e-6) * w).max() < 1e-4  # the gradient of the penalised likelihood


def test_posteriors_by_definition(spark):
    """Site sums, moments, shrinkage and posteriors of a whole table, row by row in plain Python."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in site_quality.classify(docs, labels).collect()}
    model = site_quality.fit(docs, labels)
    evidence = site_quality.Evidence(model)
    rows = [(r.doc_id, r.source or "", r.lang or "", evidence.logit((r.text or "").encode())) for r in docs.collect()]
    p = {i: 1 / (1 + math.exp(-x)) for i, _, _, x in rows}
    paths, hosts = {}, {}
    for i, host, path, _ in rows:
        paths.setdefault((host, path), []).append(p[i])
        hosts.setdefault(host, []).append(p[i])
    n, total = len(rows), sum(p.values())
    m = min(max(total / n, 1e-6), 1 - 1e-6)
    between = max((sum(sum(h) ** 2 / len(h) for h in hosts.values()) - total**2 / n - (len(hosts) - 1) * m * (1 - m)) / max(n - sum(len(h) ** 2 for h in hosts.values()) / n, 1e-9), 1e-6)
    within = sum(sum(x) ** 2 / len(x) for x in paths.values()) - sum(sum(h) ** 2 / len(h) for h in hosts.values())
    size = n - sum(sum(len(x) ** 2 for (h, _), x in paths.items() if h == host) / len(own) for host, own in hosts.items())
    inside = max((within - (len(paths) - len(hosts)) * m * (1 - m)) / max(size, 1e-9), 1e-6)
    k_host, k_path = (min(max(m * (1 - m) / v - 1, 2), 1e6) for v in (between, inside))
    for i, host, path, x in rows:
        h = (sum(hosts[host]) - p[i] + k_host * m) / (len(hosts[host]) - 1 + k_host)
        q = (sum(paths[host, path]) - p[i] + k_path * h) / (len(paths[host, path]) - 1 + k_path)
        q = min(max(q, 1e-6), 1 - 1e-6)
        z = x + math.log(q / (1 - q)) - math.log(m / (1 - m))
        score = 1 / (1 + math.exp(-z)) if x > -30 else 0.0
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].kept == (got[i].score >= 0.5)


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "p", -2.0)] * 300 + [("big", "q", 2.0)] * 2 + [("other", "p", 2.0)] * 300 + [("tiny", "p", -2.0)]
    scored = spark.createDataFrame(rows, "host string, path string, __x double")
    got = {(r.host, r.path): r for r in site_quality.sites(scored).collect()}
    rate = lambda r: (r.y + r.k_path * ((r.hy + r.k_host * r.rate) / (r.hn + r.k_host))) / (r.n + r.k_path)
    raw = 1 / (1 + math.exp(2))
    assert abs(rate(got["big", "p"]) - raw) < 0.02
    assert rate(got["tiny", "p"]) > raw + 0.05  # one document moves its site less than 300 do
    assert rate(got["big", "q"]) < 1 - raw


def test_languages(spark, docs, empty):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.identify(big).join(big.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    out = lang_id.identify(docs).collect()
    assert len(out) == docs.count()
    blank = {r.doc_id for r in docs.collect() if not r.text or not any(map(str.isalpha, r.text))}
    assert {r.doc_id for r in out if r.lang_pred == "und"} == blank and all(0 <= r.score <= 1 for r in out)
    assert lang_id.identify(empty).count() == 0
    assert {r.lang_pred for r in lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_terms(text):
    """Buckets of all n-grams, one by one, in Python's integers."""
    import collections

    mask, (m0, m1, m2) = (1 << 32) - 1, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
    c, out = [ord(x) + 1 for x in f" {text.lower()} "], collections.Counter()
    for i in range(len(c)):
        h = c[i] * m0 & mask
        for n in range(3):
            if i + n >= len(c):
                break
            if n:
                h = ((h ^ (h >> 15)) * m1 + c[i + n] * m2) & mask
            out[((h ^ (h >> 16)) * m1 & mask) >> 17] += 1
    return out


def test_predictions_by_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_id.fit(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}
    for r in lang_id.predict(docs, model).collect():
        text = rows[r.doc_id] or ""
        if not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = {k: (1 + math.log(n)) * float(model["idf"][k]) for k, n in brute_terms(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        z = [(sum(x / norm * float(w[k]) for k, x in v.items()) + float(w[-1])) / model["temperature"] for w in model["weights"]]
        e = [math.exp(x - max(z)) for x in z]
        assert r.lang_pred == model["langs"][z.index(max(z))] and r.score == pytest.approx(max(e) / sum(e), abs=1e-4)


def test_terms_don_t_depend_on_stretches():
    text = "Ünïcödé tëxt, 日本語 and ASCII " * 20
    whole = lang_id.term_counts(text)
    for step in (1, 2, 3, 50):
        assert all((a == b).all() for a, b in zip(whole, lang_id.term_counts(text, step), strict=True))
    assert dict(zip(*(x.tolist() for x in whole), strict=True)) == brute_terms(text)


def test_ftrl_by_definition():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(40, 4, replace=False)), np.full(4, 0.5)) for _ in range(30)]
    target = rng.integers(0, 2, 30).tolist()
    got = lang_id.train_ftrl(rows, target, 2, epochs=2, l1=0.05)
    z, n = {}, {}
    weight = lambda key: 0.0 if abs(z.get(key, 0.0)) <= 0.05 else -(z[key] - math.copysign(0.05, z[key])) / ((lang_id.BETA + math.sqrt(n[key])) / lang_id.ALPHA + lang_id.L2)
    order = np.random.default_rng(0)
    for _ in range(2):
        for i in order.permutation(30):
            x = [*zip(rows[i][0].tolist(), rows[i][1].tolist(), strict=True), (lang_id.DIMS, 1.0)]
            w = {(k, c): weight((k, c)) for k, _ in x for c in range(2)}
            logits = [sum(v * w[k, c] for k, v in x) for c in range(2)]
            p = [math.exp(s - max(logits)) for s in logits]
            for c in range(2):
                g = p[c] / sum(p) - (target[i] == c)
                for k, v in x:
                    before = n.get((k, c), 0.0)
                    n[k, c] = before + (g * v) ** 2
                    z[k, c] = z.get((k, c), 0.0) + g * v - (math.sqrt(n[k, c]) - math.sqrt(before)) / lang_id.ALPHA * w[k, c]
    for k, c in z:
        assert got[c, k] == pytest.approx(weight((k, c)), abs=1e-6)


def test_every_language_is_learned(spark):
    word = lambda k, j: chr(0x4E00 + 20 * k + j % 20) * 3
    rows = [(1000 * k + i, " ".join(word(k, i + j) for j in range(12)), f"l{k:03}") for k in range(300) for i in range(20 if k < 256 else 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lang_id.identify(df).join(df.select("doc_id", "lang"), "doc_id")
    right = {r.lang: r.x for r in got.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("x")).collect()}
    assert len(right) == 300 and min(right.values()) > 0.5


def test_rows_of_one_id_are_sampled_by_their_number(spark):
    nameless = spark.range(6000).selectExpr("if(id % 2 = 0, null, id) as doc_id", "concat(if(id % 2 = 0, 'gamma delta ', 'alpha beta '), id) as text", "if(id % 2 = 0, 'b', 'a') as lang")
    model = lang_id.fit(nameless, per_lang=100, per_lang_calibration=20)
    assert {r.lang_pred for r in lang_id.predict(nameless.where("doc_id is null"), model).collect()} == {"b"}
    schema = "t string, l string, h long"
    alike = spark.createDataFrame([("same", "a", -5)] * 3000 + [(f"other {i}", "a", 7919 * 2654435761 * (i + 1) % (1 << 62)) for i in range(6000)], schema)
    _, got = lang_id.choose(alike, 500)
    m = {r.t: r.m for r in got.collect()}
    assert m["same"] in (183, 184) and 300 < sum(m.values()) - m["same"] < 430  # 550 of 9000 rows, a third of them alike
    docs = spark.range(9000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "concat('text ', id) as text", "'a' as lang")
    counts, got = lang_id.choose(lang_id.training_rows(docs), 500)
    share = 550 / counts["a"]
    null = {r.text for r in docs.where("doc_id is null").collect()}
    found = {r.t for r in got.collect()}
    assert abs(len(found & null) - 3000 * share) < 60 and len(found) < 650


def test_penalty_makes_weights_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    rows, target = [], []
    for i in range(300):
        at = np.sort(rng.choice(200, 10, replace=False) + 200 * (i % 2))
        rows.append((at, np.full(10, 0.3)))
        target.append(i % 2)
    dense, sparse = (lang_id.train_ftrl(rows, target, 2, l1=x) for x in (0.0, 0.2))
    assert (sparse != 0).sum() < (dense != 0).sum()
    logits = rng.normal(size=(4000, 3)) * 2
    p = lang_id.softmax(logits)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert lang_id.fit_temperature(logits * 4, y) == pytest.approx(4, rel=0.15)


def test_exponent_meets_the_targets(spark):
    sizes = spark.createDataFrame([("a", 9000), ("b", 900), ("c", 100)], "source string, tokens long")
    p = np.array([0.9, 0.09, 0.01])
    entropy = lambda a: -sum((w := p**a / (p**a).sum()) * np.log(w)) / np.log(3)
    repeat = lambda a: max(p**a / (p**a).sum() / p)
    a = mixing.find_exponent(sizes, max_repeat=1e9, evenness=0.8)
    assert entropy(a) <= 0.8 < entropy(a - 1e-5)
    a = mixing.find_exponent(sizes, max_repeat=3.0, evenness=1.0)
    assert repeat(a) <= 3 < repeat(a - 1e-5)
    a = mixing.find_exponent(sizes, max_repeat=1e9, evenness=0.2)  # sharper than the shares are
    assert 1 < a and entropy(a) <= 0.2 < entropy(a - 1e-5)
    even = spark.createDataFrame([("a", 5), ("b", 5)], "source string, tokens long")
    assert mixing.find_exponent(sizes.where("false")) == mixing.find_exponent(even) == mixing.find_exponent(sizes, budget=9.0, evenness=0.8) == 1.0
    steep = spark.createDataFrame([("a", 500), ("b", 300), ("c", 200)], "source string, tokens long")
    q = np.array([0.5, 0.3, 0.2])
    a = mixing.find_exponent(steep, max_repeat=1.2, evenness=0.3)
    assert 1 < a and max(q**a / (q**a).sum() / q) <= 1.2 < max(q ** (a + 1e-5) / (q ** (a + 1e-5)).sum() / q)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_mixing_takes_effect_on_the_given_tables(spark, sf):
    sf = f"/root/testdata/sf{sf}"
    got = QUERIES["op9_mixing"](spark, sf)
    assert_same(got, connect(sf), ORACLE["op9_mixing"])
    p = got.toPandas()
    w = p.groupby("source").weight.first().to_numpy()
    assert abs(-(w * np.log(w)).sum() / np.log(len(w)) - mixing.TARGET_EVENNESS) < 1e-4
    assert p.exponent.nunique() == 1 and abs(p.exponent.iloc[0] - 1) > 0.1 and p.epoch.max() > 0


def test_mix_follows_its_weights(spark, docs, empty):
    rows = [(i, "w " * (1 + i % 9), "en", "hot" if i % 3 else f"s{i % 4}", 0, "", 0) for i in range(4000)]
    df = spark.createDataFrame(rows, docs.schema)
    got = mixing.mix(df, max_repeat=3.0, evenness=0.9).toPandas()
    share = got.groupby("source").n_tokens.sum() / got.n_tokens.sum()
    weight = got.groupby("source").weight.first()
    assert np.allclose(share, weight, atol=0.02) and got.slot.between(0, 1).all()
    whole = got.groupby(["source", "epoch"]).doc_id.nunique()
    assert not got.duplicated(["doc_id", "epoch"]).any() and whole.loc["hot"].max() <= 2667
    assert mixing.mix(docs).count() > 0 and mixing.mix(empty).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns
