"""Language model, near duplicates and the pipeline against brute force."""

import collections
import math
import zlib

import pytest

from cohortlab.llm import backoff_lm, ngram_join

SF = "/root/testdata/sf0.001"


def brute_scores(rows, order, mu):
    tokens, counts, known = {}, [collections.Counter() for _ in range(order + 1)], {}
    for k, (i, t) in enumerate(rows):
        tokens[k] = [*(t or "").encode().lower().split(), None]
        known[k] = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        if not known[k]:
            w = ["<s>", *tokens[k]]
            for n in range(1, order + 1):
                for j in range(len(w)):
                    if j - n + 1 >= 0 and (n > 1 or j):
                        counts[n][tuple(w[j - n + 1 : j + 1])] += 1
            counts[1][("<s>",)] += 1
    start = counts[1].pop(("<s>",), 0)
    total, v = sum(counts[1].values()), len(counts[1])
    unknown = min((sum(x == 1 for x in counts[1].values()) + 0.5) / (total + 1), 0.5) if total else 0.5
    out = []
    for k, (i, _) in enumerate(rows):
        w, s, b = ["<s>", *tokens[k]], 0.0, 0.0
        for j in range(1, len(w)):
            c = counts[1][(w[j],)]
            b += math.log10((c + 0.1) / (total + 0.1 * (v + 1)))
            p = (1 - unknown) * c / total if c else unknown
            for n in range(2, order + 1):
                if j - n + 1 < 0:
                    break
                h = tuple(w[j - n + 1 : j])
                ch = start if h == ("<s>",) else counts[n - 1][h]
                if ch:
                    p = (counts[n][(*h, w[j])] + mu * p) / (ch + mu)
            s += math.log10(p)
        out.append((i, known[k], len(w) - 1, sum(counts[1][(x,)] > 0 for x in w[1:]), total, round(b, 6), round(s, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores(spark, docs, order):
    df = docs.select("doc_id", "text", "kept", "id").unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "'' as kept", "doc_id as id").limit(60))
    got = [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in backoff_lm.score_texts(df, order=order, chunk_bytes=20_000, least_buckets=5).collect()]
    assert sorted(got, key=repr) == brute_scores([(r.doc_id, r.text) for r in df.collect()], order, backoff_lm.MU)


def test_scores_are_of_order_3(spark):
    df = spark.createDataFrame([(i, "a b c a b d a b c") for i in range(1, 30)], "doc_id long, text string")
    got = [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in backoff_lm.score_texts(df).collect()]
    assert sorted(got, key=repr) == brute_scores([(r.doc_id, r.text) for r in df.collect()], 3, backoff_lm.MU)


def test_one_traversal_carries_the_state(spark, tmp_path):
    """States, arcs and failure arcs of a small corpus, stepped word by word, against their definition."""
    import numpy as np

    from cohortlab.llm._files import Reader

    rows = [(i, t) for i, t in enumerate(["a b c a b d a b c a x", "b c a b", "a a a b", "zz yy a b c d e f", ""] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    row = backoff_lm.to_chunks(df, f"file://{tmp_path}").first()
    chunk = backoff_lm._Chunk(Reader(str(tmp_path)).read(row.name, row.offset, row.length), 3)
    counts = [chunk.counts(n).astype(float) for n in (1, 2, 3)]
    machine = backoff_lm.Automaton(chunk, counts, int(counts[0].sum()), 0.1, row.training)
    assert len(machine.at) > 10 and (machine.loss[machine.fail > 0] < 0).any()
    whole = []
    scores = machine.score(chunk.words, chunk.lens, lane=10**6, visited=whole)
    after = {int(p): int(s) for ps, ss in whole for p, s in zip(ps, ss, strict=True)}
    assert len(after) == chunk.lens.sum() and len(set(after.values())) > 8
    for lane in (1, 2, 3):
        assert np.allclose(machine.score(chunk.words, chunk.lens, lane=lane), scores)
    base2 = 2 + len(chunk.keys[0])
    for p, s in after.items():
        if chunk.words[p]:  # the longest suffix that training has
            long, short = chunk.place[1][p], chunk.place[0][p]
            assert s == (base2 + long if counts[1][long] else 2 + short if counts[0][short] else 0)


def test_nothing_to_learn_from(spark, empty):
    assert backoff_lm.score_texts(empty).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    df = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known, r.base_score) for r in backoff_lm.score_texts(df).collect()} == {(0, 0, 0.0)}


def brute_links(rows, n=5, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    root, links = {i: i for i in sets}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), links[i]) for i in sets}


def test_join_finds_all_links(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    for i in range(60):  # a group of near copies, larger than a block
        words = list(base)
        for _ in range(rnd.randrange(5)):
            words[rnd.randrange(len(words))] = f"v{i}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000, "one two"), (20_001, "ONE  two"), (20_002, ""), (20_003, None), (20_004, " ")]
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "VERIFY_BLOCK", 8)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, key string, id int")
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()} == brute_links(rows)


def test_join_edges(spark, docs, empty):
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r.n_links for r in got if r.doc_id in (4, 5)} == {2}  # 4, 5 and the repeated 4
    assert {(r.class_id, r.n_links) for r in got if r.doc_id is None} == {(None, 0)}
    assert ngram_join.near_duplicates(empty).count() == 0
    assert {r.n_links for r in ngram_join.near_duplicates(docs.where("length(text) < 2")).collect()} == {0}


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.9, 0.99), (0.5, 0.9)):
        b, r = ngram_join.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**r) ** b >= recall and b * r <= ngram_join.MOST_HASHES
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.1, 0.9999, 4)


def test_one_of_each_class_where_ids_repeat(spark):
    import corpus_pipeline

    text = lambda c: " ".join(f"{c}{i}" for i in range(100))
    a, b, c, d = map(text, "abcd")
    rows = [(1, a), (1, f"{a} end"), (2, b), (3, f"{b} end"), (3, c), (None, d), (None, f"{d} end"), (4, f"{a} more"), (2, b)]
    got = [tuple(r) for r in corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()]
    assert len(got) == 4 and {i for i, _ in got} == {1, 2, 3, None} and {t.split()[0] for _, t in got} == {"a0", "b0", "c0", "d0"}


def test_a_null_id_is_nobody_elses(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (42, text), (None, None), (None, ""), (7, None), (7, None)]
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, text), (None, None), (None, ""), (7, None), (7, None)], key=repr)


def test_pipeline_on_an_awkward_table(spark, docs, empty):
    import corpus_pipeline
    from cohortlab.llm._common import save

    more = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 100))
    for table in (more, empty):
        df = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = save(stage(spark, df, SF), "awkward")
            assert i == 4 or df.columns == docs.columns
            assert i == 4 or stage(spark, table, SF).columns == docs.columns
    assert corpus_pipeline.encode(spark, more, SF).count() == more.count()
    kept = corpus_pipeline.one_of_each(spark, more, SF)
    words = {" ".join(r.text.lower().encode().decode().split()) for r in more.collect() if r.text and r.text.split()}
    assert 0 < kept.where("text is not null").count() <= len(words) + 2 * 4


def test_links_at_a_larger_scale_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_links([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == want and sum(n > 0 for _, n in want.values()) > 50


def test_pipeline_stages(spark):
    import corpus_pipeline
    from cohortlab.llm._common import save, table

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").toPandas().set_index("doc_id")
    clean = set(labels[(labels.quality == 1) & (labels.toxic == 0)].index)
    names, before = docs.columns, None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = save(stage(spark, docs, sf), "test-stage")
        if i == 4:
            break
        assert docs.columns == names
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        if i == 1:
            assert len(clean & {d for d, _ in rows}) >= 0.93 * len(clean)
        if i == 2:  # one document of each class that brute force finds, the least
            assert {d for d, _ in rows} == {c for c, _ in brute_links(before).values()} and len(rows) == len({d for d, _ in rows})
        before = rows
    assert docs.count() == len(before)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_a_sieve_lets_all_through_that_are_listed(spark):
    from cohortlab.llm._common import sieved

    df = spark.range(40_000).selectExpr("if(id = 7, null, id) as id", "md5(cast(id as string)) as h")
    listed = df.where("id is null or id % 10 = 3")
    got = sieved(df, listed, ["id", "h"])
    assert got.count() == 40_000 and got.columns == ["id", "h", "__maybe"]
    assert got.where("(id is null or id % 10 = 3) and not __maybe").isEmpty()
    assert 0 < got.where("__maybe").count() - 4001 < 36_000 / 12
    assert sieved(df, listed.limit(0), ["id", "h"]).where("__maybe").isEmpty()


def test_near_duplicates_leave_no_minima_and_shuffle_few_texts(spark, tmp_path, monkeypatch):
    """Texts without near copies are not shuffled, and tables with minima or bands are gone when texts are."""
    from cohortlab.llm import ngram_join
    from cohortlab.sources import work

    docs = spark.range(400).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 40), i -> concat('w', cast(if(id < 20, 0, id) as string), '_', cast(i as string))), if(id < 20, cast(id as string), null)) as text")
    monkeypatch.setattr(work, "shared_dir", lambda _: f"file://{tmp_path}")
    seen, links = [], ngram_join.verified_links

    def spied(units, threshold):
        seen.append(sorted(p.name.split("-")[0] for p in tmp_path.iterdir()))
        return links(units, threshold)

    sets, texts = ngram_join._sets, []

    def sifted(docs, wanted, *rest):
        asked = wanted.selectExpr("first_id as id", "first_h as h")
        texts.append(ngram_join.sieved(ngram_join._texts(docs, "doc_id", "text"), asked, ["id", "h"]).where("__maybe").count())
        return sets(docs, wanted, *rest)

    monkeypatch.setattr(ngram_join, "verified_links", spied)
    monkeypatch.setattr(ngram_join, "_sets", sifted)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: (0, 19) if i < 20 else (i, 0) for i in range(400)}
    assert not {"minima", "bands", "classes", "buckets"} & set(seen[0]) and 20 <= texts[0] < 60
