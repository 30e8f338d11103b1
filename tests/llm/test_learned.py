"""Classifiers: held-out accuracy, edge cases, and the pipeline against its own stages."""

import zlib

import numpy as np
import pyarrow.parquet as pq

from gridverity.llm import quality, toxicity
from gridverity.llm.learning import fit_dense, fit_sparse


def auc(y, s):
    order = np.argsort(s, kind="stable")
    y, s = np.asarray(y)[order], np.asarray(s)[order]
    _, back, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[back]
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_fits_separate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - 2 * x[:, 1] > 0).astype(float)
    w = fit_dense(x, y)
    assert auc(y, x @ w[:-1] + w[-1]) > 0.99
    row, col = np.nonzero(x > 0)
    first = np.searchsorted(row, np.arange(401))
    w, b = fit_sparse(first, col, np.ones(3), y)
    assert auc(y, np.bincount(row, w[col], 400) + b) > 0.85 and np.abs(w).max() < 5
    assert np.allclose(fit_sparse(first, col, np.ones(3), y)[0], w)


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op1_toxicity(spark, d).toPandas().set_index("doc_id")
    lab = pq.read_table(f"{d}/labels.parquet").to_pandas().set_index("doc_id")
    held = [i for i in lab.index if zlib.crc32(str(i).encode()) % 4 == 2]
    assert got.held_out.loc[held].all() and got.score.between(0, 1).all() and len(got) == 10000
    y, p = lab.toxic.loc[held].to_numpy(), got.predicted.loc[held].to_numpy()
    assert auc(y, got.score.loc[held]) > 0.95
    assert (p & y).sum() / y.sum() > 0.8 and (p & (1 - y)).sum() / (1 - y).sum() < 0.05


def test_toxicity_edges(spark, docs_of, texts, labels):
    df = docs_of(texts)
    got = toxicity.add_score(df, labels)
    assert got.columns == [*df.columns, "score"] and got.count() == len(texts)
    empty = got.where("coalesce(text, '') = ''").select("score").distinct().count()
    assert empty == 1
    none = toxicity.add_score(df, labels.where("false"))
    assert none.select("score").distinct().collect()[0][0] == 0.5
    assert toxicity.add_score(docs_of([]), labels).count() == 0


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    got = quality.op5_quality(spark, d).toPandas().set_index("doc_id")
    lab = pq.read_table(f"{d}/labels.parquet").to_pandas().set_index("doc_id")
    held = [i for i in lab.index if zlib.crc32(str(i).encode()) % 4 == 2]
    y, keep = lab.quality.loc[held].to_numpy(), got.keep.loc[held].to_numpy()
    assert auc(y, got.score.loc[held]) > 0.98 and keep[y == 1].mean() > 0.99 and keep[y == 0].mean() < 0.1


def test_quality_edges(spark, docs_of, texts, labels):
    df = docs_of(texts + [(None, "x")])
    got = quality.judge(df, labels)
    assert set(df.columns) < set(got.columns) and got.count() == len(texts) + 1
    assert got.where("score is null or keep is null").count() == 0
    assert quality.judge(df, labels.where("false")).where("evidence != 0").count() == 0
    assert quality.judge(docs_of([]), labels).count() == 0


def test_sparse_sites_shrink_to_their_parents(spark):
    rows = [("a", "x", 1.0)] * 500 + [("a", "y", 0.0)] + [("b", "x", 0.0)] * 300 + [("c", "z", 0.0)]
    table, _, _ = quality.sites(spark.createDataFrame(rows, "host string, path string, good double"), 0.6)
    got = {(r.host, r.path): r for r in table.collect()}
    assert got[("a", "x")].path_rate > 0.95 and got[("b", "x")].path_rate < 0.05
    assert got[("c", "z")].host_rate > got[("b", "x")].host_rate  # one document says little
    assert got[("a", "y")].path_rate > got[("a", "y")].host_rate * 0.3


def grams(t):
    t = "".join(" " if c.isspace() else c.lower() if len(c.lower()) == 1 else c for c in t or "") + " "  # a text ends with one separator
    return {t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)}


def test_toxicity_against_brute_force(spark, docs_of):
    """Ratios, features and scores computed again on n-grams as strings, and the fit's first-order conditions."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    clean, bad = [f"w{i}" for i in range(60)], ["vile", "nasty", "hate"]
    rows = []
    for i in range(400):
        words = [rng.choice(clean) for _ in range(rng.randrange(3, 12))] + ([rng.choice(bad)] if i % 3 == 0 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    df = docs_of(rows)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    learnt = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    slots, weights, intercept = toxicity.fit_distributed(df, labels)
    y = {i: int(i % 3 == 0) for i, _ in rows}
    n1 = sum(y[i] for i in learnt)
    n0 = len(learnt) - n1
    slot_of = lambda g: int(toxicity.gram_slots(np.array([ord(c) for c in g], np.uint32), len(g))[0])
    sets = {i: {slot_of(g) for g in grams(t)} for i, t in rows}
    p, q = {}, {}
    for i in learnt:
        for s in sets[i]:
            side = p if y[i] else q
            side[s] = side.get(s, 0) + 1
    surprise = {}
    for s in set(p) | set(q):
        a, b = p.get(s, 0), q.get(s, 0)
        if a + b >= toxicity.MIN_DOCUMENTS:
            share = (a + b + 1) / (n1 + n0 + 2)
            surprise[s] = abs(a / n1 - b / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    bound = toxicity.chance_bound(np.array(sorted(surprise.values())))
    assert set(slots.tolist()) == {s for s, z in surprise.items() if z > bound}
    ratio = {s: np.log((p.get(s, 0) + 1) / (n1 + 2)) - np.log((q.get(s, 0) + 1) / (n0 + 2)) for s in slots.tolist()}
    w = dict(zip(slots.tolist(), weights.tolist()))
    rate = n1 / len(learnt)
    z = {i: intercept + sum(w[s] for s in sets[i] if s in w) for i, _ in rows}
    # first-order conditions of the penalised logistic loss in the scaled features, at the sample's own prior
    shift = np.log(rate / (1 - rate)) - np.log(n1 / n0)
    error = {i: 1 / (1 + np.exp(-(z[i] - shift))) - y[i] for i in learnt}
    for s in list(w)[:40]:
        assert abs(ratio[s] * sum(error[i] for i in learnt if s in sets[i]) + w[s] / ratio[s]) < 0.2
    got = {r.doc_id: r.score for r in toxicity.add_score(df, labels).collect()}
    assert all(abs(got[i] - 1 / (1 + np.exp(-z[i]))) < 1e-9 for i, _ in rows)
    held = [i for i, _ in rows if i not in learnt]
    assert np.mean([(got[i] >= 0.3) == y[i] for i in held]) > 0.95
    twice = df.unionByName(df).withColumn("score", F.lit(7.0))
    again = toxicity.add_score(twice, labels).groupBy("doc_id").agg(F.min("score").alias("a"), F.max("score").alias("b"), F.count("score").alias("n"))
    assert again.where("a != b or n != 2").count() == 0


def test_quality_against_brute_force(spark, docs_of, labels):
    """Posteriors and scores computed again in Python from the operator's evidence."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, None if i == 7 else " ".join(rng.choice(["good", "text", "words", "!!", "#", "9"]) for _ in range(rng.randrange(0, 30)))) for i in range(120)]
    df = docs_of(rows + rows[:3]).withColumn("source", F.when(F.col("doc_id") % 50 == 0, None).otherwise(F.concat(F.lit("h"), F.pmod("doc_id", F.lit(4)))))
    df = df.withColumn("lang", F.concat(F.lit("p"), F.pmod("doc_id", F.lit(7))))
    got = quality.judge(df, labels).collect()
    assert len(got) == 123
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            known.setdefault(r.doc_id, []).append(r.quality)
    flat = [v for vs in known.values() for v in vs]
    rate = sum(flat) / len(flat)
    good = lambda r: 1 / (1 + np.exp(-(r.evidence + np.log(rate / (1 - rate)))))
    paths, hosts = {}, {}
    for r in got:
        for table, key in ((paths, (r.source, r.lang)), (hosts, r.source)):
            k, n = table.get(key, (0.0, 0))
            table[key] = (k + good(r), n + 1)

    def strength(sites, parent):
        between = sum(n * (k / n - parent(s)) ** 2 for s, (k, n) in sites.items())
        noise = sum(parent(s) * (1 - parent(s)) for s in sites)
        whole = sum(n * parent(s) * (1 - parent(s)) for s, (_, n) in sites.items())
        return 10_000.0 if between <= noise else min(10_000.0, max(1.0, whole / (between - noise)))

    a = strength(hosts, lambda s: rate)
    host_rate = {s: (k + a * rate) / (n + a) for s, (k, n) in hosts.items()}
    b = strength(paths, lambda s: host_rate[s[0]])
    for r in got:
        g = good(r)
        k, n = hosts[r.source]
        m = (k - g + a * rate) / (n - 1 + a)
        k, n = paths[r.source, r.lang]
        path = min(max((k - g + b * m) / (n - 1 + b), 1e-4), 1 - 1e-4)
        score = 1 / (1 + np.exp(-(r.evidence + np.log(path / (1 - path)))))
        assert abs(r.host_rate - m) < 1e-9 and abs(r.score - score) < 1e-9 and r.keep == (r.score >= 0.5)


def test_filters_keep_all_columns(spark, docs_of, texts, labels):
    """Columns that are called as an operator's own keep their values."""
    from pyspark.sql import functions as F

    from gridverity.llm.near_duplicates import keep_one

    names = ["evidence", "host_rate", "path_rate", "score", "keep", "__k", "__row", "__host", "__good", "toxicity", "__n"]
    df = docs_of(texts).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for out in (quality.keep_good(df, labels), keep_one(df)):
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)


def test_look_up_splits_hot_keys(spark, monkeypatch):
    from gridverity.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    left = spark.createDataFrame([(0, i) for i in range(500)] + [(i, i) for i in range(100)] + [(None, 1)], "k int, v int")
    right = spark.createDataFrame([(i, i * 10) for i in range(60)], "k int, w int")
    for how in ("left", "inner"):
        want = left.join(right, "k", how)
        got = common.look_up(left, right, ["k"], how)
        assert sorted(map(repr, got.select("k", "v", "w").collect())) == sorted(map(repr, want.select("k", "v", "w").collect()))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "toxicity", "SimHash near-dedup", "suffix-array dedup", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns
        ids = {r.doc_id for r in before.collect()}
        kept = {r.doc_id for r in after.collect()}
        assert kept <= ids and len(kept) > 0.6 * len(ids)
        if name == "suffix-array dedup":
            assert kept == ids and all(r.n_chars == len(r.text) for r in after.collect())
        before = after
    packed = corpus_pipeline.packing_stage(spark, before, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}
    total = lambda df: df.selectExpr("sum(length)").first()[0]
    assert total(corpus_pipeline.run(spark, sf_dir)) == total(packed)


def test_pipeline_on_odd_tables(spark, docs_of, texts, labels, tmp_path):
    """Null and empty texts, repeated rows, null and repeated ids, clashing columns, and an empty table through run()."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    labels.write.parquet(str(tmp_path / "odd" / "labels.parquet"))
    odd = [*texts, *texts[:5], (None, texts[3][1]), (None, None), (4, "another text of this id")]
    docs_of(odd).withColumns({"score": F.lit("x"), "keep": F.lit(0)}).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in out} <= {i for i, _ in odd} and out
    labels.write.parquet(str(tmp_path / "none" / "labels.parquet"))
    docs_of([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
