import os
import random

import numpy as np
from pyspark.sql import functions as F

from tabspark.llm import quality as Q


def test_statistics_of_odd_texts():
    for text in (None, "", " \n", "a", "a a", "x " * 40_000, "É!!\n\n| 12 |", "😀" * 5000):
        x = Q.statistics(text)
        assert len(x) == len(Q.STATISTICS) and np.isfinite(x).all()
    a = dict(zip(Q.STATISTICS, Q.statistics("One two two.\nOne two two.\nOne one")))
    assert a["bigrams"] > 0 and abs(a["line_copies"] - np.arcsin(np.sqrt(1 / 3))) < 1e-12


def sample(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        words = [rng.choice("the of a in".split()) if rng.random() < 0.4 else f"w{rng.randrange(900)}" for _ in range(60)]
        if i % 4 == 0:
            words = [w.upper() + "!!" for w in words[:20]] * 3
        rows.append((i, " ".join(words), int(i % 4 != 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5)


def test_fit_equals_numpy_and_separates(spark):
    df = sample(spark).withColumns({"x": F.lit("clash"), "y": F.lit(0)})
    stats = Q.with_statistics(df)
    labelled = stats.join(df.select("doc_id", F.col("quality").alias("label")), "doc_id")
    model = Q.fit(labelled)
    rows = labelled.collect()
    for k in (0, 1):
        x = np.array([r.x for r in rows if r.label == k])
        assert np.allclose(model.means[k], x.mean(axis=0)) and np.allclose(model.covariances[k], np.cov(x.T, bias=True), atol=1e-9)
    # log-density difference against a direct solve
    pooled = sum(n * c for n, c in zip(model.sizes, model.covariances)) / model.sizes.sum()
    x, logs = np.array([r.x for r in rows[:20]]), []
    for k in (0, 1):
        s = (1 - Q.SHRINKAGE) * model.covariances[k] + Q.SHRINKAGE * pooled + Q.RIDGE * np.diag(np.maximum(np.diag(pooled), 1e-9))
        d = x - model.means[k]
        logs.append(np.log(model.sizes[k]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(s, d.T).T))
    want = 1 / (1 + np.exp(-np.clip(Q.TEMPERATURE * (logs[1] - logs[0]), -50, 50)))
    assert np.allclose(model.scores(x), want, atol=1e-6)
    got = {r.doc_id: r.score for r in Q.score(stats, model).collect()}
    assert np.mean([(got[r.doc_id] >= Q.THRESHOLD) == bool(r.label) for r in rows]) > 0.99


def test_without_classes(spark):
    empty = spark.createDataFrame([], "doc_id long, x array<double>, label int")
    model = Q.fit(empty)
    assert model.scores(np.zeros((2, len(Q.STATISTICS)))).tolist() == [0.5, 0.5]
    stats = Q.with_statistics(spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string"))
    one = Q.fit(stats.withColumn("label", F.lit(1)))
    assert all(0 < r.score < 1 for r in Q.score(stats, one).collect())
    assert Q.fit(stats.withColumn("label", F.lit(None).cast("int"))).sizes.sum() == 0


def test_held_out_accuracy(spark):
    from tabspark.llm.q_quality import op2_quality

    root = "/root/testdata/sf0.01"
    if not os.path.isdir(root):
        return
    labels = spark.read.parquet(f"{root}/labels.parquet")
    got = op2_quality(spark, root).filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(got) > 40 and np.mean([r.predicted == r.quality for r in got]) > 0.95
