"""Re-ranking with factors, the grouped ranker and the experiment driver, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.operators import evaluation, experiments, feed, ranking

ROWS = "request_id int, article_id string, relevance double, topics array<int>, factors array<double>"


def similarity(a, b, factors):
    if factors and a[4] and b[4] and any(a[4]) and any(b[4]):
        x, y = np.array(a[4]), np.array(b[4])
        return min(1.0, max(0.0, float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y))))
    union = set(a[3] or ()) | set(b[3] or ())
    return len(set(a[3]) & set(b[3])) / len(union) if union and a[3] and b[3] else 0.0


def greedy(rows, limit, penalty, factors):
    left, near, out = list(rows), {r[1]: 0.0 for r in rows}, []
    while left and len(out) < limit:
        best = min(left, key=lambda r: (-round(r[2] - penalty * near[r[1]], 9), -r[2], r[1]))
        left.remove(best)
        out.append((best[1], pytest.approx(near[best[1]])))
        for r in left:
            near[r[1]] = max(near[r[1]], similarity(best, r, factors))
    return out


@pytest.mark.parametrize("factors", [False, True])
def test_mmr_equals_a_greedy_choice(spark, factors):
    rng = random.Random(3)
    topics, vectors = [[], [1], [1, 2], [2, 3, 3], [4]], [None, [], [0.0, 0.0], [1.0, 2.0], [2.0, -1.0], [-1.0, 1.0], [3.0, 1.0]]
    rows = [(q, f"N{i}", round(rng.random(), 1), rng.choice(topics), rng.choice(vectors)) for q in range(40) for i in rng.sample(range(1000), rng.randrange(1, 40))]
    frame = spark.createDataFrame(rows, ROWS)
    got = {}
    for r in feed.rerank_mmr(frame if factors else frame.drop("factors"), 7, 0.3).orderBy("rank").collect():
        got.setdefault(r.request_id, []).append((r.article_id, r.max_similarity))
    for q in range(40):
        want = greedy([r for r in rows if r[0] == q], 7, 0.3, factors)
        assert [x[1] for x in got[q]] == [x[1] for x in want] and [x[0] for x in got[q]] == [x[0] for x in want]
    with pytest.raises(ValueError):
        feed.rerank_mmr(frame, 7, -0.1)
    assert feed.rerank_mmr(frame.where("false"), 7, 0.1).count() == 0


def gradients(labels, scores):
    n = len(labels)
    order = sorted(range(n), key=lambda i: (-scores[i], i))
    rank = {i: k + 1 for k, i in enumerate(order)}
    ideal = sum((2**y - 1) / math.log2(k + 2) for k, y in enumerate(sorted(labels, reverse=True)))
    g, h = [0.0] * n, [0.0] * n
    for i in range(n):
        for j in range(n):
            if labels[i] > labels[j] and ideal:
                swap = abs(2 ** labels[i] - 2 ** labels[j]) * abs(1 / math.log2(1 + rank[i]) - 1 / math.log2(1 + rank[j])) / ideal
                p = 1 / (1 + math.exp(scores[i] - scores[j]))
                g[i] -= p * swap
                g[j] += p * swap
                h[i] += p * (1 - p) * swap
                h[j] += p * (1 - p) * swap
    return g, h


def test_pair_gradients_equal_plain_python():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randrange(1, 12)
        labels, scores = [rng.randrange(3) for _ in range(n)], [rng.choice([0.0, 0.5, rng.gauss(0, 2)]) for _ in range(n)]
        g, h = ranking.pair_gradients(np.array(labels), np.array(scores))
        want = gradients(labels, scores)
        assert g == pytest.approx(want[0]) and h == pytest.approx(want[1]) and g.sum() == pytest.approx(0)


def test_grouped_ranker_beats_pointwise_trees_where_requests_differ(spark):
    """How often a request is clicked at all says nothing about which of its articles are: a pointwise model spends its
    splits on it, a grouped one sees only what differs within a request."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(1)
    rows = []
    for q in range(500):
        eager = rng.integers(1, 8)  # clicks of this request
        x = rng.normal(size=9)
        clicked = np.argsort(-x - 1.2 * rng.normal(size=9))[:eager]
        rows += [(q, i, int(i in clicked), float(x[i] * 0.5), float(eager), float(rng.normal())) for i in range(9)]
    data = spark.createDataFrame(rows, "request_id int, article_id int, label int, x double, eager double, noise double")
    train, test, names = data.where("request_id < 350"), data.where("request_id >= 350"), ["x", "eager", "noise"]
    ranker = ranking.fit_lambdarank(train, names, rounds=8, depth=2, rate=0.2)
    ndcg = lambda scored: evaluation.request_metrics(evaluation.ranked(scored, "request_id", "score", "article_id"), "request_id", "label", (5,)).agg(F.avg("ndcg_5")).first()[0]
    grouped = ndcg(ranking.score_rows(test, ranker, ["request_id", "article_id", "label"]))
    assemble = VectorAssembler(inputCols=names, outputCol="v")
    model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=8, maxDepth=2, stepSize=0.2, seed=1).fit(assemble.transform(train))
    pointwise = ndcg(model.transform(assemble.transform(test)).withColumn("score", vector_to_array("probability")[1]))
    assert grouped > pointwise and all(f != 1 for t in ranker.trees for f, _ in t.splits.values())
    assert ranking.fit_lambdarank(train.where("false"), names).trees == []


def test_measures_of_arms(spark):
    rows = [("q", i, int(i in (2, 3)), c, [c, s], 1.0 - i / 10, float(i)) for i, c, s in ((1, "a", "x"), (2, "a", "y"), (3, "b", "z"))] + [("none", 1, 0, "a", ["a"], 0.5, 0.5)]
    candidates = spark.createDataFrame(rows, "request_id string, article_id int, label int, category string, topics array<string>, down double, up double")
    ranked = experiments.rank_arms(candidates, {"down": F.col("down"), "up": F.col("up")}, ["label", "category", "topics"])
    got = {(r.arm, r.metric): r.value for r in experiments.measure(ranked, [], (1, 2), 2).collect()}
    assert got["down", "requests"] == 1 and got["down", "mrr"] == 0.5 and got["up", "mrr"] == 1
    assert (got["down", "recall_1"], got["down", "recall_2"], got["up", "recall_2"]) == (0, 0.5, 1)
    assert (got["down", "category_diversity"], got["down", "topic_coverage"], got["up", "topic_coverage"]) == (1, 3, 4)
    assert got["down", "similarity"] == pytest.approx(1 / 3, abs=1e-6) and got["up", "similarity"] == 0
    mmr = experiments.with_mmr(ranked.where("arm = 'down'"), "mmr", 1.0, 2, "topics").where("request_id = 'q'").orderBy("rank").collect()
    assert [r.article_id for r in mmr] == [1, 3, 2]
    same = experiments.compare_arms(ranked, "down", "down", (1,), iterations=20).collect()
    assert all(r.delta == 0 and r.direction == "open" for r in same)
    with pytest.raises(ValueError, match="same requests"):
        experiments.compare_arms(ranked.where("arm = 'up' OR request_id <> 'q'"), "down", "up", (1,))


def test_penalty_that_is_kept(spark):
    arms = {"base": (None, 0.5, 3.0, 0.40), "drops": (0.9, 0.1, 9.0, 0.39), "worse": (0.1, 0.6, 3.0, 0.41), "fine": (0.2, 0.4, 3.0, 0.399), "best": (0.3, 0.3, 3.0, 0.3985), "tied": (0.4, 0.3, 3.0, 0.3985)}
    rows = [(a, p, m, v) for a, (p, *values) in arms.items() for m, v in zip(("similarity", "topic_coverage", "recall_5"), values, strict=True)]
    sweep = spark.createDataFrame(rows, "arm string, penalty double, metric string, value double")
    assert experiments.choose_penalty(sweep, "base", 5).first() == ("best", 0.3)
    assert experiments.choose_penalty(sweep.where("arm in ('base', 'worse', 'drops')"), "base", 5).first() is None


def test_gradients_of_many_requests_equal_those_of_each():
    rng = np.random.default_rng(4)
    size = np.r_[rng.integers(1, 9, 200), 300, 0, 40]
    labels, scores = rng.integers(0, 3, size.sum()), np.round(rng.normal(size=size.sum()), 1)
    labels[: size[:20].sum()] = 0
    g, h = ranking.gradients(labels, scores, size)
    ends = np.cumsum(size)
    each = [ranking.pair_gradients(labels[b - n : b], scores[b - n : b]) for n, b in zip(size, ends, strict=True)]
    assert np.allclose(g, np.concatenate([x[0] for x in each])) and np.allclose(h, np.concatenate([x[1] for x in each]))


def test_arms_are_shuffled_by_request_before_they_are_ranked(spark):
    """One shuffle of the candidates, and none of the rows of each arm."""
    rows = spark.createDataFrame([(q, i, i % 2, "c", [q, i]) for q in range(30) for i in range(4)], "request_id int, article_id int, label int, category string, topics array<int>")
    ranked = experiments.rank_arms(rows, {"up": F.col("article_id"), "down": -F.col("article_id")}, ["label", "category", "topics"])
    measured = experiments.measure(ranked, [], (1, 2), 2)
    plan = measured._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(request_id") == 1 and "Join" not in plan
    got = {(r.arm, r.metric): r.value for r in measured.collect()}
    assert got["down", "recall_1"] == 0.0 and got["up", "recall_2"] == 0.5 and got["up", "mrr"] == 1.0 and got["up", "requests"] == 30


def test_staging_gives_the_rows_and_the_setting_back(spark):
    from presswork.sources import logs

    before = spark.conf.get(logs._CLEANUP, "false")
    rows = logs.staged(spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count(), "rows")
    assert rows.count() == 7 and spark.conf.get(logs._CLEANUP, "false") == before


def test_lists_are_compared_many_at_a_time_as_pairs_are(spark):
    from presswork.functions import text

    kinds = [["a", "b"], ["b", "a", "a"], ["c", None], [None], [], ["a", "c"]]
    rows = [(r, k, kinds[(r * 5 + k * k) % 6], f"c{k % 2}") for r in range(40) for k in range(1, r % 7 + 1)]
    ranking = spark.createDataFrame(rows, "request_id int, rank int, topics array<string>, category string")
    quality = experiments.list_quality(ranking, ["request_id"], "topics", 5)
    assert "ArrowEvalPython" in quality._jdf.queryExecution().toString()
    a, b = (ranking.where("rank <= 5").select("request_id", F.col("rank").alias(f"r{x}"), F.col("topics").alias(f"t{x}")) for x in "ab")
    pairs = a.join(b, "request_id").where("ra < rb").groupBy("request_id").agg(F.avg(text.jaccard(F.col("ta"), F.col("tb"))).alias("s"))
    want = {r.request_id: r.s for r in pairs.collect()}
    got = {r.request_id: r.similarity for r in quality.collect()}
    assert len(got) == len({r for r, *_ in rows}) and all(abs(s - want.get(r, 0.0)) < 1e-12 for r, s in got.items())


def test_lists_with_factors_are_compared_many_at_a_time(spark):
    """Pairs with factors went through functions of arrays, a list at a time."""
    from presswork.functions import text

    rng = np.random.default_rng(2)
    vector = lambda r, k: None if (r + k) % 5 == 0 else [0.0] * 3 if (r + k) % 7 == 0 else rng.normal(size=3).tolist()
    rows = [(r, k, [["a", "b"], ["b"], ["c", "a"], []][(r + k) % 4], f"c{k % 2}", vector(r, k)) for r in range(30) for k in range(1, r % 7 + 1)]
    ranking = spark.createDataFrame(rows, "request_id int, rank int, topics array<string>, category string, factors array<float>")
    quality = experiments.list_quality(ranking, ["request_id"], "topics", 5)
    assert "ArrowEvalPython" in quality._jdf.queryExecution().toString()
    a, b = (ranking.where("rank <= 5").select("request_id", F.col("rank").alias(f"r{x}"), F.col("topics").alias(f"t{x}"), F.col("factors").cast("array<double>").alias(f"f{x}")) for x in "ab")
    alike = text.hybrid_similarity(text.cosine(F.col("fa"), F.col("fb")), F.col("ta"), F.col("tb"))
    want = {r.request_id: r.s for r in a.join(b, "request_id").where("ra < rb").groupBy("request_id").agg(F.avg(alike).alias("s")).collect()}
    got = {r.request_id: r.similarity for r in quality.collect()}
    assert len(got) == 25 and all(abs(s - want.get(r, 0.0)) < 1e-6 for r, s in got.items())
    dots = ranking.select(experiments.product(F.col("factors"), F.col("factors")).alias("p"), "factors").collect()
    assert all((r.p is None) == (r.factors is None) and (r.p is None or r.p == pytest.approx(sum(x * x for x in r.factors))) for r in dots)


def test_all_penalties_take_one_pass_and_no_join(spark):
    rng = np.random.default_rng(6)
    rows = [(q, i, int(rng.integers(0, 2)), "c", [f"t{x}" for x in rng.integers(0, 3, 2)], float(rng.integers(0, 9)) / 10) for q in range(40) for i in range(q % 8 + 1)]
    candidates = spark.createDataFrame(rows, "request_id int, article_id int, label int, category string, topics array<string>, s double")
    ranked = experiments.rank_arms(candidates, {"own": F.col("s")}, ["label", "category", "topics"])
    arms = experiments.with_mmrs(ranked, {"some": 0.1, "much": 0.9}, 3, "topics", own="own")
    plan = arms._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    got = {(r.arm, r.request_id, r.article_id): r["rank"] for r in arms.collect()}
    want = {("own", r.request_id, r.article_id): r["rank"] for r in ranked.collect()}
    for name, penalty in (("some", 0.1), ("much", 0.9)):
        first = feed.rerank_mmr(ranked.withColumn("relevance", F.col("score")), 3, penalty).collect()
        chosen = {(r.request_id, r.article_id): r["rank"] for r in first}
        for q in range(40):
            order = sorted((k for k in want if k[0] == "own" and k[1] == q), key=lambda k: (chosen.get(k[1:], 99), want[k]))  # noqa: B023
            want.update({(name, *k[1:]): n for n, k in enumerate(order, 1)})
    assert got == want and len(got) == 3 * len(rows)


def test_several_arms_are_compared_with_one_bootstrap(spark):
    per = spark.createDataFrame([(a, q, m * q / 10, 0.5) for q in range(50) for a, m in (("base", 1.0), ("same", 1.0), ("twice", 2.0))], "arm string, request_id int, mrr double, recall_1 double")
    got = {(r.arm, r.metric): r for r in experiments.compare_measured(per, "base", ["same", "twice"], iterations=200).collect()}
    assert got["same", "mrr"].delta == 0 and got["same", "mrr"].direction == "open" and got["twice", "recall_1"].direction == "open"
    twice = got["twice", "mrr"]
    assert len(got) == 4 and twice.delta == pytest.approx(2.45) and twice.low < 2.45 < twice.high and twice.direction == "better" and twice.high - twice.low < 1.2
    draws = evaluation._poisson_of_one(np.random.default_rng(1), (1000, 1000))
    share = np.bincount(draws.ravel(), minlength=5)[:5] / draws.size
    assert np.allclose(share, [np.exp(-1) / x for x in (1, 1, 2, 6, 24)], atol=3e-3) and abs(draws.var() - 1) < 0.01
