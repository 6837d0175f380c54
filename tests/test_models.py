import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from textpulse.operators import bayes as nb
from textpulse.operators import folds as fo
from textpulse.operators import kernel as ke
from textpulse.operators import lookup
from textpulse.operators import posterior as po
from textpulse.operators import selection as se
from textpulse.operators import tokens as tk
from textpulse.operators.positions import with_position, with_running_total
from textpulse.plans import baselines as bl
from textpulse.plans.classifiers import MetaClassifier, fit_sigmoids
from textpulse.plans.stacking import IterativeStackedClassifier, StackedClassifier
from textpulse.operators.features.extract import CatalogueExtractor
from textpulse.operators.mappers import TokenLengthDistribution, TokenLengthSequence
from textpulse.functions import text as tx
from textpulse.functions.tails import two_sided_normal, two_sided_t
from textpulse.session import checkpointed
from textpulse.sources.store import ParquetStore, SessionStore


def test_positions_and_running_totals(spark):
    df = spark.range(0, 1000, numPartitions=7).select(((F.col("id") * 7919) % 1009).alias("x"), (F.col("id") % 5).alias("w"))
    placed = with_position(df, ["x"]).toPandas().sort_values("x")
    assert placed.position.tolist() == list(range(1, 1001))
    running = with_running_total(df, ["x"], ["w"]).toPandas().sort_values("x")
    assert running.cum_w.tolist() == running.w.cumsum().tolist()


def test_tails():
    assert two_sided_normal(np.array([0.0, 1.959964]))[1] == pytest.approx(0.05, abs=1e-6)
    assert two_sided_t(np.array([2.0, 0.0, 1.0]), np.array([10.0, 3.0, 1.0])) == pytest.approx([0.073388, 1.0, 0.5], abs=1e-6)


def brute_fisher(a, b, c, d):
    def weight(k):
        return math.comb(a + b, k) * math.comb(c + d, a + c - k)

    support = range(max(0, a - d), min(a + b, a + c) + 1)
    return sum(weight(k) for k in support if weight(k) <= weight(a) * (1 + 1e-7)) / math.comb(a + b + c + d, a + c)


def test_fisher_against_enumeration():
    for cells in product(range(0, 7, 2), repeat=4):
        if 0 < cells[0] + cells[1] and 0 < cells[2] + cells[3]:
            assert se.fisher_p(*cells) == pytest.approx(brute_fisher(*cells), rel=1e-9), cells
    assert 0 <= se.fisher_p(500_000, 499_000, 498_000, 501_000) < 0.01


def test_mann_whitney_against_pairs(spark):
    rng = np.random.default_rng(1)
    values, labels = rng.integers(0, 6, 40).astype(float), rng.integers(0, 3, 40)
    features = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate(values)], "doc_id bigint, feature string, value double")
    classes = spark.createDataFrame([(i, str(c)) for i, c in enumerate(labels)], "doc_id bigint, label string")
    for r in se.mann_whitney(se.value_table(features, classes)).collect():
        inside, rest = values[labels == int(r.label)], values[labels != int(r.label)]
        u = sum((x > y) + 0.5 * (x == y) for x in inside for y in rest)
        assert (r.n1, r.n2) == (len(inside), len(rest)) and r.u == pytest.approx(u)


def test_selection_keeps_what_separates_every_class(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(90):
        c = i % 3
        labels.append((i, "abc"[c]))
        rows += [(i, "good", 10.0 * c + rng.normal()), (i, "noise", rng.normal()), (i, "flat", 1.0), (i, "flag", float(c == 0))]
    features = spark.createDataFrame(rows, "doc_id bigint, feature string, value double")
    classes = spark.createDataFrame(labels, "doc_id bigint, label string")
    table = se.select_relevant_features(features, classes, 0.05).collect()
    # the middle class of "good" lies between the others, so a rank test against the rest cannot see it
    assert [(r.feature, r.occurrence) for r in table] == [("flag", 3)]
    assert {r.feature for r in se.select_relevant_features(features, classes, 1e6).collect()} == {"good", "noise", "flag"}


def test_folds_are_balanced(spark):
    docs = spark.range(103).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("label"))
    sizes = fo.stratified_folds(docs, 5, 3).groupBy("label", "fold").count().toPandas()
    spread = sizes.groupby("label")["count"].agg(lambda s: s.max() - s.min())
    assert spread.max() <= 1 and sizes["count"].sum() == 103
    parts = fo.train_test_split(docs, 0.33).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in parts}[("x", "test")] == math.ceil(0.33 * 26)
    with pytest.raises(ValueError):
        fo.check_fold_count(4)


def pairs_of(spark, current, score):
    rows = [("c", i, a, b) for i, (a, b) in enumerate(zip(current, score))]
    return spark.createDataFrame(rows, "candidate string, fold int, current double, score double")


def test_wilcoxon(spark):
    same = fo.wilcoxon(pairs_of(spark, [0.5] * 5, [0.5] * 5)).first()
    assert (same.n, same.t, same.p_value) == (0, 0.0, 1.0)
    r = fo.wilcoxon(pairs_of(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [0.5, 1.0, 3.5, 2.0, 2.5, 3.0])).first()
    assert (r.n, r.t) == (6, 1.5) and r.z == pytest.approx((1.5 - 10.5) / math.sqrt(6 * 7 * 13 / 24 - 6 / 48))


def test_posterior_weights_and_interval(spark):
    rng = np.random.default_rng(3)
    a, b = 0.60 + 0.02 * rng.normal(size=10), 0.50 + 0.02 * rng.normal(size=10)
    pairs = pairs_of(spark, a.tolist(), b.tolist())
    posterior = po.posterior(pairs)
    for r in posterior.groupBy("quantity").agg(F.sum("weight").alias("s")).collect():
        assert r.s == pytest.approx(1.0)
    summary = {r.quantity: r for r in po.posterior_summary(posterior).collect()}
    means = summary["difference of means"]
    assert means.mean == pytest.approx(a.mean() - b.mean(), abs=0.01) and means.low > 0.05
    assert summary["effect size"].mean > 2 and abs(summary["difference of stds"].mean) < 0.03
    decided = po.significance(po.posterior_summary(posterior), fo.wilcoxon(pairs))
    assert decided.first().significant and po.next_group(decided).first().candidate == "c"
    worse = po.posterior_summary(po.mean_difference_posterior(po.group_posterior(pairs_of(spark, b.tolist(), a.tolist()))))
    assert po.next_group(po.significance(worse, fo.wilcoxon(pairs))).first().candidate is None


def test_kernel_is_symmetric_with_unit_diagonal(spark, docs):
    counts = ke.gram_counts(docs)
    k = {(r.doc_i, r.doc_j): r.k for r in ke.normalised_kernel(counts, counts).collect()}
    assert all(k[(i, i)] == pytest.approx(1.0) for i in range(1, 5))
    assert all(k[(j, i)] == pytest.approx(v) for (i, j), v in k.items())


def test_sigmoids_recover_a_logistic(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(2 * m - 0.5)))
    rows = [(0, "a", float(v), "a" if t else "b") for v, t in zip(m, y)]
    (a, b), = fit_sigmoids(spark.createDataFrame(rows, "part int, class string, margin double, label string")).values()
    assert a == pytest.approx(2, abs=0.2) and b == pytest.approx(-0.5, abs=0.15)


@pytest.fixture(scope="module")
def authors(spark):
    """Two writers with other words and other word lengths."""
    rng = np.random.default_rng(6)
    words = {"x": ["sun", "sea", "sky", "red", "a"], "y": ["mountain", "forest", "thunder", "evening", "a"]}
    rows = []
    for i in range(60):
        label = "xy"[i % 2]
        rows.append((i, " ".join(rng.choice(words[label], rng.integers(8, 30))), label))
    return spark.createDataFrame(rows, "doc_id bigint, text string, label string").cache()


@pytest.mark.parametrize(
    "baseline",
    [bl.BagOfWordsNaiveBayes([0.5, 1.0], folds=5), bl.BagOfWordsMargin(folds=2), bl.SequenceKernelMargin(sample_splits=3)],
    ids=lambda b: type(b).__name__,
)
def test_baselines_separate_the_writers(authors, baseline):
    train, test = authors.filter("doc_id < 40"), authors.filter("doc_id >= 40")
    proba = baseline.fit(train).predict_proba(test).toPandas()
    assert proba.groupby("doc_id").proba.sum().tolist() == pytest.approx([1.0] * 20)
    right = baseline.predict(test).join(test, "doc_id").filter("y = label").count()
    assert right >= 19


def test_stacking_and_stores(spark, authors, tmp_path):
    train, test = authors.filter("doc_id < 40"), authors.filter("doc_id >= 40")
    store = ParquetStore(spark, str(tmp_path))
    model = StackedClassifier(
        [TokenLengthSequence(tokenizer=tx.word_marks)], CatalogueExtractor(0.5, ["aggregate"]),
        bl.BagOfWordsNaiveBayes([0.5]), meta=MetaClassifier("gbt", maxIter=3), store=store,
    )
    predicted = model.fit(train).predict(test)
    assert predicted.join(test, "doc_id").filter("y = label").count() >= 19
    assert model.get_classes() == ["x", "y"] and model.groups == ["baseline", "tokenlenseq"]
    records = store.read_records()
    assert records.filter("genre = 'class'").count() == 2 and records.count() == records.distinct().count()
    assert store.read_feature_set("tokenlenseq", split="train").select("doc_id").distinct().count() == 40
    with pytest.raises(ValueError):
        model.given_baseline = True
        model.predict_proba(test)


def test_iterative_stacking_improves_on_a_wrong_baseline(spark, authors):
    wrong = authors.select("doc_id", "label", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("class")).select(
        "doc_id", "class", F.when(F.col("class") == F.col("label"), 0.05).otherwise(0.95).alias("proba")
    )
    model = IterativeStackedClassifier(
        [TokenLengthSequence(tokenizer=tx.word_marks), TokenLengthDistribution(tokenizer=tx.word_marks)],
        CatalogueExtractor(15, ["aggregate"]), folds=5, meta=MetaClassifier("logistic"), store=SessionStore(spark),
    )
    model.fit(authors, wrong, bayesian_level=0.5, wilcoxon_level=0.5)
    assert model.groups[0] == "baseline" and len(model.groups) >= 2
    assert model.store.read_evaluation_score("baseline").count() == 5


def test_features_are_not_stored_for_every_fold(spark, authors, monkeypatch):
    seen = []
    monkeypatch.setattr("textpulse.plans.stacking.checkpointed", lambda df: seen.append(set(df.columns)) or checkpointed(df))
    model = IterativeStackedClassifier([TokenLengthSequence(tokenizer=tx.word_marks)], CatalogueExtractor(15, ["aggregate"]), None, folds=5)
    model.store, model.classes, model.given_baseline = SessionStore(spark), ["x", "y"], False
    model.folds = checkpointed(fo.stratified_folds(authors, 5))
    sides = checkpointed(fo.every_fold(authors.select("doc_id", "label"), model.folds, 5))
    tables = model._fold_features(authors, sides, None)
    model._fold_tests(tables, sides)
    rows = tables["tokenlenseq"]
    assert rows.select("fold", "doc_id", "feature").distinct().count() == rows.count() > 0
    assert {r.fold for r in rows.select("fold").distinct().collect()} == set(range(5))
    assert not any({"fold", "doc_id", "value"} <= columns for columns in seen)


def test_metrics_fit_the_score_table(spark):
    rows = [
        (d, "m", 0, "train" if d < 4 else "test", c, p)
        for d, ps in enumerate([(0.9, 0.1), (0.2, 0.8), (0.6, 0.4), (0.5, 0.5), (0.3, 0.7), (0.8, 0.2)])
        for c, p in zip("ab", ps)
    ]
    predictions = spark.createDataFrame(rows, "doc_id bigint, method string, fold int, split string, class string, proba double")
    labels = spark.createDataFrame([(d, x) for d, x in enumerate("abbabb")], "doc_id bigint, label string")
    loss = fo.score_table(predictions, labels).first()
    assert loss.train == pytest.approx(-(math.log(0.9) + math.log(0.8) + math.log(0.4) + math.log(0.5)) / 4)
    share = fo.score_table(predictions, labels, fo.accuracy).first()
    assert (share.train, share.test) == (0.75, 0.5)
    f1 = fo.score_table(predictions, labels, fo.macro_f1(["a", "b"])).first()
    assert f1.train == pytest.approx((0.8 + 2 / 3) / 2) and f1.test == pytest.approx((0 + 2 / 3) / 2)


def test_median_of_an_even_number_of_values(spark):
    from textpulse.operators.features.extract import impute

    values = [1.0, 2.0, 3.0, 10.0, None, float("inf"), float("-inf"), float("nan")]
    rows = spark.createDataFrame([(i, "f", v) for i, v in enumerate(values)] + [(9, "g", None)], "doc_id bigint, feature string, value double")
    got = {r.doc_id: r.value for r in impute(rows).collect()}
    assert [got[i] for i in (4, 5, 6, 7, 9)] == [2.5, 10.0, 1.0, 2.5, 0.0]


def test_top_vocabulary_of_groups_for_a_large_k(spark):
    from textpulse.operators.vocab import top_vocabulary

    rows = spark.range(4000).select(F.expr("CAST(id % 2 AS INT)").alias("fold"), F.expr("format_string('%05d', id)").alias("token"), F.expr("id % 7").alias("freq"))
    got = top_vocabulary(rows, 1001, ["fold"])
    assert got.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t")).distinct().count() == 2
    assert [tuple(r) for r in got.groupBy("fold").agg(F.count(F.lit(1)), F.max("t"), F.min("freq")).orderBy("fold").collect()] == [(0, 1001, 1000, 3), (1, 1001, 1000, 3)]


def test_addresses_do_not_collide(spark, tmp_path):
    from textpulse.sources.store import ParquetStore

    store = ParquetStore(spark, str(tmp_path))
    for i, key in enumerate(["a/b", "a_b", "a%2Fb", ""]):
        store.save_result(spark.range(i + 1), key)
    assert [store.read_result(k).count() for k in ("a/b", "a_b", "a%2Fb", "")] == [1, 2, 3, 4]


def test_losses_do_not_depend_on_how_tokens_meet_their_counts(spark, monkeypatch):
    texts = ["red cat", "red dog cat", "blue dog", "blue fish", "red red fish", "blue cat", "odd", ""]
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    counts = checkpointed(tk.document_counts(docs, lambda d: tk.tokens(d, tx.words)))
    folds = docs.select("doc_id", "label", F.pmod(F.floor(F.col("doc_id") / 2), F.lit(4)).cast("int").alias("fold"))
    found = []
    for common in (1, 1000):
        monkeypatch.setattr(lookup, "COMMON", common)
        losses = nb.fold_alpha_losses(counts, folds, [0.1, 1.0]).collect() + nb.alpha_losses(counts, folds, [0.1, 1.0]).collect()
        found.append({(r.asDict().get("fold"), r.alpha): r.loss for r in losses})
    assert len(found[0]) == 10 and found[0] == pytest.approx(found[1])
    # By the plain definition: each fold scored by the class counts of the others.
    held = {i: ("ab"[i % 2], t.split(), i // 2 % 4) for i, t in enumerate(texts * 2)}
    per = []
    for fold in range(4):
        train = [(c, ws) for c, ws, f in held.values() if f != fold]
        vocab = {w for _, ws in train for w in ws}
        bag = {c: [w for d, ws in train if d == c for w in ws] for c in "ab"}
        losses = []
        for c, ws, f in held.values():
            if f == fold:
                score = {k: np.log(sum(d == k for d, _ in train) / len(train)) + sum(
                    np.log((bag[k].count(w) + 1) / (len(bag[k]) + len(vocab))) for w in ws if w in vocab) for k in "ab"}
                losses.append(np.logaddexp(score["a"], score["b"]) - score[c])
        per.append(np.mean(losses))
    assert found[0][None, 1.0] == pytest.approx(np.mean(per))
    assert all("BroadcastHashJoin" in j for j in joins_by_token(counts, folds))


def joins_by_token(counts, folds):
    """The joins on the token in the plan that sums a document's tokens, without Spark's own broadcasts."""
    spark = counts.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = nb.alpha_losses(counts, folds, [1.0])._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = [line for line in plan.splitlines() if "Join [token" in line]
    assert found
    return found


def test_spread_rows_have_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(fo, "TASK_ROWS", 5)
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a").alias("label"))
    folds = rows.select("doc_id", (F.col("doc_id") % 5).cast("int").alias("fold"))
    spread = fo.every_fold(rows, folds, 5)
    assert spread.rdd.getNumPartitions() == 40 and spread.count() == 1000
    assert spread.filter("split = 'test'").count() == 200


def test_kernel_blocks_against_brute_force(spark, monkeypatch):
    texts = {1: "abab", 2: "ba", 3: "xyz", 4: "aaaaab", 5: "zzx", 6: "b"}
    rows = [*texts.items(), (None, "ab"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(ke, "MARK_ENTRIES", 8)  # several blocks of landmarks
    monkeypatch.setattr(ke, "PASS_BLOCKS", 2)
    monkeypatch.setattr(ke, "KERNEL_CELLS", 3)  # few texts and few products at a time
    monkeypatch.setattr(ke, "DENSE_SHARE", 2)

    def grams(text):
        return [text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)]

    def product(a, b):
        return sum(x == y for x in grams(a) for y in grams(b))

    want = {(i, j): product(a, b) for i, a in [*texts.items(), (None, "ab")] for j, b in texts.items() if product(a, b)}
    counts = ke.gram_counts(docs)
    got = ke.kernel_values(counts, counts).collect()
    assert len(got) == len(want) and {(r.doc_i, r.doc_j): r.k for r in got} == want
    norm = {i: math.sqrt(product(a, a)) for i, a in texts.items()}
    got = ke.normalised_kernel(counts, counts).collect()
    assert {(r.doc_i, r.doc_j): r.k for r in got} == pytest.approx({(i, j): k / norm[i] / norm[j] for (i, j), k in want.items() if i})


def test_kernel_shuffles_texts_only(spark, docs):
    counts = ke.gram_counts(docs)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (counts, ke.normalised_kernel(counts, counts))]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")


def test_selected_features_take_both_series(spark, tmp_path):
    from textpulse.queries.models import selected_features

    short = [(i, " ".join(["a", "bb"] * (5 + i % 7)), "x") for i in range(40)]
    long = [(100 + i, " ".join(["abcdefgh", "abcdefghij", "abc"] * (30 + i % 5)), "y") for i in range(40)]
    docs = spark.createDataFrame(short + long, "doc_id bigint, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.feature.split("__")[0] for r in selected_features(spark, str(tmp_path)).collect()}
    assert found == {"tokenlenseq", "tokenlendist"}


def test_kernel_of_texts_equals_that_of_counts(spark):
    rows = [(1, "abab"), (1, "xb"), (2, "ba"), (3, "xyz añ😀"), (None, "ab"), (None, "zz"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    counts, texts = ke.gram_counts(docs), ke.gram_texts(docs)
    for kernel in (ke.kernel_values, ke.normalised_kernel):
        rows = kernel(texts, counts)
        assert "Generate" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(rows.collect(), key=str) == sorted(kernel(counts, counts).collect(), key=str)
