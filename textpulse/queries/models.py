"""Selection, folds, scores, tests, naive Bayes and the sequence kernel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.functions import text as tx
from textpulse.operators import bayes as nb
from textpulse.operators import folds as fo
from textpulse.operators import kernel as ke
from textpulse.operators import mappers as mp
from textpulse.operators import posterior as po
from textpulse.operators import selection as se
from textpulse.operators import tokens as tk
from textpulse.operators.features import extract as ex
from textpulse.queries.features import BASE, STATS, lengths
from textpulse.session import checkpointed, stored
from textpulse.queries.registry import SQL_WORDS, documents, r6, register, rounded, sql_r6, table

# --- selection -----------------------------------------------------------------------------------------


def basic_features(spark, folder):
    """A dozen real, binary and constant features of the token length series."""
    series = lengths(spark, folder)
    stats = series.groupBy("doc_id").agg(
        F.avg("value").alias("mean"), F.max("value").alias("maximum"), F.count(F.lit(1)).alias("length"),
        (F.sqrt(F.avg(F.col("value") * F.col("value")) - F.avg("value") * F.avg("value"))).alias("sd"),
        F.count_if(F.col("value") == 1).alias("ones"), F.sum("value").alias("total"),
    )
    pairs = F.array(*[
        F.struct(F.lit(n).alias("feature"), e.cast("double").alias("value"))
        for n, e in (
            ("mean", F.round(F.col("mean"), 6)), ("maximum", F.col("maximum")), ("length", F.col("length")),
            ("sd", F.round(F.col("sd"), 6)), ("share_of_ones", F.round(F.col("ones") / F.col("length"), 6)),
            ("long", F.col("length") > 300), ("even", F.col("total") % 2 == 0), ("wide", F.col("maximum") > 11),
            ("constant", F.lit(1.0)),
        )
    ])
    return stats.select("doc_id", F.inline(pairs))


def labels_of(spark, folder):
    return documents(spark, folder).select("doc_id", "label")


_BASIC_SQL = f"""{BASE}, w0 AS (SELECT doc_id, avg(value) AS m, max(value) AS mx, count(*) AS n,
  sqrt(avg(value * value) - avg(value) * avg(value)) AS sd, count(*) FILTER (value = 1) AS ones, sum(value) AS tot
  FROM s GROUP BY doc_id),
f AS (SELECT doc_id, unnest(['mean', 'maximum', 'length', 'sd', 'share_of_ones', 'long', 'even', 'wide', 'constant']) AS feature,
  unnest([round(m, 6), mx, n, round(sd, 6), round(ones / n, 6), (n > 300)::INT::DOUBLE, (tot % 2 = 0)::INT::DOUBLE,
    (mx > 11)::INT::DOUBLE, 1.0]) AS value FROM w0),
fl AS (SELECT f.*, lang AS label FROM f JOIN documents USING (doc_id)),
prof AS (SELECT feature, count(*) AS n, count(DISTINCT value) AS dv, max(value) AS hi FROM f GROUP BY feature),
labs AS (SELECT DISTINCT lang AS label FROM documents)"""

_MW_SQL = """rk AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY value)
    + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM fl JOIN prof USING (feature) WHERE dv > 2),
ties AS (SELECT feature, sum(c * c * c - c) AS t FROM (
    SELECT feature, CAST(count(*) AS DOUBLE) AS c FROM f GROUP BY feature, value) GROUP BY feature),
mw0 AS (SELECT feature, label, count(*) AS n1, sum(r) AS r1 FROM rk GROUP BY 1, 2),
mw AS (SELECT feature, label, n1, n - n1 AS n2, r1 - n1 * (n1 + 1) / 2 AS u, t, n
  FROM mw0 JOIN prof USING (feature) JOIN ties USING (feature))"""


@register(
    "mann_whitney_tests",
    f"""{_BASIC_SQL}, {_MW_SQL} SELECT feature, label, n1, n2, {sql_r6('u')} AS u,
    {sql_r6('''(greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5)
      / sqrt(n1 * n2 / 12 * ((n + 1) - t / (n * (n - 1))))''')} AS z FROM mw""",
)
def mann_whitney_tests(spark, folder):
    values = se.value_table(basic_features(spark, folder), labels_of(spark, folder))
    return rounded(se.mann_whitney(values), "u", "z")


_FISHER_SQL = """cell AS (SELECT feature, l.label, count(*) FILTER (value = hi AND fl.label = l.label) AS a,
    count(*) FILTER (value = hi AND fl.label <> l.label) AS b,
    count(*) FILTER (value < hi AND fl.label = l.label) AS c,
    count(*) FILTER (value < hi AND fl.label <> l.label) AS d
  FROM fl JOIN prof USING (feature) CROSS JOIN labs l WHERE dv = 2 GROUP BY 1, 2),
hyp AS (SELECT feature, label, a, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k, b, c, d FROM cell),
logp AS (SELECT feature, label, a, k, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)
    - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) AS lp
  FROM hyp),
fisher AS (SELECT feature, label, least(1.0, sum(exp(lp)) FILTER (lp <= seen + 1e-7)) AS p
  FROM (SELECT *, max(CASE WHEN k = a THEN lp END) OVER (PARTITION BY feature, label) AS seen FROM logp) GROUP BY 1, 2)"""


@register(
    "fisher_tables", f"{_BASIC_SQL}, {_FISHER_SQL} SELECT feature, label, a, b, c, d FROM cell"
)
def fisher_tables(spark, folder):
    return se.binary_tables(se.value_table(basic_features(spark, folder), labels_of(spark, folder)))


@register(
    "fisher_exact_tests", f"{_BASIC_SQL}, {_FISHER_SQL} SELECT feature, label, {sql_r6('p')} AS p_value FROM fisher"
)
def fisher_exact_tests(spark, folder):
    tests = se.fisher_exact(se.value_table(basic_features(spark, folder), labels_of(spark, folder)))
    return tests.select("feature", "label", r6("p_value").alias("p_value"))


@register(
    "constant_features", f"{_BASIC_SQL} SELECT feature, dv AS distinct_values FROM prof WHERE dv = 1"
)
def constant_features(spark, folder):
    values = se.value_table(basic_features(spark, folder), labels_of(spark, folder))
    return se.feature_profile(values).filter("distinct = 1").select("feature", F.col("distinct").alias("distinct_values"))


_BY_SQL = """byt AS (SELECT feature, label, p, row_number() OVER (ORDER BY p, feature, label) AS k, count(*) OVER () AS m FROM fisher),
byh AS (SELECT *, sum(1 / k) OVER () AS h FROM byt),
byl AS (SELECT *, max(CASE WHEN p <= 15.0 * k / (m * h) THEN k END) OVER () AS last FROM byh),
byr AS (SELECT feature, label, p, k <= coalesce(last, 0) AS relevant FROM byl)"""


def _decided(spark, folder):
    values = se.value_table(basic_features(spark, folder), labels_of(spark, folder))
    return se.benjamini_yekutieli(se.fisher_exact(values).select("feature", "label", "p_value"), 15.0)


@register(
    "benjamini_yekutieli",
    f"{_BASIC_SQL}, {_FISHER_SQL}, {_BY_SQL} SELECT feature, label, {sql_r6('p')} AS p_value, relevant FROM byr",
)
def benjamini_yekutieli(spark, folder):
    return rounded(_decided(spark, folder), "p_value")


@register(
    "relevance_occurrences",
    f"""{_BASIC_SQL}, {_FISHER_SQL}, {_BY_SQL} SELECT feature, {sql_r6('max(p)')} AS p_value,
    CAST(count(*) AS INTEGER) AS occurrence FROM byr WHERE relevant GROUP BY feature""",
)
def relevance_occurrences(spark, folder):
    return rounded(se.occurrences(_decided(spark, folder)), "p_value")


@register(
    "occurrence_histogram",
    f"""{_BASIC_SQL}, {_FISHER_SQL}, {_BY_SQL}, o AS (SELECT feature, count(*) AS c FROM byr WHERE relevant GROUP BY feature)
    SELECT CAST(c AS INTEGER) AS occurrence, count(*) AS n_features FROM o GROUP BY c""",
)
def occurrence_histogram(spark, folder):
    return se.occurrence_histogram(_decided(spark, folder))


@register(
    "relevant_in_every_class",
    f"""{_BASIC_SQL}, {_FISHER_SQL}, {_BY_SQL}, o AS (SELECT feature, max(p) AS p, count(*) AS c FROM byr WHERE relevant GROUP BY feature)
    SELECT feature, {sql_r6('p')} AS p_value, CAST(c AS INTEGER) AS occurrence FROM o WHERE c = 4""",
)
def relevant_in_every_class(spark, folder):
    """Relevant for each of the four languages."""
    return rounded(se.relevant_for_all(_decided(spark, folder), 4), "p_value")


@register("selected_features")
def selected_features(spark, folder):
    """The relevance table of the basic calculators on two series, with every test."""
    docs = documents(spark, folder)
    mappers = [mp.TokenLengthSequence(tokenizer=tx.word_marks), mp.TokenLengthDistribution(tokenizer=tx.word_marks)]
    series = checkpointed(reduce(DataFrame.unionByName, [m.transform(docs) for m in mappers]))
    raw = stored(ex.extract_features(series, families=ex.BASIC_FAMILIES), "features")
    table_ = se.select_relevant_features(ex.impute(raw), labels_of(spark, folder), 0.05)
    return rounded(table_, "p_value")


@register(
    "projected_features",
    f"{_BASIC_SQL} SELECT doc_id, feature, value FROM f WHERE feature IN (SELECT feature FROM prof WHERE dv > 2)",
)
def projected_features(spark, folder):
    features = basic_features(spark, folder)
    values = se.value_table(features, labels_of(spark, folder))
    return se.project_features(features, se.feature_profile(values).filter("distinct > 2")).select("doc_id", "feature", "value")


# --- folds and scores ----------------------------------------------------------------------------------

FOLD_SQL = """folds AS (SELECT doc_id, lang AS label, CAST((row_number() OVER (
    PARTITION BY lang ORDER BY md5('{seed}:' || doc_id), doc_id) - 1) % {k} AS INTEGER) AS fold FROM documents)"""
FOLDS = FOLD_SQL.format(seed=0, k=10)


@register("stratified_folds", f"WITH {FOLDS} SELECT doc_id, label, fold FROM folds")
def stratified_folds(spark, folder):
    return fo.stratified_folds(documents(spark, folder), 10)


@register(
    "train_test_split",
    """WITH p AS (SELECT doc_id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id)) AS i,
      count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, label, CASE WHEN i <= ceil(0.33 * n) THEN 'test' ELSE 'train' END AS split FROM p""",
)
def train_test_split(spark, folder):
    return fo.train_test_split(documents(spark, folder), 0.33, 7)


@register(
    "fold_train_test_sizes",
    f"""WITH {FOLDS}, s AS (SELECT g.f AS fold, CASE WHEN folds.fold = g.f THEN 'test' ELSE 'train' END AS split, text
      FROM documents JOIN folds USING (doc_id) CROSS JOIN (SELECT unnest(range(10)) AS f) g)
    SELECT CAST(fold AS INTEGER) AS fold, split, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM s GROUP BY 1, 2""",
)
def fold_train_test_sizes(spark, folder):
    docs = documents(spark, folder)
    every = fo.every_fold(docs, fo.stratified_folds(docs, 10), 10)
    return every.groupBy("fold", "split").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars")
    )


@register(
    "one_fold_training_rows",
    f"""WITH {FOLDS} SELECT doc_id, lang AS label, length(text)::INTEGER AS n_chars FROM documents JOIN folds USING (doc_id) WHERE fold <> 3""",
)
def one_fold_training_rows(spark, folder):
    docs = documents(spark, folder)
    train, _ = fo.fold_train_test(docs, fo.stratified_folds(docs, 10), 3)
    return train.select("doc_id", "label", F.length("text").alias("n_chars"))


# --- naive Bayes -----------------------------------------------------------------------------------------


def word_counts(spark, folder):
    def terms(docs):
        return tk.without_stop_words(tk.tokens(docs, tx.words), tk.english_stop_words(spark))

    return stored(tk.document_counts(documents(spark, folder), terms), "word-counts")


def _nb_sql(alphas: list[float]) -> str:
    """Joint log probabilities of every document by the counts of the other folds (fold = -1: of all)."""
    from textpulse.queries.texts import _STOP_SQL

    grid = ", ".join(f"CAST({a} AS DOUBLE)" for a in alphas)
    return f"""{SQL_WORDS}, bow AS (SELECT doc_id, label, token, CAST(count(*) AS DOUBLE) AS n FROM word WHERE token NOT IN {_STOP_SQL} GROUP BY ALL),
    grid AS (SELECT unnest([{grid}]) AS alpha),
    tests AS (SELECT doc_id, fold FROM held),
    per AS (SELECT h.fold, token, bow.label, sum(n) AS n FROM bow JOIN held h USING (doc_id) GROUP BY ALL),
    tot AS (SELECT token, label, sum(n) AS n FROM bow GROUP BY ALL),
    fs AS (SELECT DISTINCT fold FROM held),
    cnt AS (SELECT fs.fold, tot.token, tot.label, tot.n - CASE WHEN fs.fold >= 0 THEN coalesce(per.n, 0) ELSE 0 END AS n
      FROM tot CROSS JOIN fs LEFT JOIN per ON per.fold = fs.fold AND per.token = tot.token AND per.label = tot.label),
    c AS (SELECT * FROM cnt WHERE n > 0),
    v AS (SELECT fold, count(DISTINCT token) AS v FROM c GROUP BY fold),
    sz AS (SELECT fold, label, sum(n) AS total FROM c GROUP BY 1, 2),
    pr AS (SELECT fs.fold, lang AS label, CAST(count(*) AS DOUBLE) AS nd FROM documents d JOIN held h USING (doc_id) CROSS JOIN fs
      WHERE h.fold <> fs.fold OR fs.fold < 0 GROUP BY 1, 2),
    cl AS (SELECT pr.fold, pr.label, ln(nd / sum(nd) OVER (PARTITION BY pr.fold)) AS prior, total, v
      FROM pr JOIN sz ON sz.fold = pr.fold AND sz.label = pr.label JOIN v ON v.fold = pr.fold),
    seen AS (SELECT DISTINCT fold, token FROM c),
    rows_ AS (SELECT b.doc_id, t.fold, b.token, b.n AS tf FROM bow b JOIN tests t USING (doc_id) JOIN seen s ON s.fold = t.fold AND s.token = b.token),
    hit AS (SELECT r.doc_id, r.fold, cl.label, alpha, sum(tf * ln((coalesce(c.n, 0) + alpha) / (total + alpha * v))) AS s
      FROM rows_ r JOIN cl ON cl.fold = r.fold CROSS JOIN grid
      LEFT JOIN c ON c.fold = r.fold AND c.token = r.token AND c.label = cl.label GROUP BY ALL),
    l AS (SELECT t.doc_id, t.fold, cl.label AS class, g.alpha, prior + coalesce(s, 0) AS l
      FROM tests t JOIN cl ON cl.fold = t.fold CROSS JOIN grid g
      LEFT JOIN hit h ON h.doc_id = t.doc_id AND h.fold = t.fold AND h.label = cl.label AND h.alpha = g.alpha),
    e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY doc_id, alpha)) AS e FROM l),
    pb AS (SELECT doc_id, fold, class, alpha, e / sum(e) OVER (PARTITION BY doc_id, alpha) AS proba FROM e)"""


@register(
    "naive_bayes_probabilities",
    f"WITH held AS (SELECT doc_id, -1 AS fold FROM documents), {_nb_sql([0.5])} SELECT doc_id, class, {sql_r6('proba')} AS proba FROM pb",
)
def naive_bayes_probabilities(spark, folder):
    docs, bow = documents(spark, folder), word_counts(spark, folder)
    labels = docs.select("doc_id", "label")
    priors = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))
    scores = nb.log_scores(bow, nb.class_counts(bow, labels), priors, [0.5], docs=labels.select("doc_id"))
    return rounded(nb.probabilities(scores), "proba")


_ALPHA_SQL = f"""WITH {FOLDS}, held AS (SELECT doc_id, fold FROM folds), {_nb_sql(nb.ALPHAS)},
    pf AS (SELECT alpha, fold, -avg(ln(greatest(least(proba, 1 - 1e-15), 1e-15))) AS loss
      FROM pb JOIN documents d USING (doc_id) WHERE class = lang GROUP BY 1, 2),
    al AS (SELECT alpha, avg(loss) AS loss FROM pf GROUP BY alpha)"""


@register("naive_bayes_alpha_losses", f"{_ALPHA_SQL} SELECT alpha, {sql_r6('loss')} AS loss FROM al")
def naive_bayes_alpha_losses(spark, folder):
    docs = documents(spark, folder)
    return rounded(nb.alpha_losses(word_counts(spark, folder), fo.stratified_folds(docs, 10)), "loss")


@register("naive_bayes_best_alpha", f"{_ALPHA_SQL} SELECT alpha FROM al ORDER BY loss, alpha LIMIT 1")
def naive_bayes_best_alpha(spark, folder):
    docs = documents(spark, folder)
    return nb.best_alpha(nb.alpha_losses(word_counts(spark, folder), fo.stratified_folds(docs, 10)))


def _fold_alpha_sql(k: int = 5) -> str:
    """Best smoothing value per fold, chosen on the documents of the other folds alone."""
    one = f"""SELECT alpha FROM (WITH folds AS (SELECT doc_id, fold FROM kept WHERE fold <> <outer>),
      documents AS (SELECT d.* FROM every d JOIN folds USING (doc_id)), held AS (SELECT doc_id, fold FROM folds), {_nb_sql(nb.ALPHAS)},
      pf AS (SELECT alpha, fold, -avg(ln(greatest(least(proba, 1 - 1e-15), 1e-15))) AS loss
        FROM pb JOIN documents d USING (doc_id) WHERE class = lang GROUP BY 1, 2),
      al AS (SELECT alpha, avg(loss) AS loss FROM pf GROUP BY alpha)
      SELECT alpha FROM al ORDER BY loss, alpha LIMIT 1)"""
    folds = " UNION ALL ".join(f"SELECT {f} AS fold, ({one.replace('<outer>', str(f))}) AS alpha" for f in range(k))
    return f"""WITH every AS (SELECT * FROM documents), {FOLD_SQL.format(seed=0, k=k)}, kept AS (SELECT * FROM folds)
    SELECT CAST(fold AS INTEGER) AS fold, alpha FROM ({folds})"""


@register("naive_bayes_fold_alphas", _fold_alpha_sql())
def naive_bayes_fold_alphas(spark, folder):
    """The smoothing value of each fold, without a look at its own documents."""
    docs = documents(spark, folder)
    folds = checkpointed(fo.stratified_folds(docs.select("doc_id", "label"), 5))
    losses = nb.fold_alpha_losses(word_counts(spark, folder), folds)
    return nb.best_fold_alphas(losses).select(F.col("fold").cast("int").alias("fold"), "alpha")


# Predictions by class priors within a text length band: cheap methods whose fold scores feed the tests.


def band_predictions(spark, folder):
    """(doc_id, method, fold, split, class, proba): smoothed class shares per text length band, per training fold."""
    docs = documents(spark, folder)
    every = fo.every_fold(docs.select("doc_id", "label", F.length("text").alias("len")), fo.stratified_folds(docs.select("doc_id", "label"), 10).select("doc_id", "fold"), 10)
    bands = F.array(*[
        F.struct(F.lit(m).alias("method"), F.floor(F.col("len") / w).alias("band"))
        for m, w in (("prior", 10_000_000), ("coarse", 1000), ("fine", 200))
    ])
    rows = every.select("doc_id", "label", "fold", "split", F.inline(bands))
    cells = rows.filter("split = 'train'").groupBy("method", "fold", "band", "label").agg(F.count(F.lit(1)).alias("n"))
    wide = cells.groupBy("method", "fold", "band").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("ns"))
    names = F.array(*[F.lit(c) for c in ("de", "en", "es", "fr")])
    # A text of band b has b * 200 characters at least, so that n bands need n * n * 100: 10 GB of texts have 10,000 at most.
    found = rows.join(F.broadcast(wide), ["method", "fold", "band"], "left")
    given = found.select("doc_id", "method", "fold", "split", "ns", F.explode(names).alias("class"))
    n = F.coalesce(F.try_element_at("ns", F.col("class")), F.lit(0))
    total = F.coalesce(F.aggregate(F.map_values("ns"), F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0))
    return given.select("doc_id", "method", "fold", "split", "class", ((n + 1) / (total + 4)).alias("proba"))


_BAND_SQL = f"""WITH {FOLDS}, ev AS (SELECT d.doc_id, d.lang AS label, length(text) AS len, g.f AS fold,
      CASE WHEN folds.fold = g.f THEN 'test' ELSE 'train' END AS split
      FROM documents d JOIN folds USING (doc_id) CROSS JOIN (SELECT unnest(range(10)) AS f) g),
    rw AS (SELECT doc_id, label, fold, split, unnest(['prior', 'coarse', 'fine']) AS method,
      unnest([len // 10000000, len // 1000, len // 200]) AS band FROM ev),
    ce AS (SELECT method, fold, band, label, count(*) AS n FROM rw WHERE split = 'train' GROUP BY ALL),
    tt AS (SELECT method, fold, band, sum(n) AS total FROM ce GROUP BY ALL),
    pd AS (SELECT rw.doc_id, rw.method, rw.fold, rw.split, rw.label, k.class, (coalesce(ce.n, 0) + 1) / (coalesce(total, 0) + 4) AS proba
      FROM rw CROSS JOIN (SELECT unnest(['de', 'en', 'es', 'fr']) AS class) k
      LEFT JOIN ce ON ce.method = rw.method AND ce.fold = rw.fold AND ce.band = rw.band AND ce.label = k.class
      LEFT JOIN tt ON tt.method = rw.method AND tt.fold = rw.fold AND tt.band = rw.band),
    sc AS (SELECT method, fold, -avg(ln(proba)) FILTER (split = 'train' AND class = label) AS train,
      -avg(ln(proba)) FILTER (split = 'test' AND class = label) AS test FROM pd GROUP BY 1, 2)"""


def band_scores(spark, folder):
    return fo.score_table(band_predictions(spark, folder), labels_of(spark, folder))


@register(
    "fold_accuracy_scores",
    f"""{_BAND_SQL}, best AS (SELECT doc_id, method, fold, split, label, min_by(class, struct_pack(p := -proba, c := class)) AS y
      FROM pd GROUP BY ALL)
    SELECT method, CAST(fold AS INTEGER) AS fold, {sql_r6("avg(CAST(y = label AS INT)) FILTER (split = 'train')")} AS train,
      {sql_r6("avg(CAST(y = label AS INT)) FILTER (split = 'test')")} AS test FROM best GROUP BY 1, 2""",
)
def fold_accuracy_scores(spark, folder):
    """The score table under another metric."""
    table = fo.score_table(band_predictions(spark, folder), labels_of(spark, folder), fo.accuracy)
    return rounded(table, "train", "test")


@register(
    "fold_score_table",
    f"{_BAND_SQL} SELECT method, CAST(fold AS INTEGER) AS fold, {sql_r6('train')} AS train, {sql_r6('test')} AS test FROM sc",
)
def fold_score_table(spark, folder):
    return rounded(band_scores(spark, folder), "train", "test")


@register(
    "prediction_accuracy",
    f"""{_BAND_SQL}, y AS (SELECT method, fold, doc_id, any_value(label) AS label, first(class ORDER BY proba DESC, class) AS y
      FROM pd WHERE split = 'test' GROUP BY 1, 2, 3)
    SELECT method, CAST(fold AS INTEGER) AS fold, {sql_r6('avg(CASE WHEN y = label THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM y GROUP BY 1, 2""",
)
def prediction_accuracy(spark, folder):
    tested = band_predictions(spark, folder).filter("split = 'test'")
    predicted = fo.most_likely(tested, ["method", "fold", "doc_id"]).join(labels_of(spark, folder), "doc_id")
    return predicted.groupBy("method", "fold").agg(r6(fo.accuracy()).alias("accuracy"))


@register(
    "prediction_f1",
    f"""{_BAND_SQL}, y AS (SELECT fold, doc_id, any_value(label) AS label, first(class ORDER BY proba DESC, class) AS y
      FROM pd WHERE split = 'test' AND method = 'fine' GROUP BY 1, 2),
    k AS (SELECT label AS class FROM y UNION SELECT y FROM y),
    o AS (SELECT k.class, count(*) FILTER (y = k.class AND label = k.class) AS hit, count(*) FILTER (y = k.class) AS given,
      count(*) FILTER (label = k.class) AS tr FROM y CROSS JOIN k GROUP BY 1)
    SELECT class, {sql_r6('coalesce(hit / nullif(given, 0), 0)')} AS precision, {sql_r6('coalesce(hit / nullif(tr, 0), 0)')} AS recall,
      {sql_r6('coalesce(2 * hit / nullif(given + tr, 0), 0)')} AS f1 FROM o""",
)
def prediction_f1(spark, folder):
    tested = band_predictions(spark, folder).filter("split = 'test' and method = 'fine'")
    predicted = fo.most_likely(tested, ["fold", "doc_id"]).join(labels_of(spark, folder), "doc_id")
    return rounded(fo.f1_scores(predicted), "precision", "recall", "f1")


@register(
    "score_pairs",
    f"""{_BAND_SQL} SELECT a.method AS candidate, CAST(a.fold AS INTEGER) AS fold, {sql_r6('b.test')} AS current, {sql_r6('a.test')} AS score
    FROM sc a JOIN sc b ON a.fold = b.fold AND b.method = 'prior' WHERE a.method <> 'prior'""",
)
def score_pairs(spark, folder):
    return rounded(fo.paired_scores(band_scores(spark, folder), "prior"), "current", "score")


_WILCOXON_SQL = f"""{_BAND_SQL}, pa AS (SELECT a.method AS candidate, b.test - a.test AS d FROM sc a JOIN sc b
      ON a.fold = b.fold AND b.method = 'prior' WHERE a.method <> 'prior'),
    ra AS (SELECT candidate, d, rank() OVER (PARTITION BY candidate ORDER BY round(abs(d), 12))
      + (count(*) OVER (PARTITION BY candidate, round(abs(d), 12)) - 1) / 2 AS r,
      count(*) OVER (PARTITION BY candidate, round(abs(d), 12)) AS c FROM pa WHERE d <> 0),
    wx AS (SELECT candidate, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS t,
      sum(c * c - 1) AS ts FROM ra GROUP BY candidate)"""


@register(
    "wilcoxon_tests",
    f"""{_WILCOXON_SQL} SELECT candidate, n, {sql_r6('t')} AS t,
    {sql_r6('(t - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ts / 48)')} AS z FROM wx""",
)
def wilcoxon_tests(spark, folder):
    pairs = fo.paired_scores(band_scores(spark, folder), "prior")
    return rounded(fo.wilcoxon(pairs, with_p=False), "t", "z")


def _posterior_sql() -> str:
    nus = ", ".join(f"({v!r}::DOUBLE, {c!r}::DOUBLE)" for v, c in po.nu_points(10))
    return f"""{_BAND_SQL}, pr2 AS (SELECT a.method AS candidate, b.test AS current, a.test AS score FROM sc a JOIN sc b
      ON a.fold = b.fold AND b.method = 'prior' WHERE a.method <> 'prior'),
    gy AS (SELECT candidate, unnest(['current', 'score']) AS grp, unnest([current, score]) AS y FROM pr2),
    pool AS (SELECT candidate, avg(y) AS m, greatest(stddev_samp(y), 1e-9) AS s FROM gy GROUP BY candidate),
    gs AS (SELECT candidate, grp, count(*) AS k, min(y) - 6 * greatest(0.01, least(0.1, stddev_samp(y))) / sqrt(count(*)) AS lo,
      max(y) + 6 * greatest(0.01, least(0.1, stddev_samp(y))) / sqrt(count(*)) AS hi FROM gy GROUP BY 1, 2),
    gr AS (SELECT *, (lo + hi) / 2 AS middle, max(hi - lo) OVER (PARTITION BY candidate) / 200 AS step FROM gs),
    nus AS (SELECT * FROM (VALUES {nus}) t(nu, constant)),
    cells AS (SELECT gr.candidate, grp, nu, constant, i, middle + step * (i - 100) AS mu, 0.01 + 0.09 / 30 * (j + 0.5) AS sd
      FROM gr, (SELECT unnest(range(201)) AS i), (SELECT unnest(range(30)) AS j), nus),
    ll AS (SELECT c.candidate, c.grp, nu, i, mu, sd, sum(constant - ln(sd) - (nu + 1) / 2 * ln(1 + ((y - mu) / sd) ** 2 / nu)) AS l
      FROM cells c JOIN gy ON gy.candidate = c.candidate AND gy.grp = c.grp GROUP BY ALL),
    lw AS (SELECT ll.*, l - ((mu - m) / (2 * s)) ** 2 / 2 AS lw FROM ll JOIN pool USING (candidate)),
    ww AS (SELECT candidate, grp, nu, i, mu, sum(exp(lw - top)) AS w FROM (
      SELECT *, max(lw) OVER (PARTITION BY candidate, grp) AS top FROM lw) GROUP BY ALL),
    df AS (SELECT a.candidate, a.i - b.i AS cell, avg(a.mu - b.mu) AS x, sum(a.w * b.w) AS w FROM ww a JOIN ww b
      ON a.candidate = b.candidate AND a.nu = b.nu AND a.grp = 'current' AND b.grp = 'score' GROUP BY 1, 2),
    post AS (SELECT candidate, x, w / sum(w) OVER (PARTITION BY candidate) AS weight FROM df),
    cu AS (SELECT *, sum(weight) OVER (PARTITION BY candidate ORDER BY x) AS cum FROM post),
    sm AS (SELECT candidate, sum(x * weight) AS mean, min(x) FILTER (cum >= 0.025) AS low,
      min(x) FILTER (cum >= 0.975 - 1e-12) AS high FROM cu GROUP BY candidate)"""


@register(
    "bayesian_mean_difference",
    f"{_posterior_sql()} SELECT candidate, {sql_r6('mean')} AS mean, {sql_r6('low')} AS low, {sql_r6('high')} AS high FROM sm",
)
def bayesian_mean_difference(spark, folder):
    pairs = fo.paired_scores(band_scores(spark, folder), "prior")
    summary = po.posterior_summary(po.mean_difference_posterior(po.group_posterior(pairs)))
    return rounded(summary.drop("quantity"), "mean", "low", "high")


@register("bayesian_quantities")
def bayesian_quantities(spark, folder):
    pairs = fo.paired_scores(band_scores(spark, folder), "prior")
    return rounded(po.posterior_summary(po.posterior(pairs)), "mean", "low", "high")


@register("group_significance")
def group_significance(spark, folder):
    pairs = fo.paired_scores(band_scores(spark, folder), "prior")
    summary = po.posterior_summary(po.mean_difference_posterior(po.group_posterior(pairs)))
    return rounded(po.significance(summary, fo.wilcoxon(pairs)), "mean", "low", "high", "p_value")


@register(
    "next_group",
    f"""{_posterior_sql()}, ra2 AS (SELECT candidate, low > 0 AS significant, mean FROM sm)
    SELECT CASE WHEN bool_or(significant) THEN arg_max(candidate, abs(mean)) END AS candidate FROM ra2""",
)
def next_group(spark, folder):
    """The choice by the interval alone (the signed-rank p needs a function SQL lacks)."""
    pairs = fo.paired_scores(band_scores(spark, folder), "prior")
    summary = po.posterior_summary(po.mean_difference_posterior(po.group_posterior(pairs)))
    return po.next_group(summary.withColumn("significant", F.col("low") > 0))


# --- sequence kernel ---------------------------------------------------------------------------------------


def _landmarks(spark, folder):
    docs = documents(spark, folder)
    return docs, ke.landmark_sample(docs, 100, 42)


_MARK_SQL = """lm AS (SELECT doc_id, lang AS label, CASE fold WHEN 0 THEN 'validation' WHEN 99 THEN 'train' END AS part FROM (
    SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1) % 100 AS fold FROM documents)
    WHERE fold IN (0, 99))"""


@register("landmark_sample", f"WITH {_MARK_SQL} SELECT doc_id, label, part FROM lm")
def landmark_sample(spark, folder):
    return _landmarks(spark, folder)[1]


def _kernel_sql() -> str:
    from textpulse.queries.texts import grams_sql

    grams = grams_sql("string_split(text, '')", 1, 3)
    return f"""WITH {_MARK_SQL}, {grams}, gc AS (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY 1, 2),
    kv AS (SELECT a.doc_id AS doc_i, b.doc_id AS doc_j, CAST(sum(a.c * b.c) AS BIGINT) AS k
      FROM gc a JOIN gc b USING (gram) WHERE b.doc_id IN (SELECT doc_id FROM lm WHERE part = 'train') GROUP BY 1, 2),
    sf AS (SELECT doc_id, CAST(sum(c * c) AS DOUBLE) AS s FROM gc GROUP BY 1)"""


def _kernel_sides(spark, folder):
    docs, marks = _landmarks(spark, folder)
    train = marks.filter("part = 'train'").select("doc_id")
    return ke.gram_texts(docs), ke.gram_counts(docs.join(F.broadcast(train), "doc_id", "left_semi"))


@register("kernel_values", f"{_kernel_sql()} SELECT doc_i, doc_j, k FROM kv")
def kernel_values(spark, folder):
    return ke.kernel_values(*_kernel_sides(spark, folder))


@register(
    "normalised_kernel",
    f"""{_kernel_sql()} SELECT doc_i, doc_j, {sql_r6('k / sqrt(a.s * b.s)')} AS k FROM kv
    JOIN sf a ON a.doc_id = doc_i JOIN sf b ON b.doc_id = doc_j""",
)
def normalised_kernel(spark, folder):
    return rounded(ke.normalised_kernel(*_kernel_sides(spark, folder)), "k")
