import pytest
from pyspark.sql import functions as F

from textpulse.functions import text as tx
from plain_stemmer import porter

from textpulse.functions.stemmer import porter_stem, stem_sql
from textpulse.operators import mappers as mp
from textpulse.operators.lookup import looked_up
from textpulse.operators import tokens as tk
from textpulse.operators import vocab as vc
from textpulse.sources.tables import read_labelled_csv, write_labelled_csv

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "plastered": "plaster",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file",
    "happy": "happi", "relational": "relat", "rational": "ration", "digitizer": "digit", "operator": "oper",
    "decisiveness": "decis", "triplicate": "triplic", "goodness": "good", "adjustment": "adjust", "adoption": "adopt",
    "bowdlerize": "bowdler", "rate": "rate", "controll": "control", "roll": "roll", "skies": "sky", "dying": "die",
    "generalizations": "gener", "is": "is",
}


def tokens_of(spark, tokenizer, text):
    return spark.createDataFrame([(text,)], "text string").select(tokenizer(F.col("text"))).first()[0]


def test_stems_in_both_engines(spark):
    import random

    import duckdb

    chance = random.Random(1)
    ends = "s ies sses ed ied eed ing y e ll ational alli logi izer ization fulness icate ative al ance er ion tion ement able ous yy".split()
    words = list(STEMS) + ["Skies", "dying", "yyy", "sayyyed", "1y1", "vying", "", "éed"]
    words += ["".join(chance.choices("abcdegilnorstuyvz", k=chance.randint(1, 6))) + chance.choice(ends) for _ in range(3000)]
    want = {w: porter(w) for w in words}
    got = spark.createDataFrame([(w,) for w in want], "token string").withColumn("stem", porter_stem()).collect()
    assert {r.token: r.stem for r in got} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE t (token VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(w,) for w in list(want)[:400]])
    assert dict(con.execute(f"SELECT token, {stem_sql('token')} FROM t").fetchall()) == {w: want[w] for w in list(want)[:400]}


def test_porter_examples():
    assert {w: porter(w) for w in STEMS} == STEMS


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("I can't go.", ["I", "ca", "n't", "go", "."]),
        ('He said: "stop it!"', ["He", "said", ":", "``", "stop", "it", "!", "''"]),
        ("They'll pay $5, or more... maybe", ["They", "'ll", "pay", "$", "5", ",", "or", "more", "...", "maybe"]),
        ("One ends. Another (here) cannot wait--ok?", ["One", "ends", ".", "Another", "(", "here", ")", "can", "not", "wait", "--", "ok", "?"]),
        ("", []),
    ],
)
def test_treebank(spark, text, expected):
    assert tokens_of(spark, tx.treebank, text) == expected


def test_words_and_ngrams(spark):
    assert tokens_of(spark, tx.words, "A Über-cool x_y 1 22") == ["über", "cool", "x_y", "22"]
    assert tokens_of(spark, lambda c: tx.char_ngrams(tx.characters(c), 2), "añb😀") == ["añ", "ñb", "b😀"]
    assert tokens_of(spark, lambda c: tx.char_ngrams(tx.characters(c), 3), "ab") == []
    assert tokens_of(spark, lambda c: tx.word_ngrams(tx.words(c), 2), "aa bb cc") == ["aa bb", "bb cc"]


def test_capitals_come_back(spark, docs):
    rows = tk.stemmed(tk.tokens(docs, tx.word_marks), "porter_case")
    assert [r.token for r in rows.filter("doc_id = 1").collect()] == ["Run"]
    assert {r.token for r in rows.filter("doc_id = 2").collect()} == {"the", "cat", "and", "Dog", ",", "end"}


def test_validation(spark, docs):
    assert tk.check_texts(docs) is docs
    with pytest.raises(ValueError):
        tk.check_texts(spark.createDataFrame([(1, None)], "doc_id bigint, text string"))
    with pytest.raises(TypeError):
        tk.check_texts(spark.createDataFrame([(1, 2)], "doc_id bigint, text int"))


def test_rank_ties_in_first_seen_order(docs):
    ranks = vc.ranked(vc.vocabulary(tk.tokens(docs, tx.word_marks))).orderBy("rank").collect()
    assert [r.rank for r in ranks] == list(range(1, len(ranks) + 1))
    assert [r.token for r in ranks[:4]] == ["the", "cat", "dog", "Running"]


def series_of(mapper, docs, doc_id):
    return [round(r.value, 6) for r in mapper.transform(docs).filter(f"doc_id = {doc_id}").orderBy("t").collect()]


def test_mappers(docs):
    length = mp.TokenLengthSequence(tokenizer=tx.word_marks)
    assert series_of(length, docs, 0) == [0.0]
    assert series_of(length, docs, 4) == [3.0, 3.0, 3.0]
    freq = mp.TokenFrequencySequence(tokenizer=tx.word_marks, stem_mode="identity").fit(docs.filter("doc_id <> 4"))
    assert series_of(freq, docs, 0) == [0.0]
    assert series_of(freq, docs, 4) == [0.0, round(0.693147, 6), 0.0]  # "dog" is unseen, "cat" seen once
    rank = mp.TokenRankSequence(tokenizer=tx.word_marks, stem_mode="identity").fit(docs.filter("doc_id = 2"))
    assert series_of(rank, docs, 4)[1] == pytest.approx(1.098612, abs=1e-6)  # "cat" ranks 2
    assert series_of(rank, docs, 4)[0] == pytest.approx(2.079442, abs=1e-6)  # unseen: last rank 6 + 1
    dist = mp.TokenLengthDistribution(tokenizer=tx.word_marks)
    assert sum(series_of(dist, docs, 3)) == pytest.approx(1 / 3)  # two of three tokens are longer than 14
    assert series_of(dist, docs, 0) == [0.0] * 14
    top = mp.TokenRankDistribution(length=2, stem_mode="identity").fit(docs)
    assert series_of(top, docs, 2) == [1.0, 3.0]  # cat, the (dog ties with cat and comes later)
    assert series_of(top, docs, 0) == [0.0, 0.0]


def test_fold_series_equal_fitting_each_fold(docs, spark):
    folds = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("fold"))
    for mapper in (
        mp.TokenFrequencySequence(tokenizer=tx.word_marks),
        mp.TokenRankSequence(tokenizer=tx.word_marks),
        mp.TokenRankDistribution(length=3),
    ):
        every = mapper.fold_series(docs, folds, 2).toPandas()
        for fold in (0, 1):
            mapper.fit(docs.filter(f"doc_id % 2 <> {fold}"))
            want = mapper.transform(docs).toPandas().sort_values(["doc_id", "t"])
            got = every[every.fold == fold].sort_values(["doc_id", "t"])
            assert got[["doc_id", "t"]].values.tolist() == want[["doc_id", "t"]].values.tolist()
            assert got.value.tolist() == pytest.approx(want.value.tolist())


def test_tfidf_has_unit_length(docs, spark):
    counts = tk.count_by(tk.tokens(docs, tx.words), "doc_id", "token")
    weights = vc.tfidf(counts, docs.agg(F.count(F.lit(1)).alias("n_docs")))
    norms = weights.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert [r.s for r in norms] == pytest.approx([1.0] * 4)


def test_csv_round_trip(spark, tmp_path):
    rows = [(0, 'He said "yes", twice\nand left', "x"), (1, "plain é", "y"), (2, "", "y")]
    write_labelled_csv(spark.createDataFrame(rows, "doc_id bigint, text string, label string"), str(tmp_path / "c"))
    back = read_labelled_csv(spark, str(tmp_path / "c")).collect()
    assert sorted((r.text, r.label) for r in back) == sorted((t, y) for _, t, y in rows)


def moved_by(spark, plan_of, rows):
    """What the exchanges of a query over ``rows`` documents carry: True if exploded tokens or grams are among it."""
    import re

    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plan = plan_of(docs)._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("Exchange hashpartitioning"):]
    return plan.count("Exchange hashpartitioning"), re.search("Generate", first) is not None


ROWS = [(1, "Aa bb aa."), (1, "aa cc"), (2, "Aa bb aa."), (None, "dd"), (None, "dd ee"), (3, ""), (4, None), (5, "x")]


def test_profile_of_whole_texts_equals_the_token_table(spark):
    from textpulse.queries.texts import _shape

    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    plain = _shape(tk.tokens(docs, tx.word_marks))
    whole = tk.part_profile(tk.whole_texts(docs, tx.word_marks(F.col("text"))), "doc_id")
    assert whole.columns == plain.columns
    assert sorted(whole.collect(), key=str) == sorted(plain.collect(), key=str)
    assert whole.count() == 4


def test_token_profiles_shuffle_texts_not_tokens(spark):
    profile = lambda d: tk.part_profile(tk.whole_texts(d, tx.word_marks(F.col("text"))), "doc_id")
    assert moved_by(spark, profile, ROWS) == (1, False)
    assert moved_by(spark, tk.word_ngram_profile, ROWS) == (1, False)


def test_gram_tables_equal_the_gram_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    for table, rows in (
        (tk.char_ngram_table(docs), tk.char_ngrams(docs)),
        (tk.raw_char_ngram_table(docs), tk.raw_char_ngrams(docs)),
    ):
        per_doc = tk.count_by(rows, "doc_id", "n", "gram", name="c")
        plain = per_doc.groupBy("n", "gram").agg(F.sum("c").alias("freq"), F.count(F.lit(1)).alias("df"))
        assert sorted(table.collect()) == sorted(plain.collect())


def test_word_ngram_profile_equals_the_gram_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    plain = tk.word_ngrams(docs).groupBy("doc_id", "n").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("gram").alias("n_distinct"),
        F.min("gram").alias("first_token"), F.max("gram").alias("last_token"),
    )
    whole = tk.word_ngram_profile(docs).select(*plain.columns)
    assert sorted(whole.collect(), key=str) == sorted(plain.collect(), key=str)


def test_gram_tables_shuffle_no_row_per_document_and_gram(spark):
    plan = tk.char_ngram_table(spark.createDataFrame(ROWS, "doc_id bigint, text string"))
    shown = plan._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in shown.splitlines() if "Exchange hashpartitioning" in line and "doc_id" in line]
    assert len(keyed) == 1 and "REPARTITION_BY_NUM" in keyed[0]


def test_lookup_of_common_and_rare_keys(spark):
    rows = spark.createDataFrame([(i, t) for i in range(3) for t in "abcx"], "doc_id bigint, token string")
    values = spark.createDataFrame([("a", 1, 9), ("b", 2, 5), ("c", 3, 1)], "token string, v int, n bigint")
    for how, unseen in (("inner", []), ("left", [None])):
        for common in (1, 2, 3):
            got = looked_up(rows, values, ["token"], "n", how, common=common).collect()
            assert sorted((r.doc_id, r.token, r.v) for r in got if r.v) == [(i, t, v) for i in range(3) for t, v in zip("abc", (1, 2, 3))]
            assert [r.v for r in got if not r.v] == unseen * 3


def joins(df):
    """The joins of a plan, line by line."""
    lines = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    return [line for line in lines if "Join" in line]


def test_tokens_meet_values_without_a_shuffle(spark, docs):
    frequency = mp.TokenFrequencySequence().fit_transform(docs)
    stems = tk.stemmed(tk.tokens(docs, tx.word_marks), "porter_case")
    weights = vc.tfidf(tk.document_counts(docs, lambda d: tk.tokens(d, tx.words)), docs.agg(F.count(F.lit(1)).alias("n_docs")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [joins(rows) for rows in (frequency, stems, weights)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(lines and all("BroadcastHashJoin" in line for line in lines) for lines in found)


def test_fit_transform_cuts_texts_once(docs):
    calls = []

    def tokenizer(text):
        calls.append(1)
        return tx.treebank(text)

    mapper = mp.TokenRankSequence(tokenizer=tokenizer)
    once = mapper.fit_transform(docs).toPandas().sort_values(["doc_id", "t"])
    assert len(calls) == 1
    twice = mp.TokenRankSequence().fit(docs).transform(docs).toPandas().sort_values(["doc_id", "t"])
    assert once.values.tolist() == twice.values.tolist()


def test_rules_are_left_out_only_where_they_change_nothing(spark):
    lines = [
        None, "", "a", " \n ", "He said: \"I CANNOT go,\" d'YE know? Gimme `this' (or that)... wanna, more'N; it's 'tis 'Twas.",
        "«Oui» “yes” ‘no’ „ja” ``x'' y--z *a* 5:3, 1,000: $5 & 6% <b> [c] {d} won't they'LL I'd dogs' ", "Gonna end. Then gotta lemme..", "İCANNOT ſ",
    ]
    rows = spark.createDataFrame([(x,) for x in lines], "text string")
    plain = F.regexp_replace("text", r"\s+", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, tx.SENTENCE_END, "$1\n$2"), r"\n", " \n ")
    plain = F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), r"(?m)^ +", "")
    for pattern, replacement in tx.TREEBANK_RULES:
        plain = F.regexp_replace(plain, pattern, replacement)
    want = F.regexp_extract_all(plain, F.lit(tx.NON_SPACE), F.lit(1))
    for r in rows.select("text", tx.treebank(F.col("text")).alias("got"), want.alias("want")).collect():
        assert r.got == r.want, r.text


def test_gram_table_explodes_no_grams_and_equals_brute_force(spark, monkeypatch):
    from collections import Counter

    import pyarrow as pa

    from textpulse.operators import grams as gr

    texts = {1: ["añb😀 añb", "", "ab"], 2: ["\0a\0"], 3: ["中文中文字"], 4: [], 5: ["bb bb bb"], 6: ["ab"]}
    freq, docs = Counter(), {}
    for doc, rows in texts.items():
        for text in rows:
            for n in range(1, 6):
                for i in range(len(text) - n + 1):
                    freq[n, text[i : i + n]] += 1
                    docs.setdefault((n, text[i : i + n]), set()).add(doc)
    want = {k: (c, len(docs[k])) for k, c in freq.items()}
    rows = [(doc, text) for doc, found in texts.items() for text in found or [None]]
    table = tk.raw_char_ngram_table(spark.createDataFrame(rows, "doc_id bigint, text string"), (1, 5))
    assert "Generate" not in table._jdf.queryExecution().executedPlan().toString()
    assert {(r.n, r.gram): (r.freq, r.df) for r in table.collect()} == want
    batch = pa.table({"doc_id": list(texts), "texts": pa.array(list(texts.values()), pa.list_(pa.string()))}).to_batches()[0]
    for most, keys in ((2_000_000, 200), (10, 2**62), (10, 200)):  # few documents at a time, prefixes numbered early
        monkeypatch.setattr(gr, "_KEYS", keys)
        got = {}
        for chunk in gr.chunks(batch.slice(0, 6), most):
            for found in gr.chunk_table(chunk, (1, 5)):
                for r in found.to_pylist():
                    f, d = got.get((r["n"], r["gram"]), (0, 0))
                    got[r["n"], r["gram"]] = f + r["freq"], d + r["df"]
        assert got == want


def test_tfidf_of_texts_equals_that_of_counts(spark):
    rows = [*ROWS, (6, "añb😀 añb"), (7, "\0a\0"), (9, "bb  bb\tbb"), (10, "Aa bb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    n_docs = spark.sql("SELECT 12L AS n_docs")
    counts = tk.document_counts(docs, lambda d: tk.char_ngrams(d).withColumnRenamed("gram", "token"))
    for sublinear in (True, False):
        found = [
            {(r.doc_id, r.token): r.weight for r in vc.tfidf(x, n_docs, min_df=0.2, sublinear=sublinear).collect()}
            for x in (counts, tk.folded_texts(docs))
        ]
        assert found[1] == pytest.approx(found[0]) and len(found[0]) > 20
    plan = vc.tfidf(tk.folded_texts(docs), n_docs, min_df=0.2)._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan.lower() and "Window" not in plan
