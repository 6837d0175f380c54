"""Every operator over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import json
import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from textpulse.llm import decontamination, dom, exact_dedup, language_id, main_text, near_dedup, piece_bpe, repeats, sharding, token_files, url_reputation

LONG = " ".join(f"word{i % 977} und{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i} of the thing" for i in range(40))
# Columns as operators name theirs, which must come through or be replaced.
EXTRA = "kept string, digest string, node string, bucket string, n string, label string, host string, uid string, key string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"
ROWS = [
    (7, "The  same text\nhere, twice over.", "en"),
    (3, "The same text here, twice over.", None),
    (3, "The same text here, twice over.", None),  # a repeated row
    (5, None, "en"),
    (6, "", None),
    (9, " \t\n", "de"),
    (None, "A text without an id stands here.", "de"),
    (11, LONG, "en"),
    (12, LONG + " end", None),
    (13, PASSAGE + " one end of it", "fr"),
    (14, "another beginning " + PASSAGE, "fr"),
    (15, "日本語 𝄞 ﷽ \x00 �", "fr"),
    (16, "Ünïcödé WORDS, and 3.5 kg of Apples at $4 in Paris.", "de"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, lang, None if i == 5 else "s", len(t or ""), *"abcdefghi") for i, t, lang in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows, name="doc_id"):
    return {r[name]: r for r in rows}


def test_exact_dedup(edge, empty):
    found = exact_dedup.exact_groups(edge).collect()
    assert len(found) == len(ROWS) and sum(r["kept"] for r in found) == 10
    same = [r for r in found if r["keep"] == 3]
    assert sorted(r["_key"] for r in same) == [3, 3, 7] and {r["size"] for r in same} == {3} and sum(r["kept"] for r in same) == 1
    assert by_id(found, "_key")[6]["keep"] == 5  # null equals empty
    kept = exact_dedup.without_copies(edge)
    assert kept.columns == edge.columns and kept.count() == 10
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.without_copies(empty).columns == edge.columns


def test_exact_dedup_tells_colliding_digests_apart(edge):
    weak = lambda text: F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2))
    one = lambda text: F.lit("x").cast("binary")
    want = sorted((r["_key"] or 0, r["keep"] or 0, r["size"]) for r in exact_dedup.exact_groups(edge).collect())
    for digest in (weak, one):
        got = sorted((r["_key"] or 0, r["keep"] or 0, r["size"]) for r in exact_dedup.exact_groups(edge, digest=digest).collect())
        assert got == want


def test_near_dedup(edge, empty):
    found = near_dedup.near_groups(edge).collect()
    rows = by_id(found, "key")
    assert len(found) == len(ROWS) and rows[7]["component"] == 3 and rows[12]["component"] == 11
    assert rows[5]["n_shingles"] == 0 and rows[6]["component"] == 6 and rows[9]["component"] == 9 and rows[None]["component"] is None
    assert rows[13]["component"] == 13 and rows[14]["component"] in (13, 14)
    assert near_dedup.one_per_group(edge).columns == edge.columns
    assert near_dedup.near_groups(empty).count() == 0 and near_dedup.one_per_group(empty).count() == 0


def test_repeats(edge, empty):
    out = repeats.without_repeats(edge.drop("kept"))
    rows = by_id(out.collect())
    assert [c for c in out.columns if c not in ("n_bytes", "spans", "kept")] == edge.drop("kept").columns
    assert rows[5]["n_bytes"] == 0 and rows[5]["spans"] == [] and rows[6]["kept"] == b""
    assert bytes(rows[11]["kept"]) == b"" and bytes(rows[12]["kept"]) == b"end"
    assert bytes(rows[13]["kept"]) == b" one end of it" and bytes(rows[14]["kept"]) == b"another beginning "
    assert repeats.without_repeats(empty).count() == 0


def test_language(edge, empty):
    profiles = language_id.learn(edge)
    assert profiles.languages == ["de", "en", "fr"]
    out = language_id.predict(edge, profiles)
    rows = by_id(out.collect())
    assert out.columns == [*edge.columns, "lang_pred", "score"] and out.count() == len(ROWS)
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (5, 6, 9))
    assert rows[12]["lang_pred"] == "en" and 0 <= rows[12]["score"] <= 1
    nothing = language_id.learn(empty)
    assert nothing.languages == [] and by_id(language_id.predict(edge, nothing).collect())[12]["lang_pred"] == "und"
    assert language_id.predict(empty, profiles).count() == 0
    assert language_id.accepted(empty).count() == 0
    assert language_id.accepted(edge).columns == edge.columns
    again = language_id.predict(out.withColumn("score", F.lit("x")), profiles)
    assert again.columns == out.columns


def test_pieces(edge, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = piece_bpe.with_text(piece_bpe.with_ids(edge, path), path)
    assert out.columns == [*edge.columns, "ids", "decoded"]
    for r in out.collect():
        assert r["ids"] == model.encode(r["text"] or "") and r["decoded"] == model.decode(r["ids"])
    assert piece_bpe.with_text(piece_bpe.with_ids(empty, path), path).count() == 0
    nulls = edge.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert {r["decoded"] for r in piece_bpe.with_text(nulls, path).collect()} == {""}


def test_token_files(spark, edge, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = edge.unionByName(edge.limit(1).withColumns({"doc_id": F.lit(99).cast("long"), "text": F.lit("a <|endoftext|>b  c\n\nd'll")}))
    token_files.write_token_files(odd, f"{tmp_path}/t", path, 2)
    rows = token_files.read_tokens(spark, f"{tmp_path}/t").collect()
    want = sorted((r["doc_id"] or 0, *tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2) for r in odd.collect())
    assert sorted((r["doc_id"] or 0, *r["ids"]) for r in rows) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    index = sorted(token_files.read_index(spark, f"{tmp_path}/t").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in index] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in index] == [sum(r["n_tokens"] for r in index[:k]) for k in range(len(index))]
    assert [r["doc_id"] for r in token_files.read_tokens(spark, f"{tmp_path}/t", 11, 12).select("doc_id").collect()] == [11, 12]
    token_files.write_token_files(empty, f"{tmp_path}/e", path, 2)
    assert token_files.read_index(spark, f"{tmp_path}/e").count() == 0


def test_sharding(edge, empty):
    clash = edge.withColumns({"shard": F.lit("x"), "slot": F.lit("y")})
    rows = sharding.interleave(clash, 4, ties=["text"]).collect()
    assert len(rows) == len(ROWS)
    sizes = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(4)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    again = sharding.interleave(clash.repartition(1), 4, ties=["text"]).collect()
    key = lambda r: (r["doc_id"] or 0, r["text"] or "", r["shard"], r["slot"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert sharding.interleave(empty, 4).count() == 0


def test_shards_have_the_mixture(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    counts = sharding.interleave(rows, 8).groupBy("source").pivot("shard", list(range(8))).count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 2 for r in counts)


def test_urls(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Example.COM/en/x?y#z"), (6, "https://www.example.com/en/"),
        (7, "http://x.net/es/1"), (8, "http://x.net"), (9, "http://good.org/p"), (10, "http://bad.org/p"), (11, "http://unseen.org/"),
        (12, "x://b.co.uk?q"), (12, "x://b.co.uk?q"), (13, "http://example.com"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumns({"host": F.lit(1), "domain": F.lit(2), "bound": F.lit("x")})
    outcomes = spark.createDataFrame([("good.org", 1)] * 60 + [("bad.org", 0)] * 60 + [("a.net", None)], "host string, good int")
    found = url_reputation.judge_urls(pages, outcomes).collect()
    got = by_id(found, "page_id")
    assert len(found) == len(rows)
    assert all(got[i]["host"] == "" and got[i]["path"] == "" and got[i]["rule"] is None for i in (1, 2, 3, 4))
    assert (got[5]["host"], got[5]["path"], got[5]["rule"], got[5]["verdict"]) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert (got[6]["rule"], got[6]["verdict"]) == ("www.example.com/en/", "allow")
    assert got[7]["rule"] == "net/es/" and got[8]["rule"] is None and got[13]["rule"] is None
    assert got[9]["verdict"] == "allow" and got[10]["verdict"] == "block"
    assert got[10]["bound"] < got[11]["bound"] < got[9]["bound"]
    none = url_reputation.judge_urls(pages, outcomes.limit(0)).collect()
    assert {r["verdict"] for r in none if r["rule"] is None} == {"block"}
    assert url_reputation.judge_urls(pages.limit(0), outcomes).count() == 0


def test_given_suffixes_part_registered_domains(spark):
    urls = [(1, "http://new.foo.gov.uk/a"), (2, "http://new.bar.gov.uk/a")]
    pages = spark.createDataFrame(urls, "page_id bigint, url string")
    rows = [("www.foo.gov.uk", 1)] * 60 + [("www.bar.gov.uk", 0)] * 60
    outcomes = spark.createDataFrame(rows, "host string, good bigint")
    default = by_id(url_reputation.judge_urls(pages, outcomes).collect(), "page_id")
    assert default[1]["bound"] == default[2]["bound"]
    got = by_id(url_reputation.judge_urls(pages, outcomes, long_suffixes=("gov.uk",)).collect(), "page_id")
    assert got[1]["bound"] > default[1]["bound"] and got[2]["bound"] < default[2]["bound"]


def test_templates(spark, edge, empty):
    items = [
        (1, "A train leaves Town for Rome with 30 people and 4 kg of rice each, so how many kg does it carry?"),
        (2, None), (3, ""), (4, "too short"), (5, "five words make one window"), (1, "five words make one window"),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    said = "a train leaves {} for {} with {} people and {} kg of rice each, so how many kg does it carry?"
    docs = [
        (100, "Before. " + items[0][1] + " After."),
        (101, "x y " + said.format("Lyon", "Berlin", 99, 1_000) + " z"),
        (102, said.format("Town", "Rome", 30, 4).replace("rice", "corn").replace("leaves", "left").replace("many", "few")),
        (103, "so five words make one window, they say"),
        (104, "the people of Rome carry rice"),
    ]
    texts = edge.unionByName(spark.createDataFrame(docs, "doc_id bigint, text string"), allowMissingColumns=True)
    found = {(r["key"], r["item"]): r for r in decontamination.contaminated(texts, bench).collect()}
    assert (100, 1) in found and (101, 1) in found and (103, 5) in found and not {k for k, _ in found} & {104, 3, 11, 13}
    assert found[100, 1]["changed"] == 0 and found[101, 1]["changed"] >= 3
    kept = decontamination.decontaminated(texts, bench)
    assert kept.columns == texts.columns and kept.count() == texts.count() - len({k for k, _ in found})
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(texts, bench.limit(0)).count() == 0


def test_contradicting_slots_are_no_copy(spark):
    said = "in {} they met {} and then {} came back to {} before the {} went away with {} again"
    bench = spark.createDataFrame([(1, said.format("Rome", "Anna", "Anna", "Rome", "Anna", "Rome"))], "item_id bigint, text string")
    docs = [(1, said.format("Oslo", "Bert", "Bert", "Oslo", "Bert", "Oslo")), (2, said.format("Aa", "Bb", "Cc", "Dd", "Ee", "Ff"))]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert [r["key"] for r in found] == [1]


def found_items(spark, items, docs):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    return {(r["key"], r["item"]): r for r in decontamination.contaminated(texts, bench).collect()}


def test_templates_do_not_depend_on_the_text_before(spark):
    short = "What is the capital city of France?"
    said = "{} has 5 red apples in his old bag. {} has 7 green apples in a box there. {} has 9 more apples than both of them."
    docs = [
        "Question: " + short,
        "so, " + short,
        said.format("Bob", "Max", "Eve"),
        "Note that " + said.format("Bob", "Max", "Eve").replace(". ", ".\n"),
        said.format("Bob", "Max", "Eve").replace("apples", "pears").replace("has", "had"),
    ]
    found = found_items(spark, [short, said.format("Tom", "Sam", "Ann")], docs)
    assert set(found) == {(0, 0), (1, 0), (2, 1), (3, 1)}
    assert found[0, 0]["changed"] == 0 and found[2, 1]["changed"] == 3 and found[3, 1]["coverage"] >= 0.9


def test_items_made_mostly_of_slots(spark):
    items = ["What is 23 + 45 * 12 - 7?", "Ann 3 Bob 4 Cid 5 Dan 6 Eve 7 Flo 8", "1 2 3 4 5 6"]
    docs = ["Question: " + items[0] + " Tell me.", "scores: " + items[1], "they count 1 2 3 4 5 6 7", "What is 24 + 44 * 11 - 8?", "9 8 7 6 5 4 3 2"]
    found = found_items(spark, items, docs)
    assert set(found) == {(0, 0), (1, 1), (2, 2)} and {r["coverage"] for r in found.values()} == {1.0}


def test_coinciding_values_of_a_document_are_no_contradiction(spark):
    said = "if you take {} red balls and {} blue balls out of the bag how many are left"
    found = found_items(spark, [said.format(3, 4)], [said.format(5, 5), said.format(6, 7)])
    assert {k: r["changed"] for k, r in found.items()} == {(0, 0): 2, (1, 0): 2}


def test_items_of_different_lengths_in_one_document(spark):
    items = ["which river runs past Paris", "which rivers run past old Paris", "a longer item of well over eight tokens in all"]
    docs = [" and ".join(items), items[1], "nothing of the kind", None, ""]
    found = found_items(spark, items, docs)
    assert set(found) == {(0, 0), (0, 1), (0, 2), (1, 1)} and {r["coverage"] for r in found.values()} == {1.0}


def test_broken_pages():
    text = lambda html: (lambda p: p.blocks_of([1] * len(p.tags)))(dom.Page(html))
    assert text("<![foo[x]]><article>Hi</article>") == ["Hi"] and text("<![%") == []
    assert text("a<!-- no end <p>y") == ["a"] and text("<!-->x<!--->y<!-- z --!>w") == ["xyw"]
    assert text("<p>x <a href='y") == ["x"] and text("<p>1 < 2") == ["1 < 2"] and text("<?x y?>z") == ["z"]
    chance = random.Random(1)
    bits = ["<", ">", "!", "[", "]", "--", "<!", "<![", "p", "div", "a ", '="', '"', "'", "/", "&#x", "&", "?", "<!--", "-->", "t", "<script>", "</li>", "%"]
    for _ in range(10_000):
        text("".join(chance.choices(bits, k=chance.randint(1, 40))))


def test_large_broken_pages_take_linear_time():
    begin = time.process_time()
    for html in ("<div>" * 50_000 + "x", "<ul><li>" * 50_000, "<a " * 300_000, "<!-- " * 200_000, "<p>x</div>" * 50_000, "<![x" * 200_000):
        dom.Page(html)
    assert time.process_time() - begin < 30


def test_sample_of_pages_holds_different_marked_ones(spark, monkeypatch):
    marked = "<html><body><nav><a href=x>Home</a></nav><article><p>Text {} of it, at length.</p></article></body></html>"
    rows = [f"<html><body><div>page {i}</div></body></html>" for i in range(300)] + [marked.format(0)] * 200 + [marked.format(i) for i in range(6)]
    pages = spark.createDataFrame([(t,) for t in rows], "html string")
    taken = []
    monkeypatch.setattr(main_text, "written", lambda df, name: taken.append((name, df.collect())) or df.sparkSession.createDataFrame(taken[-1][1], df.schema))
    assert main_text.learn(pages, most=5) is not None
    assert len(taken[0][1]) == 5 and len({r["digest"] for r in taken[0][1]}) == 5
    one = main_text.learn(spark.createDataFrame([(marked.format(1),)], "html string"))
    assert one is not None and len(taken[1][1]) > 3 * len(taken[-1][1])  # nodes of five pages and of one


def test_unmarked_pages_without_a_model(spark):
    long = "A long sentence of the page, which goes on for some time, and then some more, until it ends here."
    page = f"<body><nav><p>{long}</p></nav><div><h1>Head</h1><p>{long}</p><p>Short.</p></div><ul><li><a href=x>{long}</a></ul></body>"
    pages = spark.createDataFrame([(1, page), (2, "<body><div><p>Few words</p></div>"), (3, "")], "page_id bigint, html string")
    assert main_text.learn(pages) is None
    got = by_id(main_text.extract(pages, None).collect(), "page_id")
    assert [got[i]["text"] for i in (1, 2, 3)] == [f"Head\n{long}\nShort.", "Few words", ""]


@pytest.mark.parametrize("start", ["<body>", "", "<head><body>"])
def test_head_without_end_tag(start):
    head = "<html><head><meta charset=utf-8><title>x</title><script>var a=1</script><noscript><div>no</div></noscript>"
    page = dom.Page(head + start + "<article><p>Hello</p><p>you</article>")
    assert page.blocks_of(dom.by_convention(page)) == ["Hello", "you"]
    page = dom.Page("<head><title>x</title>\n<style>p{}</style></head><body><article>Hello")
    assert page.blocks_of([1] * len(page.tags)) == ["Hello"]
    page = dom.Page("<head><title>x</title>Hello")
    assert page.blocks_of([1] * len(page.tags)) == ["Hello"]


def test_main_text(spark):
    article = "<article><h1>Head  line</h1><p>First &amp; best<br>part.<p>Second <b>part</b>, &#233;.</article>"
    shell = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>{}<footer>&copy; us</footer>"
    rows = [(i, "u", shell.format(article.replace("Second", f"Second {i}"))) for i in range(30)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "<p"), (103, "u", shell.format("<article><p>" + LONG + "</p></article>"))]
    rows += [(104, "u", shell.format('<article><p>Text of it.</p><div class="comments"><p>Nice!</p></div><aside>side</aside><form>f</form></article>'))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit(1), "label": F.lit("x"), "features": F.lit(2)})
    out = main_text.extract(pages, main_text.learn(pages))
    got = by_id(out.collect(), "page_id")
    assert out.columns == ["page_id", "url", "html", "label", "features", "text", "n_chars"]
    assert got[3]["text"] == "Head line\nFirst & best part.\nSecond 3 part, é." and got[3]["n_chars"] == len(got[3]["text"])
    assert got[100]["text"] == "" and got[101]["text"] == "" and got[103]["text"] == LONG and got[104]["text"] == "Text of it."
    none = main_text.learn(pages.limit(0))
    assert none is None and by_id(main_text.extract(pages, none).collect(), "page_id")[3]["text"] == got[3]["text"]
    assert main_text.extract(pages.limit(0), None).count() == 0


def test_pipeline(spark, edge, tmp_path):
    bench = spark.createDataFrame([(1, "A text without an id stands here.")], "item_id bigint, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = [r["doc_id"] for r in out.collect()]
    assert None not in ids and not {5, 6, 7, 9, 12} & set(ids) and ids.count(3) == 1 and {11, 13, 16} <= set(ids)
    edge.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    bench.write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert json.dumps([name for name, _ in corpus_pipeline.STAGES])


def test_coding_with_small_caches(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["one two three four five six seven", "", "  seven six\nfive é中 four", "three two one " * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    piece_bpe._encoder.cache_clear()
    (out,) = piece_bpe._decoded(piece_bpe._encoded(iter([batch]), path, "text", "ids", 8), path, "ids", "decoded", 8)
    assert out.column("ids").to_pylist() == [model.encode(t) for t in texts]
    assert out.column("decoded").to_pylist() == [model.decode(model.encode(t)) for t in texts]
    assert 2 * piece_bpe.BOTH_WORDS < piece_bpe.CACHE_WORDS  # two caches stand beside each other
    assert piece_bpe._encoder(path, 8).limit == 8
