"""Operators against brute force, the public libraries and held-out labels, on the smallest tables."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textpulse.llm import components, dom, main_text, near_dedup, piece_bpe, repeats, shingles, suffix_sort, token_files
from textpulse.llm.common import QUERIES
from textpulse.llm.queries import ORACLES  # noqa: F401  registers all queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def plain_set(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def plain_components(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_shingles_are_the_plain_ones(texts):
    for text in [*texts.values(), "", " ", "a", "A b\tC\x0b d\x0ce f\x1cg", "é É"]:
        assert len(shingles.shingle_set(text)) == len(plain_set(text))


@pytest.mark.parametrize("bucket, block", [(128, 400_000), (4, 3_000)])
def test_near_duplicates_in_a_dense_cluster(spark, texts, monkeypatch, bucket, block):
    """Chains and stars of edited copies, also when buckets and clusters count as large."""
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    chance = random.Random(5)
    base = [t for t in texts.values() if 60 < len(t.split()) < 200][:4]
    docs = []
    for text in base:
        copies = [text.split()]
        for _ in range(25):
            words = list(chance.choice(copies))
            for _ in range(chance.choice((0, 1, 1, 2, 3))):
                words[chance.randrange(len(words))] = f"edit{chance.random()}"
            copies.append(words)
        docs += [" ".join(c) for c in copies]
    docs += list(texts.values())[:40]
    chance.shuffle(docs)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    want = plain_components({i: plain_set(t) for i, t in enumerate(docs)}, 85)
    got = {r["key"]: r["component"] for r in near_dedup.near_groups(frame).collect()}
    assert got == want and len(set(want.values())) < len(docs) - 20


def test_near_duplicate_query(spark, texts):
    want = plain_components({i: plain_set(t) for i, t in texts.items()}, 85)
    rows = QUERIES["op10_chosen_path_minhash"](spark, FOLDER).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_linked_pairs_match_sets():
    random_ = np.random.default_rng(3)
    sets = [np.unique(random_.integers(0, 40, n)) for n in random_.integers(1, 40, 30)]
    got = near_dedup.linked_pairs(sets, sets, 60)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(set(a) & set(b))
            assert got[i, j] == (100 * both >= 60 * (len(a) + len(b) - both))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199), (199, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 199: 199, 200: 199}


def test_suffixes_are_sorted(texts):
    raw = np.frombuffer(("abracadabra" * 9 + "b" * 50 + next(iter(texts.values()))[:300]).encode(), dtype=np.uint8)
    at = np.arange(len(raw))
    group = (at >= 100).astype(int)
    found = suffix_sort.Suffixes(raw, shingles.prefix_hashes(raw), at, len(raw) - at)
    order = found.sorted(group)
    data = raw.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: (group[i], data[i:], i))
    near = found.neighbours(order, group)
    assert found.verified(order, near)
    for k in range(1, len(order)):
        a, b = data[order[k - 1] :], data[order[k] :]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert near[k] == (same if group[order[k]] == group[order[k - 1]] else 0)


def test_windows_without_hashes_are_the_same(monkeypatch):
    random_ = random.Random(2)
    base = bytes(random_.choices(b"ab", k=60))
    pieces = [bytes(random_.choices(b"ab", k=9)) + base + bytes(random_.choices(b"ab", k=9)) for _ in range(12)]
    args = (pieces, np.full(12, 30), np.repeat([0, 1], 6), np.zeros(12, int), np.full(12, 29), 40)
    want = suffix_sort.repeated_windows(*args)
    monkeypatch.setattr(suffix_sort.Suffixes, "verified", lambda self, *a: False)
    assert (suffix_sort.repeated_windows(*args) == want).all() and want.any() and not want.all()


@pytest.mark.parametrize("together", [2000, 2])
def test_repeats_match_brute_force(spark, texts, monkeypatch, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    raw = {i: t.encode() for i, t in texts.items()}
    size = repeats.LENGTH
    counts = Counter(b[i : i + size] for b in raw.values() for i in range(len(b) - size + 1))
    rows = {r["doc_id"]: r for r in QUERIES["op4_sorted_suffix_repeats"](spark, FOLDER).collect()}
    assert rows.keys() == raw.keys()
    for i, b in raw.items():
        change = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - size + 1):
            if counts[b[k : k + size]] > 1:
                change[k] += 1
                change[k + size] -= 1
        gone = np.cumsum(change)[: len(b)] > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        want = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert tuple(rows[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want


def test_repeats_in_one_byte_texts(spark):
    docs = [(1, "a" * 1000), (2, "b" * 400), (3, "c" * 401), (4, "xy" * 300 + "z"), (5, "z" + "xy" * 300)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.without_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: b"", 2: b"b" * 400, 3: b"", 4: b"z", 5: b"z"}


def test_piece_ids_are_the_library_s(spark, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.piece_model(path)
    for r in QUERIES["op6_piece_encoding"](spark, FOLDER).collect():
        ids = model.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    chance = random.Random(1)
    for _ in range(4000):
        text = "".join(chance.choices("abcdeé ▁ \n\t.,the日𝄞ñ<0x>A_9²́  aabb", k=chance.randint(0, 30)))
        assert own.encode(text) == model.encode(text)
        ids = [chance.choice([0, 1, 2, *range(3, 259), *range(259, 3000)]) for _ in range(chance.randint(0, 9))]
        assert own.decode(ids) == model.decode(ids)


def test_token_files_are_the_library_s(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, start = Tokenizer.from_file(path), 0
    rows = {r["doc_id"]: r for r in QUERIES["op9_token_files"](spark, FOLDER).collect()}
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        want = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        assert tuple(rows[i][c] for c in ("start", "n_tokens", "ids_crc32")) == want
        start += len(ids)
    encoder, chance = token_files.PartEncoder(path, 2), random.Random(3)
    encoder.table.limit = 900  # so that it starts afresh at times
    for _ in range(80):
        some = ["".join(chance.choices("ab5²½é '\n\t.,!_-  sstll日𝄞́\xa0", k=chance.randint(0, 25))) for _ in range(50)]
        some += chance.sample(["<|endoftext|>", "x \ue00fy", "", " "], chance.randint(0, 4))
        want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in some]
        assert encoder.lists(some).to_pylist() == want


def test_language_on_held_out_documents(spark):
    found = QUERIES["op7_rank_order_language"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(labels, "doc_id").filter("held_out").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_main_text_is_the_article(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in QUERIES["op5_boosted_main_text"](spark, FOLDER).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_decoding_is_the_likeliest_consistent_choice():
    chance = random.Random(4)
    for _ in range(60):
        n = chance.randint(1, 8)
        parents = [-1] + [chance.randrange(i) for i in range(1, n)]
        margins = np.array([chance.gauss(0, 2) for _ in range(n)])
        keep, drop = -np.logaddexp(0, -margins), -np.logaddexp(0, margins)
        best = max(
            (sum(keep[i] if m >> i & 1 else drop[i] for i in range(n)), m)
            for m in range(1, 2**n, 2)
            if all(not m >> i & 1 or m >> parents[i] & 1 for i in range(1, n))
        )
        got = main_text.decoded(parents, margins)
        assert sum(b << i for i, b in enumerate(got)) == best[1]


def test_tolerant_trees():
    page = dom.Page("<div><p>a<p>b <b>c<br>d<ul><li>e<li>f</ul></div>tail<script>x<y</script><td>g</p>")
    assert page.blocks_of([True] * len(page.tags)) == ["a", "b c d", "e", "f", "tail", "g"]
    assert all(p < i for i, p in enumerate(page.parents))


def test_queries_read_everything(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op3_stratified_interleaving", "op8_streaming_exact_dedup"):
        assert QUERIES[name](spark, FOLDER).agg(F.countDistinct("doc_id")).first()[0] == n
