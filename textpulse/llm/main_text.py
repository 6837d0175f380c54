"""Main text of web pages by gradient-boosted trees over the nodes of their document trees.

The model learns from pages that mark their article themselves, on a bounded sample: from each as it is, with other
matter put into it, and with its marks hidden, so that it also judges pages without marks, by densities, depth and
siblings. Decoding chooses for each page the likeliest set of kept nodes in which no dropped node has a kept one
inside it.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from textpulse.llm.common import read, register, written
from textpulse.llm.dom import OTHER_TAGS, OTHER_WORDS, Page, by_convention, by_density, features
from textpulse.llm.words import runs

#: Most pages that the model learns from: different ones that mark their article.
TRAINING_PAGES = 400
TREES, DEPTH, STEP = 20, 4, 0.3


def _with_other_matter(html: str, chance: random.Random) -> str:
    """The page with a few elements put in that are not main text, made of its own words, and set deeper at times."""
    words = html.replace("<", " <").split()
    words = [w for w in words if "<" not in w and ">" not in w][:200] or ["text"]
    for place in ("<body>", "</h1>", "</article>", "</main>", "</body>"):
        if place in html and chance.random() < 0.6:
            text = " ".join(chance.choices(words, k=chance.randint(2, 60)))
            tag, word = chance.choice(sorted(OTHER_TAGS)), chance.choice(sorted(OTHER_WORDS))
            inner = chance.choice((f"<p>{text}</p>", text, f"<ul><li><a href='#'>{text}</a></li></ul>"))
            added = f"<{tag}>{inner}</{tag}>" if chance.random() < 0.5 else f'<div class="{word}">{inner}</div>'
            html = html.replace(place, place + added if place in ("<body>", "</h1>", "</article>") else added + place, 1)
    if chance.random() < 0.5:
        html = html.replace("<body>", "<body>" + chance.choice(('<div id="page">', '<div class="wrap"><div>', "<div><div><div>")), 1)
    if chance.random() < 0.4:
        html = html.replace("<article", "<main").replace("</article", "</main")
    return html


def examples(html: str) -> Iterator[tuple[int, list[float]]]:
    """Label and features of the nodes of a page and of its altered forms; none if it does not mark its main text."""
    chance = random.Random(zlib.crc32(html.encode("utf-8", "surrogatepass")))
    for form in (html, _with_other_matter(html, chance), _with_other_matter(html, chance)):
        page = Page(form)
        labels = by_convention(page)
        if labels is None:
            return
        for hidden in (0.0, 0.7, 1.0):
            if hidden:
                for i in range(1, len(page.tags)):
                    if page.tags[i] in OTHER_TAGS | {"article", "main"} or page.tokens[i]:
                        if chance.random() < hidden:
                            page.tags[i], page.tokens[i] = "div", ()
            yield from zip(labels, features(page).tolist())


@dataclass
class Boosted:
    """The trees of a fitted model as arrays: children -1 are leaves."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    weights: list[float]

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds that a node is main."""
        total = np.zeros(len(rows))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(rows), dtype=np.int64)
            while True:
                inner = np.flatnonzero(left[at] >= 0)
                if not len(inner):
                    break
                here = at[inner]
                at[inner] = np.where(rows[inner, feature[here]] <= threshold[here], left[here], right[here])
            total += weight * value[at]
        return 2 * total


def exported(model: GBTClassificationModel) -> Boosted:
    trees = []
    for tree in model.trees:
        nodes, queue = [], [tree._java_obj.rootNode()]
        for node in queue:  # grows while it is read
            if node.getClass().getSimpleName() == "LeafNode":
                nodes.append((0, 0.0, -1, -1, node.prediction()))
            else:
                split = node.split()
                nodes.append((split.featureIndex(), split.threshold(), len(queue), len(queue) + 1, 0.0))
                queue += [node.leftChild(), node.rightChild()]
        trees.append(tuple(np.array(c) for c in zip(*nodes)))
    return Boosted(trees, list(model.treeWeights))


def learn(pages: DataFrame, html: str = "html", most: int = TRAINING_PAGES) -> Boosted | None:
    """Model of at most ``most`` different pages that mark their article, chosen by a digest; null without such pages."""
    rows = pages.select(F.col(html).cast("string").alias("html")).filter("html is not null")
    rows = rows.select(F.xxhash64("html").alias("digest"), "html")

    def marking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, "html"):
            marks = pa.array([by_convention(Page(t)) is not None for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("digest").filter(marks)], names=["digest"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # at most ``most`` digests
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            first = [d not in seen and not seen.add(d) for d in digests]
            yield batch.filter(pa.array(first, pa.bool_()))

    chosen = rows.mapInArrow(marking, "digest bigint").distinct().orderBy("digest").limit(most)
    chosen = F.broadcast(written(chosen, "page-sample"))
    # Copies go in the map tasks, so that a page that stands in many rows is moved once a task.
    some = rows.join(chosen, "digest").mapInArrow(once, "digest bigint, html string").dropDuplicates(["digest"])
    some = some.select("html").repartition(8)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, "html"):
            found = [e for t in texts for e in examples(t)]
            columns = [pa.array([float(e[0]) for e in found], pa.float64()), pa.array([e[1] for e in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "values"])

    rows = written(some.mapInArrow(make, "label double, values array<double>"), "page-nodes")
    if rows.isEmpty():
        return None
    rows = rows.select("label", array_to_vector("values").alias("features"))
    return exported(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1).fit(rows))


def decoded(parents: list[int], margins: np.ndarray) -> list[bool]:
    """The likeliest kept set: keeping a node needs its parent kept, the root is kept."""
    n = len(parents)
    keep = (-np.logaddexp(0.0, -margins)).tolist()
    drop = (-np.logaddexp(0.0, margins)).tolist()
    chosen = [False] * n
    for i in range(n - 1, 0, -1):
        p = parents[i]
        chosen[i] = keep[i] > drop[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    chosen[0] = True
    for i in range(1, n):
        chosen[i] = chosen[i] and chosen[parents[i]]
    return chosen


def extract(pages: DataFrame, model: Boosted | None, html: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) to every page.

    Blocks stand in page order with one line break between them; character references are decoded and white space is
    made single spaces. A null or empty page, or one without kept text, has the empty text. Without a model a page's
    own marks decide, or else its densities. Columns of these names are replaced, all others are kept; repeated rows give equal results.
    """
    pages = pages.drop("text", "n_chars")
    schema = StructType([*pages.schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, html):
            trees = [Page(t) for t in texts]
            rows = [features(t) for t in trees]
            ends = np.cumsum([len(r) for r in rows])
            if model is None:
                kept = [by_convention(t) or by_density(t) for t in trees]
            else:
                margins = np.split(model.margins(np.concatenate(rows)), ends[:-1]) if rows else []
                kept = [decoded(t.parents, m) for t, m in zip(trees, margins)]
            out = ["\n".join(t.blocks_of(k)) for t, k in zip(trees, kept)]
            added = [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return pages.mapInArrow(judge, schema)


@register("op5_boosted_main_text")
def op5_boosted_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, folder, "pages").select("page_id", "url", "html")
    return extract(pages, learn(pages)).select("page_id", "url", "text", "n_chars")
