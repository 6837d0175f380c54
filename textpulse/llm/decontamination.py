"""Benchmark decontamination by templates.

Texts are made into tokens in which numbers, names and units become typed slots that keep their value aside. Equal
runs of template tokens (windows) of a benchmark item and of a document are found by a hash join. Matches of one
item in one document on one diagonal (document position minus item position) are one occurrence. In a copy or a
re-parameterised question every slot value of the item goes to one value of the document, so occurrences with
contradicting slots are dropped, and a document is contaminated by an item when consistent occurrences cover
enough of the item's windows. Windows are read in several forms (``FORMS``), since a capital alone does not tell a name
from the beginning of a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import located, read, register, small, whole_text, written

#: Tokens of a window; an item with fewer tokens, but at least SHORTEST, is one window of its own length.
WINDOW, SHORTEST = 8, 5
#: Share of an item's windows that must be found.
COVERAGE = 0.5
#: Share of an occurrence's slot values that must agree on their counterpart.
CONSISTENT = 0.8
#: Most benchmark windows that are broadcast.
BENCHMARK_WINDOWS = 2_000_000

# Characters of the private use area that begin a slot (number, name, unit) or join a number's parts.
NUMBER, NAME, UNIT, JOINT = "\ue000", "\ue001", "\ue002", "\ue003"
SLOTS = NUMBER + NAME + UNIT
#: Begins a capitalised word that may be a name or just begin a sentence, line or text.
FIRST = "\ue004"
UNITS = (
    "kg|g|mg|km|cm|mm|m|mi|ft|lb|lbs|oz|l|ml|s|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|"
    "miles?|meters?|metres?|kilometers?|kilometres?|grams?|kilograms?|liters?|litres?|"
    "dollars?|euros?|pounds?|cents?|percent|%"
)
_TOKEN = rf"\p{{L}}\p{{M}}\p{{Nd}}{JOINT}"
#: Rewriting steps in order, (pattern, replacement), without look-around so that any engine can run them. A step
#: stands twice where a match may end in the character that the next one begins with.
BEFORE_LOWER = ((r"([\p{Ll}\p{Nd},;:][ \t])(\p{Lu}\p{L}+)", rf"$1{NAME}$2"),) * 2
AFTER_LOWER = (
    *((r"(\p{Nd})[.,](\p{Nd})", rf"$1{JOINT}$2"),) * 2,
    (rf"(\p{{Nd}}[\p{{Nd}}{JOINT}]*)", rf" {NUMBER}$1 "),
    (rf"({NUMBER}[\p{{Nd}}{JOINT}]* ) ?({UNITS})([^\p{{L}}]|$)", rf"$1{UNIT}$2 $3"),
    (rf"[$€£] {NUMBER}", rf" {UNIT} {NUMBER}"),
)
#: The same for both forms of names, with look-around: every capitalised word begins with FIRST, or with NAME where
#: BEFORE_LOWER puts it.
CAPITALS = (
    (rf"\p{{Lu}}(?<![\p{{L}}\p{{M}}\p{{Nd}}]\p{{Lu}})(?=\p{{L}})", f"{FIRST}$0"),
    (rf"([\p{{Ll}}\p{{Nd}},;:][ \t]){FIRST}", f"$1{NAME}"),
)
#: How a window is read: capitals as names only where BEFORE_LOWER says so, all capitalised words as names, and all
#: names as words with the values of other slots. The last two do not depend on what stands before the window.
FORMS = NARROW, WIDE, VERBATIM = 1, 2, 4
SEPARATOR = rf"[^{_TOKEN}{SLOTS}]+"
VALUE = rf"([{SLOTS}])[{_TOKEN}]*"


def marked(text: Column) -> Column:
    """Lower-cased text with the slots' marks before their values; FIRST before a capital that only WIDE takes as a name."""
    out = F.translate(text, SLOTS + JOINT + FIRST, "    \n")
    for pattern, replacement in CAPITALS:
        out = F.regexp_replace(out, pattern, replacement)
    out = F.lower(out)
    numbers = out
    for pattern, replacement in AFTER_LOWER:
        numbers = F.regexp_replace(numbers, pattern, replacement)
    return F.when(out.rlike(r"\p{Nd}"), numbers).otherwise(out)


def tokens(marked_text: Column) -> Column:
    return F.array_remove(F.split(marked_text, rf"[^{_TOKEN}{SLOTS}{FIRST}]+"), "")


def _is_slot(token: Column) -> Column:
    return F.substring(token, 1, 1).isin(*SLOTS)


def _read(token: Column, form: int) -> Column:
    """The token as a form reads it."""
    mark = F.substring(token, 1, 1)
    bare = token.substr(F.lit(2), F.length(token))
    if form == VERBATIM:
        return F.when(mark.isin(NAME, FIRST), bare).otherwise(token)
    return F.when(mark.isin(*SLOTS), mark).when(mark == FIRST, bare if form == NARROW else F.lit(NAME)).otherwise(token)


def _named(values: str) -> Column:
    """Tokens with values, as WIDE takes them."""
    return F.transform(values, lambda t: F.translate(t, FIRST, NAME))


def _windows(texts: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """``keep, size, at, form, hash`` for every window of ``sizes`` tokens of ``texts`` (keep, raw).

    NARROW has all windows, another form those that it reads in another way. The text is rewritten once for all sizes,
    and only hashes leave the document: its tokens would be copied with every window.
    """

    def parts(form: int) -> Column:
        return F.transform("raw", lambda t: F.xxhash64(_read(t, form)))

    def every(form: int, size: int) -> Column:
        # The array stands here more than once, or the optimizer would put its making inside the loop.
        name = f"_parts{form}"
        count = F.size(name) - size + 1
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(name, i, size)))
        return F.when(count > 0, hashes).otherwise(F.array().cast("array<bigint>"))

    hashed = texts.withColumns({f"_parts{f}": parts(f) for f in FORMS})
    hashes = hashed.select(*keep, *(every(f, s).alias(f"_h{f}_{s}") for f in FORMS for s in sizes))

    def block(size: int) -> Column:
        own = F.col(f"_h{NARROW}_{size}")
        other = [F.zip_with(f"_h{f}_{size}", own, lambda x, y: F.when(x != y, x)) for f in FORMS[1:]]
        return F.struct(F.lit(size).alias("size"), F.size(own).alias("_n"), F.concat(own, *other).alias("_hashes"))

    blocks = hashes.select(*keep, F.array(*map(block, sizes)).alias("_blocks")).select(*keep, F.inline_outer("_blocks"))
    # The outer form: for the inner one the optimizer infers a filter on the array, and pushing that down to the scan
    # would put the whole rewriting of the text inside the loop over its windows.
    out = blocks.select(*keep, "size", "_n", F.posexplode_outer("_hashes").alias("_at", "hash")).filter("hash is not null")
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.floor(F.col("_at") / F.col("_n")) + 1).cast("int"))
    return out.select(*keep, "size", (F.col("_at") % F.col("_n")).alias("at"), form.alias("form"), "hash")


def _forms(form: Column, window: Column) -> Column:
    """All forms, as bits, that read a window as the row of ``form`` does."""
    mark = lambda t: F.substring(t, 1, 1)
    first, slot = F.exists(window, lambda t: mark(t) == FIRST), F.exists(window, _is_slot)
    same = F.lit(NARROW) + F.when(first, 0).otherwise(WIDE) + F.when(slot, 0).otherwise(VERBATIM)
    return F.when(form == NARROW, same).otherwise(form)


def benchmark_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item, at, size, plain, total, plain_total, hash, forms, theirs`` of all windows of the items.

    ``theirs`` are the window's tokens with marks and values, ``total`` counts the item's windows and ``plain_total``
    those that are ``plain``: at least half their tokens are words. ``forms`` are those in which the window is looked for
    by this hash: a template only where at least half the tokens are words in its form, the values always.
    """
    texts = items.select(F.col(key).alias("item"), tokens(marked(whole_text(text))).alias("raw"))
    texts = written(texts.withColumn("n", F.size("raw")).filter(F.col("n") >= SHORTEST), "benchmark")
    texts = texts.withColumn("own", F.least("n", F.lit(WINDOW)))
    sizes = sorted(r["own"] for r in texts.select("own").distinct().collect()) or [WINDOW]  # a few sizes
    out = _windows(texts, sizes, "item", "own", "raw").filter("size = own")
    out = out.select("item", "at", "size", "hash", "form", F.slice("raw", F.col("at") + 1, F.col("size")).alias("theirs"))
    enough = lambda values: 2 * F.size(F.filter(values, lambda t: ~_is_slot(t))) >= F.col("size")
    allowed = F.lit(VERBATIM) + F.when(enough("theirs"), NARROW).otherwise(0) + F.when(enough(_named("theirs")), WIDE).otherwise(0)
    out = out.withColumn("plain", enough("theirs")).withColumn("forms", _forms(F.col("form"), F.col("theirs")).bitwiseAND(allowed))
    out = written(out.drop("form"), "benchmark-windows")
    # Equal items (also under one key) count once each place; the totals are of distinct places.
    place = F.struct("at", "size")
    totals = out.groupBy(F.col("item").alias("of")).agg(
        F.countDistinct(place).alias("total"), F.countDistinct(F.when(F.col("plain"), place)).alias("plain_total")
    )
    return out.filter("forms > 0").join(totals, F.col("item").eqNullSafe(F.col("of"))).drop("of")


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and item found in it: ``_tp_file, _tp_row, key, item, coverage, slots, changed``.

    ``coverage``: share of the item's windows, or of its plain ones if that is more, found by the forms that were needed
    (a later form is asked only while those before it do not suffice); ``slots``: distinct slot values of
    the item in the consistent occurrences; ``changed``: those with another value in the document (0 for a plain copy).
    Windows made mostly of slots are found with equal values only. Null texts are empty and match nothing; items of
    fewer than five tokens are not looked for. Repeated documents each give their rows; null ids are carried as null.
    Empty tables give no rows, other columns are not read.
    """
    theirs = written(benchmark_windows(items, item_key, item_text), "item-windows")
    sizes = sorted(r["size"] for r in theirs.select("size").distinct().collect()) or [WINDOW]  # at most WINDOW - SHORTEST + 1
    row = ["_tp_file", "_tp_row"]
    rows = located(docs)
    raw = tokens(marked(whole_text(text))).alias("raw")
    mine = _windows(rows.select(*row, raw), sizes, *row)
    index = theirs.withColumnRenamed("at", "place")
    looked = small(theirs.select("size", "hash").distinct(), BENCHMARK_WINDOWS)
    hits = written(mine.join(looked, ["size", "hash"], "left_semi"), "window-hits")
    # Only documents with hits are rewritten again, for the tokens of their windows.
    held = rows.join(small(hits.select(*row).distinct(), 300_000), row, "left_semi")
    held = held.select(*row, F.col(key).alias("key"), raw)
    found = hits.join(small(index, BENCHMARK_WINDOWS), ["size", "hash"]).join(held, row).select(
        *row, "key", "item", "size", "place", "plain", "total", "plain_total",
        (F.col("at") - F.col("place")).alias("diagonal"), "form", "forms", "theirs",
        F.slice("raw", F.col("at") + 1, F.col("size")).alias("ours"),
    )

    forms = F.col("forms").bitwiseAND(_forms(F.col("form"), F.col("ours")))
    found = found.withColumn("form", F.explode(F.filter(F.array(*map(F.lit, FORMS)), lambda f: f.bitwiseAND(forms) > 0)))
    ours = F.when(F.col("form") == WIDE, _named("ours")).when(F.col("form") == VERBATIM, F.col("theirs")).otherwise(F.col("ours"))
    found = found.withColumn("ours", ours).withColumn("theirs", F.when(F.col("form") == WIDE, _named("theirs")).otherwise(F.col("theirs")))
    pairs = F.filter(F.arrays_zip("theirs", "ours"), lambda p: _is_slot(p["theirs"]))
    found = found.withColumn("pairs", pairs).drop("theirs", "ours")
    doc = ["_tp_file", "_tp_row", "key", "item"]
    occurrences = found.groupBy(*doc, "total", "plain_total", "form", "diagonal").agg(
        F.collect_set(F.struct("size", "place", "plain")).alias("places"),  # bounded by the item
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    agree = F.size(F.array_distinct(F.transform("pairs", lambda p: p["theirs"]))) >= CONSISTENT * F.size("pairs")
    merged = occurrences.filter(agree).groupBy(*doc, "total", "plain_total")
    merged = merged.agg(F.collect_set(F.struct("form", "places", "pairs")).alias("all"))
    plain = F.size(F.filter("places", lambda p: p["plain"]))
    coverage = F.greatest(F.size("places") / F.col("total"), F.when(F.col("plain_total") > 0, plain / F.col("plain_total")))
    # The forms in order: a later one is asked while the coverage does not suffice, for places that are new.
    places = F.array_distinct(F.flatten(F.transform("used", lambda o: o["places"])))
    new = lambda o: F.size(F.array_except(o["places"], F.col("places"))) > 0
    merged = merged.withColumn("used", F.filter("all", lambda o: o["form"] == NARROW)).withColumn("places", places)
    for form in (VERBATIM, WIDE):
        more = F.filter("more", lambda o: o["form"] == form)
        merged = merged.withColumn("more", F.when(coverage >= COVERAGE, F.slice("all", 1, 0)).otherwise(F.filter("all", new)))
        merged = merged.withColumn("used", F.concat("used", more)).withColumn("places", places)
    merged = merged.withColumn("pairs", F.array_distinct(F.flatten(F.transform("used", lambda o: o["pairs"]))))
    changed = F.filter("pairs", lambda p: p["theirs"] != p["ours"])
    return (
        merged.withColumn("coverage", coverage)
        .filter(F.col("coverage") >= COVERAGE)
        .select(*doc, "coverage", F.size("pairs").alias("slots"), F.size(changed).alias("changed"))
    )


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    rows = located(docs)
    found = contaminated(rows.drop("_tp_file", "_tp_row"), items, key, text)
    drops = written(found.select("_tp_file", "_tp_row").distinct(), "contaminated")
    return rows.join(small(drops, 300_000), ["_tp_file", "_tp_row"], "left_anti").drop("_tp_file", "_tp_row")


def _sql() -> str:
    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def steps(expr: str, rules) -> str:
        for pattern, replacement in rules:
            expr = f"regexp_replace({expr}, {quote(pattern)}, {quote(replacement.replace('$', chr(92)))}, 'g')"
        return expr

    def split(expr: str) -> str:
        return f"list_filter(string_split_regex({expr}, {quote(SEPARATOR)}), lambda x: x <> '')"

    cleaned = f"translate(coalesce(text, ''), {quote(SLOTS + JOINT)}, '    ')"
    low = f"lower({steps(cleaned, BEFORE_LOWER)})"
    raw, parts = split("m"), split(f"regexp_replace(m, {quote(VALUE)}, {quote(chr(92) + '1')}, 'g')")

    def texts(table: str, key: str) -> str:
        return f"""(SELECT {key}, {raw} AS raw, {parts} AS parts
          FROM (SELECT {key}, {steps(low, AFTER_LOWER)} AS m FROM {table}))"""

    def windows(table: str, key: str, size: str, extra: str = "") -> str:
        return f"""SELECT {key}, unnest(range(len(parts) - {size} + 1)) AS spot, {size} AS size, raw, parts FROM {table} {extra}"""

    slots = "(" + ", ".join(quote(c) for c in SLOTS) + ")"
    return f"""
WITH b AS MATERIALIZED {texts("benchmark", "item_id")},
d AS MATERIALIZED {texts("documents", "doc_id")},
bw AS (
  SELECT item_id, spot AS place, size, list_slice(raw, spot + 1, spot + size) AS theirs,
         array_to_string(list_slice(parts, spot + 1, spot + size), ' ') AS w
  FROM ({windows("b", "item_id", f"least(len(parts), {WINDOW})", f"WHERE len(parts) >= {SHORTEST}")})),
bx AS (SELECT *, count(DISTINCT place) OVER (PARTITION BY item_id) AS total FROM bw
  WHERE 2 * len(list_filter(theirs, lambda t: t[1] NOT IN {slots})) >= size),
sizes AS (SELECT DISTINCT size AS z FROM bx),
dw AS (SELECT doc_id, spot, z AS size, list_slice(raw, spot + 1, spot + z) AS ours,
         array_to_string(list_slice(parts, spot + 1, spot + z), ' ') AS w
  FROM (SELECT doc_id, raw, parts, z, unnest(range(len(parts) - z + 1)) AS spot FROM d, sizes)),
f AS (
  SELECT doc_id, item_id, total, place, spot - place AS diagonal,
         list_filter(list_zip(theirs, ours), lambda p: p[1][1] IN {slots}) AS pairs
  FROM dw JOIN bx USING (w, size)),
o AS (
  SELECT doc_id, item_id, total, diagonal, list(DISTINCT place) AS places, list_distinct(flatten(list(pairs))) AS pairs
  FROM f GROUP BY ALL),
m AS (
  SELECT doc_id, item_id, total, len(list_distinct(flatten(list(places)))) AS found, list_distinct(flatten(list(pairs))) AS pairs
  FROM o WHERE least(len(list_distinct(list_transform(pairs, lambda p: p[1]))), len(list_distinct(list_transform(pairs, lambda p: p[2]))))
    >= {CONSISTENT} * len(pairs)
  GROUP BY doc_id, item_id, total)
SELECT doc_id, item_id, round(found / total, 6) AS coverage, CAST(len(pairs) AS INTEGER) AS slots,
       CAST(len(list_filter(pairs, lambda p: p[1] <> p[2])) AS INTEGER) AS changed
FROM m WHERE found / total >= {COVERAGE}"""


@register("op2_template_decontamination", _sql())
def op2_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every contaminated document with each benchmark item found in it."""
    found = contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(
        F.col("key").alias("doc_id"), F.col("item").alias("item_id"), F.round("coverage", 6).alias("coverage"), "slots", "changed"
    )
