"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every 13 consecutive words the smallest hash among their seven 7-grams is a
fingerprint.  Two texts that share 13 words share that fingerprint at the same
place, so joining fingerprints of documents and benchmark items finds every
shared window; each match is then extended word by word in both directions and
counts if it is long enough.  Items of fewer than 13 words are one window: their
whole word sequence is the fingerprint, compared at every document position.

Computed arrays are unnested with explode_outer: for explode the optimiser infers
a filter on the array, which would evaluate it (and, inlined, its inputs) again.

The fingerprints of the benchmark are joined in blocks of a bounded number of
rows, each broadcast; documents are never shuffled with their words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbara.llm.common import doubled, let, run_hashes, stored, table

WINDOW = 13  #: words of a window
GRAM = 7  #: words of a fingerprint
SPAN = WINDOW - GRAM + 1  #: grams of a window
#: Fingerprints broadcast at a time.
BLOCK = 400_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """Words after lower-casing A-Z: runs of digits, a-z and anything beyond ASCII."""
    t = F.coalesce(text, F.lit(""))
    # lower() may touch letters beyond ASCII, so it serves only texts without any
    ascii_only = F.char_length(t) == F.octet_length(t)
    return F.filter(F.split(F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER)), NOT_WORD, -1), lambda w: w != "")


def _minima(w: Column) -> Column:
    """Smallest gram hash of every window, with the grams: struct(h, m)."""
    return let(run_hashes(w, GRAM), lambda h: F.struct(h.alias("h"), doubled(h, SPAN, lambda a, b: F.least(a, b)).alias("m")))


_RUN = "array<struct<fp:bigint,k:int,lo:int,hi:int>>"


def document_prints(w: Column, short: list[int]) -> Column:
    """Fingerprints of a document: each with the gram positions lo..hi it may stand for."""

    def runs(m: Column) -> Column:
        turns = F.filter(F.transform(m, lambda x, i: F.when((i == 0) | (F.get(m, i - 1) != x), i)), lambda i: i.isNotNull())
        return let(turns, lambda c: F.transform(c, lambda i, j: F.struct(
            F.get(m, i).alias("fp"), F.lit(GRAM).alias("k"), i.cast("int").alias("lo"),
            (F.coalesce(F.get(c, j + 1), F.size(m)) - 1 + SPAN - 1).cast("int").alias("hi"))))

    none = F.array().cast(_RUN)
    out = [F.when(F.size(w) >= WINDOW, let(_minima(w), lambda x: let(x["m"], runs))).otherwise(none)]
    for n in short:
        every = F.transform(run_hashes(w, n), lambda h, i: F.struct(h.alias("fp"), F.lit(n).alias("k"), i.cast("int").alias("lo"), i.cast("int").alias("hi")))  # noqa: B023
        out.append(F.when(F.size(w) >= n, every).otherwise(none))
    return F.concat(*out) if len(out) > 1 else out[0]


def _whole(w: Column) -> Column:
    """Hash of a short item as the run of all its words."""
    out = F.lit(None).cast("bigint")
    for n in range(1, WINDOW):
        out = F.when(F.size(w) == n, F.element_at(run_hashes(w, n), 1)).otherwise(out)
    return out


def item_prints(items: DataFrame) -> DataFrame:
    """fp, k, q, _item of every fingerprint of ``items`` (_item, _iw)."""
    n = F.size("_iw")
    small = items.filter((n > 0) & (n < WINDOW)).select(_whole(F.col("_iw")).alias("fp"), n.alias("k"), F.lit(0).alias("q"), "_item")
    chosen = let(_minima(F.col("_iw")), lambda x: F.filter(
        F.transform(x["h"], lambda h, i: F.struct(h.alias("fp"), i.cast("int").alias("q"), F.array_contains(
            F.slice(x["m"], F.greatest(F.lit(1), i - SPAN + 2), F.least(i, F.size(x["m"]) - 1) - F.greatest(F.lit(0), i - SPAN + 1) + 1), h).alias("is"))),
        lambda s: s["is"]))
    long = items.filter(n >= WINDOW).select("_item", F.explode_outer(chosen).alias("p")).select("p.fp", F.lit(GRAM).alias("k"), "p.q", "_item")
    return long.unionByName(small)


def _same(x: Column, y: Column) -> Column:
    """Number of leading equal elements."""
    return let(F.zip_with(x, y, lambda a, b: a == b), lambda z: F.coalesce(F.nullif(F.array_position(z, False), F.lit(0)) - 1, F.size(z)).cast("int"))


def _spans() -> Column:
    """Distinct spans s..e of the text ``_w`` that match the item ``_iw`` around a shared fingerprint.

    Of neighbouring matches (p, q), (p + 1, q + 1) only the first is extended,
    as all give the same span; so a text and an item that repeat one word cost
    the sum of their lengths, not the product.  Words stay in their row.
    """
    w, x, k = F.col("_w"), F.col("_iw"), F.col("k")

    def firsts(q: Column) -> Column:
        follows = lambda p: (p > F.col("lo")) & (q > 0) & F.array_contains("qs", q - 1) & (F.get(w, p - 1) == F.get(x, q - 1))
        return F.filter(F.sequence("lo", "hi"), lambda p: ~follows(p) & (F.slice(w, p + 1, k) == F.slice(x, q + 1, k)))

    def extended(p: Column, q: Column) -> Column:
        back, ahead = F.least(p, q), F.least(F.size(w) - p - k, F.size(x) - q - k)
        left = _same(F.reverse(F.slice(w, p - back + 1, back)), F.reverse(F.slice(x, q - back + 1, back)))
        right = _same(F.slice(w, p + k + 1, ahead), F.slice(x, q + k + 1, ahead))
        return F.struct((p - left).cast("int").alias("s"), (p + k + right).cast("int").alias("e"))

    return F.array_distinct(F.flatten(F.transform("qs", lambda q: F.transform(firsts(q), lambda p: extended(p, q)))))


def hits(docs: DataFrame, benchmark: DataFrame, keys: list[str], item: str = "item_id", text: str = "text") -> DataFrame:
    """keys, item and the word span s..e (end exclusive) of every match; rows may repeat."""
    items = benchmark.select(F.col(item).alias("_id"), F.xxhash64(item, text).alias("_item"), plain_words(F.col(text)).alias("_iw")).filter(F.size("_iw") > 0)
    items = stored(items.dropDuplicates(["_id", "_item"]), "items")
    prints = item_prints(items.dropDuplicates(["_item"])).groupBy("_item", "fp", "k").agg(F.array_sort(F.collect_set("q")).alias("qs"))
    prints = stored(prints, "prints")
    sizes = items.select(F.size("_iw").alias("n")).filter(F.col("n") < WINDOW).distinct()
    short = sorted(r[0] for r in sizes.collect())  # at most 12 lengths
    blocks = max(1, math.ceil(prints.count() / BLOCK))
    base = docs.select(*keys, plain_words(F.col(text)).alias("_w")).withColumn("_r", document_prints(F.col("_w"), short))
    runs = base.select(*keys, "_w", F.explode_outer("_r").alias("_p")).select(*keys, "_w", F.col("_p.fp").alias("fp"), F.col("_p.k").alias("k"), "_p.lo", "_p.hi")
    found = None
    for b in range(blocks):
        part = prints.filter(F.pmod("_item", F.lit(blocks)) == b)
        words_of = items.join(F.broadcast(part.select("_item").distinct()), "_item", "left_semi")
        met = runs.join(F.broadcast(part), ["fp", "k"]).join(F.broadcast(words_of), "_item")
        span = met.select(*keys, F.col("_id").alias(item), F.explode_outer(_spans()).alias("x"), F.least(F.lit(WINDOW), F.size("_iw")).alias("_need")).select(*keys, item, "x.s", "x.e", "_need")
        got = span.filter(F.col("e") - F.col("s") >= F.col("_need")).drop("_need")  # a row without spans has nulls and goes
        found = got if found is None else found.unionByName(got)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per distinct (doc, text) of ``docs``: doc, _key (64-bit hash of both), n_words,
    n_hit, n_items, items (sorted strings), contaminated.

    A word is hit if it lies in any occurrence of a window of an item;
    contaminated: n_hit > 0 and 20 * n_hit >= n_words.  Null or empty texts have
    no words and are never contaminated; empty items have no windows; an empty
    benchmark hits nothing.  Extra columns do not matter.
    """
    keyed = docs.select(F.col(doc).alias(doc), F.col(text).alias(text), F.xxhash64(doc, text).alias("_key"))
    found = hits(keyed, benchmark.select(item, text), [doc, "_key"], item, text)
    spans = found.groupBy(doc, "_key").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("_s"), F.array_sort(F.collect_set(F.col(item).cast("string"))).alias("items"))
    total = F.aggregate(
        "_s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")))
    hit = spans.select(F.col(doc).alias("_d"), F.col("_key").alias("_k"), total["n"].cast("long").alias("n_hit"), "items")
    sizes = keyed.select(doc, "_key", F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), lambda w: w != "")).cast("long").alias("n_words"))
    out = sizes.join(hit, (sizes["_key"] == hit["_k"]) & sizes[doc].eqNullSafe(hit["_d"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        doc, "_key", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
n AS (SELECT DISTINCT least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
