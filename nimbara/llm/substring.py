"""Removal of word runs that occur earlier in the corpus.

A run of SIZE words (a window) is repeated if the same words start earlier: in
a smaller document, or before in the same one.  Every word inside a repeated
window goes.

Shards of the corpus as suffix automata, each streamed against by every
document, cost the number of shards times the corpus (see the README for
figures), so windows are matched by anchors instead.  The anchor of a window is
the smallest hash among its GRAM-word grams: equal windows have equal anchors
at equal places, and neighbouring windows mostly share one, so a text has about
one anchor for eight words.

1. Anchors that occur once in the corpus rule their windows out.
2. Each other anchor occurrence carries a run of windows; runs of equal content
   (their context) are reduced to the first of them, which settles copies.
3. Windows of anchors with several contexts are compared by their own hashes.

Texts are read once for the runs, which are stored without them; they move
only to be joined with the runs to compare by windows and with the spans to
remove.  Every step groups with partial aggregation or joins a many side with a
stored side of unique keys, which Spark may broadcast, or sort and split where
a key is hot: passages in a third of all documents stay spread out.  Nothing is
dropped for being frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbara.llm.common import Words, discard, let, mix, rolling, shielded, slices, stored, table, words

SIZE = 20  #: words of a window
GRAM = 6  #: words of an anchor

def leftmost_minima(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in every window of ``width`` values."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    pos = np.arange(len(g))
    span = 1
    while span * 2 <= width:
        a, b = pos[: len(pos) - span], pos[span:]
        pos = np.where(g[b] < g[a], b, a)
        span *= 2
    if span < width:
        a, b = pos[:n], pos[width - span : width - span + n]
        pos = np.where(g[b] < g[a], b, a)
    return pos[:n]


class Runs:
    """Runs of neighbouring windows of a slice of texts that share their anchor."""

    def __init__(self, w: Words):
        i64 = lambda x: x.view(np.int64)
        n = len(w.hash) - SIZE + 1
        starts = np.flatnonzero(w.doc[:n] == w.doc[SIZE - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if len(starts) == 0:
            self.anchor = self.context = self.value = np.zeros(0, np.int64)
            self.doc = self.at = np.zeros(0, np.int64)
            self.offset = np.zeros(1, np.int32)
            return
        grams = rolling(w.hash, GRAM)
        p = leftmost_minima(grams, SIZE - GRAM + 1)[starts]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (w.doc[starts[1:]] != w.doc[starts[:-1]])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(starts)]]) - 1
        hashes = rolling(w.hash, SIZE, 7)[starts]
        self.anchor = i64(grams[p[first]])
        shape = ((last - first) * 64 + (p[first] - starts[first])).astype(np.uint64)
        self.context = i64(mix(hashes[first] * np.uint64(3) ^ mix(hashes[last] + shape)))
        self.value = i64(hashes)
        self.offset = np.concatenate([first, [len(starts)]]).astype(np.int32)
        self.doc = w.doc[starts[first]]
        self.at = starts[first] - w.first[self.doc]


def _kind(docs: DataFrame) -> str:
    return docs.schema["_d"].dataType.simpleString()


def all_runs(docs: DataFrame) -> DataFrame:
    """anchor, context, _d, _key, at, n (windows) of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_t"):
                r = Runs(Words(part.column("_t")))
                doc = pa.array(r.doc, pa.int64())
                cols = [pa.array(r.anchor, pa.int64()), pa.array(r.context, pa.int64()), part.column("_d").take(doc), part.column("_key").take(doc),
                        pa.array(r.at, pa.int32()), pa.array(np.diff(r.offset), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "context", "_d", "_key", "at", "n"])

    return docs.select("_d", "_key", "_t").mapInArrow(run, f"anchor long, context long, _d {_kind(docs)}, _key long, at int, n int")


def window_hashes(docs: DataFrame) -> DataFrame:
    """anchor, context, _d, _key, at, hs (hash of each window) of the runs that the column ``runs`` of a document lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_t"):
                w = Words(part.column("_t"))
                hashes = rolling(w.hash, SIZE, 7).view(np.int64)
                runs = part.column("runs")
                doc, each = np.repeat(np.arange(len(runs)), pc.list_value_length(runs).to_numpy(zero_copy_only=False)), runs.flatten()
                anchor, context, at, n = (each.field(c) for c in ("anchor", "context", "at", "n"))
                n = n.to_numpy()
                off = np.concatenate([[0], np.cumsum(n)])
                first = w.first[doc] + at.to_numpy()
                hs = hashes[np.repeat(first - off[:-1], n) + np.arange(off[-1])] if len(n) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(hs, pa.int64()))
                doc = pa.array(doc, pa.int64())
                cols = [anchor, context, part.column("_d").take(doc), part.column("_key").take(doc), at, lists]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "context", "_d", "_key", "at", "hs"])

    return docs.select("_d", "_key", "_t", "runs").mapInArrow(run, f"anchor long, context long, _d {_kind(docs)}, _key long, at int, hs array<long>")


def _with(docs: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` joined with ``side`` (_d, _key and others)."""
    side = side.withColumnsRenamed({"_d": "_e", "_key": "_f"})
    return docs.join(side, (F.col("_key") == F.col("_f")) & F.col("_d").eqNullSafe(F.col("_e")), how).drop("_e", "_f")


def repeated_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """_d, _key and the disjoint word spans (s, e) to remove of every document that has some, in order."""
    base = docs.select(F.col(doc).alias("_d"), F.xxhash64(doc, text).alias("_key"), F.coalesce(text, F.lit("")).alias("_t"))
    runs = stored(all_runs(base), "runs")
    twice = stored(runs.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor"), "anchors")
    met = stored(runs.join(twice, "anchor"), "met")
    discard(runs)
    place = F.struct("_d", "_key", "at")
    firsts = stored(met.groupBy("anchor", "context").agg(F.min(F.struct("_d", "_key", "at", "n")).alias("f"), F.count("*").alias("c")), "contexts")
    # Contexts of one anchor that differ may still share windows.
    several = stored(firsts.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor"), "several")
    edge = firsts.join(several, "anchor").groupBy("f._d", "f._key").agg(F.collect_list(F.struct("anchor", "context", "f.at", "f.n")).alias("runs"))
    edge = stored(edge, "edges")
    own = stored(window_hashes(_with(base, edge)), "windows")
    each = own.select("anchor", "context", "_d", "_key", "at", F.posexplode_outer("hs").alias("o", "h")).withColumn("start", F.col("at") + F.col("o"))
    least = each.groupBy("anchor", "h").agg(F.min(F.struct("_d", "_key", "start")).alias("f"), F.count("*").alias("k")).filter("k > 1").drop("k")
    least = stored(least, "least")
    late = each.join(least, ["anchor", "h"]).filter(F.struct("_d", "_key", "start") != F.col("f"))
    masks = late.groupBy("anchor", "context").agg(F.collect_set("o").alias("mask"))
    settled = stored(
        firsts.select("anchor", "context", "c", F.struct("f._d", "f._key", "f.at").alias("f")).join(masks, ["anchor", "context"], "left")
        .filter((F.col("c") > 1) | F.col("mask").isNotNull()).drop("c"), "settled")
    mine = F.when(place == F.col("f"), F.coalesce(F.col("mask"), F.array().cast("array<int>")))
    whole = F.array(F.struct(F.col("at").alias("s"), (F.col("at") + F.col("n") - 1 + SIZE).alias("e")))
    some = F.transform(mine, lambda o: F.struct((F.col("at") + o).alias("s"), (F.col("at") + o + SIZE).alias("e")))
    hit = met.join(settled, ["anchor", "context"]).select("_d", "_key", F.explode_outer(F.when(mine.isNull(), whole).otherwise(some)).alias("x"))
    lists = hit.filter(F.col("x").isNotNull()).groupBy("_d", "_key").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    # Runs of overlapping spans: a span begins a run where all before it have ended.
    ends = F.transform("xs", lambda x, i: F.when((i == 0) | (F.get("xs", i - 1)["e"] < x["s"]), i))
    heads = F.filter(ends, lambda i: i.isNotNull())
    spans = let(heads, lambda a: F.transform(a, lambda i, j: F.struct(
        F.get("xs", i)["s"].alias("s"), F.get("xs", F.coalesce(F.get(a, j + 1), F.size("xs")) - 1)["e"].alias("e"))))
    out = stored(lists.select("_d", "_key", spans.alias("spans")), "spans")
    for t in (twice, met, firsts, several, edge, own, least, settled):
        discard(t)
    return out


@shielded
def substring_dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with n_words, n_removed, spans (removed word spans) and kept (the words left, joined by a space).

    Words are runs without space, tab and the controls 10 to 13; null and empty
    texts have none.  Rows equal in document and text are one document; two
    texts under one document id are ordered by a hash.
    """
    spans = repeated_spans(docs, doc, text)
    rest = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "spans", "kept")]
    base = docs.select(*rest, F.col(doc).alias("_d"), F.xxhash64(doc, text).alias("_key"), F.coalesce(text, F.lit("")).alias("_t"))
    out = _with(base, spans, "left").withColumn("_w", words(F.col("_t")))
    # What stays lies between the spans; both ends are in order.
    between = lambda w: F.flatten(F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["e"])), F.concat(F.transform("spans", lambda x: x["s"]), F.array(F.size(w))), lambda e, s: F.slice(w, e + 1, s - e)))
    kept = F.when(F.col("spans").isNull(), F.col("_w")).otherwise(between(F.col("_w")))
    lost = F.aggregate("spans", F.lit(0), lambda a, s: a + s["e"] - s["s"])
    return out.select(*rest, F.size("_w").cast("long").alias("n_words"), F.coalesce(lost, F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"), F.array_join(kept, " ").alias("kept"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1),
l AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
t AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.p) AS kept FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN t USING (doc_id)
"""
