"""Length buckets of least padding, and token-budget batches inside them.

One pass counts the documents of each length.  This global histogram has as
many rows as there are different lengths, however many documents there are.
Dynamic programming over it chooses the bucket bounds that minimise padding;
bounds are lengths that occur, so a bucket's longest documents are not padded.
Inside a bucket, documents are numbered in shards of a hash and the shards'
counts give each its offset, so batches are full across shards (one part-filled
batch a bucket) and no task sees a bucket whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nimbara.llm.common import shielded, stored, table, words
from nimbara.llm.token_counts import count_tokens

BUCKETS = 16
#: Tokens of a batch after padding.
BUDGET = 65_536
VOCABULARY = "word_bpe_49k.json"


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    lengths: ascending; counts: documents of each.  The cheapest last bucket
    i..j costs before[i] + bound_j * documents(i..j): for each i a line in
    bound_j whose slope falls with i, so the lower envelope of lines, kept as a
    stack, answers every j in amortised constant time.
    """
    m = len(lengths)
    if m == 0:
        return []
    docs, toks = [0], [0]
    for v, c in zip(lengths, counts):
        docs.append(docs[-1] + c)
        toks.append(toks[-1] + c * v)
    best = [docs[j + 1] * lengths[j] for j in range(m)]  # padded tokens up to j
    froms = [[0] * m]
    for _ in range(1, min(buckets, m)):
        now, back = [0] * m, [0] * m
        lines: list[tuple[int, int, int]] = []  # slope, height, first class
        at = 0
        for j in range(m):
            new = (-docs[j], best[j - 1] if j else 0, j)
            while len(lines) > 1 and (new[1] - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - new[0]):
                lines.pop()
            lines.append(new)
            at = min(at, len(lines) - 1)
            x = lengths[j]
            while at + 1 < len(lines) and lines[at + 1][0] * x + lines[at + 1][1] < lines[at][0] * x + lines[at][1]:
                at += 1
            now[j], back[j] = lines[at][0] * x + lines[at][1] + docs[j + 1] * x, lines[at][2]
        best = now
        froms.append(back)
    bounds, j = [], m - 1
    for back in reversed(froms):
        bounds.append(lengths[j])
        j = back[j] - 1
        if j < 0:
            break
    return bounds[::-1]


@shielded
def pack(docs: DataFrame, length: str = "length", doc: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``docs`` with bucket, padded (the bucket's bound), batch and slot.

    length: a column of true lengths (null: 0).  Every row gets exactly one slot;
    a document longer than ``budget`` makes a batch of its own.  Batch ids are
    unique over all buckets.  Rows of equal ``doc`` and length are ordered by a
    hash of all columns, equal rows arbitrarily.  An empty table gives an empty
    result; columns named as an output are replaced.
    """
    base = docs.drop("bucket", "padded", "batch", "slot").withColumn("_n", F.coalesce(F.col(length), F.lit(0)).cast("long"))
    seen = base.groupBy("_n").agg(F.count("*").alias("n")).orderBy("_n").toArrow()  # a row for each length
    counts = seen.column("n").to_pylist()
    bounds = best_bounds(seen.column("_n").to_pylist(), counts, buckets)
    shards = int(min(4096, max(64, sum(counts) // 50_000)))
    spark = docs.sparkSession
    of = F.lit(0)
    for b in range(len(bounds) - 1, -1, -1):
        of = F.when(F.col("_n") <= bounds[b], F.lit(b)).otherwise(of)
    every = F.xxhash64(*[F.col(f"`{c}`") for c, kind in base.dtypes if "map" not in kind])
    placed = base.withColumn("_h", every).withColumn("bucket", of.cast("int")).withColumn("_s", F.pmod("_h", F.lit(shards)).cast("int"))
    counts = placed.groupBy("bucket", "_s").count().collect()  # at most buckets * shards rows
    offsets, first, running = [], {}, {}
    for r in sorted(counts, key=lambda r: (r["bucket"], r["_s"])):
        offsets.append((r["bucket"], r["_s"], running.get(r["bucket"], 0)))
        running[r["bucket"]] = running.get(r["bucket"], 0) + r["count"]
    at = 0
    for b in sorted(running):
        first[b] = at
        at += -(-running[b] // max(1, budget // max(1, bounds[b])))
    rows = [(b, s, o, bounds[b], max(1, budget // max(1, bounds[b])), first[b]) for b, s, o in offsets]
    side = spark.createDataFrame(rows, "bucket int, _s int, _o long, padded long, _cap long, _f long")
    rank = F.row_number().over(Window.partitionBy("bucket", "_s").orderBy(doc, "_n", "_h")) - 1
    out = placed.withColumn("_r", rank).join(F.broadcast(side), ["bucket", "_s"])
    pos = F.col("_o") + F.col("_r")
    return out.select(
        *[c for c in docs.columns if c not in ("bucket", "padded", "batch", "slot")], "bucket", "padded",
        (F.col("_f") + F.floor(pos / F.col("_cap"))).cast("long").alias("batch"), (pos % F.col("_cap")).cast("int").alias("slot"))


def with_length(docs: DataFrame, text: str = "text") -> Column:
    """Number of words as ``length``, where no vocabulary is at hand."""
    return F.size(words(F.col(text))).cast("long").alias("length")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens as length, bucket, padded length, batch and slot."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(stored(count_tokens(docs, VOCABULARY, out="length", keep_text=False), "lengths"))
