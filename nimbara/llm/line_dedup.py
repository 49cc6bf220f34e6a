"""Line deduplication by overlapping chunks of two lines with text, in DataFrame functions only.

A chunk goes from each line with text to the next one, with the blank lines
between them, so where a chunk lies depends on nothing around it: every
repeated run of two or more lines with text is reached whole, whatever its
length, period or edges.  Chunks that occur more than once in the corpus are
compared byte by byte with their first occurrence (smallest document, then
position) and removed; chunks may overlap their first occurrence, so of one
line repeated the first stays.

Only hashes are grouped over the whole corpus; texts of chunks are shipped for
repeated hashes alone.  Tables are broadcast up to a checked number of rows and
bytes and joined by sorting beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbara.llm.common import let, shielded, small, stored, table

#: Rows of a broadcast side; texts and lists in it are bounded in bytes as well.
SMALL = 300_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def chunks(text: Column) -> Column:
    """Chunks of a text, from each line with text to the next: array of struct(lo, n, h, body)."""

    def cut(lines: Column) -> Column:
        at = F.filter(F.transform(lines, lambda s, i: F.when(s.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
        pairs = let(at, lambda a: F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.size(a)), lambda x, y: F.struct(x.alias("lo"), (y - x + 1).alias("n"))))
        whole = F.transform(pairs, lambda p: F.struct(p["lo"].alias("lo"), p["n"].alias("n"), F.array_join(F.slice(lines, p["lo"] + 1, p["n"]), "\n").alias("body")))
        return F.transform(whole, lambda p: F.struct(p["lo"].alias("lo"), p["n"].alias("n"), F.xxhash64(p["body"]).alias("h"), p["body"].alias("body")))

    return let(lines_of(text), cut)


def repeated_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, _key, lo, n of every chunk to remove: repeated, byte-equal to its first occurrence, and not that one.

    _key is a hash of doc and text.  Rows equal in both are one document.
    """
    keyed = docs.select(F.col(doc).alias("_d"), F.xxhash64(doc, text).alias("_key"), F.col(text).alias("_t"))
    found = keyed.filter(F.instr(F.coalesce("_t", F.lit("")), "\n") > 0).select("_d", "_key", F.explode_outer(chunks(F.col("_t"))).alias("c"))
    at = F.struct("_d", "_key", "c.lo")
    first = found.filter(F.col("c").isNotNull()).groupBy(F.col("c.h").alias("h")).agg(F.min(at).alias("f"), F.max(at).alias("l"))
    twice = stored(first.filter(F.col("f") != F.col("l")).select("h", "f"), "chunks")
    occurrences = found.select("_d", "_key", "c.lo", "c.n", "c.h", "c.body").join(small(twice, SMALL), "h")
    is_first = (F.struct("_d", "_key", "lo") == F.col("f"))
    held = stored(occurrences.withColumn("is_first", is_first).drop("f"), "bodies")
    heads = held.filter("is_first").select("h", F.col("body").alias("first_body")).distinct()
    rest = held.filter(~F.col("is_first")).join(small(heads, SMALL, F.octet_length("first_body")), "h").filter(F.col("body") == F.col("first_body"))
    return rest.select("_d", "_key", "lo", "n")


@shielded
def line_dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines (see above) removed from ``text``, plus n_lines and n_removed_lines.

    Every row stays, also if no line is left (its text is then empty).  Null
    texts stay null and have 0 lines; an empty text has one (empty) line.  A
    null document id sorts first.  Columns named n_lines or n_removed_lines are
    replaced; all others pass through.
    """
    # Chunks overlap, so line numbers are collected, not chunks.
    lines = repeated_chunks(docs, doc, text).select("_d", "_key", F.explode(F.sequence("lo", F.col("lo") + F.col("n") - 1)).alias("i"))
    gone = lines.groupBy("_d", "_key").agg(F.array_sort(F.collect_set("i")).alias("_gone"))
    gone = stored(gone.withColumnsRenamed({"_d": "_gd", "_key": "_gk"}), "gone")
    base = docs.drop("n_lines", "n_removed_lines").withColumn("_key", F.xxhash64(doc, text))
    out = base.join(small(gone, SMALL, 4 * F.size("_gone")), (F.col("_key") == F.col("_gk")) & F.col(doc).eqNullSafe(F.col("_gd")), "left")
    lost = F.when(F.col("_gone").isNotNull(), F.size("_gone"))
    # What is left lies between the removed lines; both lists are in order.
    between = lambda x: F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), "_gone"), F.concat("_gone", F.array(F.size(x))), lambda a, b: F.slice(x, a + 2, b - a - 1)))
    left = F.array_join(let(lines_of(F.col(text)), between), "\n")
    total = F.size(F.split(F.col(text), "\n", -1))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    return out.select(
        *[F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left).alias(text) if c == text else F.col(c) for c in keep],
        F.coalesce(F.when(F.col(text).isNotNull(), total), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("n_removed_lines"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines and the SHA-256 of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
