"""Quality rules whose cutoffs come from the corpus.

Every text gets a handful of measures, each a count over a total, computed
inside its row.  Per language and source, mergeable quantile sketches
(Greenwald-Khanna summaries, built in each task and merged) give the quartiles
of each measure.  A small group's quartiles are drawn towards those of its
language, and these towards those of all rows, by their number of rows.  The
fences lie REACH interquartile ranges beyond the quartiles, for every measure
alike; a text goes if a count lies beyond its fence by more than NOISE standard
errors of such a count.  The thresholds, one row a group, are joined back.

All of it is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbara.llm.common import let, run_hashes, shielded, small, stored, table, words

WINDOW = 8  #: words of a window that may repeat
#: measure -> (count, total, side of the fence).
MEASURES = {
    "symbol_rate": ("n_symbols", "word_chars", "high"),  # symbols per word character
    "mark_rate": ("n_marks", "n_words", "high"),  # words that are only punctuation, per word
    "shout_rate": ("n_upper", "n_letters", "high"),  # upper-case share of the letters
    "dup_line_rate": ("n_dup_lines", "n_lines", "high"),  # repeated lines per line with a word
    "repeat_rate": ("n_repeats", "n_windows", "high"),  # words in repeated windows per word, in windows
    "same_rate": ("n_same", "n_words", "high"),  # words equal to the word before, per word
    "mean_word": ("word_chars", "n_words", "both"),  # code points per word
}
#: Columns that only serve the measures.
PARTS = ["n_marks", "n_upper", "n_letters", "n_lines", "n_repeats", "n_windows", "n_same"]
OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *PARTS, *MEASURES, "base_failed", "kept"]
#: Sketch accuracy: rank error of at most rows / ACCURACY in a group.
ACCURACY = 1000
#: Rows that the wider group's quartiles count for in a group.
PRIOR = 50
#: Fence: quartile + REACH * (upper quartile - lower quartile).
REACH = 3.0
#: Standard errors of a count that chance may add to it.
NOISE = 3.0
#: Threshold rows that may be broadcast.
SMALL = 20_000


def window_words(w: Column, size: int = WINDOW) -> Column:
    """Words of ``w`` inside windows of ``size`` words found twice or more in ``w``.

    Windows are compared by 64-bit hashes.  A text without repeated windows is
    settled by one hash set; else hashes and positions are sorted together.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def spread(p: Column) -> Column:
            twice = F.filter(
                F.transform(p, lambda x, j: F.when(
                    ((j > 0) & (F.get(p, j - 1)["h"] == x["h"])) | (F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False))), x["i"])),
                lambda i: i.isNotNull(),
            )
            return let(
                F.array_sort(twice),
                lambda s: F.aggregate(
                    F.transform(s, lambda i, j: F.least(F.coalesce(F.get(s, j + 1) - i, F.lit(size)), F.lit(size))),
                    F.lit(0).cast("long"), lambda a, x: a + x),
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, spread))

    return let(run_hashes(w, size), covered)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with the base counts, the parts of the measures and the measures.

    Null and empty texts have no words and measures of 0.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in docs.columns if c != text]
    parts = docs.withColumn("_t", t).withColumn("_w", words(F.col("_t")))

    def lines(x: Column) -> Column:
        full = F.filter(F.split(x, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
        return let(full, lambda f: F.struct(F.size(f).alias("n"), F.size(F.array_distinct(f)).alias("d")))

    w, whole = F.col("_w"), lambda c: c.cast("long")
    same = F.filter(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: a == b), lambda x: x)
    out = (
        parts.withColumn("_l", lines(F.col("_t")))
        .withColumn("_j", F.array_join(w, ""))
        .select(
            *keep,
            whole(F.size(w)).alias("n_words"),
            whole(F.char_length("_j")).alias("word_chars"),
            whole(F.size(F.split("_j", r"[#*$%&|<>]", -1)) - 1).alias("n_symbols"),
            whole(F.col("_l.n") - F.col("_l.d")).alias("n_dup_lines"),
            window_words(w).alias("n_repeat_words"),
            whole(F.size(F.filter(w, lambda x: ~x.rlike(r"[\p{L}\p{N}]")))).alias("n_marks"),
            whole(F.char_length(F.regexp_replace("_j", r"[^A-Z]+", ""))).alias("n_upper"),
            whole(F.char_length(F.regexp_replace("_j", r"[^A-Za-z]+", ""))).alias("n_letters"),
            whole(F.col("_l.n")).alias("n_lines"),
            whole(F.when(F.size(w) > 1, F.size(same)).otherwise(0)).alias("n_same"),
        )
        .withColumn("n_repeats", F.col("n_repeat_words") / F.lit(float(WINDOW)))
        .withColumn("n_windows", F.col("n_words") / F.lit(float(WINDOW)))
    )
    rate = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    n = F.col("n_words")
    return out.select("*", *[rate(a, b).alias(m) for m, (a, b, _) in MEASURES.items()], ((n < 20) | (100 * F.col("n_repeat_words") > 30 * n)).alias("base_failed"))


def quartiles(rows: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """_level, _n and <measure> (lower and upper quartile) of every group and, by grouping sets, of every wider group.

    Only rows that pass the base rules shape the sketches.  Partial sketches are
    merged, so a group with a third of all rows costs one summary a task.
    """
    sketch = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), ACCURACY).alias(m) for m in MEASURES]
    base = rows.filter(~F.col("base_failed")).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by})
    sets = [list(by[:k]) for k in range(len(by), -1, -1)]
    return base.groupingSets(sets, *by).agg(F.count("*").alias("_n"), *sketch, F.grouping_id().alias("_level"))


@shielded
def quality_rules(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source"), hold: bool = True) -> DataFrame:
    """Every row of ``docs`` (without ``text``) with base counts, measures, their fences and verdicts.

    ``kept`` is false if ``base_failed``, else whether every count is inside the
    fence of the row's group.  A null language or source counts as an empty
    string.  An empty table gives an empty result; repeated rows are judged
    alike; columns named as an output are replaced.
    """
    rows = measured(docs.drop(*[c for c in OUTPUTS if c not in by]), text)
    rows = stored(rows, "quality") if hold else rows
    found = rows.withColumns({f"_k{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(by)})
    held = quartiles(rows, by)
    held = stored(held, "quartiles") if hold else held
    top = held.filter(F.col("_level") == 2 ** len(by) - 1).select(*MEASURES).first()  # one row: all documents
    at = {m: tuple(F.lit(top[m][i] if top and top[m] else None).cast("double") for i in (0, 1)) for m in MEASURES}
    for k in range(1, len(by) + 1):
        have = held.filter(F.col("_level") == 2 ** (len(by) - k) - 1)
        packed = small(have.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate(by[:k])], F.struct("_n", *MEASURES).alias(f"_f{k}")), SMALL)
        found = found.join(packed, [F.col(f"_k{i}") == F.col(f"_j{i}") for i in range(k)], "left").drop(*[f"_j{i}" for i in range(k)])
        # A row of a group without base rows has the wider group's quartiles.
        n = F.col(f"_f{k}._n")
        own = {m: tuple(F.coalesce((n * F.col(f"_f{k}.{m}")[i] + PRIOR * at[m][i]) / (n + PRIOR), at[m][i]).alias(f"_q{k}{m}{i}") for i in (0, 1)) for m in MEASURES}
        found = found.select("*", *[c for pair in own.values() for c in pair])
        at = {m: tuple(F.col(f"_q{k}{m}{i}") for i in (0, 1)) for m in MEASURES}
    inside, fences = F.lit(True), []
    for m, (count, total, side) in MEASURES.items():
        (q1, q3), c, n = at[m], F.col(count), F.col(total)
        most = q3 + REACH * (q3 - q1)
        inside &= c <= n * most + NOISE * F.sqrt(n * most + 1)
        fences.append(most.alias(f"{m}_max"))
        if side == "both":
            least = F.greatest(q1 - REACH * (q3 - q1), F.lit(0.0))
            inside &= c >= n * least - NOISE * F.sqrt(n * least + 1)
            fences.append(least.alias(f"{m}_min"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return found.select(*rows.columns, *fences, kept.alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The same with exact quantiles; sketches agree where groups are small."""
    rate = lambda m: f"CASE WHEN {MEASURES[m][1]} > 0 THEN {MEASURES[m][0]} * 1.0::DOUBLE / {MEASURES[m][1]} ELSE 0 END"
    measures = ", ".join(f"{rate(m)} AS {m}" for m in MEASURES)
    cuts = "count(*) AS n, " + ", ".join(f"quantile_disc({m}, {p}) AS {m}_{q}" for m in MEASURES for p, q in ((0.25, "q1"), (0.75, "q3")))
    drawn, inside = [], []
    for m, (count, total, side) in MEASURES.items():
        for q in ("q1", "q3"):
            wide = f"coalesce((b.n * b.{m}_{q} + {PRIOR} * c.{m}_{q}) / (b.n + {PRIOR}), c.{m}_{q})"
            drawn.append(f"coalesce((a.n * a.{m}_{q} + {PRIOR} * {wide}) / (a.n + {PRIOR}), {wide}) AS {m}_{q}")
        most = f"({m}_q3 + {REACH} * ({m}_q3 - {m}_q1))"
        inside.append(f"{count} <= {total} * {most} + {NOISE} * sqrt({total} * {most} + 1)")
        if side == "both":
            least = f"greatest({m}_q1 - {REACH} * ({m}_q3 - {m}_q1), 0.0)"
            inside.append(f"{count} >= {total} * {least} - {NOISE} * sqrt({total} * {least} + 1)")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM x WHERE k > 1) GROUP BY doc_id),
e AS (SELECT doc_id, lang, source, w, array_to_string(w, '') AS j, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS f FROM d),
c0 AS (SELECT e.doc_id, lang, source, len(w)::BIGINT AS n_words, length(j)::BIGINT AS word_chars, len(regexp_extract_all(j, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(f) - len(list_distinct(f)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(f) AS n_lines,
  coalesce(n_repeat_words, 0) / {float(WINDOW)}::DOUBLE AS n_repeats, len(w) / {float(WINDOW)}::DOUBLE AS n_windows,
  len(list_filter(w, lambda v: regexp_full_match(v, '[^\p{{L}}\p{{N}}]+'))) AS n_marks, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_same,
  length(regexp_replace(j, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(j, '[^A-Za-z]+', '', 'g')) AS n_letters FROM e LEFT JOIN r USING (doc_id)),
m AS (SELECT *, {measures}, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c0),
a AS (SELECT lang, source, {cuts} FROM m WHERE NOT base_failed GROUP BY lang, source),
b AS (SELECT lang, {cuts} FROM m WHERE NOT base_failed GROUP BY lang),
c AS (SELECT {cuts} FROM m WHERE NOT base_failed),
f AS (SELECT m.* EXCLUDE ({", ".join(MEASURES)}), {", ".join(drawn)}
      FROM m LEFT JOIN a ON a.lang = m.lang AND a.source = m.source LEFT JOIN b ON b.lang = m.lang CROSS JOIN c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(inside)} AS kept FROM f
"""


OP4_SQL = _oracle()
