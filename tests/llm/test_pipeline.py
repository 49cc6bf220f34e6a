"""The pipeline's stages: columns, decisions that take effect, clean documents kept."""

import corpus_pipeline as cp


def test_pipeline_runs_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = {}
    for name, stage in cp.STAGES[:-1]:
        before = docs.count()
        docs = cp.stored(stage(spark, docs, sf), "test")
        sizes[name] = (before, docs.count())
        assert docs.columns == cp.COLUMNS
    assert all(0 < b <= a for a, b in sizes.values())
    assert sizes["line_dedup"][0] == sizes["line_dedup"][1]
    assert sizes["quality_rules"][1] > 0.6 * sizes["quality_rules"][0]
    out = cp.run(spark, sf)
    assert out.count() == docs.count() and out.select("batch", "slot").distinct().count() == docs.count()


def test_contaminated_documents_go(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first()
    rows = [(1, bench.text, "en", "s", 0), (2, "some other words that no item has " * 3, "en", "s", 0), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.stage_decontaminate(spark, docs, sf).collect()) == [2, 3]
    assert sorted(r.doc_id for r in cp.stage_near_duplicates(spark, docs.union(docs.limit(1)), sf).collect())[-2:] == [2, 3]


def test_one_row_of_each_class_stays(spark, sf):
    long = " ".join(f"word{i}" for i in range(200))
    other = " ".join(f"else{i}" for i in range(200))
    rows = [(1, long, "en", "b", 0), (1, long, "en", "a", 0), (1, long, "en", "a", 0), (1, long + " more", "en", "s", 0), (2, long, "en", "s", 0), (None, other, "en", "s", 0), (None, other, "en", "s", 0),
            (1, "words that no other document has", "en", "s", 0), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (1, other + " so", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, cp.stage_near_duplicates(spark, docs, sf).collect()), key=str)
    heads = [(r[0], r[1]) for r in got]
    assert heads.count((None, other)) == 1 and (1, other + " so") not in heads
    assert sum(r[1].startswith("word0 ") for r in got) == 1 and heads.count((3, "")) == 2
    assert (1, "words that no other document has", "en", "s", 0) in got and len(got) == 5
    twins = spark.createDataFrame(rows[:3], docs.schema)
    assert [tuple(r) for r in cp.stage_near_duplicates(spark, twins, sf).collect()] == [rows[1]]


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_odd_rows_and_clashing_columns(spark, sf, odd):
    """Nulls, empty and very long texts, repeated rows and columns named like the stages' own go through every stage."""
    from pyspark.sql import functions as F

    docs = odd.withColumn("n_chars", F.char_length("text").cast("long"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == cp.COLUMNS and out.count() <= docs.count(), name
    lines = cp.stage_lines(spark, docs, sf)
    assert lines.count() == docs.count() and lines.filter("text IS NULL").count() == 1
    packed = cp.stage_packing(spark, docs, sf)
    assert packed.count() == docs.count() and packed.select("batch", "slot").distinct().count() == docs.count()


def test_rows_judged_apart_by_source(spark, sf):
    """Equal id and text, but another language and source: each row gets its own verdict."""
    odd = " ".join(f"w{(j * 13) % 997}{'#' if j % 3 == 0 else ''}" for j in range(90))
    texts = lambda mark: [" ".join(f"w{(i * 7 + j * 13) % 997}{mark if (j + i) % 3 == 0 else ''}" for j in range(90)) for i in range(400)]
    rows = [(i, t, "en", s, 0) for s, mark in (("plain", ""), ("marked", "#")) for i, t in enumerate(texts(mark))] + [(9000, odd, "en", "plain", 0), (9000, odd, "en", "marked", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.source for r in cp.stage_quality(spark, docs, sf).filter("doc_id = 9000").collect()] == ["marked"]
