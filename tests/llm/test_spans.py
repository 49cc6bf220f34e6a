"""Decontamination, substring and line dedup against brute force."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from nimbara.llm import line_dedup as L
from nimbara.llm import substring as S
from nimbara.llm.decontaminate import OP7_SQL, decontaminate, op7_decontamination
from nimbara.llm.substring import OP10_SQL, op10_substring_dedup, substring_dedup


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def oracle(sf, sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return sorted(map(tuple, con.execute(sql).fetchall()))


def test_decontamination_matches_sql(spark, sf):
    got = sorted(map(tuple, op7_decontamination(spark, sf).collect()))
    assert got == oracle(sf, OP7_SQL, "documents", "benchmark")


def test_decontamination_short_items(spark):
    bench = spark.createDataFrame([(1, "Alpha beta gamma"), (2, ""), (3, None), (4, "x y z a b c d e f g h i j k l m"), (5, "q r s t u v w")], "item_id int, text string")
    docs = spark.createDataFrame(
        [(1, "zz alpha BETA. gamma alpha beta gamma tt"), (2, None), (3, ""), (4, "n x y z a b c d e f g h i j"), (5, "x y z a b c d e f g h i j k l m"), (6, "q r s t u v w q r s"), (7, "aa " * 300)],
        "doc_id int, text string")
    got = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in decontaminate(docs, bench).collect()}
    assert got == {1: (6, ["1"], True), 2: (0, [], False), 3: (0, [], False), 4: (13, ["4"], True), 5: (16, ["4"], True), 6: (7, ["5"], True), 7: (0, [], False)}


def test_decontamination_of_repeated_words(spark):
    """A long text and an item of one word, or of a short period, take time in proportion to their lengths."""
    import time

    bench = spark.createDataFrame([(1, "a " * 120), (2, "x y " * 60)], "item_id int, text string")
    docs = spark.createDataFrame([(1, "b " + "a " * 4_000), (2, "x y " * 1_000 + "z"), (3, "a " * 12), (4, "q " * 50 + "a " * 13)], "doc_id int, text string")
    began = time.time()
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate(docs, bench).collect()}
    assert got == {1: (4_000, ["1"]), 2: (2_000, ["2"]), 3: (0, []), 4: (13, ["1"])}
    assert time.time() - began < 240


def test_decontamination_in_blocks(spark, sf, monkeypatch):
    from nimbara.llm import decontaminate as D

    whole = sorted(map(tuple, op7_decontamination(spark, sf).collect()))
    monkeypatch.setattr(D, "BLOCK", 150)
    assert sorted(map(tuple, op7_decontamination(spark, sf).collect())) == whole


def test_decontamination_edges(spark, odd):
    none = odd.limit(0)
    bench = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    assert decontaminate(none, bench).count() == 0
    assert decontaminate(odd, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert sorted(r.doc_id for r in decontaminate(odd, bench).filter("contaminated").collect()) == [4, 5]


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_substring_matches_sql(spark, sf, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = sorted(map(tuple, op10_substring_dedup(spark, sf).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == oracle(sf, OP10_SQL, "documents")


def brute_windows(rows, size=20):
    first, out = {}, {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - size + 1):
            if first.setdefault(tuple(w[i : i + size]), (d, i)) != (d, i):
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_substring_edges(spark, odd):
    rows = [(i, t) for i, t in enumerate(["a " * 90, " ".join("abcdefghijklmnopqrstuvwxyz"), "q " + " ".join("abcdefghijklmnopqrstuvwxyz") + " z", " ".join("bcdefghijklmnopqrstu"), "", None])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == brute_windows(rows)
    assert substring_dedup(odd).count() == odd.count()
    assert substring_dedup(odd.limit(0)).count() == 0


def brute_lines(rows):
    """Lines of every pair of neighbouring lines with text, blank ones between them included, that stands earlier in the corpus."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        lines = t.split("\n")
        full = [i for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for a, b in zip(full, full[1:]):
            body = tuple(lines[a : b + 1])
            if body in seen:
                gone.update(range(a, b + 1))
            seen.add(body)
        out[d] = (len(lines), len(gone), hashlib.sha256("\n".join(x for i, x in enumerate(lines) if i not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("small", [L.SMALL, 0])
def test_line_dedup_matches_brute_force(spark, sf, monkeypatch, small):
    monkeypatch.setattr(L, "SMALL", small)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_lines, r.n_removed_lines, r.kept_sha256) for r in L.op6_line_dedup(spark, sf).collect()}
    assert got == want and any(v[1] for v in got.values())


def test_line_chunks_resist_shifts(spark):
    body = "\n".join(f"line number {i} of a long shared passage" for i in range(400))
    rows = [(1, body), (2, "a new first line\n" + body), (3, body.replace("number 30", "number thirty"))]
    got = {r.doc_id: r.n_removed_lines for r in L.line_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1] == 0 and got[2] >= 370 and got[3] >= 370  # a change costs the chunks around it


def test_line_dedup_reaches_periodic_runs_and_edges(spark):
    run, pair = ["same line"] * 91, ["left", "right"] * 30
    passage = [f"passage line {i}" for i in range(12)]
    rows = [(1, "\n".join(["a", *run, "b"])), (2, "\n".join(["c", *run[:40], "d"])), (3, "\n".join(["e", *pair, "f"])), (4, "\n".join(["g", *pair[:31], "h"])),
            (5, "\n".join(["i", *passage, "j"])), (6, "\n".join(["k", *passage[:5], "", *passage[5:], "l"])), (7, "\n".join(passage[3:6])), (8, "once\n\ntwice"), (9, "x\nonce\n\ntwice\ny")]
    got = {r.doc_id: (r.n_removed_lines, r.text) for r in L.line_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1] == (90, "a\nsame line\nb") and got[2] == (40, "c\nd")
    assert got[3] == (58, "e\nleft\nright\nf") and got[4] == (31, "g\nh")
    assert got[5][0] == 0 and got[6] == (12, "k\n\nl") and got[7] == (3, "")
    assert got[8][0] == 0 and got[9] == (3, "x\ny")


def test_line_dedup_edges(spark, odd):
    out = L.line_dedup(odd)
    assert out.count() == odd.count()
    assert out.filter("doc_id = 1").first().text is None
    assert L.line_dedup(odd.limit(0)).count() == 0


def test_window_minima():
    import numpy as np

    g = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 5, 15, 16):
        want = [int(np.argmin(g[i : i + width])) + i for i in range(len(g) - width + 1)]
        assert S.leftmost_minima(g, width).tolist() == want


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    from nimbara.llm.common import Words

    texts = ["ab ba\taB  é é", None, "", "x", " lead", "trail "]
    w = Words(pa.array(texts))
    by = defaultdict(set)
    words = [x for t in texts for x in WORD.findall(t or "")]
    for h, x in zip(w.hash.tolist(), words):
        by[h].add(x)
    assert len(w.hash) == len(words) and all(len(v) == 1 for v in by.values()) and len(by) == len(set(words))
    assert w.counts().tolist() == [5, 0, 0, 1, 1, 1]
