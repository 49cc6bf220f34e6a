"""Scores, counts, rules, extraction, personal data, packing and the similarity join."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbara.llm import html, ngram_join, packing, pii, quality, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- token counts


def test_token_counts_match_the_library(spark, sf, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    extra = ["", "  \n", "a<|startoftext|>b <|endoftext|>", "É́ ǅ İstanbul", "it's we're 123 \x1c\x85\xa0x", "q" * 5000]
    got = {r.doc_id: r.n_tokens for r in token_counts.op9_token_counts(spark, sf).collect()}
    assert got == {d: len(tok.encode(t or "", add_special_tokens=False).ids) for d, t in texts}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(extra)] + [(99, None)], "doc_id int, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, "word_bpe_49k.json").collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(extra)} | {99: 0}


@pytest.mark.parametrize("head", [0, 40, 10**6])
def test_token_counts_with_any_head(spark, sf, texts, monkeypatch, head):
    """The broadcast part and the shuffled part add up to the same counts; small tables of a worker start anew."""
    want = {r.doc_id: r.n_tokens for r in token_counts.op9_token_counts(spark, sf).collect()}
    monkeypatch.setattr(token_counts, "HEAD", head)
    monkeypatch.setattr(token_counts, "SLICE", 20_000)
    assert {r.doc_id: r.n_tokens for r in token_counts.op9_token_counts(spark, sf).collect()} == want


def test_pieces_of_runs(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_counts, "KEPT", 1)
    p = token_counts.PieceCounts(public_tokenizers.path("word_bpe_49k.json"))
    assert [p.run("one-two") for _ in range(3)] == [3, 3, 3] and p.run("a<|endoftext|>b") == 3


def test_token_counts_edges(spark, odd):
    got = token_counts.count_tokens(odd, "word_bpe_49k.json")
    assert got.columns == [*[c for c in odd.columns if c != "n_tokens"], "n_tokens"] and got.count() == odd.count()
    assert {r.n_tokens for r in got.filter("doc_id IN (1, 2, 6)").collect()} == {0} and {r.n_tokens for r in got.filter("doc_id IN (4, 5)").collect()} == {3}
    assert token_counts.count_tokens(odd.limit(0), "word_bpe_49k.json").count() == 0
    assert token_counts.count_tokens(odd.select("doc_id", "text"), "piece_bpe_32k.model").filter("text = ''").first().n_tokens == 0


# --- quality rules


def base_counts(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), sum(len(re.findall(r"[#*$%&|<>]", x)) for x in w), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_quality_base_counts(spark, sf, texts):
    got = {r.doc_id: tuple(r)[1:7] for r in quality.op4_quality_rules(spark, sf).collect()}
    assert got == {d: base_counts(t) for d, t in texts}


def test_quality_verdicts_follow_exact_quantiles(spark, monkeypatch):
    monkeypatch.setattr(quality, "PRIOR", 0)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(rng.random())[2:4] for _ in range(60)), "en", "s") for i in range(40)]
    rows += [(100, " ".join(f"w{i}###" for i in range(60)), "en", "s"), (101, " ".join(f"BIG{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(60)), "en", "s")]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()}
    assert not got[100].kept and not got[101].kept and all(got[i].kept for i in range(40))
    # The same fences from exact quartiles: sketches of small groups are exact.
    base = [r for r in got.values() if not r.base_failed]
    for m, (count, total, side) in quality.MEASURES.items():
        x = sorted(r[m] for r in base)
        q1, q3 = (x[max(0, -(-len(x) * k // 4) - 1)] for k in (1, 3))
        top = q3 + quality.REACH * (q3 - q1)
        assert all(abs(r[f"{m}_max"] - top) < 1e-9 for r in got.values())
        assert all(r[count] <= r[total] * top + quality.NOISE * (r[total] * top + 1) ** 0.5 for r in got.values() if r.kept)


def test_quality_fences_move_with_the_group(spark):
    def texts(mark, first):
        return [(first + i, " ".join(f"w{(i * 7 + j * 13) % 997}{mark if (j + i) % 3 == 0 else ''}" for j in range(90)), "en", mark or "none") for i in range(400)]

    odd = (9000, " ".join(f"w{(j * 13) % 997}{'#' if j % 3 == 0 else ''}" for j in range(90)), "en")
    make = lambda rows: spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality_rules(make(texts("", 0) + texts("#", 1000) + [(*odd, "none"), (9001, *odd[1:], "#")])).collect()}
    # The same text goes where its group has no symbols and stays where a third of the words have one.
    assert not got[9000].kept and got[9001].kept
    assert got[1000].symbol_rate_max > 2 * got[0].symbol_rate_max
    assert sum(not r.kept for d, r in got.items() if d < 9000) == 0


def test_every_fence_comes_from_quartiles(spark, sf):
    """With other quartiles every fence is another one, also of measures that are mostly zero."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality.quality_rules(docs)
    fences = [c for c in got.columns if c.endswith(("_max", "_min"))]
    kinds = got.select(*[F.count_distinct(c).alias(c) for c in fences]).first()
    assert kinds["mean_word_max"] > 4 and kinds["shout_rate_max"] > 4
    gone = got.filter("NOT base_failed AND NOT kept").count()
    assert 0 < gone < 0.15 * docs.count()
    bad = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    share = {r.quality: r.kept for r in bad.collect()}
    assert share[1] > 0.93 and share[0] < 0.1


def test_quality_edges(spark, odd):
    out = quality.quality_rules(odd)
    assert out.count() == odd.count() and quality.quality_rules(odd.limit(0)).count() == 0
    assert {r.kept for r in out.filter("doc_id IN (1, 2, 6)").collect()} == {False}


# --- toxicity


def brute_segments(sc):
    def rec(lo, hi):
        best = None
        for i in range(lo, hi):
            t = 0
            for j in range(i, hi):
                t += sc[j]
                if t > 1e-12 and (best is None or t > best[0] + 1e-12):
                    best = (t, i, j + 1)
        return [] if best is None else rec(lo, best[1]) + [(best[1], best[2], round(best[0], 6))] + rec(best[2], hi)

    return rec(0, len(sc))


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(200):
        sc = [rng.choice([-1.3, -0.7, -0.2, 0.5, 0.9, 1.7]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 22))]
        got, want = toxicity.segments(sc), brute_segments(sc)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-5)


def test_rate_solves_its_equation():
    s, c = np.array([2.0, -0.5]), np.array([1.0, 20.0])
    r = toxicity.rate_of(s, c)
    assert abs((c / c.sum() * np.exp(r * s)).sum() - 1) < 1e-6


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.op2_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[d].predicted, y) for d, y in labels.items() if d in got and got[d].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_counts_match_a_plain_count(spark, sf):
    """Scores of tokens against log-odds computed in one process."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {(r.text, r.y) for r in toxicity.training_texts(docs, labels, "toxic").collect()}
    model = toxicity.fit(toxicity.training_texts(docs, labels, "toxic"))
    seen = [Counter(), Counter()]
    for t, y in rows:
        seen[y].update(set(toxicity.tokens(t)))
    n0, n1, share = sum(seen[0].values()), sum(seen[1].values()), sum(y for _, y in rows) / len(rows)
    want = {}
    for w, y1 in seen[1].items():
        y0 = seen[0][w]
        y = y1 + y0
        gain = y1 * np.log(y1 / share / y) + (y0 * np.log(y0 / (1 - share) / y) if y0 else 0)
        if y1 > share * y and gain >= np.log(len(seen[0] | seen[1])) + toxicity.EVIDENCE:
            a = toxicity.PRIOR * y
            want[w] = np.log((y1 + a) / (n1 + toxicity.PRIOR * (n1 + n0))) - np.log((y0 + a) / (n0 + toxicity.PRIOR * (n1 + n0))) - toxicity.DRIFT
    assert {w: round(s, 9) for w, s in model.scores.items()} == {w: round(float(s), 9) for w, s in want.items() if s > 0}


def test_toxicity_edges(spark, odd):
    make = lambda rows: spark.createDataFrame(rows, "text string, y int")
    model = toxicity.fit(make([]))
    assert toxicity.score_toxicity(odd, model).count() == odd.count()
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0
    model = toxicity.fit(make([("bad word here", 1), ("good word here", 0)] * 3))
    assert 0 <= model.score(None) <= 1


# --- HTML


def test_html_blocks():
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><header>top</header><article><header><h1>Head &amp; more</h1></header>'
        '<p>One <b>bold</b>\n text<br>next<p>Two<script>var x = "</p>";</script><aside>side</aside><div class="cookie-notice">eat</div><ul><li>a<li>b</ul>'
        '<section id="comments"><p>bad</section></article><footer>&copy; x</footer></body>')
    kept = [t for s, t in html.page_blocks(page) if s == html.CONTENT]
    assert kept == ["Head & more", "One bold text next", "Two", "a", "b"]
    assert html.page_blocks(None) == [] and html.page_blocks("<p") == [] and html.page_blocks("a < b") == [(html.OPEN, "a < b")]


def test_html_extracts_the_article(spark, sf):
    norm = lambda t: "\n\n".join(x for x in (" ".join(s.split()) for s in t.split("\n")) if x)
    docs = {norm(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = html.op1_html_extraction(spark, sf).collect()
    assert rows and all(r.text.split("\n\n", 1)[1] in docs and r.n_chars == len(r.text) for r in rows)


def test_html_host_repeats(spark):
    menu = "<div>Home one two three four five six</div>"
    rows = [(1, "http://h.x/1", menu + "<p>Unique text of page one &amp; more"), (2, "http://h.x/2", menu + "<p>Other words here<br>so"), (3, None, None), (4, "http://h.x/4", ""), (5, "http://other/1", menu + "<p>alone")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {1: "Unique text of page one & more", 2: "Other words here so", 3: "", 4: "", 5: "Home one two three four five six\n\nalone"}
    assert html.extract(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def test_html_probes():
    main = lambda h: [t for s, t in html.page_blocks("<article>" + h + "</article>") if s in (html.CONTENT, html.DOUBT)]
    assert main('<p>Good text <span class="share">Share this</span> goes on</p>') == ["Good text goes on"]
    assert main('<p>Good text lost <span class="share">Share</p>') == ["Good text lost"]
    assert main("<p>Seen <span hidden>not seen</span> too</p>") == ["Seen too"]
    assert main('<p class="x>Hello</p><p>more') == ["Hello", "more"]
    assert main('<p>the <span class="form-factor">ATX</span> board</p>') == ["the ATX board"]
    assert [s for s, _ in html.page_blocks('<article><p>a</p><div class="social-proof">b</div></article>')] == [html.CONTENT, html.DOUBT]
    assert html.page_blocks("<div role='main'><p>a</p></div><div>b</div>") == [(html.CONTENT, "a"), (html.TEMPLATE, "b")]


def test_html_deep_pages_take_linear_time():
    import time

    began = time.time()
    html.page_blocks("<p>" + "<div>" * 40_000 + "x" + "</span></div>" * 40_000)
    html.page_blocks("<p><table>" + "<b>" * 20_000 + "<div>y</div>" * 20_000)
    html.page_blocks('<a title="' * 20_000)
    assert time.time() - began < 5


def brute_repeats(pages):
    """Text of pages by direct comparison of all token runs of each host's blocks that are not content."""
    blocks = {p: html.page_blocks(h) for p, _, h in pages}
    hosts = {p: html._host(u) for p, u, _ in pages}
    seen = defaultdict(set)
    for p, bs in blocks.items():
        for s, t in bs:
            w = t.split(" ")
            for i in range(len(w) - html.RUN + 1):
                if s != html.CONTENT:
                    seen[hosts[p], tuple(w[i : i + html.RUN])].add(p)
    out = {}
    for p, bs in blocks.items():
        kept = []
        for s, t in bs:
            w = t.split(" ")
            gone = {j for i in range(len(w) - html.RUN + 1) if s != html.CONTENT and len(seen[hosts[p], tuple(w[i : i + html.RUN])]) > 1 for j in range(i, i + html.RUN)}
            if s != html.TEMPLATE:
                kept.append(" ".join(x for j, x in enumerate(w) if j not in gone))
        out[p] = "\n\n".join(x for x in kept if x)
    return out


def test_html_repeats_match_brute_force(spark):
    rng = random.Random(5)
    phrases = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 14))) for _ in range(12)]
    pages = []
    for i in range(60):
        body = "".join(f"<div>{' '.join(rng.sample(phrases, rng.randint(1, 3)))} u{i} v{rng.randint(0, 5)}</div>" for _ in range(rng.randint(0, 5)))
        if i % 7 == 0:
            body = f"<nav>{phrases[0]}</nav><article><p>{phrases[1]}</p><div class='related-note'>{phrases[2]} {phrases[3]}</div></article>" + body
        pages.append((i, f"http://h{i % 3}/p" if i % 11 else None, body))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert got == brute_repeats(pages)


def test_html_edges(spark):
    long = "<div>" + " ".join(f"w{i % 50}" for i in range(50_000)) + "</div>"
    rows = [(1, "http://h/1", "<p>same six words stand here twice"), (1, "http://h/1", "<p>same six words stand here twice"), (2, None, None), (3, "no url", ""), (4, "http://h/4", long), (None, "http://h/5", "<p>x")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumns({c: F.lit("clash") for c in ("_key", "_page", "text", "n_chars", "host", "runs", "block")})
    got = sorted(((r.page_id, r.text) for r in html.extract(df).collect()), key=str)
    assert [t for p, t in got if p == 1] == ["same six words stand here twice"] * 2 and (2, "") in got and (3, "") in got and (None, "x") in got
    assert len(got) == 6 and html.extract(df.limit(0)).count() == 0


# --- personal data

E, I = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
C, P = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = []
    for k, pattern in (("email", E), ("ip", I), ("card", C), ("phone", P)):
        for m in pattern.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            if not (k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (16 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 8 <= len(d) <= 15):
                out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base_spans(spark, sf, texts):
    got = {r.doc_id: r.base_sha256 for r in pii.op5_pii(spark, sf).collect()}
    assert got == {d: hashlib.sha256(base(t or "").encode()).hexdigest() for d, t in texts}


def test_pii_odd_texts(spark):
    odd = ["a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004", "4111 1111 1111 1111 and 4111-1111-1111-1111-1 4111111111111111111111", "+1 (222) 333-4444 +12 3 +1-----",
           "é@a.b " * 3 + "+4 1234 5678 9012 3456", "1" * 30000, "a.b@" * 5000, "1-" * 40000, "a@b." * 3000 + "c", "", "256.1.1.1 1.1.1.1"]
    df = spark.createDataFrame([*enumerate(odd), (99, None)], "doc_id int, text string")
    got = {r.doc_id: ",".join(f"{m.kind}:{m.s}:{m.e}" for m in r.base) for r in pii.find_pii(df).collect()}
    assert got == {i: base(t) for i, t in enumerate(odd)} | {99: ""}


def test_pii_disclosing_terms(spark):
    rows = [(i, f"item {i} quite different text number {i * 7} the Zanzibarine writes to boss@acme.org about matter{i} today") for i in range(8)]
    rows += [(100 + i, f"ordinary words {i} about nothing at all, text and number {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    words = {rows[i][1][m.s : m.e] for i in range(8) for m in got[i].terms}
    assert "Zanzibarine" in words and not any("matter" in w or w == "number" for w in words)
    assert not any(got[100 + i].terms for i in range(30))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "boss@acme.org" not in clean[0] and "[email]" in clean[0] and "[term]" in clean[0] and clean[100] == rows[8][1]


def brute_disclosure(rows):
    """Told pairs by counting every entity, class and context word in plain Python."""
    texts = sorted({t or "" for _, t in rows})
    entities, beside, has = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        for w in re.split(r"[\x20\x09-\x0D]+", t):
            has[re.sub(r"^[\W_]+|[\W_]+$", "", w.lower())].add(i)
        found = [x.split(":") for x in base(t).split(",") if x]
        spans = [(int(a), int(b)) for _, a, b in found]
        for k, a, b in found:
            a, b = int(a), int(b)
            body = t[a:b].lower()
            digits = re.sub("[^0-9]", "", body)
            value = digits if k in ("card", "phone") else body
            of = body.split("@")[-1] if k == "email" else ".".join(body.split(".")[:2]) if k == "ip" else digits[:6]
            words = [(m.start(), m.end()) for m in WORD.finditer(t)]
            before = [w for w in words if w[1] <= a and not (w[1] == a)][-pii.REACH :]
            after = [w for w in words if w[0] > b][: pii.REACH]
            for e in ((k, value), ("class", k, of)):
                entities[e].add(i)
                for s, z in before + after:
                    term = re.sub(r"^[\W_]+|[\W_]+$", "", t[s:z].lower())
                    if re.search(r"[^\W\d_]", term) and not any(s < q and p < z for p, q in spans):
                        beside[e, term].add(i)
    n, total = len(texts), sum(len(WORD.findall(t)) for t in texts)
    told = set()
    for (e, term), both in beside.items():
        p, nt = len(entities[e]) / n, max(len(has[term]), len(both))
        share = min(1.0, len(both) / nt)
        if p >= 1 or np.log2(share / p) / -np.log2(p) < pii.DISCLOSURE:
            continue
        rest = (1 - share) * np.log((1 - share) / (1 - p)) if share < 1 else 0.0
        far = -nt * (share * np.log(share / p) + rest) if share > p else 0.0
        near = sum(np.log((nt - j) * (len(entities[e]) - j) / ((n - j) * (j + 1))) for j in range(len(both))) if len(both) <= pii.FEW else 0.0
        if min(0.0, far, near) + np.log(len(entities) * total / len(both)) <= np.log(pii.LEVEL):
            told.add((e, term))
    return told, entities, texts


def test_pii_terms_match_brute_force(spark):
    rng = random.Random(11)
    filler = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(220):
        w = [rng.choice(filler) for _ in range(40)]
        if i < 60:
            name, box = f"Name{chr(65 + i % 6)}", f"box{i % 6}@firm{i % 3}.org"
            w[10:11] = [rng.choice(filler), f"Firm{chr(65 + i % 3)}ia,", f"({name})", box, rng.choice(filler)]
            if i % 4 == 0:
                w.append(name.upper())
        rows.append((i, " ".join(w)))
    rows += [(900, rows[0][1]), (901, None), (902, "")]
    told, entities, texts = brute_disclosure(rows)
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert any(e[0] == "class" for e, _ in told) and any(e[0] == "email" for e, _ in told)
    for d, t in rows:
        i = texts.index(t or "")
        mine = {term for e, term in told if i in entities[e]}
        spans = [tuple(map(int, x.split(":")[1:])) for x in base(t or "").split(",") if x]
        want = [(m.start(), m.end()) for m in WORD.finditer(t or "") if re.sub(r"^[\W_]+|[\W_]+$", "", m[0].lower()) in mine and not any(m.start() < q and p < m.end() for p, q in spans)]
        assert [(x.s, x.e) for x in got[d].terms] == want, d


def test_sanitise_edges(spark, odd):
    rows = [(1, "mail a@b.co now", "x"), (1, "call +49 30 1234567 now", "y"), (1, "mail a@b.co now", "z"), (None, "see 10.0.0.1", "n"), (2, None, "n"), (3, "", "n")]
    df = spark.createDataFrame(rows, "doc_id int, text string, base string").withColumns({c: F.lit("clash") for c in ("terms", "_d", "_key", "_spans", "sp", "_t")})
    got = pii.sanitise(df)
    assert got.columns == df.columns
    assert sorted(((r.text, r.base) for r in got.collect()), key=str) == sorted(
        [("mail [email] now", "x"), ("call [phone] now", "y"), ("mail [email] now", "z"), ("see [ip]", "n"), (None, "n"), ("", "n")], key=str)
    assert pii.sanitise(df.limit(0)).count() == 0 and pii.sanitise(odd).count() == odd.count()


def test_pii_few_texts_and_short_terms(spark):
    rows = [(i, f"note {i * 11} from Kim at kim@acme.org on day{i}") for i in range(3)]
    rows += [(50, "only Uma wrote to uma@acme.org once")]
    rows += [(100 + i, f"ordinary note from nobody at all, on line {i}") for i in range(60)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    words = {rows[i][1][m.s : m.e] for i in range(3) for m in got[i].terms}
    assert words == {"Kim"}
    assert not got[50].terms and not any(got[100 + i].terms for i in range(60))


def test_pii_context_words(spark):
    from pyspark.sql import functions as F

    long = "z" * 190
    texts = ["first a@b.c last", f"one two {long} {long} three x@y.z four\x0bfive\x0c{long} {'q' * 5000} six seven", " \n1 2 3 4 5 6\ta@b.c  7 8 9 10 11 12", "(a@b.c) end", "a@b.c", "v" * 60_000 + " a@b.c " + "é" * 4000 + "-x"]

    def want(t):
        (m,) = E.finditer(t)
        parts = [(w.start(), w.end(), w[0]) for w in WORD.finditer(t)]
        before, after = [p for p in parts if p[1] < m.start()], [p for p in parts if p[0] > m.end()]
        return sorted((w, s) for s, _, w in [*before[-pii.REACH :], *after[: pii.REACH]])

    df = spark.createDataFrame([*enumerate(texts)], "i int, t string").select("i", F.explode(pii.base_spans(F.col("t"))).alias("p"), "t")
    got = {r.i: sorted((c.w, c.s) for c in r.c) for r in df.select("i", pii._contexts(F.col("t"), F.col("p")).alias("c")).collect()}
    assert got == {i: want(t) for i, t in enumerate(texts)}


def test_pii_edges(spark, odd):
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(odd.limit(0)).count() == 0


# --- packing


def test_best_bounds_against_all_choices():
    rng = random.Random(2)
    for _ in range(60):
        n, k = rng.randint(1, 8), rng.randint(1, 4)
        lengths, counts = sorted(rng.sample(range(1, 60), n)), [rng.randint(1, 5) for _ in range(n)]
        cost = lambda b: sum(c * (min(x for x in b if x >= v) - v) for v, c in zip(lengths, counts))  # noqa: B023, E731
        got = packing.best_bounds(lengths, counts, k)
        want = min(cost({*q, lengths[-1]}) for m in range(min(k, n)) for q in itertools.combinations(lengths[:-1], m))
        assert len(got) <= k and cost(got) == want


def slow_bounds(histogram, buckets):
    """Least padding by trying every first class of every last bucket."""
    lengths, counts = zip(*histogram)
    docs = np.concatenate([[0], np.cumsum(counts)])
    best, froms = docs[1:] * np.array(lengths), []
    for _ in range(1, min(buckets, len(lengths))):
        before, now, back = np.concatenate([[0], best[:-1]]), best.copy(), []
        for j in range(len(lengths)):
            cost = before[: j + 1] + (docs[j + 1] - docs[: j + 1]) * lengths[j]
            back.append(int(np.argmin(cost)))
            now[j] = cost[back[-1]]
        best = now
        froms.append(back)
    out, j = [], len(lengths) - 1
    for back in [*reversed(froms), [0] * len(lengths)]:
        out.append(lengths[j])
        j = back[j] - 1
        if j < 0:
            break
    return out[::-1]


def test_packing_batches(spark, sf, texts):
    rows = packing.op3_packing(spark, sf).collect()
    assert {r.doc_id: r.length for r in rows} == {r.doc_id: r.n_tokens for r in token_counts.op9_token_counts(spark, sf).collect()}
    assert {r.padded for r in rows} == {max(r.length for r in rows if r.bucket == b) for b in {r.bucket for r in rows}}
    histogram = sorted(Counter(r.length for r in rows).items())
    assert sorted({r.padded for r in rows}) == slow_bounds(histogram, packing.BUCKETS)
    batches = defaultdict(list)
    for r in rows:
        assert r.length <= r.padded
        batches[r.batch].append(r)
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) == 1 or sum(r.padded for r in b) <= packing.BUDGET
    partial = Counter(b[0].bucket for b in batches.values() if len(b) < packing.BUDGET // max(1, b[0].padded))
    assert max(partial.values(), default=0) <= 1


def test_packing_edges(spark, odd):
    docs = odd.select("doc_id", "text", "bucket", packing.with_length(odd))
    assert packing.pack(docs).count() == odd.count() and packing.pack(docs.limit(0)).count() == 0


# --- similarity join


def brute_classes(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    where, common = defaultdict(list), Counter()
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    for v in where.values():
        common.update(itertools.combinations(sorted(v), 2))
    parent, links = {d: d for d in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 9 * c >= 4 * (len(sets[a]) + len(sets[b])):
            links[a] += 1
            links[b] += 1
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (find(d), links[d]) for d in sets}


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 3])
def test_classes_and_links(spark, sf, texts, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.op8_ngram_join(spark, sf).collect()}
    want = brute_classes(texts)
    wrong = [d for d in want if got[d] != want[d]]
    assert len(wrong) <= 0.001 * len(want)  # the forest's target recall


def test_chains_of_similar_texts(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):  # each differs from the last in one word; the ends are far apart
        rows.append((i, " ".join(words)))
        words[(i * 5) % 200] = f"x{i}"
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_similarity_edges(spark, odd):
    out = {(r.doc_id, r.class_id, r.class_size) for r in ngram_join.similar_classes(odd).collect()}
    assert ngram_join.similar_classes(odd).count() == odd.count() and ngram_join.similar_classes(odd.limit(0)).count() == 0
    assert (4, 4, 2) in out and (5, 4, 2) in out and (1, 1, 1) in out and (2, 2, 1) in out


@pytest.mark.parametrize("rest", [ngram_join.REST, 2])
def test_crowded_buckets_lose_no_pair(spark, monkeypatch, rest):
    monkeypatch.setattr(ngram_join, "REST", rest)
    g = np.random.default_rng(0)
    sketches = g.integers(0, 1 << 16, (9, 64)).astype(np.uint16)  # nodes 0 to 4 lead nothing: unlike all others
    sketches[6], sketches[8] = sketches[5], sketches[7]
    sketches[6, :20] += 1  # similar to 5, not next to it
    sketches[8, :4] += 1
    rows = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sketches)], "node long, sketch binary")
    keys = spark.createDataFrame([(i, k) for k in (1, 2) for i in range(9)], "node long, k long")
    ties = {tuple(sorted((r.a, r.b))) for r in ngram_join._tied(keys, rows).collect()}
    assert ties == {(5, 6), (7, 8)}  # two leaders a bucket, and nothing after them, found none


def join_rows(spark, run):
    """Rows that joins give in all, by their keys, while ``run`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    every, made = store.executionsList(seen, 10_000), Counter()
    for i in range(every.size()):
        e = every.apply(i)
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for n in (nodes.apply(j) for j in range(nodes.size())):
            for m in (n.metrics().apply(j) for j in range(n.metrics().size())):
                if "Join" in n.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made[re.sub(r"#\d+L?|^\w+ |, Build\w+|, false$", "", n.desc())] += int(values.apply(m.accumulatorId()).replace(",", ""))
    return made


def test_crowded_buckets_make_few_rows(spark):
    g = np.random.default_rng(0)
    base = g.integers(0, 1 << 16, 64).astype(np.uint16)
    sketches = np.repeat(base[None], 300, 0)
    for i, x in enumerate(sketches):
        x[g.permutation(64)[:6]] += i + 1  # similar to all, next to none
    rows = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sketches)], "node long, sketch binary").cache()
    keys = spark.createDataFrame([(i, 100 * t + int(k)) for t in range(24) for i, k in enumerate(g.integers(0, 8, 300))], "node long, k long").cache()
    out = []
    made = join_rows(spark, lambda: out.extend((r.node, r.label) for r in ngram_join.components(ngram_join._tied(keys, rows), "t").collect()))
    assert sorted(out) == [(i, 0) for i in range(300)]
    assert 0 < max(made.values()) < 20_000


def test_components_of_a_path(spark):
    order = np.random.default_rng(1).permutation(400)
    for nodes in (range(400), order):
        edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(nodes, nodes[1:])] + [(900, 901), (902, 902)], "a long, b long")
        got = {r.node: r.label for r in ngram_join.components(edges, "path").collect()}
        assert got == dict.fromkeys(range(400), 0) | {900: 900, 901: 900}
