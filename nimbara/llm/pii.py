"""Personal data: pattern spans, and terms that give protected entities away.

The patterns find e-mail addresses, network addresses, card and phone numbers.
Around every such entity the words within REACH words are its context.  Over
the whole corpus, counted in distinct texts, the share of a term's texts in
which the term stands by an entity, P(entity | term), and the entity's
information content -log2 P(entity) give the disclosure
PMI / IC = log2(P(entity | term) / P(entity)) / -log2 P(entity): 1 means that
the term reveals the entity fully.  Terms of any length above DISCLOSURE whose
meetings with the entity are too many for chance (LEVEL, over all pairs of an
entity and a term) are generalised wherever they stand in a text that holds the
entity.  One meeting never tells a term that discloses from any other rare word.
What is protected is the value of an entity and the class it belongs to: an
address's domain, a network, a number's leading digits.

All of it is built from DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbara.llm.common import discard, let, shielded, small, stored, table, words

#: Words on either side of an entity that are its context.
REACH = 5
#: Least share of the entity's information that a term must carry.
DISCLOSURE = 0.97
#: Chance that any term of the corpus meets any entity as often with no tie between them.
LEVEL = 0.05
#: Up to so many meetings their chance is bounded by counting, beyond by large deviations.
FEW = 20
#: Rows of a broadcast side.
SMALL = 200_000

#: Anchored to the start of a run, or the end of the match before: the same
#: matches as without, but a long run is tried once, not from each character.
#: Groups that only repeat are possessive, which Java matches without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(d: Column) -> Column:
        n = F.size(d)
        add = lambda x, i: F.when((n - i) % 2 == 0, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x)
        return F.aggregate(F.transform(d, lambda x, i: add(x.cast("int"), i)), F.lit(0), lambda a, x: a + x)

    return let(F.filter(F.split(digits, ""), lambda x: x != ""), total) % 10 == 0


def _valid(kind: str, body: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.char_length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(256)) <= 255)
        return F.forall(F.split(body, r"\."), part)
    if kind == "card":
        n = F.char_length(_digits(body))
        return (n >= 16) & (n <= 19) & luhn(_digits(body))
    if kind == "phone":
        n = F.char_length(_digits(body))
        return (n >= 8) & (n <= 15)
    return F.lit(True)


_SPAN = "array<struct<kind:string,s:int,e:int,body:string>>"


def spans_of(text: Column, kind: str) -> Column:
    """Valid matches of one kind with code-point bounds, in order.

    Gaps come from splitting at the pattern and bodies from extracting it; the
    bounds are running lengths.
    """
    pattern = PATTERNS[kind]
    # Cheap tests first: most texts hold no such entity.
    hint = {"email": F.instr(text, "@") > 0, "phone": F.instr(text, "+") > 0}.get(kind, F.lit(True))
    bodies = F.regexp_extract_all(text, F.lit(pattern), 0)

    def place(x: Column) -> Column:
        state = lambda end, out: F.struct(end.alias("end"), out.alias("out"))
        step = lambda a, z: let(a["end"] + F.char_length(z["g"]), lambda s: state(
            s + F.char_length(z["b"]),
            F.concat(a["out"], F.array(F.struct(F.lit(kind).alias("kind"), s.cast("int").alias("s"), (s + F.char_length(z["b"])).cast("int").alias("e"), z["b"].alias("body"))))))
        pairs = F.zip_with(x["b"], F.slice(x["g"], 1, F.size(x["b"])), lambda b, g: F.struct(b.alias("b"), g.alias("g")))
        folded = F.aggregate(pairs, state(F.lit(0), F.array().cast(_SPAN)), step, lambda a: a["out"])
        return F.filter(folded, lambda m: _valid(kind, m["body"]))

    both = F.struct(bodies.alias("b"), F.split(text, pattern, -1).alias("g"))
    return F.when(hint & text.rlike(pattern), let(both, place)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed and then by start."""
    return F.concat(*[spans_of(text, k) for k in KINDS])


def _entities(span: Column) -> Column:
    """What is protected: the value, numbers without separators, and its class (domain, network, leading digits)."""
    digits, low = _digits(span["body"]), F.lower(span["body"])
    value = F.when(span["kind"].isin("card", "phone"), digits).otherwise(low)
    of = (
        F.when(span["kind"] == "email", F.substring_index(low, "@", -1))
        .when(span["kind"] == "ip", F.substring_index(low, ".", 2))
        .otherwise(F.substring(digits, 1, 6)))
    return F.array(F.xxhash64(span["kind"], value), F.xxhash64(F.lit("class"), span["kind"], of))


def term_of(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


#: Words beside an entity are read from so many code points on either side, and
#: from WIDER times as many again and again where these hold fewer than REACH.
NEAR, WIDER, TIMES = 200, 16, 3


def _contexts(t: Column, span: Column) -> Column:
    """Up to REACH whole words before and after a span: struct(w, s), s the word's first code point."""

    def laid(part: Column, at: Column, ahead: bool, cut: Column) -> Column:
        pieces = F.split(part, r"[\x20\x09-\x0D]", -1)
        held = lambda a, w: F.struct(w.alias("w"), a["at"].cast("int").alias("s"))
        full = lambda a: F.size(a["out"]) >= REACH
        more = lambda a, w: F.concat(F.when(full(a), F.slice(a["out"], 2, REACH - 1)).otherwise(a["out"]), F.array(held(a, w)))
        take = lambda a, w: F.when((w == "") | (full(a) if ahead else F.lit(False)), a["out"]).otherwise(more(a, w))
        step = lambda a, w: F.struct((a["at"] + F.char_length(w) + 1).alias("at"), take(a, w).alias("out"))
        # the innermost piece touches the entity, the outermost may be cut
        outer = F.when(cut, F.lit(1)).otherwise(0)
        inner = lambda x: F.slice(x, 2 if ahead else F.lit(1) + outer, F.greatest(F.lit(0), F.size(x) - 1 - outer))
        skipped = lambda x: F.char_length(F.element_at(x, 1)) + 1
        begin = lambda x: at + (skipped(x) if ahead else F.when(cut, skipped(x)).otherwise(0))
        start = lambda x: F.struct(begin(x).alias("at"), F.array().cast("array<struct<w:string,s:int>>").alias("out"))
        return let(pieces, lambda x: F.aggregate(inner(x), start(x), step, lambda a: a["out"]))

    def side(ahead: bool, near: int, times: int) -> Column:
        if times == 0:  # the whole side
            return laid(F.substring(t, span["e"] + 1, F.char_length(t)), span["e"], True, F.lit(False)) if ahead else laid(F.substring(t, F.lit(1), span["s"]), F.lit(0), False, F.lit(False))
        lo = F.greatest(F.lit(0), span["s"] - near)
        cut = span["e"] + near < F.char_length(t) if ahead else lo > 0
        found = laid(F.substring(t, span["e"] + 1, F.lit(near)), span["e"], True, cut) if ahead else laid(F.substring(t, lo + 1, span["s"] - lo), lo, False, cut)
        return let(found, lambda x: F.when((F.size(x) >= REACH) | ~cut, x).otherwise(side(ahead, near * WIDER, times - 1)))

    return F.concat(side(False, NEAR, TIMES), side(True, NEAR, TIMES))


def log_chance(both: Column, ent: Column, term: Column, n_all: int) -> Column:
    """An upper bound of log P(at least ``both`` shared texts) of an entity in ``ent`` and a term in ``term`` of n_all texts.

    The texts of the term are drawn at random.  Exact where all of them are shared, up to FEW.
    """
    share, p = both / term, ent / F.lit(float(n_all))
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0)
    far = F.when(share > p, -term * (share * F.log(share / p) + rest)).otherwise(0.0)
    step = lambda a, i: a + F.log((term - i) * (ent - i) / ((F.lit(float(n_all)) - i) * (i + 1)))
    near = F.when(both <= FEW, F.aggregate(F.sequence(F.lit(0), F.least(both, F.lit(FEW)).cast("int") - 1), F.lit(0.0), step))
    return F.least(F.lit(0.0), far, near)


def _free(spans: Column, s: Column, e: Column) -> Column:
    """Whether s..e touches none of ``spans``."""
    return ~F.exists(spans, lambda q: (s < q["e"]) & (q["s"] < e))


def _occurrences(text: Column, terms: Column, spans: Column) -> Column:
    """struct(s, e) of the words of ``text`` whose term is in ``terms``, outside ``spans``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(a: Column, w: Column) -> Column:
        end = (a["at"] + F.char_length(w)).cast("int")
        hit = (w != "") & F.array_contains(terms, term_of(w)) & _free(spans, a["at"], end)
        return F.struct((end + 1).alias("at"), F.when(hit, F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), end.alias("e"))))).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.split(text, r"[\x20\x09-\x0D]", -1), start, step, lambda a: a["out"])


def told_pairs(found: DataFrame, docs: DataFrame, held: DataFrame, text: str) -> DataFrame:
    """ent, term of the terms that disclose a protected entity beside which they stand.

    found: _tid (hash of the text), _t, sp (base spans) of texts with entities.
    held: _tid and n_words of every row.
    """
    one = found.select("_tid", "_t", "sp", F.explode_outer("sp").alias("p"))
    # No word inside another entity is a term: entities are removed anyway.
    beside = F.filter(_contexts(F.col("_t"), F.col("p")), lambda c: _free(F.col("sp"), c["s"], c["s"] + F.char_length(c["w"])))
    words_of = F.array_distinct(F.transform(beside, lambda c: term_of(c["w"])))
    ctx = one.select("_tid", _entities(F.col("p")).alias("ents"), F.explode_outer(words_of).alias("term")).filter(F.col("term").rlike(r"\p{L}"))
    ctx = stored(ctx.select("_tid", F.explode_outer("ents").alias("ent"), "term").distinct(), "contexts")
    ents = found.select("_tid", F.explode_outer("sp").alias("p")).select("_tid", F.explode_outer(_entities(F.col("p"))).alias("ent"))
    n_ent = stored(ents.distinct().groupBy("ent").agg(F.count("*").alias("n_ent")), "entities")
    copies = stored(held.groupBy("_tid").agg(F.count("*").alias("m"), F.max("n_words").alias("n_words")), "copies")
    all_ = copies.agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).first()
    n_all = all_["n"] or 1
    # No more than words / n_both terms are in n_both texts or more, so there are no more pairs than this.
    pairs = F.lit(float(n_ent.count())) * F.lit(float(all_["words"] or 1)) / F.col("n_both")
    by_pair = ctx.groupBy("ent", "term").agg(F.count("*").alias("n_both")).join(n_ent, "ent")
    chance = lambda n_term: log_chance(F.col("n_both"), F.col("n_ent"), n_term, n_all) + F.log(pairs)
    share = lambda n: F.least(F.lit(1.0), F.col("n_both") / n)
    p_ent = F.col("n_ent") / F.lit(float(n_all))
    # Both conditions only get harder with n, so what fails for a smaller count of texts always fails.
    tells = lambda n: (p_ent < 1) & (F.log2(share(n) / p_ent) / -F.log2(p_ent) >= DISCLOSURE) & (chance(n) <= math.log(LEVEL))
    near = ctx.select("term", "_tid").distinct().groupBy("term").agg(F.count("*").alias("n_beside"))
    by_pair = stored(by_pair.join(near, "term").filter(tells(F.col("n_beside"))), "pairs")
    # texts with a candidate term, over the whole corpus; copies of a text count as one
    wanted = small(by_pair.select("term").distinct(), SMALL, F.octet_length("term"))
    terms = F.array_distinct(F.transform(F.array_distinct(words(F.col(text))), term_of))
    texts = docs.select(F.xxhash64(text).alias("_tid"), F.explode(terms).alias("term")).join(wanted, "term", "left_semi")
    again = small(copies.filter("m > 1").select("_tid", "m"), SMALL)
    n_term = texts.join(again, "_tid", "left").groupBy("term").agg(F.round(F.sum(1 / F.coalesce("m", F.lit(1)))).cast("long").alias("n_term"))
    told = stored(by_pair.join(n_term, "term").filter(tells(F.greatest("n_term", "n_both"))).select("ent", "term"), "told")
    for t in (ctx, n_ent, copies, by_pair):
        discard(t)
    return told


def _found(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """_d, _key, base and terms of every row."""
    keyed = docs.select(F.col(doc).alias("_d"), F.xxhash64(doc, text).alias("_key"), F.xxhash64(text).alias("_tid"), F.coalesce(text, F.lit("")).alias("_t"))
    rows = keyed.withColumn("sp", base_spans(F.col("_t")))
    held = stored(rows.select("_d", "_key", "_tid", F.size(words(F.col("_t"))).alias("n_words"), F.when(F.size("sp") > 0, F.col("_t")).alias("_t"), "sp"), "spans")
    found = held.filter(F.size("sp") > 0)
    told = told_pairs(found, docs, held.select("_tid", "n_words"), text)
    # A term that discloses an entity goes wherever it stands in a text with that entity.
    has = found.select("_tid", F.explode_outer("sp").alias("p")).select("_tid", F.explode_outer(_entities(F.col("p"))).alias("ent")).distinct()
    per = has.join(small(told, SMALL, F.octet_length("term")), "ent").groupBy("_tid").agg(F.collect_set("term").alias("_w"))
    spans = found.dropDuplicates(["_tid"]).join(per, "_tid").select("_tid", _occurrences(F.col("_t"), F.col("_w"), F.col("sp")).alias("terms"))
    spans = stored(spans, "terms").withColumnRenamed("_tid", "_of")
    discard(told)
    out = held.select("_d", "_key", "_tid", "sp").join(spans, F.col("_tid") == F.col("_of"), "left")
    return out.select("_d", "_key", F.col("sp").alias("base"), F.coalesce("terms", F.array().cast("array<struct<s:int,e:int>>")).alias("terms"))


def find_pii(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc, base spans ``base`` and ``terms`` (s, e), both in order.

    Bounds are code points, ends exclusive.  Null and empty texts have none; an
    empty table gives an empty result.  Rows of equal text count as one text in
    the statistics and get the same spans.  Other columns do not matter.
    """
    return _found(docs, doc, text).select(F.col("_d").alias(doc), "base", "terms")


@shielded
def sanitise(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with entities replaced by their kind in brackets and disclosing terms by [term].

    Every row keeps its place, also rows of equal id; null texts stay null; all
    other columns pass through.
    """
    every = F.array_sort(F.concat(
        F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["kind"].alias("k"))),
        F.transform("terms", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), F.lit("term").alias("k")))))
    spans = _found(docs.select(doc, text), doc, text).dropDuplicates(["_d", "_key"]).select("_d", "_key", every.alias("_spans"))
    joined = docs.join(spans, (F.xxhash64(docs[doc], docs[text]) == F.col("_key")) & docs[doc].eqNullSafe(F.col("_d")), "left")
    t = docs[text]
    step = lambda a, m: F.when(m["s"] < a["end"], F.struct(F.greatest(a["end"], m["e"]).alias("end"), a["out"].alias("out"))).otherwise(
        F.struct(m["e"].alias("end"), F.concat(a["out"], F.substring(t, a["end"] + 1, m["s"] - a["end"]), F.lit("["), m["k"], F.lit("]")).alias("out")))
    done = F.aggregate("_spans", F.struct(F.lit(0).alias("end"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(t, a["end"] + 1, F.char_length(t))))
    return joined.select(*[F.when(t.isNull(), t).otherwise(done).alias(text) if c == text else docs[c] for c in docs.columns])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    label = lambda m: F.concat_ws(":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))
    base = F.transform("base", label)
    terms = F.transform("terms", lambda m: F.concat_ws(":", F.lit("term"), m["s"].cast("string"), m["e"].cast("string")))
    count = lambda k: F.size(F.filter("base", lambda m: m["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"))
