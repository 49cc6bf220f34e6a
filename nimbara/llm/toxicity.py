"""Toxic passages as maximum-scoring segments of token log-odds.

Fit: on a bounded sample of labelled rows, every token gets the log-odds of the
toxic against the other rows under a Dirichlet prior shaped by the pooled
counts; tokens whose log-odds stand out from their sampling error keep their
score, all others score a small negative drift.  The scores of a text's tokens
form a walk of negative drift, so the scores of chance segments follow an
extreme-value law: its rate is the root of E[exp(rate * score)] = 1 over tokens
of the non-toxic rows, its size factor is fitted to their best segments.

Score: one linear scan finds all maximal scoring segments of a text.  Their
excess over what a text of that length shows by chance is summed and mapped to
a probability by a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbara.llm.common import ddl, discard, shielded, slices, stored, table

#: Labelled rows used for fitting, at most; those of smallest hash.
FIT_ROWS = 20_000
PRIOR = 0.02  #: weight of the Dirichlet prior, as a share of all counts
EVIDENCE = 2.0  #: least log-likelihood gain of a token beyond the log of the vocabulary
DRIFT = 0.05  #: score lost at every token

TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    """Runs of letters of any script, lower-cased."""
    return TOKEN.findall(text.lower())


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end exclusive, score), in linear time.

    Candidates are kept with the walk's height at their two ends; a candidate
    joins the nearest earlier one that starts lower, if that one ends lower too.
    """
    found: list[list[float]] = []  # start, end, height before, height after
    height = 0.0
    lower: list[int] = []  # of each candidate: the nearest earlier one that starts lower
    for i, s in enumerate(scores):
        before, height = height, height + s
        if s <= 0:
            continue
        start, low, end, high = i, before, i + 1, height
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = lower[j]
            if j < 0 or found[j][3] >= high:
                found.append([start, end, low, high])
                lower.append(j)
                break
            start, low = int(found[j][0]), found[j][2]
            del found[j:], lower[j:]
    return [(int(a), int(b), round(h - g, 9)) for a, b, g, h in found]


def sparse_segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """``segments`` of a walk that is -drift everywhere but at positions ``at``."""
    walk: list[float] = []
    last = -1
    for i, s in zip(at, score):
        walk += [-drift * (i - last - 1), s]
        last = i
    return [(at[a // 2], at[(b - 1) // 2] + 1, s) for a, b, s in segments(walk)]


class Model:
    """Token scores, drift, extreme-value constants and calibration."""

    def __init__(self, scores: dict[str, float], drift: float = DRIFT):
        self.scores, self.drift = scores, drift
        self.rate, self.size, self.curve = 1.0, 1.0, (-3.0, 1.0, 0.0)

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and the maximal scoring segments in token positions."""
        words, get = tokens(text), self.scores
        at = [i for i, w in enumerate(words) if w in get]
        return len(words), sparse_segments(at, [get[words[i]] for i in at], self.drift) if at else []

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """Summed excess of the segments over chance, and the best segment's."""
        if not found:
            return 0.0, 0.0
        floor = math.log(max(1.0, self.size * n))
        over = [max(0.0, self.rate * s - floor) for _, _, s in found]
        return math.log1p(sum(over)), math.log1p(max(over))

    def probability(self, x: tuple[float, float]) -> float:
        a, b, c = self.curve
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * x[0] + c * x[1]))))

    def score(self, text: str | None) -> float:
        return self.probability(self.evidence(*self.passages(text or "")))


def log_odds(counts: DataFrame, share: float) -> list[tuple[str, float, int]]:
    """token, score and clean texts of the tokens whose texts lean to the toxic side beyond chance.

    counts: token, y1 and y0 (toxic and other texts with it); share: of all
    texts, the toxic ones'.  The vocabulary is counted and judged where it is;
    only tokens with evidence, at most one for every few (toxic text, token)
    pairs of the sample, come to the driver.
    """
    n1, n0, size = counts.agg(F.coalesce(F.sum("y1"), F.lit(0)), F.coalesce(F.sum("y0"), F.lit(0)), F.count("*")).first()
    if not n1 or not n0 or not 0 < share < 1:
        return []
    prior = PRIOR * (n1 + n0)
    y1, y0 = F.col("y1"), F.col("y0")
    y = y1 + y0
    gain = y1 * F.log(y1 / (share * y)) + F.when(y0 > 0, y0 * F.log(y0 / ((1 - share) * y))).otherwise(0.0)
    least = math.log(size) + EVIDENCE  # as many tokens are tried
    a = prior * y / (n1 + n0)
    score = F.log((y1 + a) / (n1 + prior)) - F.log((y0 + a) / (n0 + prior)) - DRIFT
    found = counts.filter(y1 > share * y).filter(gain >= least).select("token", score.alias("score"), "y0").filter("score > 0")
    return [(r["token"], r["score"], r["y0"]) for r in found.orderBy("token").collect()]


def rate_of(scores: np.ndarray, counts: np.ndarray) -> float:
    """Positive root of sum(p * exp(rate * score)) = 1; the mean score must be negative."""
    p = counts / counts.sum()
    if not (scores > 0).any() or (p * scores).sum() >= 0:
        return 1.0
    f = lambda r: (p * np.exp(np.clip(r * scores, -60, 60))).sum() - 1
    lo, hi = 0.0, 1.0
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def training_texts(docs: DataFrame, labels: DataFrame, label: str, most: int = FIT_ROWS) -> DataFrame:
    """text and y of at most ``most`` labelled documents that are not held out (crc32(doc_id) % 3 is not 1); copies speak once."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    ids = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # bounded by ``most``
    return rows.groupBy(F.xxhash64("text").alias("_h"), "y").agg(F.first("text").alias("text")).select("text", "y")


def _over(rows: DataFrame, schema: str, each) -> DataFrame:
    """``each`` (text, y) -> list of rows, over the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                out = [r for t, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist()) for r in each(t, y)]
                columns = list(zip(*out)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return rows.mapInArrow(run, schema)


def fit(rows: DataFrame) -> Model:
    """A model from ``rows`` (text, y), in three passes over them.

    Texts stay where they are: the driver gets the scored tokens, and two or
    three numbers a text.  Without rows of both labels every text scores alike.
    """
    rows = stored(rows, "sample")
    counts = _over(rows, "token string, y1 long, y0 long", lambda t, y: [(w, y, 1 - y) for w in set(tokens(t))])  # a text speaks once for a token
    counts = stored(counts.groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")), "tokens")
    share, total = rows.agg(F.avg("y"), F.count("*")).first()
    found = log_odds(counts, share or 0.0)
    model = Model({w: s for w, s, _ in found})
    if not total:
        return model
    n0 = max(1, counts.agg(F.sum("y0")).first()[0] or 0)
    model.rate = rate_of(np.array([s for _, s, _ in found] + [-model.drift]), np.array([y0 + 0.01 for _, _, y0 in found] + [n0]))

    def best(text: str, y: int) -> list[tuple]:
        n, f = model.passages(text)
        return [] if y or not n else [(n * math.exp(-model.rate * max((s for _, _, s in f), default=0.0)),)]

    # Moment fit of the Gumbel law: mean of exp(-rate * best) ~ 1 / (size * n).
    mean = _over(rows, "z double", best).agg(F.avg("z")).first()[0]
    if mean is not None:
        model.size = max(1e-6, 1.0 / max(1e-9, mean))
    seen = _over(rows, "a double, b double, y long", lambda t, y: [(*model.evidence(*model.passages(t)), y)]).toArrow()
    order = np.lexsort([seen.column(c).to_numpy() for c in ("a", "b", "y")])
    x = np.column_stack([np.ones(len(order)), *(seen.column(c).to_numpy()[order] for c in ("a", "b"))])
    y = seen.column("y").to_numpy()[order].astype(float)
    w = np.zeros(3)
    for _ in range(50):  # ridge-penalised Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.curve = (float(w[0]), float(w[1]), float(w[2]))
    discard(rows)
    discard(counts)
    return model


@shielded
def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with score and passages (token start, end, score of each segment).

    Null and empty texts have no passage and the score of that.  Repeated rows
    score alike; an empty table gives an empty result; columns named as an
    output are replaced, all others pass through.
    """
    keep = [c for c in docs.columns if c not in ("score", "passages")]
    rest = [c for c in keep if c != text]
    schema = ddl(docs.select(*rest), "score double", "passages array<struct<start:int,end:int,score:double>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                scores, found = [], []
                for t in part.column(text).to_pylist():
                    n, f = model.passages(t or "")
                    scores.append(model.probability(model.evidence(n, f)))
                    floor = math.log(max(1.0, model.size * n)) if f else 0.0
                    found.append([{"start": a, "end": b, "score": s} for a, b, s in f if model.rate * s > floor])
                arrays = [part.column(c) for c in rest] + [pa.array(scores, pa.float64()), pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "score", "passages"])

    return docs.select(*keep).mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_texts(docs, table(spark, sf_dir, "labels"), "toxic"))
    scored = score_toxicity(docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
