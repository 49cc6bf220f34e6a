"""Token counts without token ids.

A text is a bag of pre-tokens, and a pre-token always splits into the same
number of pieces.  White space never belongs to a pre-token of the word-level
vocabularies, so texts are cut into runs without white space first.

1. Distinct runs of the corpus with their counts; runs that differ only in
   punctuation and case at the edges go to the same task.
2. Each task cuts its runs into pre-tokens and counts the pieces of each
   distinct pre-token once; a run's pieces are the sum over its pre-tokens.
3. Every document's frequencies of runs are joined to the piece counts and
   summed: the HEAD most frequent runs from a broadcast table of that size, all
   others, a small share of a text, by a shuffled join.

Token ids are never built, texts are never shuffled, and all that moves are
distinct runs and the rarer (document, run, count) rows.  Runs are told apart
by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbara.llm.common import Words, discard, shielded, slices, stored, table

#: Entries a worker keeps before it starts anew.
KEPT = 300_000
#: Runs whose piece counts are broadcast, at most.
HEAD = 500_000
#: Count classes in a power of two, for choosing the head.
STEPS = 8
SLICE = 2 << 20
_OPEN: dict[str, object] = {}


class PieceCounts:
    """Number of pieces of runs without white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pre: dict[str, int] = {}  # distinct pre-token -> pieces

    def run(self, text: str) -> int:
        if any(s in text for s in self.special):  # the library's own handling
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        if len(self.pre) > KEPT:
            self.pre.clear()
        n = 0
        for pre, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text)):
            if (k := self.pre.get(pre)) is None:
                k = len(self.tok.model.tokenize(pre))
                if len(pre) <= 64:
                    self.pre[pre] = k
            n += k
        return n


class SentencePieces:
    """Vocabularies whose pieces may cross white space: the whole text is counted."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def run(self, text: str) -> int:
        return len(self.sp.encode(text, num_threads=1)) if text else 0


def counter(path: str):
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    if path not in _OPEN:
        _OPEN[path] = SentencePieces(path) if path.endswith(".model") else PieceCounts(path)
    return _OPEN[path]


def _merged(hs: list[np.ndarray], ns: list[np.ndarray], runs: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct hashes with their summed counts and runs."""
    h, at, of = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
    return h, np.bincount(of, np.concatenate(ns), len(h)).astype(np.int64), pa.concat_arrays(runs).take(pa.array(at))


def distinct_runs(texts: DataFrame) -> DataFrame:
    """h, run, n of the distinct runs of ``_t`` in every task (or KEPT of them at a time)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ([], [], [])
        size = 0

        def out() -> pa.RecordBatch:
            h, n, runs = _merged(*held)
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), runs, pa.array(n, pa.int64())], names=["h", "run", "n"])

        for batch in batches:
            for part in slices(batch, "_t", SLICE):
                w = Words(part.column("_t"))
                h, at, n = np.unique(w.hash.view(np.int64), return_index=True, return_counts=True)
                raw = w.buf.tobytes()
                runs = pa.array([raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist())], pa.binary()).cast(pa.string())
                for x, y in zip(held, (h, n, runs)):
                    x.append(y)
                size += len(h)
                if size > 2 * KEPT:
                    merged = _merged(*held)
                    held, size = tuple([x] for x in merged), len(merged[0])
                    if size > KEPT:
                        yield out()
                        held, size = ([], [], []), 0
        if size:
            yield out()

    return texts.select("_t").mapInArrow(cut, "h long, run string, n long")


def piece_counts(runs: DataFrame, vocabulary: str) -> DataFrame:
    """h, n, pieces of every distinct run.

    Rows are dealt out by the run without case and edges, so all rows of a run
    meet in one task, and so do nearly all runs of a pre-token.
    """
    core = F.regexp_replace(F.lower("run"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ([], [], [])
        for batch in batches:
            for x, y in zip(held, (batch.column("h").to_numpy(), batch.column("n").to_numpy(), batch.column("run"))):
                x.append(y)
        if held[0]:
            pieces = counter(vocabulary)
            h, n, words = _merged(*held)
            for lo in range(0, len(h), KEPT):
                k = [pieces.run(x) for x in words[lo : lo + KEPT].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + KEPT]), pa.array(n[lo : lo + KEPT]), pa.array(k, pa.int64())], names=["h", "n", "pieces"])

    return runs.repartition(F.when(core != "", core).otherwise(F.col("run"))).mapInArrow(count, "h long, n long, pieces long")


def frequent(pieces: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and pieces of the most frequent runs: whole count classes, at most ``most`` runs."""
    kind = F.floor(F.log2("n") * STEPS)
    least, total = None, 0
    for r in pieces.groupBy(kind.alias("k")).count().orderBy(F.desc("k")).collect():  # some hundred classes
        total += r["count"]
        if total > most:
            break
        least = r["k"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = pieces.filter(kind >= least).select("h", "pieces").toArrow()
    h, k = top.column("h").to_numpy(), top.column("pieces").to_numpy()
    order = np.argsort(h)
    return h[order], k[order]


def text_tokens(texts: DataFrame, vocabulary: str) -> DataFrame:
    """_key and n (tokens) of every distinct text; ``texts``: _key, _t (not null)."""
    pieces = stored(piece_counts(distinct_runs(texts), vocabulary), "pieces")
    head = texts.sparkSession.sparkContext.broadcast(frequent(pieces, HEAD))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, count = head.value
        for batch in batches:
            for part in slices(batch, "_t", SLICE):
                w = Words(part.column("_t"))
                h, code = np.unique(w.hash.view(np.int64), return_inverse=True)
                at = np.minimum(np.searchsorted(top, h), max(0, len(top) - 1))
                known = top[at] == h if len(top) else np.zeros(len(h), bool)
                own = np.where(known, count[at], 0) if len(top) else np.zeros(len(h), np.int64)
                n = np.bincount(w.doc, own[code], w.docs).astype(np.int64) if len(code) else np.zeros(w.docs, np.int64)
                rest = ~known[code]
                pair, times = np.unique(w.doc[rest] * max(1, len(h)) + code[rest], return_counts=True)
                doc, code = np.divmod(pair, max(1, len(h)))
                off = pa.array(np.searchsorted(doc, np.arange(w.docs + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(off, pa.array(h[code], pa.int64())), pa.ListArray.from_arrays(off, pa.array(times, pa.int32()))],
                    names=["_key", "n", "rare", "times"])

    rows = stored(texts.select("_key", "_t").mapInArrow(sums, "_key long, n long, rare array<long>, times array<int>"), "frequencies")
    rare = rows.select("_key", F.explode_outer(F.arrays_zip("rare", "times")).alias("r")).filter(F.col("r").isNotNull()).select("_key", F.col("r.rare").alias("h"), F.col("r.times").alias("times"))
    found = rare.join(pieces.select("h", "pieces"), "h").select("_key", (F.col("pieces") * F.col("times")).alias("n"), F.lit(0).alias("copies"))
    every = rows.select("_key", "n", F.lit(1).alias("copies")).unionByName(found)
    # Copies of a text add the same sum each.
    out = stored(every.groupBy("_key").agg((F.sum("n") / F.sum("copies")).cast("long").alias("n")), "tokens")
    discard(pieces)
    discard(rows)
    return out


@shielded
def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """``docs`` with the number of tokens of ``text`` as ``out`` (replaced if it is there).

    vocabulary: path of the tokenizer file on every executor; or the name of a
    file of the installed ``public_tokenizers`` module.  The vocabulary must cut
    at white space (``.json``) or be a SentencePiece model.  Null and empty
    texts have 0 tokens; an empty table gives an empty result; repeated rows
    stay; all other columns pass through, ``text`` itself only if keep_text.
    Row order is free.
    """
    keep = [c for c in docs.columns if c != out and (keep_text or c != text)]
    t = F.coalesce(F.col(text), F.lit(""))
    if vocabulary.endswith(".model"):

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = counter(vocabulary)
            for batch in batches:
                for part in slices(batch, "_t", SLICE):
                    n = [pieces.run(x) for x in part.column("_t").to_pylist()]
                    yield pa.RecordBatch.from_arrays([*part.drop_columns(["_t"]).columns, pa.array(n, pa.int64())], names=[*keep, out])

        return docs.select(*keep, t.alias("_t")).mapInArrow(whole, docs.select(*keep).schema.add(out, "long"))
    keyed = docs.withColumn("_key", F.xxhash64(t))
    tokens = text_tokens(keyed.select("_key", t.alias("_t")), vocabulary)
    return keyed.join(tokens.withColumnsRenamed({"_key": "_of", "n": "_n"}), F.col("_key") == F.col("_of")).select(*keep, F.col("_n").alias(out))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = count_tokens(docs, "word_bpe_49k.json", keep_text=False)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
