"""Suffix automata of reference shards, broadcast and streamed against.

For a reference of bounded size: its texts are cut into shards, each task
builds the automaton of every shard once and streams documents through it.  The
matching statistic of a word is the length of the longest run of words ending
there that occurs in the shard; runs of ``size`` words or more are removed.

The whole corpus as its own reference is ``substring.py``; the README has the
figures that rule automata out there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbara.llm.common import ddl, slices

#: Words of a shard, and of a reference that may be broadcast.
SHARD, MOST = 100_000, 2_000_000


class SuffixAutomaton:
    """Automaton of all word runs of some texts; runs never cross texts."""

    def __init__(self, texts: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in texts:
            last = 0
            for w in words:
                last = self._extend(last, w)

    def _state(self, length: int, link: int, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: str) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, w: str) -> int:
        q = self.next[p].get(w)
        if q is not None:  # a new text that repeats an old run
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        new = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def statistics(self, words: list[str]) -> list[int]:
        """For every word: the longest run ending there that occurs in the texts."""
        out, s, n = [], 0, 0
        for w in words:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            out.append(n)
        return out


def covered(statistics: list[int], size: int) -> list[tuple[int, int]]:
    """Maximal spans covered by runs of ``size`` or more, disjoint and in order."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(statistics):
        if n >= size:
            lo = i + 1 - n
            while out and out[-1][1] >= lo:
                lo = min(lo, out.pop()[0])
            out.append((lo, i + 1))
    return out


def remove_reference(docs: DataFrame, reference: DataFrame, text: str = "text", size: int = 20) -> DataFrame:
    """``docs`` with every run of ``size`` words that occurs in ``reference`` removed (words left joined by a space), plus n_removed.

    The reference may have at most MOST words; more is an error, not a cut.
    Null texts stay null; texts that lose nothing stay as they are.
    """
    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    ref = reference.select(split.alias("w")).filter(F.size("w") >= size).distinct()
    total = ref.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    if total > MOST:
        raise ValueError(f"the reference has {total} words; at most {MOST} are broadcast")
    shards: list[list[list[str]]] = [[]]
    room = SHARD
    for row in ref.collect():  # bounded above
        if room < len(row["w"]) and shards[-1]:
            shards.append([])
            room = SHARD
        shards[-1].append(row["w"])
        room -= len(row["w"])
    keep = [c for c in docs.columns if c != "n_removed"]
    held = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [SuffixAutomaton(s) for s in held.value if s]
        for batch in batches:
            for part in slices(batch, text):
                texts, gone = [], []
                for t in part.column(text).to_pylist():
                    words = [w for w in _split(t or "")]
                    drop: set[int] = set()
                    for a in automata:
                        for lo, hi in covered(a.statistics(words), size):
                            drop.update(range(lo, hi))
                    texts.append(t if not drop else " ".join(w for i, w in enumerate(words) if i not in drop))
                    gone.append(len(drop))
                cols = [pa.array(texts, pa.string()) if c == text else part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(gone, pa.int64())], names=[*keep, "n_removed"])

    return docs.select(*keep).mapInArrow(run, ddl(docs.select(*keep), "n_removed long"))


def _split(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()]
