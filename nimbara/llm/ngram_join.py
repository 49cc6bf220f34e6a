"""Similarity join on word shingles: a MinHash LSH forest and exact verification.

1. Texts of equal word sequence are one node with a weight.
2. Every node gets TREES signatures of DEPTH minimum hashes.  A tree's sorted
   signatures form a prefix trie.  Matching starts at the longest prefixes and
   shortens them until two texts at the threshold meet in some tree with the
   target probability.  In each trie node (bucket) every pair counts that a
   sketch does not rule out.  Members next to the bucket's leader are settled by
   a tie to it (see ``_tied``); the rest is compared pair by pair but where ties
   connect it already, and only a spanning forest of its pairs becomes ties.
3. Ties make candidate groups.  Inside a group all pairs are verified on their
   full shingle sets, by blocks of BLOCK texts or HASHES shingles, with counts of common shingles
   from matrix products; a block pair emits the number of links of each text
   and a spanning forest, so rows stay linear in the group for each block.
4. Verified links make the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbara.llm.common import Words, discard, mix, rolling, slices, small, stored, table

SHINGLE = 5  #: words of a shingle; a shorter text is one shingle
NUMERATOR, DENOMINATOR = 4, 5  #: least Jaccard similarity, as a fraction
TREES, DEPTH = 16, 8
#: Least probability that a pair at the threshold meets in some tree.
RECALL = 0.9995
#: A sketch rules a pair out below this share of equal hashes (of SKETCH): about
#: four standard errors under the threshold.
SKETCH, RULED_OUT = 64, 0.6
#: Sketch hashes in which a pair of texts may differ, and a settled member from its leader.
APART, NEXT = int((1 - RULED_OUT) * SKETCH), 8
#: Leaders that a bucket has one after the other before its rest is compared pair by pair, and texts of a block of the rest.
ROUNDS, REST = 2, 4096
#: Texts of a block, and shingles of a block beyond which it is cut (one text stays whole).
BLOCK, HASHES = 1000, 1_000_000
SMALL = 300_000


def depths(threshold: float = NUMERATOR / DENOMINATOR, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> list[int]:
    """Prefix lengths from the longest down to the first that meets the target recall."""
    out = []
    for d in range(depth, 0, -1):
        out.append(d)
        if 1 - (1 - threshold**d) ** trees >= recall:
            break
    # The longest, the shortest and one between serve all: a bucket's members
    # share the shorter prefixes as well.
    return sorted({out[0], out[len(out) // 2], out[-1]}, reverse=True)


def shingle_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a slice of texts, in order, and where each text's begin (with the end)."""
    counts = w.counts()
    h = rolling(w.hash, SHINGLE)
    valid = w.doc[: len(h)] == w.doc[SHINGLE - 1 :] if len(h) else np.zeros(0, bool)
    long, doc = h[valid], w.doc[: len(h)][valid]
    brief = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(brief):
        whole = np.array([sequence_hash(w.hash[w.first[i] : w.first[i + 1]]) for i in brief], np.uint64)
        long, doc = np.concatenate([long, whole]), np.concatenate([doc, brief])
        order = np.argsort(doc, kind="stable")
        long, doc = long[order], doc[order]
    return long, np.searchsorted(doc, np.arange(w.docs + 1))


def sequence_hash(h: np.ndarray, seed: int = 0) -> np.uint64:
    at = mix(np.arange(1, len(h) + 1, dtype=np.uint64) + np.uint64(seed << 32))
    return mix((mix(h ^ at) * (at | np.uint64(1))).sum(dtype=np.uint64, keepdims=True))[0]


_A = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix(np.arange(1001, TREES * DEPTH + 1001, dtype=np.uint64))


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minimum hashes, one row for each text that has shingles; at: their beginnings."""
    out = np.empty((len(at), TREES * DEPTH), np.uint64)
    for j in range(TREES * DEPTH):
        out[:, j] = np.minimum.reduceat((h ^ _B[j]) * _A[j], at)
    return out


def _signed(base: DataFrame) -> DataFrame:
    """_d, _key, node, n (shingles), k<depth> (bucket key of each tree), sketch; texts without words have a null node."""
    levels = depths()
    schema = f"_d {base.schema['_d'].dataType.simpleString()}, _key long, node long, n int, " + ", ".join(f"k{d} array<long>" for d in levels) + ", sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_t"):
                w = Words(part.column("_t"))
                h, first = shingle_hashes(w)
                has = np.flatnonzero(np.diff(first) > 0)
                sig = signatures(h, first[has]) if len(has) else np.zeros((0, TREES * DEPTH), np.uint64)
                node = np.zeros(w.docs, np.int64)
                node[has] = [sequence_hash(w.hash[w.first[i] : w.first[i + 1]], 3).view(np.int64) for i in has]
                row = np.full(w.docs, -1)
                row[has] = np.arange(len(has))
                take = pa.array(row, pa.int64(), mask=row < 0)
                cols = [part.column("_d"), part.column("_key"), pa.array(node, pa.int64(), mask=row < 0), pa.array(np.diff(first), pa.int32())]
                tree = sig.reshape(len(has), TREES, DEPTH)
                for d in levels:
                    k = np.broadcast_to(mix(np.arange(TREES, dtype=np.uint64) * np.uint64(64) + np.uint64(d)), (len(has), TREES))
                    for j in range(d):
                        k = mix(k * np.uint64(31) ^ tree[:, :, j])
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(k).view(np.int64).ravel(), pa.int64()), TREES).cast(pa.list_(pa.int64()))
                    cols.append(lists.take(take))
                low = (sig[:, :: TREES * DEPTH // SKETCH] >> np.uint64(20)).astype(np.uint16)
                cols.append(pa.array([None if r < 0 else low[r].tobytes() for r in row], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["_d", "_key", "node", "n", *[f"k{d}" for d in levels], "sketch"])

    return base.mapInArrow(run, schema)


def components(edges: DataFrame, label: str) -> DataFrame:
    """node, label (smallest node reached) of all nodes of undirected ``edges`` (a, b).

    Every node points to its smallest neighbour, pointers are followed to their
    end, and edges are put between the ends; what lies in one component is an
    edge no more, so rows shrink from round to round until none is left.
    """
    ends = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    left, out = stored(edges.select(*ends("a", "b")).filter("a <> b").distinct(), f"{label}-edges"), None
    while True:
        to = left.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(left.select(F.col("b").alias("node"), F.col("b").alias("label")))
        labels = stored(to.groupBy("node").agg(F.min("label").alias("label")), f"{label}-labels")
        while True:
            jump = labels.select(F.col("node").alias("was"), F.col("label").alias("further"))
            after = stored(labels.withColumnRenamed("label", "was").join(jump, "was").select("node", "was", F.col("further").alias("label")), f"{label}-labels")
            discard(labels)
            labels = after.select("node", "label")
            if not after.filter("was <> label").limit(1).count():
                break
        out = labels if out is None else stored(_followed(out, labels), f"{label}-labels")
        at, bt = (labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}t")) for x in ("a", "b"))
        after = stored(left.join(at, "a").join(bt, "b").select(*ends("at", "bt")).filter("a <> b").distinct(), f"{label}-edges")
        discard(left)
        left = after
        if not left.limit(1).count():
            return out


def _followed(labels: DataFrame, further: DataFrame) -> DataFrame:
    """Labels (node, label) with the label that ``further`` has for theirs, if it has one."""
    to = further.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return labels.join(to, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))


def _apart(ties: DataFrame) -> DataFrame:
    """Ties a, b with the number of hashes (apart) in which their sketches sa, sb differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SKETCH) for c in ("sa", "sb"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x != y).sum(1), pa.int32())], names=["a", "b", "apart"])

    return ties.mapInArrow(run, "a long, b long, apart int")


def _forest(x: np.ndarray, y: np.ndarray, same: bool, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of rows of x and y whose sketches differ in at most APART hashes; same: y is x.

    label: rows of one label, first those of x, need no connection.
    """
    n = len(x) + (0 if same else len(y))
    root = np.arange(n)
    if label is not None:
        _, first, of = np.unique(label, return_index=True, return_inverse=True)
        root = first[of]
    most = max(1, (2 << 20) // max(1, len(y)))
    found: tuple[list, list] = ([], [])
    for lo in range(0, len(x), most):
        part = x[lo : lo + most]
        if len(part) * len(y) <= 4096:  # most buckets are small
            equal = (part[:, None] == y[None]).sum(2)
        else:
            equal = np.zeros((len(part), len(y)), np.uint8)
            for j in range(SKETCH):
                equal += part[:, j, None] == y[None, :, j]
        if same:
            equal = np.triu(equal, lo + 1)
        i, k = np.nonzero(equal >= SKETCH - APART)
        i, k = i + lo, k if same else k + len(x)
        while len(i):  # in each round the smallest root around joins a root
            i, k = i[(open_ := root[i] != root[k])], k[open_]
            if not len(i):
                break
            high, low = np.maximum(root[i], root[k]), np.minimum(root[i], root[k])
            one = np.unique(high, return_index=True)[1]
            found[0].append(i[one])
            found[1].append(k[one])
            up = np.arange(n)
            up[high[one]] = low[one]
            while not (up[up] == up).all():
                up = up[up]
            root = up[root]
    return tuple(np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64) for v in found)


def _rest_ties(rest: DataFrame, sketch: DataFrame) -> DataFrame:
    """Ties a, b of labels that connect the similar pairs of every bucket of ``rest`` (node, k, label), all compared, by blocks of REST texts.

    Buckets of one label are connected already.
    """
    mark = F.xxhash64("node")
    sets = rest.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.shiftright(mark, 24)).alias("f"), F.bit_xor(mark).alias("g"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    once = sets.groupBy("n", "f", "g").agg(F.min("k").alias("k"))  # buckets of the same texts are compared once
    blocks = F.ceil(F.col("n") / REST).cast("int")
    member = rest.join(once.select("k", blocks.alias("nb")), "k").withColumn("side", F.pmod(F.xxhash64("node"), "nb").cast("int"))
    member = member.withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("nb") - 1)))
    member = member.select("k", "node", "label", "side", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj")).join(sketch, "node")
    bin_ = F.when(F.col("bi") + F.col("bj") > 0, F.col("k")).otherwise(F.pmod(F.xxhash64("k"), F.lit(4096)))

    def run(data: pa.Table) -> pa.Table:
        k, label, side = (data.column(c).to_numpy() for c in ("k", "label", "side"))
        sk = np.frombuffer(b"".join(data.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
        across = data.column("bi")[0].as_py() != data.column("bj")[0].as_py()
        order = np.argsort(k, kind="stable")
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own in np.split(order, np.flatnonzero(np.diff(k[order])) + 1):
            if across:
                x, y = own[side[own] == side[own].min()], own[side[own] == side[own].max()]
                if (side[own] == side[own][0]).all():
                    continue
            else:
                x = y = own
            every = x if not across else np.concatenate([x, y])
            i, j = _forest(sk[x], sk[y], not across, label[every])
            a.append(label[every[i]])
            b.append(label[every[j]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return member.withColumn("bin", bin_).groupBy("bin", "bi", "bj").applyInArrow(run, "a long, b long")


def _tied(keys: DataFrame, sketch: DataFrame) -> DataFrame:
    """Ties a, b that connect every pair of the buckets k whose sketches differ in at most APART hashes: of each node to the smallest it reaches.

    In each round the smallest node of a bucket leads, so a large group of
    similar texts has few leaders over all its buckets, and few distinct ties.
    A member that differs from the leader in at most NEXT hashes is settled.
    Whatever differs from it in at most APART then differs from the leader in at
    most APART + NEXT, for differences obey the triangle inequality; all these
    are tied to the leader, and no pair of a settled member is lost.  Members
    that are not settled stay, and after ROUNDS rounds all their pairs are
    compared but those that the ties connect already.
    """
    ties, left = None, keys
    for _ in range(ROUNDS):
        lead = left.groupBy("k").agg(F.min("node").alias("b"), F.max("node").alias("hi")).filter("b <> hi").select("k", "b")
        met = stored(left.join(lead, "k").filter("node <> b"), "met")
        pairs = met.select(F.col("node").alias("a"), "b").distinct()
        pairs = pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        good = stored(_apart(pairs.select("a", "b", "sa", "sb")).filter(F.col("apart") <= APART + NEXT), "ties")
        near = good.select("a", "b")
        ties = near if ties is None else ties.unionByName(near)
        settled = good.filter(F.col("apart") <= NEXT).select(F.col("a").alias("node"), "b")
        left = stored(met.join(settled, ["node", "b"], "left_anti").select("node", "k"), "left")
        if not left.limit(1).count():
            return _star(components(ties, "candidates"))
    labels = components(ties, "candidates")
    known = labels.select(F.col("node").alias("_n"), "label")
    rest = stored(left.join(known, F.col("node") == F.col("_n"), "left").select("node", "k", F.coalesce("label", "node").alias("label")), "open")
    further = components(stored(_rest_ties(rest, sketch), "rest"), "rest")
    alone = further.join(labels.select("node"), "node", "left_anti")
    return _star(stored(_followed(labels, further).unionByName(alone), "candidates"))


def _star(labels: DataFrame) -> DataFrame:
    """Edges a, b from every other node to its label."""
    return labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))


def _linked(sets: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix of the pairs whose sets meet the threshold."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    common = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[0], np.diff(column) != 0]))
        for lo in range(0, int(column[-1]) + 1, 2048):
            a, b = np.searchsorted(column, [lo, lo + 2048])
            m = np.zeros((n, min(2048, int(column[-1]) + 1 - lo)), np.float32)
            m[owner[a:b], column[a:b] - lo] = 1
            common += m @ m.T
    inter = common.astype(np.int64)
    ok = (NUMERATOR + DENOMINATOR) * inter >= NUMERATOR * (size[:, None] + size[None, :])
    np.fill_diagonal(ok, False)
    return ok


def _verified(member: DataFrame) -> DataFrame:
    """node, root, links (weighted) by block pair; rows of ``member``: node, weight, side, comp, bi, bj, h."""

    def run(data: pa.Table) -> pa.Table:
        comp, node, weight, side = (data.column(c).to_numpy() for c in ("comp", "node", "weight", "side"))
        lists = data.column("h").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        flat, off = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        _, keep = np.unique(node, return_index=True)  # repeated rows of one document
        across = data.column("bi")[0].as_py() != data.column("bj")[0].as_py()
        order = keep[np.argsort(comp[keep], kind="stable")]
        nodes, roots, links = [], [], []
        for own in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            ok = _linked([flat[off[i] : off[i + 1]] for i in own])
            # Between two blocks only pairs across count; pairs inside a block have their own task.
            counted = ok & (side[own][:, None] != side[own][None, :]) if across else ok
            links.append(counted @ weight[own])
            ids = node[own]
            root = ids.copy()
            while True:
                low = np.minimum(root, np.where(counted, root[None, :], np.iinfo(np.int64).max).min(1))
                if (low == root).all():
                    break
                root = low
            nodes.append(ids)
            roots.append(root)
        return pa.table({"node": np.concatenate(nodes), "root": np.concatenate(roots), "links": np.concatenate(links).astype(np.int64)})

    return member.groupBy("bin", "bi", "bj").applyInArrow(run, "node long, root long, links long")


def similar_classes(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc, _key, class_id (smallest doc of the class), class_size, n_links, head and head_key.

    head and head_key are doc and _key of the smallest row of the class; class_id is head but where that is null.

    Two documents are linked if the Jaccard similarity of their sets of
    SHINGLE-word shingles is at least NUMERATOR / DENOMINATOR; classes are the
    connected components.  n_links counts all other documents linked to a row,
    copies included.  Null and empty texts have no shingles and no links.
    Nodes are 64-bit hashes of word sequences.
    """
    base = docs.select(F.col(doc).alias("_d"), F.xxhash64(doc, text).alias("_key"), F.coalesce(text, F.lit("")).alias("_t"))
    signed = stored(_signed(base), "signatures")
    levels = depths()
    # Rows equal in document and text are one document for classes, but count as copies.
    groups = stored(signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("weight"), F.min(F.struct("_d", "_key")).alias("rep")), "nodes")
    reps = signed.join(groups.select(F.col("node").alias("g"), "rep", "weight"), (F.col("node") == F.col("g")) & (F.col("_key") == F.col("rep._key")) & F.col("_d").eqNullSafe(F.col("rep._d")))
    reps = stored(reps.drop("g", "rep"), "reps")
    # Trees in which a text shares no shortest prefix end here; keys of all depths are different buckets.
    zipped = F.arrays_zip(*[f"k{d}" for d in levels])
    keys = reps.select("node", F.explode_outer(zipped).alias("z")).select("node", *[F.col("z").getField(f"k{d}").alias(f"k{d}") for d in levels])
    short = f"k{levels[-1]}"
    shared = keys.groupBy(short).agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select(short)
    shared = stored(keys.join(shared, short), "shared")
    ties = _tied(shared.select("node", F.explode_outer(F.array(*[f"k{d}" for d in levels])).alias("k")), reps.select("node", "sketch"))
    candidates = stored(ties.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(ties.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), "candidates")
    member_of = stored(candidates.select("node", F.col("label").alias("comp")).join(reps.select("node", "_d", "_key", "weight", "n").distinct(), "node"), "groups")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / HASHES)).cast("int")
    chosen = stored(member_of.join(member_of.groupBy("comp").agg(blocks.alias("nb")), "comp"), "chosen")
    total = chosen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bins = max(1, int(total[0] // 500_000), int(total[1] // 500))
    texts = base.join(small(chosen.withColumnsRenamed({"_d": "_e", "_key": "_f"}), SMALL), (F.col("_key") == F.col("_f")) & F.col("_d").eqNullSafe(F.col("_e")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_t"):
                h, first = shingle_hashes(Words(part.column("_t")))
                own = [np.unique(h[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:])]
                off = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("node", "weight", "comp", "nb")], lists], names=["node", "weight", "comp", "nb", "h"])

    shingled = texts.select("node", "weight", "comp", "nb", "_t")
    sized = shingled.mapInArrow(sets, "node long, weight long, comp long, nb int, h array<long>")
    member = sized.withColumn("side", F.pmod(F.xxhash64("node"), "nb").cast("int"))
    member = member.withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("nb") - 1)))
    member = member.select(
        "node", "weight", "side", "comp", "h", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"),
        F.when(F.col("nb") > 1, F.col("comp")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(bins))).alias("bin"))
    checked = stored(_verified(member), "verified")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")
    found = links.join(classes, "node", "left")
    node = groups.join(found.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left").select(
        "node", "weight", F.coalesce("label", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), "rep")
    node = stored(node, "classed")
    for t in (groups, reps, shared, member_of, chosen, checked, candidates, classes):
        discard(t)
    heads = node.groupBy("class").agg(F.min("rep").alias("head"), F.sum("weight").alias("class_size"))
    full = node.join(heads, "class").select(F.col("node").alias("g"), F.col("head._d").alias("class_id"), F.col("head._key").alias("head_key"), "class_size", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    out = signed.select("_d", "_key", "node").join(full, F.col("node") == F.col("g"), "left")
    return out.select(
        F.col("_d").alias(doc), "_key", F.coalesce("class_id", F.col("_d")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("g").isNull(), F.col("_d")).otherwise(F.col("class_id")).alias("head"), F.coalesce("head_key", "_key").alias("head_key"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


#: Exact links by a join on shingles; the forest meets it but for its target recall.
OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
      UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
k AS (SELECT doc_id, min(c) AS class_id FROM r GROUP BY doc_id),
m AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT k.doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, coalesce(n_links, 0) AS n_links FROM k LEFT JOIN m USING (doc_id)
"""
