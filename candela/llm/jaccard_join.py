"""Exact near-duplicate groups by Jaccard similarity of word shingles.

Two documents link when the shingle sets' intersection holds at least 80 % of their union. Groups are the connected components of links.

1. Equal sets are one node from the start, so copies cost nothing further.
2. Two linked sets share a shingle in their prefixes: the 20 % that come first in an order common to all sets, here by how many nodes
   hold a shingle, rare ones first. A set whose prefix is filled by shingles of its own can link with none and is done. Nodes that share
   a prefix shingle are joined to coarse groups; no link leaves its coarse group.
3. In a coarse group, shingles are hashed to classes, and a set is the point of its class counts. An R-tree over the points bounds the
   overlap of two boxes, and of two sets, by the sum of the smaller coordinates. Only pairs that could still link, and are not in one
   component already, are verified on their whole sets. Large coarse groups are cut into blocks, and each pair of blocks is one task.
4. Each task returns a spanning forest of its links, never all pairs; the forests' components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.columns import packed, quoted, unpacked
from candela.llm.hashing import mixed, portions, shingle_hashes, word_hashes
from candela.llm.registry import query, table
from candela.session import checkpointed, discard

WORDS = 5
NEEDED, OF = 80, 100  # link: OF * intersection >= NEEDED * union
CLASSES = 256  # coordinates of a set's point
LEAF = 16  # points in a leaf, and boxes in a node, of the tree
BLOCK_SETS, BLOCK_SHINGLES = 500, 2_000_000  # size of a block of a coarse group
LONGEST_RUN = 1_000_000  # a shingle of more nodes counts as held by so many in all its rows: the order stays common to all sets
SMALL = 500_000  # so many rows of tasks (some 25 MB) are broadcast; beyond, texts and nodes are both shuffled


def arrow_batches(spark: SparkSession, rows: int) -> None:
    """Rows that go to a Python task at once, from the next job on: few for texts, many for numbers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def sets_of(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z lower-cased; null: none)."""
    texts = ["" if t is None else t for t in texts]
    out = []
    for part in portions(texts):
        found, firsts = word_hashes(texts[part])
        hashes, at = shingle_hashes(found, firsts, words)
        out += [np.unique(hashes[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
    return out


def set_key(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def node_of(key: bytes | None) -> int | None:
    """A node's number: half of its set's digest."""
    return None if key is None else int.from_bytes(key[:8], "little", signed=True)


def prefix_length(n: np.ndarray) -> np.ndarray:
    """How many first shingles of a set of n any linked set must meet: n less the least overlap, and one more."""
    return n + (-n * NEEDED) // OF + 1


def keyed_sets(docs: DataFrame) -> DataFrame:
    """``_id`` as it is, ``n_shingles`` and ``node`` (null for an empty set) of each row of ``_id``, ``_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sets_of(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([node_of(set_key(s)) for s in found], pa.int64()),
                ],
                names=["_id", "n_shingles", "node"],
            )

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_text").mapInArrow(run, f"_id {kind}, n_shingles long, node long")


def shingle_rows(docs: DataFrame, bits: int) -> DataFrame:
    """``shingle`` (cut to ``bits`` bits), ``node``, ``n`` (the set's size): a row for each element of each set."""
    keep = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for s in sets_of(batch.column("_text").to_pylist()) if len(s)]
            nodes = pa.array([node_of(set_key(s)) for s in found], pa.int64())
            cut = [s & keep for s in found]
            flat = np.concatenate(cut) if cut else np.zeros(0, np.uint64)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in cut])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [nodes, pa.array([len(s) for s in found], pa.int32()), lists], names=["node", "n", "shingles"]
            )

    made = docs.select("_text").mapInArrow(run, "node long, n int, shingles array<long>")
    return made.select(F.explode("shingles").alias("shingle"), "node", "n")


def _distinct(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """Sorted batches without the rows that equal the row before them in the keys, be it in an earlier batch."""
    last: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = last is None or any(v[0] != x for v, x in zip(values, last, strict=True))
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        last = [v[-1] for v in values]
        yield batch.filter(pa.array(new))


def _runs(batches: Iterator[pa.RecordBatch], key: str, longest: int | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches regrouped so that no run of equal keys is cut. With ``longest``, a run of more rows comes in several parts, the
    first of which has at least so many rows."""
    held: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        for name in batch.schema.names:
            held.setdefault(name, []).append(batch.column(name).to_numpy(zero_copy_only=False))
        last = held[key][-1]
        if last[0] == last[-1] and held[key][0][0] == last[-1] and (longest is None or sum(map(len, held[key])) < longest):
            continue
        whole = {name: np.concatenate(parts) for name, parts in held.items()}
        cut = int(np.searchsorted(whole[key], whole[key][-1]))
        cut = len(whole[key]) if cut == 0 else cut
        yield {name: part[:cut] for name, part in whole.items()}
        held = {name: [part[cut:]] for name, part in whole.items()} if cut < len(whole[key]) else {}
    if held:
        yield {name: np.concatenate(parts) for name, parts in held.items()}


def _shared(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle and node: each (shingle, node) once with ``held``, how many nodes hold the shingle, if two or more do.

    ``held`` is ``longest`` for all rows of a shingle that so many nodes or more hold, so that every node orders a shingle alike.
    """
    common = None  # the last shingle of the part before, if it is held by the longest number: its other nodes may follow
    for run in _runs(_distinct(batches, "shingle", "node"), "shingle", longest):
        s, node, n = run["shingle"], run["node"], run["n"]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        rows = np.diff(np.concatenate([starts, [len(s)]]))
        held = np.minimum(rows, longest)
        if s[0] == common:
            held[0] = longest
        common = s[-1] if held[-1] == longest else None
        held = np.repeat(held, rows)
        keep = held >= 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[keep]) for x in (s, node, n)] + [pa.array(held[keep].astype(np.int32))],
            names=["shingle", "node", "n", "held"],
        )


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node, ``held`` and shingle: those in the node's prefix. Shingles of its own, which have no row, come first.

    A node's rows are never cut: they are at most the set of one text, which was held whole to make them."""
    for run in _runs(batches, "node"):
        node, n = run["node"], run["n"].astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        rows = np.diff(np.concatenate([starts, [len(node)]]))
        place = np.arange(len(node)) - np.repeat(starts, rows) + n - np.repeat(rows, rows)
        keep = place < prefix_length(n)
        yield pa.RecordBatch.from_arrays([pa.array(run["shingle"][keep]), pa.array(node[keep])], names=["shingle", "node"])


def coarse_pairs(docs: DataFrame, total: int) -> DataFrame:
    """``a``, ``b``: each node with the least node that has one of its prefix shingles, as a stored table. ``total``: how many shingles all sets hold.

    Shingles are cut to a few bits more than their number needs; a clash of two can only add a candidate.
    """
    bits = min(64, ceil(log2(max(total, 2))) + 12)
    rows = shingle_rows(docs, bits).repartition("shingle").sortWithinPartitions("shingle", "node")
    shared = rows.mapInArrow(partial(_shared, longest=LONGEST_RUN), "shingle long, node long, n int, held int")
    ordered = shared.repartition("node").sortWithinPartitions("node", "held", "shingle")
    prefixes = checkpointed(ordered.mapInArrow(_prefixes, "shingle long, node long"))
    # A shingle of many nodes is a skewed key of this join, which the planner can split; its least node is a sum with map-side combine.
    # Written first, so that both sides of the join are shuffled for it alone.
    least = checkpointed(prefixes.groupBy("shingle").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("m")).filter("m > 1"))
    pairs = prefixes.join(least.select("shingle", "b"), "shingle").filter("node <> b")
    stored = checkpointed(pairs.select(F.col("node").alias("a"), "b").distinct())
    discard(prefixes, least)
    return stored


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node it is connected to, for each node of the pairs (a, b).

    Every round takes the least label of all neighbours, then the label's own label; rounds end when no label changes. Tables between
    rounds are written to the shared folder.
    """
    both = checkpointed(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    known = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    changed = True
    while changed:
        labels = known.select("node", "label")
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen, labels.node == seen.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = lower.join(above, "label").select("node", "old", F.least("label", "above").alias("label"))
        made = checkpointed(jumped)
        changed = made.filter("label <> old").limit(1).count() > 0
        discard(known)
        known = made
    discard(both)
    return known.select("node", "label")


class CountTree:
    """An R-tree over the class counts of sets. A box keeps the largest count of each class, and the least and largest set size in it:
    with them it bounds the overlap of any set inside from above. Sets of like size and like counts stand side by side."""

    def __init__(self, sets: list[np.ndarray], classes: int = CLASSES, leaf: int = LEAF):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        points = np.array([np.bincount((mixed(s) % np.uint64(classes)).astype(np.int64), minlength=classes) for s in sets])
        kind = np.uint8 if points.max() < 256 else np.uint16 if points.max() < 65536 else np.int64
        top = np.argsort(-points, axis=1, kind="stable")[:, 0]
        self.order = np.lexsort((top, self.sizes))
        self.leaf = leaf
        self.levels = [(points[self.order].astype(kind), self.sizes[self.order], self.sizes[self.order])]
        while len(self.levels[-1][0]) > 1:
            high, least, most = self.levels[-1]
            at = np.arange(0, len(high), leaf)
            self.levels.append(
                (np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at))
            )

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which box pairs may hold a linked pair, and the bound of the overlap."""
        high, least, most = self.levels[level]
        overlap = np.zeros(len(a), dtype=np.int64)
        fits = (most[a] * OF >= least[b] * NEEDED) & (most[b] * OF >= least[a] * NEEDED)
        for part in np.array_split(np.flatnonzero(fits), max(1, len(a) // 20_000)):
            overlap[part] = np.minimum(high[a[part]], high[b[part]]).sum(axis=1, dtype=np.int64)
        return fits & (overlap * (OF + NEEDED) >= NEEDED * (least[a] + least[b])), overlap

    def pairs(self) -> Iterator[tuple[int, int, int]]:
        """(bound, x, y) of all pairs of different sets whose bound lets them link, the highest bound first."""
        a = b = np.zeros(1, dtype=np.int64)
        for level in range(len(self.levels) - 2, -1, -1):
            n = len(self.levels[level][0])
            found = []
            for k in range(0, len(a), 2048):  # children of some pairs of boxes at a time
                x, y = a[k : k + 2048], b[k : k + 2048]
                child = np.arange(self.leaf)
                left = (x[:, None] * self.leaf + child)[:, :, None]
                right = (y[:, None] * self.leaf + child)[:, None, :]
                left, right = (v.ravel() for v in np.broadcast_arrays(left, right))
                use = (left < n) & (right < n) & ((left < right) if level == 0 else (left <= right))
                left, right = left[use], right[use]
                may, overlap = self._possible(level, left, right)
                found.append((left[may], right[may], overlap[may]))
            a, b, bound = (np.concatenate(v) for v in zip(*found, strict=True))
        if len(self.levels) > 1:
            for k in np.argsort(-bound, kind="stable"):
                yield int(bound[k]), int(self.order[a[k]]), int(self.order[b[k]])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets link, by their exact intersection."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * OF >= NEEDED * (len(x) + len(y) - both)


def forest(sets: list[np.ndarray], side: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with ``side``, of the links between different sides only."""
    above = list(range(len(sets)))

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    out = []
    for _, x, y in CountTree(sets).pairs() if len(sets) > 1 else ():
        if side is not None and side[x] == side[y]:
            continue
        rx, ry = root(x), root(y)
        if rx != ry and linked(sets[x], sets[y]):
            above[rx] = ry
            out.append((x, y))
    return out


def _task_forest(rows: pa.Table) -> pa.Table:
    """Links of the coarse groups of one task; rows whose text has another set than their node are not asked for and go."""
    cells = rows.select(["label", "node", "block", "_text"]).to_pylist()
    across = rows.column("_i")[0].as_py() != rows.column("_j")[0].as_py()
    groups: dict[int, dict[int, tuple[np.ndarray, int]]] = {}
    for k in range(0, len(cells), 256):
        some = cells[k : k + 256]
        for cell, found in zip(some, sets_of([c["_text"] for c in some]), strict=True):
            if node_of(set_key(found)) == cell["node"]:
                groups.setdefault(cell["label"], {})[cell["node"]] = (found, cell["block"])
    a, b = [], []
    for group in groups.values():
        nodes = sorted(group)
        sides = [group[n][1] for n in nodes] if across else None
        for x, y in forest([group[n][0] for n in nodes], sides):
            a.append(nodes[x])
            b.append(nodes[y])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links(docs: DataFrame, keyed: DataFrame, coarse: DataFrame) -> DataFrame:
    """``a``, ``b``, as a stored table: links that join all nodes of each group, from the coarse groups (node, label) and the texts of their nodes."""
    need = keyed.join(coarse, "node").groupBy("node", "label").agg(F.min("_id").alias("_rep"), F.first("n_shingles").alias("n"))
    need = checkpointed(need)
    sizes = need.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    sized = need.join(sizes.select("label", blocks.alias("blocks")), "label")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    n = need.count()
    bins = max(1, ceil(n / BLOCK_SETS))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = sized.withColumn("block", block).select("*", others.alias("_other")).select(
        "node", "label", "block", "_rep",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(F.col("label")).alias("_task"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.least("block", "_other")).alias("_i"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.greatest("block", "_other")).alias("_j"),
    )
    copied = sizes.agg(F.sum(F.col("m") * blocks)).first()[0] or 0  # rows of tasks: each node with each block of its group
    if copied <= SMALL:
        tasks = F.broadcast(tasks)
    texts = docs.select("_id", "_text").join(tasks, F.col("_id").eqNullSafe(F.col("_rep")))
    keys = ["_task", "_i", "_j"]
    found = texts.select(*keys, "label", "node", "block", "_text").groupBy(*keys).applyInArrow(_task_forest, "a long, b long")
    stored = checkpointed(found)
    discard(need)
    return stored


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the key, ``n_shingles``, ``node`` (equal for equal sets, null for empty ones), ``group`` (equal
    for rows that links connect) and ``component_id``, the least key of the group.

    A text with fewer than five words has one shingle, the whole of it. Null texts and texts without words have none, link with nothing
    and are alone: their component is their own key. Null keys are never the least unless a group has no other; repeated rows each have
    a row, in one group; an empty table gives an empty result. Other columns are not used.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(quoted(key)).alias("_id"), F.col(quoted(text)).alias("_text"))
    arrow_batches(spark, 1024)
    keyed = checkpointed(keyed_sets(rows))
    total = keyed.agg(F.sum("n_shingles")).first()[0] or 0
    arrow_batches(spark, 8192)
    pairs = coarse_pairs(rows, total)
    coarse = components(pairs)
    joined = links(rows, keyed, coarse)
    labels = components(joined)
    discard(pairs, joined)
    nodes = keyed.filter("node IS NOT NULL").groupBy("node").agg(F.min("_id").alias("_least"))
    grouped = nodes.join(labels, "node", "left").select("node", "_least", F.coalesce("label", "node").alias("group"))
    least = grouped.groupBy("group").agg(F.min("_least").alias("component_id"))
    known = grouped.select("node", "group").join(least, "group").withColumnRenamed("node", "_n")
    full = keyed.filter("node IS NOT NULL").join(known, F.col("node") == F.col("_n")).drop("_n")
    alone = keyed.filter("node IS NULL").select("*", F.lit(None).cast("long").alias("group"), F.col("_id").alias("component_id"))
    columns = [F.col("_id").alias(key), "n_shingles", "node", "group", "component_id"]
    return full.select(*columns).unionByName(alone.select(*columns))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each group: that with the least key. Rows without words all stay. All columns are kept.

    If several rows of a group have that key, one of them stays; in a group of null keys only, one.
    """
    names = docs.columns
    marked = near_groups(docs, key, text).filter("node IS NOT NULL")
    chosen = marked.filter(F.col(quoted(key)).eqNullSafe(F.col("component_id")))
    chosen = chosen.groupBy("group").agg(F.min("node").alias("_node"), F.first("component_id").alias("_key")).select("_node", "_key")
    arrow_batches(docs.sparkSession, 1024)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([node_of(set_key(s)) for s in sets_of(texts.to_pylist())], pa.int64())

    node = F.arrow_udf(run, "long")
    rows = packed(docs, node(F.col(quoted(text))).alias("_n"), F.col(quoted(key)).alias("_k"))
    kept = rows.filter("_n IS NOT NULL").join(chosen, F.col("_n") == F.col("_node")).filter(F.col("_k").eqNullSafe(F.col("_key")))
    kept = kept.dropDuplicates(["_n"])
    return unpacked(kept.select("_input_row").unionByName(rows.filter("_n IS NULL").select("_input_row")), names, [])


@query("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_groups(docs).select("doc_id", "n_shingles", "component_id")
