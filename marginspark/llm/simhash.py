"""Near-duplicates by SimHash fingerprints, found through BK-trees.

A text's fingerprint is the bitwise majority over the 64-bit hashes of its word
shingles.  Texts are linked when their fingerprints differ in at most ``radius``
bits; a class is what links connect.

1. Fingerprints are made in the scan.  From there on only distinct fingerprints
   are looked at, so exact copies cost one fingerprint, however many there are.
2. A fingerprint is cut into ``radius + agree`` bands.  Fingerprints within the
   radius agree in ``agree`` bands at least, so the values of each choice of
   ``agree`` bands are buckets in which all partners meet.  One suits some ten
   million distinct fingerprints, three (20 choices of 30 bits or more) some
   ten milliards; the classes are the same.
3. A bucket is dealt by a hash into shards of about ``SHARD`` fingerprints.
   Each shard builds one BK-tree: children keyed by their integer distance to
   the parent.  All fingerprints of the bucket are looked up in all its shard
   trees, following only the edges that the radius allows.  A task grows the
   trees of many small buckets side by side; a large bucket is spread over
   pairs of its shards, so no bucket is too large for a task.
4. A shard sends one link per fingerprint and class met in its tree, not one
   per pair; classes grow from these by smallest-label rounds on stored tables.

The trees are sent to the tasks by the shuffle rather than as broadcasts, since
a broadcast of all trees would grow with the input.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; shorter texts than a shingle give one shingle; repeated rows and
repeated ids share a class; an empty table gives an empty result; columns of
the input named like result columns give way to them.  Ids may be null: a null
is smaller than nothing, so it names a class only where all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginspark.llm.batches import slices, text_batches
from marginspark.llm.columns import boxed, unboxed
from marginspark.llm.components import connected
from marginspark.workspace import Workspace

#: Words of a shingle, bits by which linked fingerprints may differ.
SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints of one tree, about.
SHARD = 4096
_LINKS = "a long, b long"


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Only A-Z are lowered and only ASCII white space parts words: both are
    what the methods of bytes do."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    runs = [w[i:] for i in range(min(shingle, len(w)))]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(b" ".join(run), SEED) for run in zip(*runs)), np.uint64
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The other columns of ``docs`` boxed as ``doc``, and ``fp`` (the 64 bits
    as a signed long)."""
    boxes = docs.select(
        boxed(docs, text, "fingerprint", "component_id").alias("doc"),
        docs[f"`{text}`"].cast("string").alias("_t"),
    )
    schema = T.StructType([boxes.schema["doc"], T.StructField("fp", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "_t"):
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(found.view(np.int64))], ["doc", "fp"]
            )

    return boxes.mapInArrow(scan, schema)


class BKForest:
    """BK-trees over distinct fingerprints, one per run of ``tree`` numbers,
    built and searched level by level with whole arrays.  Edges are kept sorted
    by ``node * 65 + distance``, so the children in a range of distances are
    one slice."""

    def __init__(self, values: np.ndarray, tree: np.ndarray) -> None:
        self.values = values
        names, self.root, own = np.unique(tree, return_index=True, return_inverse=True)
        self.names = names
        at = self.root[own]
        below = np.flatnonzero(at != np.arange(len(values)))
        at = at[below]
        edges, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(below):
            gap = np.bitwise_count(values[below] ^ values[at]).astype(np.int64)
            keys, first, group = np.unique(
                at * 65 + gap, return_index=True, return_inverse=True
            )
            heads = below[first]
            edges.append(keys)
            children.append(heads)
            stays = np.ones(len(below), bool)
            stays[first] = False
            at, below = heads[group][stays], below[stays]
        edge, child = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edge, kind="stable")
        self.edge, self.child = edge[order], child[order]

    def within(
        self, queries: np.ndarray, tree: np.ndarray, radius: int
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) numbers of all pairs within the radius, in portions;
        each query searches the tree of its number."""
        place = np.minimum(np.searchsorted(self.names, tree), max(len(self.names) - 1, 0))
        q = np.flatnonzero(self.names[place] == tree) if len(self.names) else place[:0]
        waiting = [(q, self.root[place[q]] if len(q) else q)]
        while waiting:
            q, node = waiting.pop()
            if len(q) > _FRONT:
                # Where all lie close together nearly all edges are followed.
                waiting += [(q[_FRONT:], node[_FRONT:]), (q[:_FRONT], node[:_FRONT])]
                continue
            gap = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            hit = gap <= radius
            if hit.any():
                yield q[hit], node[hit]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(gap - radius, 0))
            high = np.searchsorted(
                self.edge, node * 65 + np.minimum(gap + radius, 64), side="right"
            )
            many = high - low
            ends = np.cumsum(many)
            if len(ends) and ends[-1]:
                slot = np.arange(ends[-1]) + np.repeat(low - (ends - many), many)
                waiting.append((np.repeat(q, many), self.child[slot]))


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each member's smallest known fellow) after the links a - b."""
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not ((jump := new[new]) == new).all():
            new = jump
        if (new == label).all():
            break
        label = new
    return label


#: Queries that start together, and steps of a search taken at once.
_WALK = 1024
_FRONT = 16_384


def tree_links(
    values: np.ndarray, tree: np.ndarray, queries: np.ndarray, asked: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the radius connects inside each tree of
    ``values``, and between ``queries`` and the tree each is asked of: one per
    fingerprint and class at most."""
    forest = BKForest(values, tree)
    n = len(values)
    label = np.arange(n)
    for at in range(0, n, _WALK):
        part = slice(at, at + _WALK)
        for q, node in forest.within(values[part], tree[part], radius):
            label = _roots(label, q + at, node)
    inner = np.flatnonzero(label != np.arange(n))
    left, right = [values[inner]], [values[label[inner]]]
    for at in range(0, len(queries), _WALK):
        part = slice(at, at + _WALK)
        met = [np.zeros(0, np.int64)]
        for q, node in forest.within(queries[part], asked[part], radius):
            met.append(np.unique((q + at) * n + label[node]))
        pair = np.unique(np.concatenate(met))
        left.append(queries[pair // max(n, 1)])
        right.append(values[pair % max(n, 1)])
    return np.concatenate(left), np.concatenate(right)


def bands(fp: Column, radius: int, agree: int) -> Column:
    """(choice, value) for every choice of ``agree`` out of ``radius + agree``
    bands; the first bands take the bits that do not divide evenly."""
    count = radius + agree
    cuts = [64 * k // count for k in range(count + 1)]
    choices = []
    for k, chosen in enumerate(combinations(range(count), agree)):
        value, filled = F.lit(0).cast("long"), 0
        for c in chosen:
            size = cuts[c + 1] - cuts[c]
            bits = F.shiftrightunsigned(fp, cuts[c]).bitwiseAND((1 << size) - 1)
            value = value + F.shiftleft(bits, filled)
            filled += size
        choices.append(F.struct(F.lit(k).alias("k"), value.alias("v")))
    return F.array(*choices)


def links(
    prints: DataFrame, ws: Workspace, radius: int = RADIUS, shard: int = SHARD, agree: int = 1
) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints of ``prints(fp)`` that
    connect what the radius connects."""
    spread = prints.select("fp", F.explode(bands(F.col("fp"), radius, agree)).alias("at"))
    spread = spread.select("fp", "at.k", "at.v")
    sizes = spread.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    shards = F.ceil(F.col("n") / shard).cast("int")
    placed = spread.join(ws.save(sizes, "buckets"), ["k", "v"]).select(
        "fp", "k", "v",
        shards.alias("shards"),
        F.pmod(F.xxhash64("fp", F.lit(7)), shards).cast("int").alias("own"),
    )
    # A task's share is a tree and the queries of one shard: those of the tree's
    # own shard (they are its nodes), or those of a later shard.
    last = F.col("shards") - 1
    nodes = placed.select(
        "fp", "k", "v", F.col("own").alias("tree"), F.lit(True).alias("node"),
        F.explode(F.sequence(F.col("own"), last)).alias("part"),
    )
    asked = placed.where("own > 0").select(
        "fp", "k", "v", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("tree"),
        F.lit(False).alias("node"), F.col("own").alias("part"),
    )
    keys = ["k", "v", "tree", "part"]
    rows = nodes.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "fp")
    return rows.select(*keys, "fp", "node").mapInArrow(
        lambda batches: _search(batches, radius), _LINKS
    )


#: Rows whose trees a task grows side by side.
_GROVE = 16_384


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Complete runs of (k, v, tree, part) are searched together; a run has the
    rows of two shards at most."""
    held: list[np.ndarray] = []

    def grown(rows: np.ndarray) -> pa.RecordBatch:
        starts = np.ones(len(rows), bool)
        starts[1:] = (rows[1:, :4] != rows[:-1, :4]).any(1)
        run = np.cumsum(starts)
        fp, node = rows[:, 4].view(np.uint64), rows[:, 5] == 1
        # Trees grow in the order of a hash: in sorted order neighbours would
        # make deep branches.
        mixed = np.lexsort((fp * np.uint64(0x9E3779B97F4A7C15), run))
        mixed = mixed[node[mixed]]
        a, b = tree_links(fp[mixed], run[mixed], fp[~node], run[~node], radius)
        arrays = [pa.array(x.view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    for batch in batches:
        columns = [c.cast(pa.int8()) if c.type == pa.bool_() else c for c in batch.columns]
        held.append(np.column_stack([np.asarray(c).astype(np.int64) for c in columns]))
        if sum(map(len, held)) < _GROVE:
            continue
        rows = np.ascontiguousarray(np.concatenate(held))
        cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
        at = int(cuts[-1]) if len(cuts) else 0
        held = [rows[at:]]
        if at:
            yield grown(rows[:at])
    rows = np.concatenate(held) if held else np.zeros((0, 6), np.int64)
    if len(rows):
        yield grown(np.ascontiguousarray(rows))


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    agree: int = 1,
    workspace: Workspace | None = None,
) -> DataFrame:
    """The columns of ``docs`` but for the text, with ``fingerprint`` (16 hex
    digits) and ``component_id``, the smallest id of the row's class."""
    ws = workspace or Workspace(docs.sparkSession)
    with text_batches(ws.spark):
        hashed = ws.save(with_fingerprints(docs, text, shingle), "fingerprints")
    prints = hashed.groupBy("fp").agg(F.min(F.col("doc")[id]).alias("least"))
    prints = ws.save(prints, "distinct")
    found = ws.save(links(prints.select("fp"), ws, radius, agree=agree).distinct(), "links")
    roots = connected(found, ws)
    joined = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = ws.save(joined.join(least, "root").select("fp", "component_id"), "named")
    return hashed.join(named, "fp").select(
        *unboxed(hashed, "doc", "fingerprint", "component_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class: a row of the smallest id, of several such
    rows the one whose content hashes lowest, of equal rows one."""
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.select(
        F.xxhash64(F.lit(1), *[docs[f"`{n}`"] for n in plain]).alias("_h1"),
        F.xxhash64(F.lit(2), *[docs[f"`{n}`"] for n in plain]).alias("_h2"),
        docs[f"`{id}`"].alias("_id"),
        docs[f"`{text}`"].alias("_text"),
        F.struct("*").alias("_row"),
    )
    found = near_duplicates(rows.drop("_row"), "_id", "_text").where("_id <=> component_id")
    first = F.struct("_h1", "_h2")
    chosen = found.groupBy("component_id").agg(F.min(first).alias("_key")).select("_key.*")
    kept = rows.join(Workspace(docs.sparkSession).save(chosen, "chosen"), ["_h1", "_h2"])
    return kept.groupBy("_h1", "_h2").agg(F.first("_row").alias("_row")).select("_row.*")
