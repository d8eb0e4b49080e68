"""Token ids in raw payloads, with keyed access through minimal perfect hashes.

Writing.  Ids are split at approximate quantiles into shards of consecutive ids.
The texts are encoded where they are read, and only ids move: to their shard,
sorted by document id.  A shard is a few blocks; a block is one row with the raw
ids of its documents one after the other (little-endian, two bytes each where
the vocabulary allows), their lengths and their ids.  The blocks are a table
bucketed by shard, so that keyed reading never moves a payload.

Index.  Document ids are hashed into buckets of some ``BUCKET`` keys.  A bucket
gets a minimal perfect hash by displacement: groups of keys, the largest first,
take the first displacement that puts all their keys on free slots; groups of
one key name their slot.  Each slot has a 32-bit fingerprint of its key, so an
unknown key is told with that certainty, and the places of the key's documents.

Reading.  A key costs one hash, one displacement, one fingerprint and one slice
of a payload.  ``read`` does this for a table of keys, bucket by bucket.

Defined results: a null or empty text is the end id alone; documents of one id
stand together, in the order of the stored rows, and are all found; a null id
comes first and is found by a null (it has a bucket of its own);
unknown keys give no row; an empty table gives an empty store; other columns of
the input are not stored, so no name can clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginspark.llm.batches import slices, text_batches
from marginspark.llm.subwords import encoder
from marginspark.workspace import Workspace

SHARD = 1024
#: Bound of the split points that tasks are sent.
MAX_SHARDS = 100_000
#: Ids of a block, but for a document that is longer.
BLOCK_IDS = 1 << 21
BUCKET = 8192
_GROUP = 4
_NULL = -(1 << 63)
_BLOCKS = (
    "shard int, block int, first_token long, doc_ids array<long>, lengths array<int>, payload binary"
)
_SPOT = "array<struct<shard:int,block:int,place:int,copies:int>>"
_INDEX = (
    "bucket int, seed long, displace array<int>, prints array<long>, spots array<" + _SPOT + ">"
)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit numbers for each salt."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Slot of a hash under a displacement; a negative one names the slot."""
    moved = _mix(h + d.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 3) % np.uint64(n)
    return np.where(d < 0, -d - 1, moved.astype(np.int64))


def prints(keys: np.ndarray) -> np.ndarray:
    """32-bit fingerprints."""
    return (_mix(keys.view(np.uint64), 99) >> np.uint64(32)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, displacements, slot of each key) for distinct 64-bit keys."""
    n = len(keys)
    groups = max(1, (n + _GROUP - 1) // _GROUP)
    for seed in range(64):
        h = _mix(keys.view(np.uint64), seed)
        group = ((h >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        sizes = np.bincount(group, minlength=groups)
        starts = np.cumsum(sizes) - sizes
        displace = np.zeros(groups, np.int64)
        slot = np.zeros(n, np.int64)
        free = np.ones(n, bool)
        placed = True
        for g in np.argsort(-sizes, kind="stable"):
            own = order[starts[g] : starts[g] + sizes[g]]
            if len(own) < 2:
                break
            placed = False
            for first in range(0, 1 << 16, 256):
                d = np.arange(first, first + 256)
                at = _slots(h[own][None, :], np.repeat(d[:, None], len(own), 1), n)
                good = free[at].all(1) & (np.diff(np.sort(at, 1), axis=1) > 0).all(1)
                if good.any():
                    hit = int(good.argmax())
                    displace[g], slot[own] = d[hit], at[hit]
                    free[at[hit]] = False
                    placed = True
                    break
            if not placed:
                break
        if not placed:
            continue
        alone = np.flatnonzero(sizes == 1)
        own, left = order[starts[alone]], np.flatnonzero(free)
        displace[alone], slot[own] = -left - 1, left
        return seed, displace, slot
    raise ValueError("no displacement found")


def find(keys: np.ndarray, seed: int, displace: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where the fingerprint tells that it is unknown."""
    h = _mix(keys.view(np.uint64), seed)
    group = ((h >> np.uint64(32)) % np.uint64(len(displace))).astype(np.int64)
    slot = _slots(h, displace[group], len(known))
    return np.where(known[slot] == prints(keys), slot, -1)


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(_NULL)).astype(np.int64)


@dataclass
class TokenStore:
    """A written store: tables of blocks, shards and index below a folder."""

    blocks: DataFrame
    shards: DataFrame
    index: DataFrame
    buckets: int

    def _bucket(self, key: Column) -> Column:
        return _bucket(key, self.buckets)

    def find(self, keys: DataFrame, id: str = "doc_id") -> DataFrame:
        """(id, shard, block, place, copies) of every known key of ``keys``."""
        asked = keys.select(F.col(id).cast("long").alias("id")).distinct()
        asked = asked.withColumn("bucket", self._bucket(F.col("id")))

        def look(mine: pa.Table, known: pa.Table) -> pa.Table:
            names = ("shard", "block", "place", "copies")
            kinds = [("id", pa.int64()), *[(n, pa.int32()) for n in names]]
            if not len(mine) or not len(known):
                return pa.schema(kinds).empty_table()
            row = known.slice(0, 1)
            get = lambda name: np.asarray(row.column(name).combine_chunks().flatten())
            slot = find(
                _numbers(mine.column("id")),
                row.column("seed")[0].as_py(),
                get("displace").astype(np.int64),
                get("prints"),
            )
            hit = np.flatnonzero(slot >= 0)
            spots = row.column("spots").combine_chunks().flatten().take(pa.array(slot[hit]))
            ids = mine.column("id").combine_chunks().take(pa.array(np.repeat(hit, np.asarray(spots.value_lengths()))))
            flat = spots.flatten()
            fields = [flat.field(n).cast(pa.int32()) for n in names]
            return pa.Table.from_arrays([ids, *fields], schema=pa.schema(kinds))

        pairs = asked.groupBy("bucket").cogroup(self.index.groupBy("bucket"))
        return pairs.applyInArrow(
            look, "id long, shard int, block int, place int, copies int"
        )

    def read(self, keys: DataFrame, id: str = "doc_id") -> DataFrame:
        """(id, start, n_tokens, ids) of the documents of the keys: ``start`` is
        the number of ids of all documents before, ``ids`` little-endian
        unsigned 32-bit numbers."""
        found = self.find(keys, id)
        spot = F.struct("block", "place", "copies", "id")
        # A shard's keys are bounded by its size; its payloads stay where they
        # are, as the blocks are bucketed by shard.
        wanted = found.groupBy("shard").agg(F.collect_list(spot).alias("spots"))
        wanted = wanted.join(self.shards, "shard").hint("merge")
        rows = self.blocks.join(wanted, "shard").select(
            (F.col("base") + F.col("first_token")).alias("first"),
            "lengths",
            "payload",
            F.filter("spots", lambda s: s["block"] == F.col("block")).alias("spots"),
        )

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(len(batch)):
                    yield _documents(batch.slice(row, 1))

        return rows.mapInArrow(
            cut, f"`{id}` long, start long, n_tokens long, ids binary"
        )


def _documents(row: pa.RecordBatch) -> pa.RecordBatch:
    """The asked documents of one block."""
    lengths = np.asarray(row.column(1).flatten()).astype(np.int64)
    ends = np.cumsum(lengths)
    payload = row.column(2)[0].as_buffer()
    width = payload.size // int(ends[-1]) if len(ends) and ends[-1] else 4
    first = row.column(0)[0].as_py()
    spots = row.column(3).flatten()
    copies = np.asarray(spots.field("copies")).astype(np.int64)
    place = np.repeat(np.asarray(spots.field("place")).astype(np.int64), copies)
    place += np.arange(len(place)) - np.repeat(np.cumsum(copies) - copies, copies)
    ids = spots.field("id").take(pa.array(np.repeat(np.arange(len(spots)), copies)))
    start, size = ends[place] - lengths[place], lengths[place]
    every = np.frombuffer(payload, np.dtype(f"<u{width}"))
    raw = [every[a : a + n].astype("<u4").tobytes() for a, n in zip(start.tolist(), size.tolist())]
    arrays = [ids, pa.array(first + start), pa.array(size), pa.array(raw, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["id", "start", "n_tokens", "ids"])


def _bucket(key: Column, buckets: int) -> Column:
    """The bucket of a key; null has one of its own, so that no number is its twin."""
    return F.when(key.isNull(), -1).otherwise(
        F.pmod(F.xxhash64(key, F.lit(11)), F.lit(buckets)).cast("int")
    )


def _encoded(docs: DataFrame, splits: list[float], tokenizer: str, end_id: int) -> DataFrame:
    """(shard, id, row, n, ids) of each document, encoded where it is read."""
    cuts = np.array(splits, np.float64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        kind = np.dtype(f"<u{code.id_bytes}")
        for part, texts in slices(batches, "text"):
            ids, sizes = code.encode(texts)
            ends = np.cumsum(sizes)
            raw = [
                np.append(ids[e - n : e], end_id).astype(kind).tobytes()
                for e, n in zip(ends.tolist(), sizes.tolist())
            ]
            shard = np.searchsorted(cuts, _numbers(part.column(0)), side="right")
            arrays = [
                pa.array(shard.astype(np.int32)), part.column(0), part.column(1),
                pa.array((sizes + 1).astype(np.int32)), pa.array(raw, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["shard", "id", "row", "n", "ids"])

    return docs.mapInArrow(encode, "shard int, id long, row long, n int, ids binary")


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Sorted documents put together block by block."""
    shard, block, first, held, tokens = None, 0, 0, [], 0

    def close() -> pa.RecordBatch:
        ids, sizes, raw = zip(*held)
        row = ([shard], [block], [first], [list(ids)], [list(sizes)], [b"".join(raw)])
        kinds = (
            pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(),
        )
        names = ("shard", "block", "first_token", "doc_ids", "lengths", "payload")
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

    for batch in batches:
        for own, id_, size, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
            if held and (own != shard or tokens + size > limit):
                yield close()
                first, block = (first + tokens, block + 1) if own == shard else (0, 0)
                held, tokens = [], 0
            shard = own
            held.append((id_, size, raw))
            tokens += size
    if held:
        yield close()


def write_store(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    shard_docs: int = SHARD,
    block_ids: int = BLOCK_IDS,
    id: str = "doc_id",
    text: str = "text",
    workspace: Workspace | None = None,
) -> TokenStore:
    """Write all texts in ascending order of id and index them by id."""
    spark = docs.sparkSession
    ws = workspace or Workspace(spark)
    texts = docs.select(
        docs[f"`{id}`"].cast("long").alias("id"),
        F.monotonically_increasing_id().alias("row"),
        docs[f"`{text}`"].cast("string").alias("text"),
    )
    count = texts.count()
    shards = min(MAX_SHARDS, max(1, -(-count // shard_docs)))
    splits: list[float] = []
    if shards > 1:
        points = [i / shards for i in range(1, shards)]
        splits = texts.stat.approxQuantile("id", points, 0.2 / shards)
    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    encoded = _encoded(texts.select("id", "row", "text"), sorted(set(splits)), tokenizer, end_id)
    order = ["shard", F.asc_nulls_first("id"), "row"]
    placed = encoded.repartition(parts, "shard").sortWithinPartitions(*order)
    made = placed.mapInArrow(lambda batches: _blocks(batches, block_ids), _BLOCKS)
    name = f"token_store_{uuid.uuid4().hex}"
    writer = made.write.format("parquet").option("path", f"{ws.root}/{name}")
    with text_batches(spark):
        writer.bucketBy(parts, "shard").saveAsTable(name)
    blocks = spark.table(name)

    sizes = blocks.select(
        "shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("shard").agg(F.sum("n").alias("n"))  # MAX_SHARDS rows at most
    base = F.coalesce(F.sum("n").over(before), F.lit(0))
    bases = ws.save(totals.select("shard", base.alias("base")), "shards")

    buckets = max(1, -(-count // BUCKET))
    places = blocks.select("shard", "block", F.posexplode("doc_ids").alias("place", "id"))
    spots = places.groupBy("id", "shard", "block").agg(
        F.min("place").alias("place"), F.count("*").cast("int").alias("copies")
    )
    spot = F.struct("shard", "block", "place", "copies")
    keys = spots.groupBy("id").agg(F.sort_array(F.collect_list(spot)).alias("spots"))
    keyed = keys.withColumn("bucket", _bucket(F.col("id"), buckets))
    index = ws.save(keyed.groupBy("bucket").applyInArrow(_index, _INDEX), "index")
    return TokenStore(blocks, bases, index, buckets)


def _plain(spots: pa.ListArray) -> pa.ListArray:
    """The same lists with fields that may be null, as the schema says."""
    flat = spots.flatten()
    names = ("shard", "block", "place", "copies")
    fields = [pa.field(n, pa.int32()) for n in names]
    rows = pa.StructArray.from_arrays([flat.field(n).cast(pa.int32()) for n in names], fields=fields)
    ends = np.cumsum(np.asarray(spots.value_lengths()))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), rows)


def _index(table: pa.Table) -> pa.Table:
    """The hash of one bucket's keys, their fingerprints and places by slot."""
    keys = _numbers(table.column("id"))
    seed, displace, slot = build_hash(keys)
    by_slot = np.argsort(slot)
    spots = table.column("spots").combine_chunks().take(pa.array(by_slot))
    bounds = pa.array([0, len(keys)], pa.int32())
    arrays = [
        pa.array([table.column("bucket")[0].as_py()], pa.int32()),
        pa.array([seed], pa.int64()),
        pa.array([displace], pa.list_(pa.int32())),
        pa.array([prints(keys)[by_slot]], pa.list_(pa.int64())),
        pa.ListArray.from_arrays(bounds, _plain(spots)),
    ]
    return pa.Table.from_arrays(arrays, ["bucket", "seed", "displace", "prints", "spots"])
