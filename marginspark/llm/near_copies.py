"""One document of each class of near copies, by exact similarity of shingles.

Two texts are linked when the sets of their word shingles have a Jaccard
similarity of ``least`` or more; a class is what links connect.

1. A text's set is hashed in the scan.  From there on only distinct sets are
   looked at, so copies of a whole cost nothing.
2. A set has ``BANDS`` bucket keys of ``ROWS`` minima each.  Two sets at
   similarity s share no bucket with probability (1 - s^ROWS)^BANDS: below one
   in a million at 0.8.  This is the only place where chance plays a part.
   With a ``radius`` the texts' SimHash fingerprints are made in the same scan,
   and those that the radius links, found through the BK-trees of
   :mod:`simhash`, are compared before all others.
3. Links are compared on the texts themselves.  In the first rounds each bucket
   is compared with one member of its own, drawn anew in each round; only
   members of other classes are compared.  So a large group of near copies
   takes rows in proportion to its members and soon is one class.
4. Last, the members of buckets that are not of one class yet meet through
   their rarest shingles, which leaves out no similar pair: two sets of a and b
   shingles at similarity s share s / (1 + s) * (a + b) of them, so in one order
   of all shingles, rarest first, they share one near the start of both.  How
   near follows from both sizes, so sizes are dealt into narrow classes.  Many
   texts that each differ from a common one by too much thus never meet, however
   many they are, since what sets each apart comes first.

Defined results: words are parted by ASCII white space and only A-Z are lowered;
a text shorter than a shingle has one shingle, and texts without words are one
class.  The row that stays is one of the smallest id, of several such rows the
one whose content hashes lowest, of equal rows one; a null id stays only where a
class has no other.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginspark.llm import simhash
from marginspark.llm.batches import slices, text_batches
from marginspark.llm.components import connected
from marginspark.workspace import Workspace

#: Words of a shingle, similarity of linked texts.
SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 28, 4
#: Rounds of one draw per bucket before all pairs that are left.
DRAWS = 2
#: Sizes in one class differ by less than this factor.
SIZE_STEP = 1.02
#: Shingles hashed at once, and pairs of texts that go to a worker at once.
_STEP = 2048
_PAIRS = 200
_SALTS = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, each once, in order."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    runs = [w[i:] for i in range(min(shingle, len(w)))]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(run)) for run in zip(*runs)), np.uint64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band; none for a set without shingles."""
    if not len(own):
        return own
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), _STEP):
        mixed = (own[at : at + _STEP] ^ _SALTS[0]) * _SALTS[1]
        np.minimum(low, mixed.min(1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        key = (key ^ part) * _MIX
        key ^= key >> np.uint64(29)
    return key


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _prints(rows: DataFrame, shingle: int, marked: bool) -> DataFrame:
    """(_h1, _h2, _id, d, n, bands, fp): ``d`` names the set, ``n`` is its size,
    ``fp`` is the text's SimHash fingerprint (null if not ``marked``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "_text"):
            d, n, keys, fp = [], [], [], []
            for text in texts:
                fp.append(int(np.uint64(simhash.fingerprint(text)).view(np.int64)) if marked else None)
                own = shingles(text, shingle)
                d.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                n.append(len(own))
                keys.append(band_keys(own))
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:3],
                    pa.array(np.array(d, np.uint64).view(np.int64)),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array(fp, pa.int64()),
                ],
                ["_h1", "_h2", "_id", "d", "n", "bands", "fp"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_h1", "_h2", "_id", F.col("_text").cast("string").alias("_text")).mapInArrow(
        scan, f"_h1 long, _h2 long, _id {kind}, d long, n long, bands array<long>, fp long"
    )


def _simhash_pairs(prints: DataFrame, ws: Workspace, radius: int) -> DataFrame:
    """Pairs ``(d, d2)`` of sets whose texts' fingerprints the radius links: one
    per set and class of fingerprints, as :func:`simhash.links` has them."""
    met = ws.save(prints.select("d", "fp").distinct(), "fingerprints")
    names = ws.save(met.groupBy("fp").agg(F.min("d").alias("name")), "names")
    found = simhash.links(names.select("fp"), ws, radius).distinct()
    a, b = names.toDF("a", "left"), names.toDF("b", "right")
    near = found.join(a, "a").join(b, "b").select(F.col("left").alias("d"), F.col("right").alias("d2"))
    same = met.join(names, "fp").select("d", F.col("name").alias("d2"))
    return ws.save(same.unionByName(near).where("d <> d2"), "simhash")


def _shared(rows: DataFrame, ws: Workspace, shingle: int) -> DataFrame:
    """(d, n, c, unique, shared): the shingles of ``rows(d, n, c, text)`` that
    other rows have too, rarest first, and the number of the others."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            own = [shingles(t, shingle).view(np.int64) for t in texts]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *own]))
            lists = pa.ListArray.from_arrays(pa.array(ends), flat)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], ["d", "n", "c", "s"])

    listed = ws.save(rows.mapInArrow(scan, "d long, n long, c long, s array<long>"), "shingles")
    single = listed.select("d", "n", "c", F.explode("s").alias("t"))
    known = single.groupBy("t").agg(F.count("*").alias("f")).where("f > 1")
    # A text's own shingles come together, never those of different texts.
    found = single.join(known, "t").groupBy("d", "n", "c").agg(
        F.array_sort(F.collect_list(F.struct("f", "t"))).alias("s")
    )
    return found.select(
        "d", "n", "c", (F.col("n") - F.size("s")).alias("unique"), F.col("s.t").alias("shared")
    )


def _size_class(n: int) -> int:
    return int(np.log(n) / np.log(SIZE_STEP) + 1e-9)


def prefix_keys(n: int, unique: int, shared: list[int], least: float) -> Iterator[tuple[bool, int, int]]:
    """(asks, class of sizes, shingle) under which a set meets similar ones: as
    the larger set it asks in the classes of sizes that may be similar, as the
    smaller one it lies in its own.  ``unique`` shingles come before ``shared``
    in the order."""

    def first(other: int) -> list[int]:
        # With a partner of ``other`` or more shingles, one of these is shared.
        both = int(np.ceil(least / (1 + least) * (n + other) - 1e-9))
        return shared[: max(0, n - both + 1 - unique)]

    own = _size_class(n)
    for t in first(n):
        yield False, own, t
    low = max(1, int(np.ceil(least * n - 1e-9)))
    for k in range(_size_class(low), own + 1):
        for t in first(max(low, int(np.ceil(SIZE_STEP**k - 1e-6)))):
            yield True, k, t


def _rare_pairs(rows: DataFrame, ws: Workspace, shingle: int, least: float) -> DataFrame:
    """Pairs ``(d, d2)`` of ``rows(d, n, c, text)`` of different ``c`` among
    which are all that are similar."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                (d, n, c, *key)
                for d, n, c, unique, own in zip(*(x.to_pylist() for x in batch.columns))
                for key in prefix_keys(n, unique, own, least)
            ]
            kinds = [pa.int64()] * 3 + [pa.bool_(), pa.int32(), pa.int64()]
            columns = list(zip(*made)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["d", "n", "c", "asks", "k", "t"]
            )

    placed = _shared(rows, ws, shingle).mapInArrow(
        keys, "d long, n long, c long, asks boolean, k int, t long"
    )
    placed = ws.save(placed, "prefixes")
    # Where a class holds most of a key, its members need not meet each other.
    many = placed.groupBy("k", "t", "c").agg(F.count("*").alias("many"))
    main = many.groupBy("k", "t").agg(
        F.max_by("c", "many").alias("main"), (F.min("c") < F.max("c")).alias("mixed")
    )
    placed = ws.save(placed.join(main.where("mixed").drop("mixed"), ["k", "t"]), "mixed")
    ask, lie = placed.where("asks"), placed.where("not asks")
    lie = lie.select("k", "t", *[F.col(x).alias(f"{x}2") for x in ("d", "n", "c")], F.col("main").alias("main2"))
    met = [
        (ask.where("c <> main"), lie),
        (ask.where("c = main"), lie.where("c2 <> main2")),
    ]
    larger = (F.col("n2") <= F.col("n")) & (F.col("c") != F.col("c2"))
    found = [x.join(y, ["k", "t"]).where(larger).select("d", "d2") for x, y in met]
    return found[0].unionByName(found[1]).distinct()


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs ``(a, b)`` of similar texts."""
    left = texts.select(F.col("d").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("d").alias("b"), F.col("text").alias("right"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            good = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                for name, text in ((a, x), (b, y)):
                    if name not in known:
                        known[name] = shingles(text or "", shingle)
                good.append(similarity(known[a], known[b]) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    met = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return met.mapInArrow(compare, "a long, b long")


def _roots(
    sets: DataFrame, docs: DataFrame, ws: Workspace, shingle: int, least: float, first: DataFrame | None
) -> DataFrame:
    """(node, root) of the sets that are not the root of their class; the pairs
    of ``first`` are compared first."""
    spread = sets.select("d", "n", F.explode("bands").alias("v"))
    shared = spread.groupBy("v").agg(F.count("*").alias("many")).where("many > 1").select("v")
    members = ws.save(spread.join(shared, "v"), "members")
    known = members.select("d")
    if first is not None:
        known = known.unionByName(first.select("d")).unionByName(first.select(F.col("d2").alias("d")))
    named = sets.join(known.distinct(), "d").select("d", "_h1", "_h2")
    texts = docs.join(named, ["_h1", "_h2"]).groupBy("d").agg(F.first("_text").alias("text"))
    texts = ws.save(texts, "texts")
    links = seen = None
    roots = ws.spark.createDataFrame([], "node long, root long")
    for turn in range(-1 if first is not None else 0, DRAWS + 1):
        if turn < 0:
            pairs = first
        else:
            own = members.join(roots, members["d"] == roots["node"], "left").select(
                "v", "d", "n", F.coalesce("root", "d").alias("c")
            )
            own = ws.save(own, "labelled")
            # One member of each bucket that is not of one class yet.
            draw = F.struct(F.xxhash64("v", "d", F.lit(turn)).alias("_at"), "d", "n", "c")
            drawn = own.groupBy("v").agg(
                F.min(draw).alias("p"), (F.min("c") < F.max("c")).alias("open")
            )
            drawn = ws.save(drawn.where("open").select("v", "p.d", "p.n", "p.c"), "drawn")
            drawn = drawn.toDF("v", "d2", "n2", "c2")
            if drawn.isEmpty():
                break
            if turn == DRAWS:
                left = own.join(drawn.select("v"), "v").select("d", "n", "c").distinct()
                pairs = _rare_pairs(left.join(texts, "d").select("d", "n", "c", "text"), ws, shingle, least)
            else:
                near = F.least("n", "n2") >= least * F.greatest("n", "n2")
                pairs = own.join(drawn, "v").where(near & (F.col("c") != F.col("c2")))
        pairs = pairs.select(F.greatest("d", "d2").alias("a"), F.least("d", "d2").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = ws.save(pairs, "pairs")
        if pairs.isEmpty():
            continue
        with text_batches(ws.spark, _PAIRS):
            found = ws.save(_similar(pairs, texts, shingle, least), "similar")
        seen = pairs if seen is None else seen.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        roots = connected(links, ws)
    return roots


def keep_one(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    least: float = LEAST,
    radius: int | None = None,
) -> DataFrame:
    """One row of each class, with the columns of ``docs``.  With a ``radius``
    texts whose SimHash fingerprints are linked by so many bits are candidates
    before all others."""
    ws = Workspace(docs.sparkSession)
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.select(
        F.xxhash64(F.lit(1), *[docs[f"`{n}`"] for n in plain]).alias("_h1"),
        F.xxhash64(F.lit(2), *[docs[f"`{n}`"] for n in plain]).alias("_h2"),
        docs[f"`{id}`"].alias("_id"),
        docs[f"`{text}`"].alias("_text"),
        F.struct("*").alias("_row"),
    )
    with text_batches(ws.spark):
        prints = ws.save(_prints(rows, shingle, radius is not None), "prints")
    key = F.struct("_h1", "_h2")
    sets = prints.groupBy("d").agg(
        F.min(key).alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    sets = ws.save(sets.select("d", "n", "bands", "key.*"), "sets")
    pairs = None if radius is None else _simhash_pairs(prints, ws, radius)
    roots = _roots(sets, rows.select("_h1", "_h2", "_text"), ws, shingle, least, pairs)
    first = F.struct(F.col("_id").isNull().alias("none"), "_id", "_h1", "_h2")
    least_of = prints.groupBy("d").agg(F.min(first).alias("first"))
    classes = least_of.join(roots, F.col("d") == F.col("node"), "left")
    chosen = classes.groupBy(F.coalesce("root", "d")).agg(F.min("first").alias("first"))
    chosen = ws.save(chosen.select("first._h1", "first._h2"), "chosen")
    kept = rows.select("_h1", "_h2", "_row").join(chosen, ["_h1", "_h2"])
    return kept.groupBy("_h1", "_h2").agg(F.first("_row").alias("_row")).select("_row.*")
