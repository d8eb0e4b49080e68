"""Nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import math

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginspark.llm import (
    chat, html_text, line_dedup, packing, pieces, quality, simhash, token_store, topk, toxicity,
)

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
LINE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, "the text of it\n" + LINE, "en"),
    (2, None, None),
    (3, "", "en"),
    (None, "a row without an id", "en"),
    (4, LONG, "en"),
    (5, "the text of it\n" + LINE, "en"),
    (5, "the text of it\n" + LINE, "en"),
    (None, None, None),
]
#: Names that working or result columns have.
CLASHES = ("ids", "row", "base", "fp", "doc", "score", "kept", "start", "line", "pos", "_row", "n_lines", "component_id", "closed")


def docs(spark, rows=ROWS):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return frame.withColumns({name: F.lit(name) for name in CLASHES})


def with_text(name, run):
    return pytest.param(run, id=name)


PER_DOCUMENT = [
    with_text("pieces", lambda d: pieces.decode(pieces.encode(d, PIECES), PIECES)),
    with_text("simhash", simhash.near_duplicates),
    with_text("toxicity", lambda d: toxicity.scores(d, [(-1, 0.5), (3, 1.0)])),
    with_text("line_dedup", line_dedup.dedup_lines),
    with_text("quality", quality.apply_rules),
    with_text("html", lambda d: html_text.extract(d, "text")),
]


@pytest.mark.parametrize("run", PER_DOCUMENT)
def test_one_row_per_document(spark, run):
    out = run(docs(spark)).toPandas()
    assert len(out) == len(ROWS)
    assert sorted(out.doc_id.dropna()) == [1, 2, 3, 4, 5, 5]
    assert len(set(c.lower() for c in out.columns)) == len(out.columns)
    assert set(out.lang.dropna()) == {"en"}
    assert run(docs(spark, [])).count() == 0


def test_pieces_of_nulls(spark):
    out = pieces.decode(pieces.encode(docs(spark), PIECES), PIECES).toPandas()
    for row in out.itertuples():
        assert row.decoded == row.text
        assert (row.ids is None) == (row.text is None)


def test_simhash_classes_and_survivors(spark):
    out = simhash.near_duplicates(docs(spark)).toPandas()
    same = out[out.doc_id.isin([1, 5])]
    assert set(same.component_id) == {1} and len(set(same.fingerprint)) == 1
    zero = out[out.fingerprint == "0" * 16]
    assert len(zero) == 3 and set(zero.component_id) == {2}
    kept = simhash.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 4] and len(ids) == 4
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_simhash_with_more_bands_and_small_shards(spark):
    base = 0x0123456789ABCDEF
    values = sorted({base ^ (1 << i) ^ (1 << j) for i in range(0, 40, 3) for j in range(1, 60, 7)})
    prints = spark.createDataFrame([(v,) for v in values], "fp long").repartition(3)
    from marginspark.llm.components import connected
    from marginspark.workspace import Workspace

    want = None
    for agree, shard in ((1, 4096), (1, 9), (3, 4096)):
        ws = Workspace(spark)
        roots = connected(ws.save(simhash.links(prints, ws, 3, shard, agree), "links"), ws)
        found = {r.node: r.root for r in roots.collect()}
        want = want or found
        assert found == want and len(found) == len(values) - 1


def test_line_runs(spark):
    rows = [
        (1, "short\n" + LINE + "\nx y z", None),
        (2, "own line\nshort\n" + LINE + "\n\nx y z\nmore of its own", None),
        (3, "short\nx y z", None),
        (4, "\n".join(["a b c d e f g h i j"] * 12), None),
    ]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert out[1].text == rows[0][1] and out[1].n_removed_lines == 0
    # The blank line does not break the run; lines around a run's words go too.
    assert out[2].text == "own line\n\nmore of its own" and out[2].n_removed_lines == 3
    assert out[3].text == rows[2][1]
    assert out[4].text == "a b c d e f g h i j" and out[4].n_removed_lines == 11


def test_quality_verdicts(spark):
    out = quality.apply_rules(docs(spark)).toPandas().set_index("text")
    assert not out.kept[""] and out.base_failed[""]
    assert out.n_words[LONG] == 60_000 and out.n_repeat_words[LONG] == 60_000
    assert quality.keep_good(docs(spark)).columns == docs(spark).columns


def test_packing_and_store(spark):
    frame = docs(spark)
    out = packing.pack(frame, BPE, window=64, open_windows=2).toPandas()
    assert out.length.sum() == out.drop_duplicates(["doc_id", "lang", "doc_tokens"]).doc_tokens.sum() + out[out.doc_id == 5].length.sum() // 2
    assert packing.pack(docs(spark, []), BPE).count() == 0
    store = token_store.write_store(frame, BPE, 1)
    read = store.read(frame).toPandas()
    assert len(read) == len(ROWS)
    empty = token_store.write_store(docs(spark, []), BPE, 1)
    assert empty.read(frame).count() == 0


def test_packing_merges_over_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    frame = spark.createDataFrame([(i, "a b c " * (i % 9)) for i in range(90)], "doc_id long, text string")
    out = packing.pack(frame.repartition(9), BPE, window=32, open_windows=2).toPandas()
    sizes = out.groupby("sequence_id").length.sum()
    assert (sizes < 32).sum() <= 1 and out.doc_id.nunique() == 90


def test_topk_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, lambda i: i % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0], "x"), (1, [0.5], "y")], "vec_id long, embedding array<double>, score string")
    assert [tuple(r) for r in topk.top_k(few, lambda i: i % 50 == 0).collect()] == [(0, 1, 1, 256 * 128)]


def test_topk_keeps_queries_beside_one_of_another_length(spark):
    rows = [(0, [1.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 0.0]), (4, []), (5, []), (6, [3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for block in (1, 2, 2048):
        got = topk.top_k(vectors, lambda i: i < 5, 1, scale=1, block=block).collect()
        assert sorted(tuple(r) for r in got) == [
            (0, 1, 6, 3), (1, 1, 3, 2), (2, 1, 3, 2), (3, 1, 1, 2), (4, 1, 5, 0),
        ]


def test_topk_of_large_components(spark):
    rows = [
        [400000.0, 0.0039063], [3e9, 1.0], [-3e9, 2.5], [1e30, -1e30], [1e30, -9e29], [0.5, 0.25],
        [2.0**60, 3.0], [400000.0, 0.0039063],
    ]
    for some in (rows[:1] + rows[5:6] + rows[7:], rows[:3] + rows[5:6], rows[:3] + rows[5:7], rows):
        vectors = spark.createDataFrame(
            [(i, v) for i, v in enumerate(some)], "vec_id long, embedding array<double>"
        ).repartition(3)
        got = topk.top_k(vectors, lambda i: i < 9, 3).collect()
        whole = [[math.floor(256 * x) for x in v] for v in some]
        for q, own in enumerate(whole):
            best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in enumerate(whole) if i != q)
            want = [(i, min(max(-s, -(2**63)), 2**63 - 1)) for s, i in best[:3]]
            assert [(r.vec_id, r.score) for r in sorted(got) if r.query_id == q] == want
    beyond = spark.createDataFrame([(0, [1e307]), (1, [1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(beyond, lambda i: i < 9).count() == 0


def test_store_tells_null_from_the_least_id(spark):
    rows = [(None, "nothing"), (-(2**63), "least"), (5, "five"), (None, "again")]
    store = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), BPE, 1)
    size = {i: set() for i, _ in rows}
    for r in store.read(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        size[r.doc_id].add((r.start, r.n_tokens))
    assert [len(size[i]) for i in (None, -(2**63), 5)] == [2, 1, 1]
    starts = sorted(s for own in size.values() for s, _ in own)
    assert starts[0] == min(size[None])[0] and len(starts) == 4


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (None, 0, None, "y"),
        (3, 0, "user", "same"), (3, 0, "user", "same"), (4, None, "judge", "z"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({"segment": F.lit(1), "loss": F.lit(2), "valid": F.lit(3)})
    out = {r.conv_id: r for r in chat.read_chats(chat.format_chats(frame)).collect()}
    assert {k: r.valid for k, r in out.items()} == {1: True, 2: False, 3: False, 4: False, None: False}
    assert {k: r.n_turns for k, r in out.items()} == {1: 2, 2: 1, 3: 2, 4: 1, None: 1}
    assert out[2].loss_chars == 1 and out[1].loss_chars == 0
    assert chat.read_chats(chat.format_chats(frame.limit(0))).count() == 0


def test_toxicity_without_and_with_labels(spark):
    frame = docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(frame, none) == []
    rows = [(i, "you idiot there" if i % 3 == 0 else f"fine words {i}", None) for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (7, None), (7, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    out = toxicity.scores(docs(spark, rows), model).toPandas()
    assert (out[out.doc_id % 3 == 0].score > 0.5).all() and (out[out.doc_id % 3 > 0].score < 0.3).all()


def test_stages_take_nothing_and_extra_columns(spark):
    from tests.conftest import SMALL

    for rows in ([], ROWS):
        frame = docs(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SMALL)
            assert out.columns == frame.columns, name
            assert out.count() <= len(rows)
        assert (corpus_pipeline.STAGES[-1][1](spark, frame, SMALL).count() > 0) == bool(rows)
