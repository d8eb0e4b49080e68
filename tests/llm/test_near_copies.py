"""The near-copy stage of the pipeline against all pairs of texts."""

import random

import pandas as pd

import corpus_pipeline
from marginspark.llm import near_copies, simhash
from marginspark.llm.queries import table
from tests.conftest import SMALL


def sets_of(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """The least id of each class, by comparing all pairs."""
    sets = [sets_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or both >= 0.8 * (len(a) + len(sets[j]) - both):
                label[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted(least.values())


def planted():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = [(1000, None), (1001, ""), (1002, "two words"), (1003, "Two  words")]
    for group in range(12):
        base = [word() for _ in range(120)]
        for copy in range(12):
            own = list(base)
            for at in rng.sample(range(120), copy % 6):
                own[at] = word()
            rows.append((100 * group + copy * 7 % 12, " ".join(own)))
    return rows


def test_stage_links_at_similarity_of_five_words(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()]
    assert sorted(kept) == survivors(rows)
    # Three bits let most of these copies stay.
    assert len(kept) < simhash.keep_one(docs).count()


def test_stage_on_given_documents(spark):
    docs = table(spark, SMALL.replace("sf0.001", "sf0.01"), "documents")
    seen: pd.DataFrame = docs.toPandas()
    kept = corpus_pipeline.near_copies(spark, docs, SMALL).toPandas()
    assert sorted(kept.doc_id) == survivors(list(zip(seen.doc_id, seen.text)))
    same = kept.merge(seen, on="doc_id", suffixes=("", "_was"))
    assert (same.text == same.text_was).all()


def test_ids_may_be_null_and_tables_empty(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "g h"), (3, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_copies.keep_one(docs).collect()
    assert sorted(kept, key=lambda r: r.text) == [(3, "a b c d e f"), (None, "g h")]
    assert near_copies.keep_one(docs.where("false")).count() == 0


def test_prefixes_miss_no_similar_pair():
    rng = random.Random(8)
    sets = [set(rng.sample(range(60), rng.randrange(1, 40))) for _ in range(120)]
    sets += [set(list(s)[: max(1, len(s) - rng.randrange(5))]) for s in sets]
    met, often = {}, {t: sum(t in s for s in sets) for s in sets for t in s}
    for d, s in enumerate(sets):
        shared = sorted((t for t in s if often[t] > 1), key=lambda t: (often[t], t))
        for asks, *key in near_copies.prefix_keys(len(s), len(s) - len(shared), shared, 0.8):
            met.setdefault(tuple(key), ([], []))[asks].append(d)
    pairs = {(a, b) for lie, ask in met.values() for a in ask for b in lie if len(sets[b]) <= len(sets[a])}
    for a, s in enumerate(sets):
        for b in range(a):
            if len(s & sets[b]) >= 0.8 * len(s | sets[b]):
                assert (a, b) in pairs or (b, a) in pairs


def test_texts_that_each_differ_too_much_are_not_compared(spark, monkeypatch):
    compared = []
    plain = near_copies._similar
    monkeypatch.setattr(
        near_copies, "_similar", lambda pairs, *a: compared.append(pairs.count()) or plain(pairs, *a)
    )
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base, per_text = [word() for _ in range(200)], []
    for n in (100, 400):
        rows = []
        for i in range(n):
            own = list(base)
            for at in rng.sample(range(200), 6):
                own[at] = word()
            rows.append((i, " ".join(own)))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        compared.clear()
        kept = [r.doc_id for r in near_copies.keep_one(docs).collect()]
        assert sorted(kept) == survivors(rows)
        per_text.append(sum(compared) / n)
    assert per_text[1] < 1.6 * per_text[0]


def test_stage_compares_what_simhash_links(spark, monkeypatch):
    """Fingerprints that 3 bits link are compared, at whatever similarity."""
    compared = []
    plain = near_copies._similar
    monkeypatch.setattr(
        near_copies, "_similar", lambda pairs, *a: compared.append(pairs.collect()) or plain(pairs, *a)
    )
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    # Runs of the same three words give one fingerprint, 9 other words most of the shingles.
    runs = [" ".join([word() for _ in range(3)] * 150) for _ in range(2)]
    rows = [(10 * i + j, f"{run} {' '.join(word() for _ in range(9))}") for i, run in enumerate(runs) for j in range(4)]
    rows += [(100, "a b c d e f g"), (101, "h i j k l m n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len({simhash.fingerprint(t) for _, t in rows}) == 4
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()]
    assert sorted(kept) == survivors(rows)
    # Three of the four texts of a run meet the fourth.
    assert len(compared[0]) == 6
