"""Token counts, alignments and fill-in-the-middle forms against plain versions."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from marginspark.llm import alignment, fill_middle, token_counts
from marginspark.llm.queries import QUERIES, table
from tests.conftest import SMALL

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
FILE_A = public_tokenizers.path("byte_bpe_50k.json")
FILE_B = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "a ", "  two  blanks \n\n and\tmore\r\nlines\r", "x▁y has the marker",
    "it's <|endoftext|> <|startoftext|>x<|endoftext|> </s> <unk> <0x41>", "Σας ΣΑΣ É é İIıß ²,³.",
    "\x00\x01 a\x1cb\x85c\xa0d᠎e", "👍🏽 中文字 ١٢٣　三", "w" * 3000, "f(x);\r {\r}\r", "same", "same",
    "".join(map(chr, range(1, 0x2400))),
    "a<P>b\nc", "one\ntwo\nthree", "<S", "tail<", "\n\n\n", " ".join(f"w{i % 89}," for i in range(30_000)),
]


def odd(spark):
    ids = [None if i == 1 else min(i, 13) for i in range(len(ODD))]
    rows = list(zip(ids, ODD, range(len(ODD))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int").repartition(4)
    names = ("row", "doc", "key", "n", "near", "links", "groups", "form", "output", "n_tokens", "h")
    return docs.withColumns({x: F.lit(x) for x in names})


def by_place(out):
    return {r["at"]: r for r in out.collect()}


# --- token counts


@pytest.mark.parametrize("head", [0, 5, token_counts.HEAD])
def test_token_counts_of_odd_texts(spark, head):
    t = Tokenizer.from_file(WORD_FILE)
    out = token_counts.count_tokens(odd(spark), WORD_FILE, head=head)
    assert len(set(out.columns)) == len(out.columns) and "text" not in out.columns
    found = by_place(out)
    assert len(found) == len(ODD)
    for i, text in enumerate(ODD):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        size = len((text or "").encode())
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (n, size, n > 2048), i
    assert token_counts.count_tokens(odd(spark).where("false"), WORD_FILE).count() == 0


def test_token_counts_where_blanks_matter(spark):
    t = Tokenizer.from_file(FILE_A)
    assert not token_counts.pretokens(FILE_A).words
    found = by_place(token_counts.count_tokens(odd(spark), FILE_A, head=3))
    for i, text in enumerate(ODD):
        assert found[i].n_tokens == len(t.encode(text or "", add_special_tokens=False).ids)


def test_token_counts_of_documents(spark):
    docs = table(spark, SMALL, "documents").toPandas()
    got = QUERIES["op11_token_counts"](spark, SMALL).toPandas().set_index("doc_id")
    t = Tokenizer.from_file(WORD_FILE)
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in docs.text]
    assert got.n_tokens[docs.doc_id].tolist() == want
    assert got.n_bytes[docs.doc_id].tolist() == [len((x or "").encode()) for x in docs.text]
    assert got.over_limit[docs.doc_id].tolist() == [n > 2048 for n in want]
    assert got.dtypes.astype(str).to_dict() == {"n_bytes": "int64", "n_tokens": "int64", "over_limit": "bool"}


def test_vocabulary_counts_each_pretoken_once(spark):
    rows = [(i, "the cat the dog" if i % 2 else "The cat's " + "z" * 90) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {bytes(r.key): (r.n_docs, r.pieces) for r in token_counts.vocabulary(docs, WORD_FILE).collect()}
    assert found[b"the"] == (40, 1) and found[b"dog"] == (20, 1) and found[b"'s"] == (20, 1)
    assert len(found) == 5 and [len(k) for k in found if k[:1] == b"\0"] == [17]


@pytest.mark.parametrize("path", [WORD_FILE, FILE_A])
def test_words_are_cut_as_columns(path, monkeypatch):
    p = token_counts.PreTokens(path)
    texts = [*ODD, " The end. A,b a,, a., , . ,x it's it's Z. É, \x0b\x0cx\x1fy\x1cz "]
    rows, at, units = p.units(pa.array(texts, pa.string()))
    units = units.to_pylist()
    for i, text in enumerate(texts):
        own = [w.decode() for w in (text or "").encode().split()] if p.words else [text] if text else []
        assert [u for u in (units[k] for k in at[rows == i]) if u] == own
    for distinct in (False, True):
        place, found = p.cut(pa.array(units), distinct)
        for i, u in enumerate(units):
            own = [found[int(k)].as_py() for k in np.flatnonzero(place == i)]
            want = p.of(u) if u else []
            assert sorted(own) == sorted({*want} if distinct else want)
    if p.words:  # words of letters take no call each
        monkeypatch.setattr(p, "of_unit", None)
        place, found = p.cut(pa.array(["Some", "words,", "", "here."]))
        assert sorted(zip(place.tolist(), found.to_pylist())) == [
            (0, "some"), (1, ","), (1, "words"), (3, "."), (3, "here")
        ]


# --- alignment


def plain_alignment(texts):
    a, b = Tokenizer.from_file(FILE_A), SentencePieceProcessor(model_file=FILE_B)
    a.encode_special_tokens = True
    letter = alignment.byte_letters()
    token = {i: t for t, i in a.get_vocab(with_added_tokens=False).items()}

    def of_b(i):
        piece = b.id_to_piece(i)
        byte = re.fullmatch("<0x(..)>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    aligned = []
    for text in texts:
        aligned.append([])
        if not text:
            continue
        raw = (" " + text).encode()
        left = [(i, bytes(letter[c] for c in token[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, of_b(i)) for i in b.encode(text)]
        if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
            continue
        at, marks = 0, []
        for side in (left, right):
            ends, at = {}, 0
            for k, (_, x) in enumerate(side, 1):
                at += len(x)
                ends[at] = k
            marks.append(ends)
        i = j = 0
        for end in sorted(marks[0].keys() & marks[1].keys()):
            x, y = marks[0][end], marks[1][end]
            aligned[-1].append(([t for t, _ in left[i:x]], [t for t, _ in right[j:y]]))
            i, j = x, y
    return aligned


def scored(aligned):
    links = [Counter((x, y) for g, h in groups for x in g for y in h) for groups in aligned]
    docs = Counter(pair for own in links for pair in own)
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(n, best.get(x, 0))
    for groups, own in zip(aligned, links):
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        yield (
            sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(own.values()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
            sum(n for p, n in own.items() if docs[p] == best[p[0]]),
            sum(n * docs[p] for p, n in own.items()),
        )


SCORES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.mark.parametrize("head", [0, 7, alignment.HEAD])
def test_alignment_of_odd_texts(spark, head):
    found = by_place(alignment.link_scores(odd(spark), FILE_A, FILE_B, head=head))
    for i, want in enumerate(scored(plain_alignment(ODD))):
        assert tuple(found[i][c] for c in SCORES) == want, i
    assert alignment.link_scores(odd(spark).where("false"), FILE_A, FILE_B).count() == 0


def test_alignment_gives_groups_and_links(spark):
    found = by_place(alignment.align(odd(spark), FILE_A, FILE_B))
    for i, groups in enumerate(plain_alignment(ODD)):
        assert [(list(g.a), list(g.b)) for g in found[i].groups] == groups
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        assert {(k.a, k.b): k.n for k in found[i].links} == links


def test_alignment_of_documents(spark):
    docs = table(spark, SMALL, "documents").toPandas()
    got = QUERIES["op12_alignment"](spark, SMALL).toPandas().set_index("doc_id")
    assert got.columns.tolist() == SCORES
    for doc, want in zip(docs.doc_id, scored(plain_alignment(docs.text))):
        assert tuple(got.loc[doc]) == want, doc


def test_chunks_are_forgotten_in_time(monkeypatch):
    monkeypatch.setattr(alignment, "GROUPS", 40)
    groups = alignment.Groups(alignment.pair_of(FILE_A, FILE_B))
    texts = [f"some words{i} and others{i * 7}" for i in range(60)]
    for lot in (texts[:20], texts[20:40], texts):
        codes, many = groups(lot)
        ends = np.cumsum(many)
        own = [[groups.sides[0][c] for c in codes[e - n : e]] for e, n in zip(ends, many)]
        assert [[x for g in text for x in g] for text in own] == [
            [x for g, _ in text for x in g] for text in plain_alignment(lot)
        ]


# --- fill in the middle


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(2)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 4, size).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(symbols)
        for s in range(4):
            want = np.concatenate([[0], np.cumsum(symbols == s)])
            assert (matrix.rank(s, np.arange(size + 1)) == want).all()


@pytest.mark.parametrize("ends, unit", [
    ((fill_middle.LINE,), r"[^\n]*\n|[^\n]+"),
    ((fill_middle.LINE, fill_middle.STOP), r"[^\n.!?]*[\n.!?]|[^\n.!?]+"),
])
def test_units_and_cuts(ends, unit):
    texts = [t or "" for t in ODD] + ["a.b\nc!", ".", "d?\n"]
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    units = fill_middle.Units(chars, np.array([len(t) for t in texts]), ends)
    own = [re.findall(unit, t) for t in texts]
    assert units.count.tolist() == [len(x) for x in own]
    for share in (0, 0.4, 0.8, 1):
        asked = (units.count * share).astype(int)
        assert units.cut(asked).tolist() == [len("".join(x[:k])) for x, k in zip(own, asked)]


def test_forms_of_odd_texts(spark):
    settings = fill_middle.Settings(seed=3, rate=70, spm=40)
    found = by_place(fill_middle.transform(odd(spark), settings=settings))
    forms = Counter(r.form for r in found.values())
    for i, text in enumerate(ODD):
        text, row = text or "", found[i]
        id = "" if row.doc_id is None else str(row.doc_id)
        h = [int(hashlib.sha256(f"3:{id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
        p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
        form = "spm" if h[3] % 100 < 40 else "psm"
        form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 70 else form
        out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        plain = form == "plain"
        assert (row.n, row.form, row.output) == (len(lines), form, out)
        assert (row.prefix_chars, row.middle_chars) == ((None, None) if plain else (len(p), len(m)))
        assert fill_middle.restore(out, form) == text
    assert len(forms) == 3
    digests = fill_middle.with_digests(fill_middle.transform(odd(spark)))
    for i, row in by_place(digests).items():
        assert row.restored_sha256 == hashlib.sha256((ODD[i] or "").encode()).hexdigest()
    assert fill_middle.transform(odd(spark).where("false")).count() == 0
