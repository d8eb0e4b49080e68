"""The helpers inside tasks: tries, trees, hashes, templates, memories of chunks."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from marginspark.llm import chat, html_text, line_dedup, pieces, simhash, subwords, token_store
from marginspark.llm.packing import Packer
from marginspark.llm.screens import screen, screened

PARTS = [
    "a", " ", "\n", "\t", "  ", "'s", "don't", "é", "ß", "3", "12", "!!", " \n", "　", "\x85",
    "Σ", "İ", "<|endoftext|>", "語", "́", "😀", "x", " b", ",", ".", "...", "a,", "!,", "_,",
    " ,", "²,", "word", "Words", "", " ",
]


def jumble(parts, count, most, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(count)]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("memory", [200, 300_000])
def test_chunks_give_the_ids_of_whole_texts(file, memory, monkeypatch):
    monkeypatch.setattr(subwords, "MAX_CHUNKS", memory)
    own = subwords.Encoder(public_tokenizers.path(file))
    texts = jumble(PARTS, 4000, 14) + ["", " ", "long" * 5000]
    for _ in range(2):
        ids, sizes = own.encode(texts)
        want = own.tokenizer.encode_batch(texts, add_special_tokens=False)
        got = np.split(ids, np.cumsum(sizes)[:-1])
        assert all(g.tolist() == w.ids for g, w in zip(got, want))


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))


def test_viterbi_finds_what_the_library_lists_first(model):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        raw = file.read()
    at = raw.index(b"\x12\x06tok_v0\x18\x02") + 9
    unigram = raw[:at] + b"\x01" + raw[at + 1 :]  # the same pieces, as Unigram
    library = sentencepiece.SentencePieceProcessor(model_proto=unigram)
    words = sorted({w for w in jumble(["the", "ing", "at", "on", "er", "qu", "zz", "ß"], 800, 6) if w})
    ids, sizes = pieces.PieceEncoder(model).encode(words)
    for word, own in zip(words, np.split(ids, np.cumsum(sizes)[:-1])):
        best = library.nbest_encode_as_ids(word, 2)[0]
        assert model.scores[own].sum() == model.scores[best].sum()


def test_pieces_give_texts_back(model):
    texts = jumble(PARTS, 3000, 12) + ["", " ", "  x", "語" * 3000, "\u0007 \U0001f9ff"]
    own = pieces.PieceEncoder(model)
    for _ in range(2):
        ids, sizes = own.encode(texts)
        assert [model.decode(i) for i in np.split(ids, np.cumsum(sizes)[:-1])] == texts


def test_trie_holds_its_keys_only():
    keys = sorted({bytes(random.Random(i).choices(range(97, 103), k=i % 6 + 1)) for i in range(400)})
    trie = pieces.DoubleArray(keys, range(len(keys)))

    def look(key):
        node = 0
        for byte in key:
            child = trie.base[node] + byte
            if trie.check[child] != node or not child:
                return -1
            node = child
        return trie.value[node]

    assert [look(k) for k in keys] == list(range(len(keys)))
    assert look(b"zz") == -1


def test_forest_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    values = [rng.integers(0, 2**63, dtype=np.uint64)]
    while len(values) < 600:
        near = values[-1] ^ np.uint64(1 << int(rng.integers(0, 64)))
        values.append(near if len(values) % 30 else rng.integers(0, 2**63, dtype=np.uint64))
    values = np.unique(np.array(values, np.uint64))
    rng.shuffle(values)
    tree = np.sort(rng.integers(0, 3, len(values)))
    forest, found = simhash.BKForest(values, tree), set()
    for q, node in forest.within(values, tree, 3):
        found |= set(zip(q.tolist(), node.tolist()))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    near &= tree[:, None] == tree[None, :]
    assert found == set(zip(*(x.tolist() for x in np.nonzero(near))))


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_minimal_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    seed, displace, slot = token_store.build_hash(keys)
    assert sorted(slot) == list(range(len(keys)))
    prints = np.zeros(len(keys), np.int64)
    prints[slot] = token_store.prints(keys)
    assert (token_store.find(keys, seed, displace, prints) == slot).all()
    others = keys + 1
    assert (token_store.find(others, seed, displace, prints) >= 0).sum() == 0


def test_template_is_reversible():
    template = chat.TEMPLATE
    parts = ["#", "###", "\\", "<", "</turn>", "</tur", "\n", "1", "0", "### User: ", "]", " </turn>\n"]
    for text in jumble(parts, 20_000, 9):
        safe = template.escape(text)
        assert not any(c in safe for c in template.control)
        for role in ("user", "assistant", text):
            assert template.parse(template.header(role) + safe + template.end) == (role, text)


def test_packer_keeps_order_and_fills_windows():
    out = []
    packer = Packer(16, 3, lambda n, pieces, closed: out.append((pieces, closed)))
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 50, 200)
    for tag, n in enumerate(sizes):
        packer.add(tag, 0, np.arange(n))
    assert all(sum(len(i) for _, _, i in p) == 16 for p, _ in out)
    packer.finish()
    short = [p for p, _ in out if sum(len(i) for _, _, i in p) < 16]
    assert len(short) <= 1
    pieces_ = sorted((tag, start, len(i)) for p, _ in out for tag, start, i in p)
    for tag, n in enumerate(sizes):
        own = [(s, k) for t, s, k in pieces_ if t == tag]
        assert [s for s, _ in own] == np.cumsum([0, *(k for _, k in own)]).tolist()[:-1]
        assert sum(k for _, k in own) == n


PAGE = """<html><head><title>x</title></head><body><header class=top>Site <a href=/>Home</a></header>
<div id="cookie-notice"><p>We use cookies to improve the site and the experience of it.</p></div>
<article class="post"><header><h1>Title &amp; more</h1></header><p>A first paragraph of the article with
the words that are in it, and so on it goes for a while.</p><div class="ad-slot ads">Buy it</div><p>Short.</p>
<ul><li>one<li>two</ul><p>x &lt; y &nbsp; z<br>b<p>un <i>it<b>al</i>ic</b><script>"</p>"</script>
<form><label>Name</label></form><section id="comments"><h2>Comments</h2><div>I like it.</div></section></article>
<aside><p>Side of the page</p></aside><footer>&copy; us</footer>"""
TEXT = [
    "Title & more",
    "A first paragraph of the article with the words that are in it, and so on it goes for a while.",
    "Short.", "one", "two", "x < y z b", "un italic",
]


def test_page_rules():
    assert html_text.main_text(PAGE) == "\n\n".join(TEXT)
    bare = PAGE.replace("article class", "div class").replace("</article>", "</div>")
    assert html_text.main_text(bare).split("\n\n")[-1] == TEXT[-1]
    assert html_text.main_text("") == ""
    assert html_text.main_text("<article>left open <b title='a>b'>x</b> 1 < 2") == "left open x 1 < 2"


@pytest.mark.parametrize(
    "attributes",
    ['href="/the-hidden-valley"', 'title="a hidden gem"', 'href="/x?id=menu"', 'data-role="banner"',
     "title='class=ad'", 'data-id=menu href=/?class=popup', 'title="no end of hidden'],
)
def test_attributes_are_read_whole(attributes):
    page = f"<article><p>Before <a {attributes}>the link</a> and after.</p></article>"
    assert html_text.main_text(page) == "Before the link and after."
    for name in ("hidden", "HIDDEN=''", "id=menu", "role = 'banner'", 'title="x"class="ad"'):
        page = f"<article><p>Before.</p><p title='a > b' {name}>Not this.</p></article>"
        assert html_text.main_text(page) == "Before."


PROSE = [
    f"In the {n} of the year we went to the river and sat there for a while, for it was warm, and "
    "what we had with us was no more than a loaf of bread and some of the apples from the tree."
    for n in ("spring", "summer", "autumn")
]


@pytest.mark.parametrize("name", ["text-center", "post-meta", "entry-title", "main-menu", "text", "content"])
def test_a_small_mark_does_not_hide_the_article(name):
    body = "".join(f"<p>{p}</p>" for p in PROSE)
    page = f"<body><div class={name}>By the staff</div><div>{body}</div></body>"
    assert html_text.main_text(page).endswith("\n\n".join(PROSE))
    # A mark that holds the article still decides.
    page = f"<div>{PROSE[0]}</div><div class='post-content has-sidebar'>{body}<p>Short.</p></div>"
    assert html_text.main_text(page) == "\n\n".join([*PROSE, "Short."])


@pytest.mark.parametrize("name", ["main-menu", "main-nav", "post-nav", "content-sidebar", "text-widget"])
def test_menus_are_hidden_whatever_they_are_menus_of(name):
    body = "".join(f"<p>{p}</p>" for p in PROSE)
    page = f"<div class=wrap><div class={name}>{PROSE[0]}</div>{body}</div>"
    assert html_text.main_text(page) == "\n\n".join(PROSE)


def test_html_of_pages_without_marks():
    import pyarrow.parquet as pq

    from tests.conftest import SMALL

    pages = pq.read_table(f"{SMALL}/pages.parquet").column("html").to_pylist()
    for page in filter(None, pages):
        bare = page.replace("<article", "<div").replace("</article", "</div")
        assert bare != page and html_text.main_text(bare) == html_text.main_text(page) != ""


PARAGRAPHS = [
    "The river is high in the spring and the people of the town go down to it with their boats, "
    "as they have done for a hundred years, and when the water is low again they come back to the market.",
    "Der Fluss ist im Frühling hoch und die Leute aus der Stadt gehen mit den Booten zu ihm hinunter, wie "
    "sie es seit hundert Jahren tun, und wenn das Wasser wieder niedrig ist, kommen sie auf den Markt zurück.",
    "Le fleuve est haut au printemps et les gens de la ville vont vers lui avec leurs bateaux, comme ils le "
    "font depuis cent ans, et quand l'eau est basse ils reviennent au marché de la place avec les enfants.",
    "El río es alto en la primavera y la gente de la ciudad va a él con sus barcos, como lo hace desde hace "
    "cien años, y cuando el agua es baja otra vez la gente vuelve al mercado de la plaza con los niños.",
]


@pytest.mark.parametrize("prose", PARAGRAPHS)
def test_html_passes_decide_without_marks(prose):
    menu = "".join(f'<li><a href="/{i}">Section number {i}</a></li>' for i in range(9))
    names = "Aldo Brunt Cesk Dorn Eskil Frode Gunt Halm Ivor Jost Kled Lunt Mard"
    page = (
        f"<body><div><ul>{menu}</ul></div><div><h1>Title</h1><p>{prose}</p><p>Short.</p><p>{names}</p>"
        f"<p>{prose}</p></div><div class=ad>{prose}</div><div><ul>{menu}</ul><p>Imprint</p></div></body>"
    )
    want = ["Title", prose, "Short.", names, prose]
    assert html_text.main_text(page) == "\n\n".join(want)
    # Where nothing is long enough alone, blocks that stand together are.
    half = prose[: prose.index(" ", len(prose) // 2)]
    rest = prose[len(half) + 1 :]
    page = f"<div><ul>{menu}</ul></div><div><p>{half}</p><p>{rest}</p></div><div><ul>{menu}</ul></div>"
    assert html_text.main_text(page) == f"{half}\n\n{rest}"
    assert html_text.main_text(f"<div><ul>{menu}</ul></div><div>Only this.</div>") == "Only this."


def test_plans_hold_no_screen(spark):
    """The text of a plan, which the driver keeps for each query, is as small as
    the plan, and windows of all lengths are ranked by the same two joins."""
    run = "\n".join(f"line {i} of a run with many words" for i in range(20))
    rows = [(i, f"head {i}\n{run}\ntail {i}") for i in range(4)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(out._jdf.queryExecution().toString()) < 100_000
    assert [r.n_removed_lines for r in out.orderBy("doc_id").collect()] == [0, 20, 20, 20]


def test_screen_parts_rows(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("k"))
    keys = rows.where("k < 100 or k is null")
    mask = screen(keys, "k")
    kept = screened(rows, mask, "k")
    gone = screened(rows, mask, "k", out=True)
    assert kept.columns == gone.columns == ["k"]
    assert kept.count() + gone.count() == 2000
    assert kept.intersect(keys).count() == keys.distinct().count()
    assert gone.where("k < 100 or k is null").count() == 0
    assert gone.count() > 1600
