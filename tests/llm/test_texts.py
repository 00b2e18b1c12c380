"""Token counts, packing, language and page texts."""

import random
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import llm_brute as brute
import numpy as np
import pytest

from holdfast.llm import html_text, language_id, packing, queries, token_counts

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = [*"ab  \n\t'sdtlevrm.,!?19é² 　漢字ß🙂\x1c\x85İ|<>", "<|endoftext|>", "  ", " \n", "the ", "aaa"]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    odd = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    return [*odd, "", "a" * 3000, " " * 500, "\n" * 50 + " x", "word " * 5000]


@pytest.fixture(scope="module")
def library(texts):
    found = tokenizers.Tokenizer.from_file(JSON).encode_batch(texts, add_special_tokens=False)
    return [x.ids for x in found]


def test_counts_and_ids_equal_the_library(texts, library):
    assert token_counts.counter(JSON)(texts) == [len(x) for x in library]
    encoder = packing.Encoder(RANKS, JSON)
    assert [encoder.encode(t).tolist() for t in texts] == library


def test_count_query_rows(table, given, clashing):
    rows = given.limit(40).unionByName(table([(None, "x y"), (1, None), (1, None), (2, "")]))
    out = token_counts.count_tokens(clashing(rows), JSON).collect()
    library = tokenizers.Tokenizer.from_file(JSON)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))
                   for r in rows.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in out) == want
    assert token_counts.count_tokens(table([]), JSON).collect() == []


def check_pieces(pieces, ids_of, size=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids_of)
    for d, ps in by_doc.items():
        ids, at = np.array([*ids_of[d], packing.END_ID], "<u4"), 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = total = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
        total += at
    return padding / total


def test_packing_round_trip(given, table, clashing):
    extra = table([(90_001, None), (90_002, ""), (90_003, "long text. " * 30_000), (90_004, "x" * 20_000)])
    docs = clashing(given.unionByName(extra))
    library = tokenizers.Tokenizer.from_file(JSON)
    ids_of = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in docs.select("doc_id", "text").collect()}
    pieces = [r.asDict() for r in queries.packed(docs).collect()]
    assert check_pieces(pieces, ids_of) < 0.02
    assert queries.packed(table([])).collect() == []


def test_packing_over_small_blocks():
    draw = np.random.default_rng(3)
    stops = np.zeros(1 << 16, dtype=bool)
    stops[:40] = True
    docs = {d: draw.integers(1, 1000, draw.integers(0, 900)) for d in range(60)} | {99: draw.integers(1, 1000, 30_000)}
    packer, out = packing.Packer(stops, packing.PackRules(size=64, grid=4, block_tokens=1024), 5), []
    for d, ids in docs.items():
        packer.add(d, ids.astype(np.uint16))
        while packer.full():
            out += packer.pack(last=False)
    out += packer.pack(last=True)
    names = [c.split()[0] for c in packing.SCHEMA.split(", ")]
    assert check_pieces([dict(zip(names, p, strict=True)) for p in out], docs, 64) < 0.2
    order = [p[0] for p in sorted(out, key=lambda p: (p[5], p[6]))]
    assert list(dict.fromkeys(order)) == list(docs)


def test_cuts_are_cheapest():
    draw = random.Random(8)
    for _ in range(200):
        cuts = [0, *sorted(draw.sample(range(1, 60), draw.randint(1, 25)))]
        cuts = [c for i, c in enumerate(cuts) if i == 0 or c - cuts[i - 1] <= 16] or [0]
        cuts = [*cuts[:1], *[c for i, c in enumerate(cuts[1:]) if c - cuts[i] <= 16]]
        if any(b - a > 16 for a, b in zip(cuts, cuts[1:], strict=False)) or len(cuts) < 2:
            continue
        prices = [draw.random() * 8 for _ in cuts]
        best = [0.0]
        for k in range(1, len(cuts)):
            best.append(min(
                best[j] + prices[k] + 16 - (cuts[k] - cuts[j]) for j in range(k) if cuts[k] - cuts[j] <= 16))
        assert packing.best_cuts(cuts, prices, 16)[0] == pytest.approx(best)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = language_id.identify(docs).collect()
    assert {r.doc_id for r in out if r.held_out} == {d for d in lang if zlib.crc32(str(d).encode()) % 3 == 1}
    right = [r.lang_pred == lang[r.doc_id] for r in out if r.held_out]
    assert sum(right) / len(right) > 0.98 and all(0 <= r.score <= 1 for r in out)
    hidden = language_id.identify(docs.selectExpr(
        "doc_id", "text", "if(crc32(cast(doc_id as string)) % 3 = 1, 'xx', lang) lang", "'s' source")).collect()
    assert {r.doc_id: r.lang_pred for r in hidden} == {r.doc_id: r.lang_pred for r in out}


def test_language_of_odd_rows(table, odd_rows, clashing):
    rows = [*odd_rows, (None, "abc abc", "en"), (400, "12 34 !", "en")]
    out = {r.doc_id: r for r in language_id.identify(clashing(table(rows))).collect()}
    assert len(out) == len(rows)
    assert all(out[d].lang_pred == "und" and out[d].score == 0 for d in (300, 301, 302, 400))
    assert out[None].lang_pred in ("en", "de") and not out[None].held_out
    assert {r.lang_pred for r in language_id.identify(table([(1, "abc", None), (3, None)])).collect()} == {"und"}
    assert language_id.identify(table([])).collect() == []


PAGE = """<!doctype html><html><head><title>t</title></head><body class="home"><div id="top-nav" class="navbar">
<a href=/>Home</a></div><div class="cookie-notice">We use cookies</div><div class="layout">
<div class="post-{n} content"><h1>Title &amp; more</h1><div class="body"><p>First para
 with   <b>bold</b> &lt;tag&gt; text&nbsp;here {n}.<p>Second para <a href="x">link</a> tail<ul><li>one<li>two</ul>
<div class="ad">buy</div><script>x("</div>")</script><blockquote><p>Quote</p></blockquote><p>a<br>b</p></div></div>
<aside class=sidebar>side text side text</aside><section id="comments"><p>Nice post, a long comment. Nice.</p></section>
</div><form><p>Subscribe</p></form><footer>foot</footer></body></html>"""
TEXT = "Title & more\nFirst para with bold <tag> text here {n}.\nSecond para link tail\none\ntwo\nQuote\na b"


def test_page_texts(table):
    short = '<html><body><div class="layout"><div class="post-9 content"><p>' + "hi " * 60 + '</p></div><div class="x">' + "word " * 90 + "</div></div></body></html>"
    rows = [(n, f"http://h.example/{n}", PAGE.replace("{n}", str(n))) for n in range(5)]
    rows += [(9, "https://user@H.example:80/9", short), (10, None, "<p>a&nbsp;b"), (11, "odd", None), (12, "http://h.example", ""),
             (None, "http://x/", "<!-- open <p>x"), (13, "http://y/", "<p>" * 3000 + "deep")]
    out = {r.page_id: r for r in html_text.main_texts(table(rows, "page_id bigint, url string, html string")).collect()}
    assert len(out) == len(rows)
    assert all(out[n].text == TEXT.replace("{n}", str(n)) and out[n].n_chars == len(out[n].text) for n in range(5))
    assert out[9].text == " ".join(["hi"] * 60)  # the host's path, although the page's own best container is another
    assert (out[10].text, out[11].text, out[12].text, out[None].text, out[13].text) == ("a b", "", "", "", "deep")
    assert html_text.main_texts(table([], "page_id bigint, url string, html string")).collect() == []


@pytest.mark.parametrize("mark", [
    "<svg-icon name=x></svg-icon>", "<button-group></button-group>", "<title-card></title-card>", '<svg class="share" />',
    "<math/>", "<svg viewBox='0 0 1 1'>", '<button class="share">', "<select>", "<button><button>x</button>", "<template>",
    "<svg><svg/><g>x</g></svg>", "<noscript>x</noscript>",
])
def test_page_goes_on_after_hidden_tags(mark):
    page = f"<body><article><p>one</p>{mark}<p>two</p><svg><text>drawn</text></svg><p>three</p></article></body>"
    assert html_text.extract(page, []) == ("one\ntwo\nthree", "/body/article")
    for raw in ("script", "style", "title", "textarea"):
        assert html_text.extract(f"<body><p>one</p><{raw}>two <p>three", [])[0] == "one"


@pytest.mark.parametrize(("inner", "path", "sizes"), [
    ("<main><div class=lead>{a}</div><div class=rest>{b}</div></main>", "/body/main", (60, 40)),
    ("<header><h1>T</h1></header><main><p>{a}</p><div>{b}</div></main>", "/body/main", (40, 60)),
    ("<div class=post>{a}</div><article class=card>{b}</article>", "/body/div.post", (95, 5)),
    ("<article><div class=one>{a}</div><div class=two>{b}</div></article>", "/body/article", (70, 30)),
    ("<article class=part>{a}</article><article class=part>{b}</article>", "/body", (50, 50)),
    ("<div class=post>{a}</div><div class=sidebar>{b}</div>", "/body/div.post", (30, 70)),
])
def test_page_parts_beside_each_other(inner, path, sizes, table):
    a, b = ("word " * n for n in sizes)
    page = f"<body>{inner.format(a=a, b=b)}</body>"
    whole = path in ("/body", "/body/main", "/body/article")
    rows = [(i, f"http://h.example/{i}", page) for i in range(3)]  # the path wins its host
    for r in html_text.main_texts(table(rows, "page_id bigint, url string, html string")).collect():
        assert r.path == path and r.text.count("word") == (sum(sizes) if whole else sizes[0])


STORY = "<h1>Title here</h1><p>" + "word " * 60 + "</p><p>" + "more " * 40 + "</p>"
STORY_TEXT = "Title here\n" + " ".join(["word"] * 60) + "\n" + " ".join(["more"] * 40)
NAV = "<nav><a href=/>home</a></nav>"


@pytest.mark.parametrize("page", [
    f"<body><form id=aspnetForm><input type=hidden name=state>{NAV}<div class=c>{STORY}</div></form></body>",
    f"<body><form id=aspnetForm><textarea>x</textarea>{NAV}{STORY.replace('h1', 'h2')}</form></body>",
    f'<body><div class="post comments-open">{STORY}</div></body>',
    f'<body><div class="page header-fixed">{NAV}<div class=c>{STORY}</div></div></body>',
    f'<body><div class="page nav-open" role=form><form><input></form><div class=c>{STORY}</div></div></body>',
    f'<body><article><div class="menu-of-the-day">{STORY}</div></article></body>',
    f'<body><div id="main-menu">x</div><div class="ad">y</div>{STORY}<div class="cookie-banner">c</div><div class="newsletter-signup">n</div></body>',
    f'<body>{STORY}<div class="ad-leaderboard">Buy now</div><div class="share-2024"><a href=x>a</a> <a href=y>b</a></div></body>',
    f'<body><article>{STORY}</article><div class=comments><article>{"<p>long reply</p>" * 200}</article></div></body>',
    f'<body><div class=post>{STORY}<section class="comment-list">{"<p>long reply</p>" * 200}</section></div></body>',
    f"<body><article>{STORY}<form><p>Ask us</p><input></form></article></body>",
])
def test_articles_are_not_lost_to_names_and_forms(page):
    assert html_text.extract(page, [])[0] == STORY_TEXT


def test_parts_with_boilerplate_words_among_others_stay():
    body = '<p class="share-price">The price rose.</p><section id="related-work"><h2>Related</h2><p>{}</p></section>'
    page = f"<body><article><h1>T</h1><p>{'a ' * 30}</p>{body.format('x ' * 30)}</article></body>"
    text = html_text.extract(page, [])[0].split("\n")
    assert text[0] == "T" and text[2:] == ["The price rose.", "Related", " ".join(["x"] * 30)]


@pytest.mark.parametrize(("inline", "want"), [
    ('abc <span class="ad">X</span> def', "abc def"), ('abc <b class="share">q<b>r</b> s</b>def', "abc def"),
    ('abc <span class="ad">X', "abc"), ('abc <span class="share-price">9</span> def', "abc 9 def"),
])
def test_inline_boilerplate_does_not_end_its_block(inline, want):
    assert html_text.extract(f"<body><p>{inline}</p><p>next</p></body>", [])[0] == f"{want}\nnext"


def test_host_path_needs_a_share_of_the_page():
    page = f"<body><article class=card>one two three four five</article><div class=post>{'word ' * 80}</div></body>"
    assert html_text.extract(page, ["/body/article.card", "/body/div.post"])[1] == "/body/div.post"
    assert html_text.extract(page, ["/body/article.card"])[1] == "/body/div.post"


class Article(HTMLParser):
    """Blocks of the generator's one <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.part, self.depth, self.hidden = [], "", 0, 0

    def flush(self):
        if self.depth and self.part.split():
            self.blocks.append(" ".join(self.part.split()))
        self.part = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "br":
            self.part += " "
        elif tag in html_text.BLOCK_TAGS:
            self.flush()
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden -= 1
        elif tag in html_text.BLOCK_TAGS:
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        self.part += "" if self.hidden else data


def test_all_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_texts(pages).collect()}
    for r in pages.collect():
        plain = Article()
        plain.feed(r.html or "")
        plain.close()
        assert got[r.page_id] == "\n".join(plain.blocks), r.page_id


def test_repeated_pages_and_clashing_columns(table, clashing):
    rows = [(1, "http://a.example/1", f"<body><article>{STORY}</article></body>")] * 3 + [(None, None, None)]
    df = clashing(table(rows, "page_id bigint, url string, html string")).selectExpr("*", "'x' AS host", "'x' AS paths", "'x' AS path")
    out = [tuple(r) for r in html_text.main_texts(df).select("page_id", "text", "n_chars").collect()]
    assert sorted(out, key=str) == sorted([(1, STORY_TEXT, len(STORY_TEXT))] * 3 + [(None, "", 0)], key=str)


def test_languages_equal_plain_centroids(given, table):
    """Every prediction against plain TF-IDF vectors and spherical means in Python's own numbers."""
    odd = [(10_001, "12 34", "en"), (10_002, "Straße ÄÖÜ straße", "de"), (10_003, "漢字 漢字", None),
           (10_004, "zz " * 3000, None), (10_005, None, "fr"), (10_006, "", "fr"), (None, "the and of", "en")]
    rows = [(r.doc_id, r.text, r.lang) for r in given.collect()] + odd
    learn = [(d, t, x) for d, t, x in rows
             if d is not None and zlib.crc32(str(d).encode()) % 3 != 1 and t is not None and x is not None]
    vector, centres, floors = brute.language_model(learn)
    out = {r.doc_id: r for r in language_id.identify(table(rows)).collect()}
    assert len(out) == len(rows)
    for d, t, _ in rows:
        got = out[d]
        if t is None or not any(map(str.isalpha, t)):
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        own = vector(t)
        score = {x: max(brute.cosine(own, c) for y, c in centres if y == x) for x in floors}
        best = max(score.values())
        assert got.score == pytest.approx(best, abs=2e-4) and score[got.lang_pred] == pytest.approx(best, abs=2e-4)
        if abs(best - floors[got.lang_pred]) > 2e-4:
            assert got.rejected == (best < floors[got.lang_pred])
