"""Pure functions: the cutter, balance, the allowlist, and columns by cases."""

import random
import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docloom.functions import layout as L
from docloom.functions import lexer, marks
from docloom.functions import markdown as M
from docloom.functions import text as T
from docloom.functions.sanitizer import ALLOWED, DROPPED, handler, sanitize, text_handler
from docloom.sources import sinks
from docloom.sources.pdf import Pdf, SplitError, simple_pdf
from docloom.streaming.live import Cutter, Document, advance, paints


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_cutter():
    assert lexer.cut_blocks("<h3>Cost</h3>\n<dl><dt>rent</dt> <dd>12") == (["<h3>Cost</h3>"], "<dl><dt>rent</dt> <dd>12")
    assert lexer.cut_blocks("<p>rain <em>and <u>wind</u></em></p>after<pre>x</pre>")[0] == ["<p>rain <em>and <u>wind</u></em></p>", "<p>after</p>", "<pre>x</pre>"]
    assert lexer.cut_blocks("words first<br><h2>y</h2>")[0] == ["<p>words first</p>", "<br>", "<h2>y</h2>"]
    assert lexer.cut_blocks("3 < 4 and more") == (["<p>3</p>"], "< 4 and more")
    assert lexer.cut_blocks(" \n ") == ([], "")
    assert lexer.cut_blocks("<img alt='a > b'><td>z</td>")[0] == ["<img alt='a > b'>", "<td>z</td>"]


def test_normalize_and_balance():
    assert lexer.normalize("<h4>odd</h5>") == ["<p>odd</p>"]
    assert lexer.normalize("  no markup at all ") == ["<p>no markup at all</p>"]
    assert lexer.is_single_block("<ul id='list-2'><li>q<br></li></ul>", "list-2")
    for bad, ident in (("<h2 id=t>1</h2><h2>2</h2>", "t"), ("<h2 id=t>1</h3>", "t"), ("<h2 name='t'>1</h2>", "t"), ("<h2 id='-t'>1</h2>", "-t"), ("text", "t"), ("<h2 id=t>1", "t")):
        assert not lexer.is_single_block(bad, ident)


def test_provisional():
    html, n = lexer.provisional("<ol start=3><li>mon</li><li>tue</li><li>we")
    assert n == 2 and html == "<ol start=3><li>mon</li><li>tue</li></ol>"
    assert lexer.provisional("<dl><dt>wor") is None
    assert lexer.provisional("<h2>half a head") is None
    html, n = lexer.provisional("<table><tbody><tr><td>7</td></tr><tr><td>8</td></tr><tr><td>")
    assert (html, n) == ("<table><tbody><tr><td>7</td></tr><tr><td>8</td></tr></tbody></table>", 2)


@pytest.mark.parametrize(
    ("page", "clean"),
    [
        ('<h2 class="big" onfocus="run()">Fruit<style>h2{}</style><a title="t" href="ftp://files.test/x">old</a> <a href="mailto:a@b.test">mail</a></h2>', '<h2>Fruit<a title="t">old</a> <a href="mailto:a@b.test" rel="noopener noreferrer nofollow">mail</a></h2>'),
        ("<main><section><ul><li hidden>1</li></ul></section></main>", "<ul><li>1</li></ul>"),
        ("<img src='https://pics.test/1.png' srcset='x' width=4 onerror=go>", '<img src="https://pics.test/1.png" width="4">'),
        ('<p data-bbox="0,0,9,9" data-other="1">box</p>', '<p data-bbox="0,0,9,9">box</p>'),
        ("<blockquote>R&amp;D &lt;tag&gt;", "<blockquote>R&amp;D &lt;tag&gt;"),
        ("<noscript><p>no</p></noscript><button>press</button>kept<math><mi>x</mi></math>", "kept"),
        ('<a href="  data&colon;text/html,x">d</a>', "<a>d</a>"),
        ("cut off <ifra", "cut off "),
        ("", ""),
    ],
)
def test_sanitizer(page, clean):
    assert sanitize(page) == clean
    assert sanitize(clean) == clean


class Reader(HTMLParser):
    """What an allowlist must leave of a page, by the standard library's parser: text as written, and start tags."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.text, self.starts, self.hidden = [], [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            if tag not in lexer.VOID:
                self.hidden.append(tag)
        elif not self.hidden and tag in ALLOWED:
            self.starts.append(tag)

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()

    def put(self, raw):
        if not self.hidden:
            self.text.append(raw)

    handle_data = put

    def handle_entityref(self, name):
        self.put(f"&{name};")

    def handle_charref(self, name):
        self.put(f"&#{name};")


def test_pages_against_the_standard_parser():
    """Sanitized pages and their blocks hold the text and the allowed elements of the page, in order, and nothing else."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    squeezed = lambda x: "".join(x.split())
    for page in pages:
        expected = Reader(page)
        clean = sanitize(page)
        assert squeezed(re.sub("<[^>]*>", "", clean)) == squeezed("".join(expected.text))
        assert re.findall("<([a-z0-9]+)", clean) == expected.starts
        assert not re.search(r'<[^>]*(?: on[a-z]+=|href="/|style=|class=)', clean)
        blocks = lexer.normalize(sanitize(lexer.strip_fence(page)))
        assert all(map(lexer.is_complete, blocks))
        assert squeezed(re.sub("<[^>]*>", "", "".join(blocks))) == squeezed("".join(expected.text))


def test_handlers():
    hide = text_handler("*", lambda t: t.replace("room 17", "room #"))
    assert sanitize("<h3>In room 17 <u>now</u></h3>", (hide,)) == "<h3>In room # <u>now</u></h3>"
    assert sanitize("<li>fish &amp; chips</li>", (text_handler("*", lambda t: t),)) == "<li>fish &amp; chips</li>"
    seen = []
    sanitize("<h4>y<style>.hidden{}</style></h4>", (text_handler("*", lambda t: seen.append(t) or t),))
    assert ".hidden{}" in seen
    marked = handler("li", lambda: {"element": lambda e: e.set("data-page", "4")})
    assert sanitize("<ul><li>z</li></ul>", (marked,)) == '<ul><li data-page="4">z</li></ul>'


def test_chunk_borders_change_nothing():
    page = "```html\n<h1>A</h1><p>b <i>c</i></p>loose<table><tr><td>1</td></tr></table><script>x</script> tail\n```"
    whole = Cutter()
    expected = whole.feed(page) + whole.flush()
    rng = random.Random(1)
    for _ in range(200):
        cuts = sorted(rng.sample(range(len(page)), 6))
        c, out = Cutter(), []
        for a, b in zip([0, *cuts], [*cuts, len(page)]):
            out += c.feed(page[a:b])
        assert out + c.flush() == expected


def test_advance_orders_and_ignores_repeats():
    state, first = advance(None, [(1, "b</p>", False), (0, "<p>a", False)])
    state, again = advance(state, [(0, "<p>a", False), (2, "<p>c", True)])
    kinds = [e["type"] for e in first + again]
    assert kinds == ["progress", "append", "append", "done"] and [e["seq"] for e in first + again] == [1, 2, 3, 4]
    assert first[1]["html"] == '<p id="block-1">ab</p>'
    assert advance(state, [(3, "<p>late</p>", False)])[1] == []


def test_live_parts():
    """Rows of an open table are shown as they finish, a later attempt starts anew, and silence ends a part in its place."""
    doc = Document()
    doc.start("page", 3)
    assert [e["type"] for e in doc.events] == ["append"] * 3 + ["progress"] and "Converting page 2 of 3" in doc.events[1]["html"]
    doc.chunk(1, 0, "<table><tr><td>a</td></tr><tr><td>b", False, 0, None, 0)
    assert doc.events[-1]["html"].endswith("<table><tr><td>a</td></tr></table></div></section>")
    doc = Document(doc.saved())
    doc.chunk(1, 0, "<p>again</p>", False, 1, None, 10)
    doc.chunk(1, 2, "", True, 1, None, 20)
    doc.chunk(1, 1, "tail", False, 1, None, 30)
    doc.chunk(1, 1, "late", False, 0, None, 40)
    assert doc.events[-1]["html"].endswith('of 3"><p>again</p><p>tail</p></section>')
    doc.chunk(2, 0, "", False, 0, "model is down", 50)
    assert "Page 2 could not be converted. model is down" in doc.events[-1]["html"] and not doc.done
    doc.silent(90_049, 90_000)
    assert doc.done and "Page 3 could not be converted. page 3 produced no output for 90s." in doc.events[-2]["html"] and doc.events[-1]["type"] == "done"


def test_silent_documents():
    doc = Document()
    doc.start(None, None)
    doc.chunk(0, 0, "<p>a</p>", False, 0, None, 1_000)
    doc.silent(60_000, 90_000)
    assert not doc.done and doc.next_idle(60_000, 90_000) == 31_000
    doc.silent(91_000, 90_000)
    assert doc.events[-1]["message"] == "The parser produced no output for 90s." and doc.done


def test_open_tables_are_read_once():
    scanner, size = lexer.Scanner(), []
    scanner.feed("<table>")
    for i in range(3000):
        scanner.feed(f"<tr><td>{i}</td></tr>")
        size.append(len(scanner.tail))
    assert scanner.finished() == 3000 and max(size) == 0
    assert len(scanner.feed("</table>")) == 1


def test_encrypted_pdf_keeps_numbers():
    plain = simple_pdf([(200, 200), (300, 400)])
    locked = plain.replace(b"trailer\n<<", b"9 0 obj\n<< /Filter /Standard /V 1 >>\nendobj\ntrailer\n<< /Encrypt 9 0 R /ID [<01> <01>]")
    page = Pdf(locked).page(2)
    assert b"4 0 obj" in page and b"/Encrypt 9 0 R" in page and b"/ID [<01> <01>]" in page and b"9 0 obj" in page
    assert len(Pdf(page).pages) == 1


def test_upload_pages():
    page = sinks.landing_html("Docs & more", "/s", ("image/png",))
    assert "Docs &amp; more" in page and 'accept="image/png"' in page and "script" not in page
    assert '<p role="alert">a &lt; b</p>' in sinks.message_html("t", "a < b") and "'sha256-" in sinks.content_policy()


def test_paints():
    assert paints([(0, 10), (50, 100), (130, 100), (2000, 101), (2010, 102)]) == [0, 2, 3, 4]


def test_pdf():
    file = Pdf(simple_pdf([(200, 200), (300, 400)]))
    assert len(file.pages) == 2
    second = Pdf(file.page(2))
    assert len(second.pages) == 1 and b"[0 0 300 400]" in file.page(2)
    with pytest.raises(SplitError):
        Pdf(b"nothing")
    with pytest.raises(SplitError):
        file.page(3)


def test_markdown_cut():
    assert lexer.cut_markdown("a\n\n```\nx\n\ny\n```\nb") == (["a", "```\nx\n\ny\n```"], "b")


@pytest.mark.parametrize(
    ("block", "html"),
    [
        ("### Weather *now*\nnot kept", "<h3>Weather <em>now</em></h3>"),
        ("####### seven", "<p>####### seven</p>"),
        ("* tea\n\n+ milk\nplain", "<ul><li>tea</li><li>milk</li><li>plain</li></ul>"),
        ("7) seven\n8. eight", "<ol><li>seven</li><li>eight</li></ol>"),
        (">so\n> it _goes_", "<blockquote><p>so it <em>goes</em></p></blockquote>"),
        ("_____", "<hr>"),
        ("~~~\nif x > 1 & y:\n  go\n~~~", "<pre><code>if x &gt; 1 &amp; y:\n  go</code></pre>"),
        ("|day|`rain`|\n|:--|--:|\n|mon|**2**|\n\n|tue|", '<table><thead><tr><th scope="col">day</th><th scope="col"><code>rain</code></th></tr></thead><tbody><tr><td>mon</td><td><strong>2</strong></td></tr><tr><td>tue</td></tr></tbody></table>'),
        ("![a map](http://maps.test/1)", '<figure><img src="http://maps.test/1" alt="a map"><figcaption>a map</figcaption></figure>'),
        ("![](maps/1.png)", "<figure><figcaption>Figure</figcaption></figure>"),
        ("[Chart : rain by day]", "<figure><figcaption>rain by day</figcaption></figure>"),
        ("<aside>as it is</aside>", "<aside>as it is</aside>"),
        ("go [home](http://home.test/a_b) or\nstay_here", '<p>go <a href="http://home.test/a_b">home</a> or stay_here</p>'),
        (" \n", ""),
    ],
)
def test_markdown_blocks(spark, block, html):
    assert one(spark, M.block_html(F.lit(block)))[0] == html


def test_layout(spark):
    e = one(spark, L.decode_div(F.lit("<DIV data-label='LIST-ITEM' data-page=' 12 ' data-bbox='-2.5 7,8.49;9'>4. x</DIV> ")).alias("e")).e
    assert (e.label, e.bbox, e.page, e.content) == ("List-item", None, 12, "4. x")
    e = one(spark, L.decode_div(F.lit('<div data-bbox="[-2.5,0, 7e1 ,8.5]" data-label="page_footer" data-page="0">f</div>')).alias("e")).e
    assert (e.label, list(e.bbox), e.page, e.content) == ("Page-footer", [-2, 0, 70, 9], None, "f")
    e = one(spark, L.decode_div(F.lit('<div data-bbox=", 5,6,7" data-label="drawing">no div end')).alias("e")).e
    assert (e.label, list(e.bbox), e.page, e.content) == ("Text", [0, 5, 6, 7], None, "no div end")
    assert one(spark, L.decode_div(F.lit("loose")).alias("e")).e.content == "loose"


@pytest.mark.parametrize(
    ("label", "content", "html"),
    [
        ("Title", "## On *rain*", "<h1{}>On <em>rain</em></h1>"), ("Section-header", "Wind", "<h2{}>Wind</h2>"), ("List-item", "- dry", "<li{}>dry</li>"), ("List-item", "2020", "<li{}>2020</li>"),
        ("Formula", "$$ a < b $$", "<pre{}><code>a &lt; b</code></pre>"), ("Picture", "see [chart: clouds ]", "<figure{}><figcaption>clouds</figcaption></figure>"), ("Picture", "![](x)", "<figure{}><figcaption>Figure</figcaption></figure>"),
        ("Picture", "[a] tree", "<figure{}><figcaption>a tree</figcaption></figure>"), ("Table", "<table><tr></tr></table>", "<table><tr></tr></table>"), ("Table", "a | b", "<p{}>a | b</p>"), ("Footnote", "1 & 2", "<p{}>1 &amp; 2</p>"),
        ("Page-header", "p. 3", ""), ("Text", "  ", ""),
    ],
)
def test_layout_elements(spark, label, content, html):
    element = F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, (1, 2, 3, 4))).alias("bbox"), F.lit(5).alias("page"), F.lit(content).alias("content"))
    assert one(spark, L.render(element))[0] == html.format(' data-page="5" data-bbox="1,2,3,4"')
    if label == "Page-header":
        assert one(spark, L.render(element, furniture=True))[0] == '<p data-page="5" data-bbox="1,2,3,4">p. 3</p>'


def test_inline_marks():
    assert marks.inline(" a*b*c (*d*) _e f_ *g * **h** ") == "a*b*c (<em>d</em>) <em>e f</em> <em>g </em> <strong>h</strong>"
    assert marks.inline("``x`y` &#39; &nope & <i>") == "`<code>x</code>y` &#39; &amp;nope &amp; &lt;i&gt;"
    assert marks.inline("[x](ftp://a) [[y](https://b.test) [](http://c) [z](https://)") == '[x](ftp://a) <a href="https://b.test">[y</a> [](http://c) [z](https://)'
    assert marks.inline("`_a_`") == "<code>_a_</code>" and marks.inline("***b**") == "*<strong>b</strong>"


def test_text(spark):
    r = one(spark, T.escape_html(F.lit("<&\"'>")), T.stamp_figure_page(F.lit('<figure data-page="9">x</figure>'), F.lit(2)), T.media_type(F.lit("a/b.JPG")), T.media_type(F.lit("none")), T.title_of(F.lit(None).cast("string")), T.is_safe_url(F.lit(" HTTPS://x")), T.with_root_id(F.lit('<p class="a" id="old">x</p>'), F.lit("new")))
    assert list(r) == ["&lt;&amp;&quot;&#39;&gt;", '<figure data-page="2">x</figure>', "image/jpeg", None, "document", True, '<p id="new" class="a">x</p>']
