import html
import random
import re
import time
from html.parser import HTMLParser

from citespark.llm.html import extract_text, main_text

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><a href=/>Home</a></header>
<div class="cookie-notice">We use cookies. Accept all of them, please.</div><div id="wrap" class="content-with-sidebar">
<div class="post"><h2>Title here</h2><p>First para of the text, with commas and so on. It is long enough to be content.
<p>Second&nbsp;para &amp; more   text, with punctuation; and length. A <b>third</b> sentence here.<ul><li>item one</ul>
<p>Short.</p><form><input><label>Name</label></form></div>
<div class="sidebar"><p>Other posts you may like, very interesting, click now.</p></div>
<div id="comments"><p>Great article, thanks a lot! I liked it, really.</p></div></div><footer>(c) me</footer></body></html>"""


def test_blocks_of_the_article_only():
    assert main_text(PAGE).split("\n") == [
        "Title here", "First para of the text, with commas and so on. It is long enough to be content.",
        "Second para & more text, with punctuation; and length. A third sentence here.", "item one", "Short."]


def test_article_and_main_elements():
    page = ("<nav>Menu one</nav><main><article><header><h1>Head</h1></header><p>One, two.</p><aside>Ad text, here.</aside>"
            "<div class='share-buttons'>Share this, now</div><p>x<script>y</script>z</p><section class=comments><p>So bad, "
            "really bad. I did not like any of it, sorry to say so.</p></section><footer>By me</footer></article></main>")
    assert main_text(page) == "Head\nOne, two.\nxz"
    assert main_text("<article class='comment-page'><p>a<p>b</article><p>outside") == "a\nb"


def test_broken_and_empty_pages():
    for page, text in ((None, ""), ("", ""), (" <", "<"), ("<p", "<p"), ("plain text", "plain text"), ("<script>x<b>", ""),
                       ("<article></article><p>Hello there, you.</p>", "Hello there, you."), ("<b>a</i></b><", "a<"),
                       ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<!-- x --><p>1 &lt; 2</p><!-- open", "1 < 2")):
        assert main_text(page) == text, page


def test_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extract_text(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        body = r["html"][r["html"].index("<article>") + 9:r["html"].index("</article>")]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split("<p>|</p>|</h1>", body)]
        own = got[r["page_id"]]
        assert own["text"] == "\n".join(p for p in parts if p) and own["n_chars"] == len(own["text"])
        assert own["url"] == r["url"]


def test_odd_tables(spark):
    rows = [(1, "u", "<p>a</p>", 3), (1, "u", "<p>a</p>", 4), (None, None, None, 5), (2, None, "", None),
            (3, "v", "<p>" + "long text, yes. " * 50_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = extract_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(str((r[0], r[3])) for r in out.collect()) == sorted(
        map(str, [(1, 1), (1, 1), (None, 0), (2, 0), (3, 16 * 50_000 - 1)]))
    assert extract_text(df.where("false")).count() == 0


def test_hints_do_not_take_the_article():
    story = "<h1>Head</h1><p>The story is told here, at some length, with commas.</p><p>It goes on, and it ends.</p>"
    text = "Head\nThe story is told here, at some length, with commas.\nIt goes on, and it ends."
    nav = "<div class=menu><a href=/>Home</a></div>"
    assert main_text(f"<body><form id=aspnetForm>{nav}<article>{story}</article></form></body>") == text
    assert main_text(f"<body><form id=aspnetForm>{nav}<div>{story}</div></form></body>") == text
    for name in ("overflow-hidden", "hidden-xs post", "post no-comments", "content-with-sidebar", "has-comments"):
        assert main_text(f'<body>{nav}<div class="{name}">{story}</div><div class="hidden">Not to be seen.</div>') == text
    teasers = "".join(f"<article><h3><a href=/{k}>Other {k}</a></h3><p>A teaser, short.</p></article>" for k in "ab")
    assert main_text(f"<body>{nav}<div>{story}</div><div>{teasers}</div></body>") == text
    linked = story.replace("Head", "<a href=/x>Head</a>")
    assert main_text(f"<body>{nav}<div>{linked}</div></body>") == text
    assert main_text(f"<article>{linked}<ul><li><a href=/s>Source</a></ul></article>") == text + "\nSource"


def test_deep_and_broken_pages_end():
    began = time.monotonic()
    for depth in (3_000, 50_000):
        assert main_text("<div>" * depth + "<p>Deep text, here.") == "Deep text, here."
    for n in (4_000, 40_000):
        assert main_text("<a b=" * n) == " ".join(("<a b=" * n).split())
        assert main_text('<a b="' * n + "<p>x, y</p>").endswith("x, y")
        assert main_text("</script " * n).startswith("</script")
        assert main_text("<script></script " * n) == "</script"  # all but the last end tag end in the tag behind
        main_text("<b>" + "<div>" * n + "</b>x" * n)
        main_text("<font>" * n + "<li>a</li>" * n)
        main_text("<!--" * n + "<![CDATA[" * n)
    assert time.monotonic() - began < 60


class Plain(HTMLParser):
    """Blocks of the article element of a well-formed page, without what is named in ``out``."""

    def __init__(self, out=("script", "style", "nav", "aside", "footer")):
        super().__init__()
        self.out, self.depth, self.open, self.blocks = out, 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.out
        self.open += tag == "article"
        if tag not in ("a", "b", "i", "em", "span"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag not in ("a", "b", "i", "em", "span"):
            self.blocks.append("")
        self.depth -= tag in self.out
        self.open -= tag == "article"

    def handle_data(self, data):
        if self.open and not self.depth:
            self.blocks[-1] += data


def test_against_the_parser_of_the_library():
    draw = random.Random(7)
    words = "lorem, ipsum. dolor &amp; sit &lt;amet&gt; caf&eacute; – x".split()

    def inline():
        return " ".join(f"<{t}>{w}</{t}>" if (t := draw.choice(["", "", "b", "a", "span"])) else w
                        for w in draw.choices(words, k=draw.randint(8, 30)))

    for _ in range(200):
        parts = [draw.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li><li>two</li></ul>", "<blockquote><p>{}</p></blockquote>",
                              "<div>{}</div>", "<script>if (a < b) x()</script><p>{}</p>", "<aside>{}</aside>"]).format(inline())
                 for _ in range(draw.randint(1, 8))]
        page = (f"<html><head><title>t</title></head><body><nav><a>Home</a></nav><article><p>One, two. {inline()}</p>{''.join(parts)}"
                f"</article><footer>(c)</footer></body></html>")
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert main_text(page) == "\n".join(t for b in plain.blocks if (t := " ".join(b.split()))), page
