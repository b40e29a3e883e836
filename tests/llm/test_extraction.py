import html
import re

import pytest

from tideline.llm import extraction as E

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:"</p>"}</style><script>var t="</p><p>x";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div class='cookie-notice'><p>Cookies</p></div>
<article><h1>Head &amp;  line</h1><p><b>One<br>two<p>Three &lt;b&gt; 4 < 5 &copy; x</p><ul><li>a<li>b</ul><form><input><button>Go</button></form>
<div id="comments"><p>Reader</p></div><pre> k  v </pre></article><aside>Side</aside><footer>Foot</footer></body></html>"""


def test_article():
    assert E.main_text(PAGE) == "Head & line\nOne two\nThree <b> 4 < 5 © x\na\nb\nk v"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a", "a"), ("<p>a</div></p><p>b</p></section>", "a\nb"),
    ("<main><p>m</p></main><p>x</p>", "m"), ("<p>cut <a href=\"x", "cut"), ("a<script>never closed", "a"), ("<p>x<!-- open", "x"),
    ("<nav>m</nav>", ""), ("<header>h</header><article><header><h1>t</h1></header><p>b</p></article>", "t\nb"), ("<p>&#x41;&nbsp;&am b</p>", "A &am b"),
    ("<div class=content><span>i</span>n<b>l</b>ine</div>", "inline"), ("<<p>a>b</p>", "< a>b"),
])
def test_cases(page, text):
    assert E.main_text(page).replace("\n", " ") == text.replace("\n", " ")


def test_long_page():
    body = "".join(f"<p>w{i} x</p>" for i in range(20000))
    assert E.main_text(f"<article>{body}</article>").count("\n") == 19999
    assert E.main_text("<" * 20000 + "<a " * 5000) is not None


def test_all_pages_against_plain_expressions(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in E.extract(pages).collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
        assert r.text == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_repeated_branches_go_and_varied_ones_stay(spark):
    def page(i):
        return f"<body><div class='zone'><p>Same on every page</p></div><div class='story{i}'><p>Text {i} of its own</p><p>A shared paragraph</p></div></body>"

    rows = [(i, f"https://A.example/{i}", page(i), "h") for i in range(40)] + [(100, "https://b.example/1", page(1), "h"), (101, None, page(2), "h"), (102, "https://a.example/c", None, "h"), (103, "https://a.example/3", page(3), "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in E.extract(pages).collect()}
    assert got[7].text == "Text 7 of its own\nA shared paragraph" and got[7].host == "a.example"
    assert got[100].text.startswith("Same on every page")  # one page tells nothing of its host
    assert got[101].text.startswith("Same") and got[102].text == "" and got[103].text == got[3].text
    assert E.extract(pages.limit(0)).count() == 0


def test_copies_of_a_page_keep_their_article(spark):
    same = "<body><article class='x'><p>One text that a host repeats.</p></article></body>"
    rows = [(i, f"http://c.example/{i}", same) for i in range(30)]
    out = E.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in out.collect()} == {"One text that a host repeats."}
