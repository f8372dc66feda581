import random

import pytest

from clusterloom.llm.html_text import extract, main_text

SCHEMA = "page_id long, url string, html string, text string, host string, n_chars string"

ARTICLE = "<article><h1>A &amp; B</h1><p>One\n two&nbsp;three <b>bo</b>ld.<p>Next<br>line<ul><li>x<li>y</ul></article>"
TEXT = "A & B One two three bold. Next line x y"


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("just text", "just text"), ("a < b &lt; c", "a < b < c"),
    (f"<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav>{ARTICLE}<footer>f</footer></body></html>", TEXT),
    (f"<header><h1>Site</h1></header>{ARTICLE}<aside>side</aside><form>Name <input></form>", TEXT),
    (f"<div class='cookie-notice'>We use cookies</div><main>{ARTICLE}</main><div id=comments><article>me too</article></div>", TEXT),
    (f"<div class='page has-sidebar'>{ARTICLE}<div class=sidebar><p>More</div></div>", TEXT),
    (f"{ARTICLE[:-10]}<section class='comments'><p>First!</p></section></article>", TEXT),
    ("<article><header><h1>Kept</h1></header><p>in</p><footer>by me</footer></article>", "Kept in"),
    ("<body><script>var t='</p>';</script><p>a</p><style>p{}</style><!-- <p>no</p> --><p>b</p>", "a b"),
    ("<p>a<script>never ends", "a"), ("<p>a<!-- never ends <p>b", "a"), ("<p>x</i></b>y</p>z", "xy z"),
    ("<div><b><p>one</b> two</p>three</div>", "one two three"), ("<p title='a > b'>q</p>", "q"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("<ul><li><a href=a>Home</a><li><a>News</a></ul><p>See <a>this</a> now</p>", "See this now"),
    ("<P>&copy; &#8212; &#x41;&bogus; 😀</P>", "© — A&bogus; 😀"), ("<article>" + "<div>" * 3000 + "deep", "deep"),
])
def test_one_page(page, text):
    assert main_text(page) == text


def soup(i, draw):
    """A page without any telling element or class."""
    def words(n):
        return " ".join(f"w{draw.randrange(10_000)}" for _ in range(n))

    body = [words(12) for _ in range(3)]
    page = (
        "<body><div class='x1'><span>Welcome to our site</span></div>"
        f"<div class='x2'><p>{body[0]}</p><p>{body[1]}</p><p>All rights reserved here</p><p>{body[2]}</p></div>"
        f"<div class='x3'><div>Call us today</div><div>Open at {'nine' if i % 20 else 'ten'}</div></div></body>"
    )
    return page, " ".join(body)


def test_templates_are_learned_from_the_host(spark):
    draw = random.Random(1)
    made = [soup(i, draw) for i in range(60)]
    rows = [(i, f"http://WWW.a.com/{i}", p, "t", "h", "n") for i, (p, _) in enumerate(made)]
    # copies of one page do not make its text a template
    rows += [(100 + i, "http://www.a.com/c", made[0][0], "t", "h", "n") for i in range(200)]
    rows += [(400 + i, f"http://b.com/{i}", made[i][0], "t", "h", "n") for i in range(3)]
    rows += [(500, None, made[5][0], "t", "h", "n"), (501, "http://a.com", None, "t", "h", "n"), (None, "http://www.a.com/", "", "t", "h", "n")]
    found = extract(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in found.collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == text for i, (_, text) in enumerate(made))
    assert all(got[100 + i].text == made[0][1] for i in range(200))
    for few in (400, 500):  # too few pages to judge by
        assert got[few].text.startswith("Welcome to our site") and "All rights" in got[few].text
    assert got[501].text == got[None].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())
    again = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA), most_broadcast=0).collect()}
    assert again == {k: r.text for k, r in got.items()}


def test_repeated_lines_of_articles_stay(spark):
    pages = [f"<nav>n</nav><article><h1>Head {i}</h1><p>Text {i}</p><p>Very common line</p><div>Shared by</div></article>" for i in range(40)]
    rows = [(i, f"http://a.com/{i}", p, "t", "h", "n") for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Head {i} Text {i} Very common line" for i in range(40)}


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], SCHEMA)).collect() == []
