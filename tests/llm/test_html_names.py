import pytest

from clusterloom.llm.html_text import main_text

LONG = "<p>" + "many words of text " * 5 + "</p>"
TEXT = ("many words of text " * 5).strip()


@pytest.mark.parametrize(("page", "text"), [
    ("<article><h2 id='related-work'>Related work</h2><p>a</p></article>", "Related work a"),
    ("<article><section id='search-algorithms'>b</section><p id='social-impact'>c</p></article>", "b c"),
    ("<article><header class='entry-header'><h1>Head</h1></header><p>d</p></article>", "Head d"),
    ("<article><p data-role='menu'>e</p></article>", "e"),
    (f"<article>{LONG}<div class='share'>f</div></article>", TEXT),
    (f"<div class='content has-sidebar'>{LONG}<div class='sidebar'>g</div></div>", TEXT),
    (f"<body><form id='aspnetForm'><nav>n</nav><article>{LONG}</article></form></body>", TEXT),
    (f"<body><form>{LONG}<form>Name <input></form></form></body>", TEXT),
    (f"<body>{LONG}<form>Name <input></form></body>", TEXT),
])
def test_names_and_forms_lose_no_main_text(page, text):
    assert main_text(page) == text
