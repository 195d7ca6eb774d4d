import time

import pytest

from tracemill.llm import html_text


def text(page):
    return "\n".join(html_text.blocks(html_text.roots(html_text.parse(page)), set()))


def test_letters_that_grow_in_lower_case_lose_no_text():
    page = "<article><p>" + "İ" * 40 + "</p><script>var a = '<p>';</SCRIPT><p>after the script</p><style>p{}</style ><p>after the style</p></article>"
    assert text(page).split("\n") == ["İ" * 40, "after the script", "after the style"]


def test_broken_tags_are_read_as_far_as_they_go():
    assert text('<p>one<p title="a>b">two<p title="open>three</p><b>four') == "one\ntwo\nthree\nfour"
    assert text("a < b <1> c <!-- d <p> --> e <!-- f") == "a < b <1> c e"
    assert text("x <!doctype y") == "x <!doctype y" and text("x <b") == "x <b" and text("<p>x<!-- never closed <p>y") == "x"
    assert text("<table><tr><td><p>in</table></p>out") == "in\nout"


@pytest.mark.parametrize(
    "unit",
    ['<a href="', "<b>", "</p>", "<a \"'>", "<", "<a", "<!x ", "<script>", "<a href=\"'>", "<ul><li><b>", "<p><i>", "<td><b></p>", "&amp;", "<!--", "<div class='", "<p class=\"x\" ", "</b", "x<y "],
)
def test_broken_pages_take_time_in_proportion(unit):
    def took(size):
        page = "<p><table>" + unit * (size // len(unit)) + "</p></i>" * (size // 40)
        began = time.process_time()
        text(page)
        return time.process_time() - began

    took(20_000)
    small, large = took(150_000), took(600_000)
    assert large < 8 * small + 0.5  # four times the page; a square would be sixteen times
