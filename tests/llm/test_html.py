"""Pages that are broken, hostile, or without a telling element around their article."""

import time

import pytest

from athenor.functions.storage import table
from athenor.llm import html_crf

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return html_crf.train()


def texts(html):
    return [b.text for b in html_crf.leaf_blocks(html)]


@pytest.mark.parametrize("unit", ["<a ", "</x ", "<script ", "<svg a='", '<a b="', "<a b='\"", "<!", "<!-- ", "<a <a x=\">\"", "'<a =\"", "<textarea></textarea", "<p title=it's>x", "&<>", "<div>", "</"])
def test_reading_takes_time_in_proportion_to_the_page(unit):
    start = time.process_time()
    html_crf.leaf_blocks(unit * (2_000_000 // len(unit)))
    assert time.process_time() - start < 20


def test_quotation_marks_count_after_an_equals_sign_only():
    assert texts("<p title=it's>First paragraph here.</p><p>Second one, it's long.</p><p>Third.</p>") == ["First paragraph here.", "Second one, it's long.", "Third."]
    assert texts("<p a='>' b = \">\" it's>one<p \">two<p x='a\"b'>three") == ["one", "two", "three"]
    assert texts('<p x="never closed>one</p><p>two</p>') == ["one", "two"]
    assert texts("a <b>c</b> < d <p <q>e<!doctype x><? y ?></ z>f<!-- <p>g</p> -->h") == ["a c < d", "efh"]
    assert texts("<script>a</script><SCRIPT x='>'>b</ScRiPt >c<style>d</styles></style>e<textarea>f") == ["ce"]
    assert texts("one<p") == ["one"] and texts("one <") == ["one <"] and texts("<p") == []


def test_articles_in_plain_elements(model):
    rest = ('<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>', "<footer>&copy; x.example</footer>")
    body = "<h1>A heading here</h1><p>First paragraph of the text, with words.</p><p>Second one is here too.</p><p>Third closes it.</p>"
    want = "A heading here\nFirst paragraph of the text, with words.\nSecond one is here too.\nThird closes it."
    for wrap in ("<div>{}</div>", '<div id="wrap"><div>{}</div></div>', "<table><tr><td>{}</td></tr></table>", "<section>{}</section>", "{}", '<div class="' + "x" * 40 + '">{}</div>'):
        assert model.extract(f"<html><body>{rest[0]}{wrap.format(body)}{rest[1]}</body></html>")[0] == want, wrap


def test_pages_of_the_table_without_their_article_element(spark, model):
    """The same texts, to a fiftieth, when every ``article`` is a plain ``div``."""
    pages = [r.html for r in table(spark, FOLDER, "pages").select("html").collect()]
    same = [model.extract(h)[0] == model.extract(h.replace("<article>", "<div>").replace("</article>", "</div>"))[0] for h in pages]
    assert sum(same) >= 0.98 * len(same)
