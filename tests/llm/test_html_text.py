from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from surveyframe.llm import html_text
from surveyframe.llm.html_text import visible_text

PAGES = [
    ("", ""), ("plain & simple", "plain & simple"), ("a&amp;b &lt;c&gt; &eacute;", "a&b <c> é"),
    ("<p>one<p>two", "one\n\ntwo"), ("<div>one</div><div>two</div>", "one\ntwo"),
    ("a<br>b<br><br>c", "a\nb\n\nc"), ("<b>a</b> <i>b</i>c", "a bc"), ("a <b> b</b>", "a b"),
    ("<title>no</title><script>if (a < b) x('</p>')</script>yes<style>p{}</style>", "yes"),
    ("x<!-- no <p> -->y<!DOCTYPE html>z", "xyz"),
    ("<p hidden>no</p><p>yes", "yes"), ("<div style='DISPLAY : none'><p>no</div>yes", "yes"),
    ('<span style="visibility:hidden">no</span>yes<input type=hidden value=no>', "yes"),
    ("<div hidden=until-found>yes</div>", "yes"),
    ("<p>a<div>b</div>c", "a\n\nb\nc"),
    ("<ul><li>a<li>b</ul>", "- a\n- b"),
    ("<ol start=3><li>a<p>more</p><li>b</ol>", "3. a\n\n   more\n4. b"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"),
    ("<table><caption>t</caption><thead><tr><th>a</thead><tbody><td>b</table>x", "t\na\nb\n\nx"),
    ("<table><tr><td colspan=2>a<td>b<tr><td>cc<td>d<td>e</table>", "a      | b\ncc | d | e"),
    ("<table><tr><td>a<br>b<td>c</table>", "a | c\nb |"),
    ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in | out"),
    ("<pre> a\n  b</pre>c", " a\n  b\n\nc"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<select><option>a<option>b</select>", "a\nb"), ("<textarea> <b>x</textarea>", " <b>x"),
    ("</p></div></table>x", "x"), ("<p>a</b></i>b", "ab"), ("<td>a<tr>b", "ab"),
    ("a < b and c > d", "a < b and c > d"), ("<h1>a<h2>b", "a\n\nb"), ("<script>no", ""),
    ("<head><meta><title>no</title><p>yes", "yes"), ("<a title='x > y'>z</a>", "z"),
    ("<P>A<BR/>B</P>", "A\nB"), ("a<hr>b", "a\n\nb"), ("<noscript>no</noscript>yes", "yes"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_layout(html, text):
    assert visible_text(html) == text.strip("\n")


TAGS = st.sampled_from([
    "<p>", "</p>", "<div>", "</div>", "<table>", "</table>", "<tr>", "<td colspan=3>", "</td>",
    "<th>", "<ul>", "<ol>", "<li>", "</li>", "</ul>", "</ol>", "<br>", "<pre>", "</pre>", "<b>",
    "</b>", "<dl>", "<dd>", "<dt>", "</dl>", "<select>", "<option>", "<caption>", "<tbody>",
    "<h1>", "</h1>", "<body>", "<head>", "</head>", "<html>", "</body>", "&amp;", "\n", "<"])


@settings(max_examples=400, deadline=None)
@given(st.lists(TAGS | st.integers(0, 99).map("word{} ".format), max_size=60))
def test_no_word_is_lost_whatever_the_tags(parts):
    html = " ".join(parts)
    found = visible_text(html).replace("|", " ").split()
    words = [p.strip() for p in parts if p.startswith("word")]
    assert [w for w in found if w.startswith("word")] == words or sorted(
        w for w in found if w.startswith("word")) == sorted(words)


@settings(max_examples=200, deadline=None)
@given(st.text("<>/!-=\"' apbr&;#x\n", max_size=80))
def test_any_text_is_a_page(html):
    visible_text(html)


def test_deep_and_wide_pages_end():
    assert visible_text("<div>" * 50_000 + "x") == "x"
    wide = "<table>" + "<tr><td>" + "y" * 5_000 + "<td>z" + "<tr><td>a<td>b" * 2_000
    assert len(visible_text(wide)) < 50_000


def test_table_of_pages(spark):
    rows = [(1, "<p>a<p>b"), (2, None), (3, ""), (None, "<b>c"), (1, "<p>a<p>b"),
            (4, "<i>d</i> " * 50_000)]
    pages = spark.createDataFrame(
        [(i, "u", h, "x", 1) for i, h in rows],
        "page_id bigint, url string, html string, text string, n_chars int").repartition(3)
    found = html_text.extract(pages).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars, r.n_lines) for r in found) == sorted(
        (str(i), t, len(t), t.count("\n") + 1 if t else 0)
        for i, t in ((i, visible_text(h or "")) for i, h in rows))
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("part", [
    "<a ", "<!", "<?", "</a ", "<a \"", "<a '\"", "<a b='>' c=\"", "<", "<!-- ", "&", "<p><button><div>",
    "<ul><li>x", "<table><tr><td>x", "<dl><dd>x", "<svg><g>x", "<div>x", "<td colspan=1000>x",
    "<table><tr><td colspan=1000>x<td>y", "<p>x<span>", "<title>x", "<textarea>", "<b x=\"a>b\">t"])
def test_long_malformed_pages_take_time_in_proportion(part):
    page = part * (1_000_000 // len(part))
    start = time.process_time()
    html_text.visible_text(page + "\">'> the end")
    html_text.visible_text("<table>" + page)
    assert time.process_time() - start < 10  # the square of the length would take hours


def test_deep_nesting_keeps_all_text():
    for opening in ("<ul><li>", "<table><tr><td>", "<dl><dd>", "<ol><li><table><tr><td>"):
        page = "".join(f"{opening}word{i}" for i in range(300))
        assert html_text.visible_text(page).split() and [
            w for w in re.findall(r"word\d+", html_text.visible_text(page))
        ] == [f"word{i}" for i in range(300)]


def test_wide_cells_are_aligned():
    wide = "w" * 200
    page = f"<table><tr><td>{wide}<td>b<tr><td>a<td>c</table>"
    assert html_text.visible_text(page) == f"{wide} | b\n{'a'.ljust(200)} | c"
    # A single cell of great width doesn't fill thousands of rows with spaces.
    page = f"<table><tr><td>{'w' * 50_000}<td>b" + "<tr><td>a<td>c" * 5_000 + "</table>"
    assert len(html_text.visible_text(page)) < 200_000


def test_wide_spans():
    page = "<table><tr><td colspan=1000>over all<tr><td>one<td>two<td>three</table>"
    assert html_text.visible_text(page) == "over all\none | two | three"


def test_tags_with_quotes():
    cases = {
        "<a title=\"a>b\">x</a>": "x", "<a title='\"' b=\">\">x": "x", "a < b > c": "a < b > c",
        "<a \"unclosed <p>x</p>": "<a \"unclosed\n\nx", "1 <2 and <b>3</b>": "1 <2 and 3",
        f"<a title=\"{'y>' * 500}\">x": "x", f"<p{' a' * 400}>x": "x", f"</p{' a' * 400}>x": "x",
        f"<!doctype {'a ' * 400}>x": "x", "<b": "<b", "<!": "<!", "</": "</"}
    for page, text in cases.items():
        assert html_text.visible_text(page) == text
