"""Which style rules of a page count, and pages made to be slow."""

import time

import pytest

from polyadic.llm.html_layout import text_of


@pytest.mark.parametrize(
    "css",
    [
        '<style media="print">.a{display:none}</style>',
        "<noscript><style>.a{display:none}</style></noscript>",
        "<template><style>.a{display:none}</style></template>",
        "<style>@media print{.a{display:none} p{display:none}}</style>",
        "<style>/* .a{display:none} */</style>",
        "<style>.a{display:none}.a{display:block}</style>",
        "<style>.a{display:block!important}p.a{display:none}</style>",
    ],
)
def test_shown(css):
    assert text_of(f"{css}<p class=a>shown") == "shown"


@pytest.mark.parametrize(
    "css, style",
    [
        (".a{display:none!important}", "display:block"),
        (".a{display:block!important}", "display:none!important"),
        (".a{display:none}", ""),
        ("/* x */ .a/* y */{display:none}", ""),
        ('@import "x"; .a{display:none}', ""),
        ("@media print{p{color:red}} .a{display:none}", ""),
        ("p.a{display:block}.a{display:none!important}", ""),
        (".a{display:none!important}.a{display:block}", ""),
    ],
)
def test_hidden(css, style):
    assert text_of(f'<style media=screen>{css}</style><p class=a style="{style}">hidden') == ""


def test_inline_style_beats_rules():
    assert text_of("<style>#i{display:none}</style><p id=i style='display:block'>shown") == "shown"
    assert text_of("<style>#i{visibility:hidden}p{visibility:visible}</style><p id=i>hidden") == ""


def test_spans_keep_columns():
    page = "<table><tr><td rowspan=2>a<td>b<td rowspan=3>c<tr><td>d<tr><td>e<td>f<tr><td>g<td>h<td>i</table>"
    assert text_of(page).split("\n") == ["a  b  c", "   d", "e  f", "g  h  i"]


@pytest.mark.parametrize(
    "page",
    [
        "<style>" + "@a" * 300_000 + "</style><p>x",
        "<style>" + "@a{" * 200_000 + "</style><p>x",
        "<style>" + "/*" * 300_000 + "</style><p>x",
        "<style>" + "".join(f".c{k}{{display:none}}" for k in range(20_000)) + "</style>" + "".join(f"<p class=d{k}>x" for k in range(20_000)),
        "<style>" + ".a{display:block}" * 20_000 + "</style>" + "<p class=a>x" * 20_000,
        "<table><tr>" + "<td colspan=1000 rowspan=60000>a" * 6_000 + "<tr>" + "<td>b" * 6_000 + "</table>",
    ],
    ids=["at-rules", "open blocks", "comments", "rules", "repeated rules", "spans"],
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    text_of(page)
    assert time.process_time() - began < 10
