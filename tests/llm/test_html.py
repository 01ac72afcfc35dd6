from lodestar.llm.html import extract, render


def test_blocks_lists_tables_and_visibility():
    page = """<html><head><title>no</title><style>p{}</style></head><body><h1>Head  line</h1>
    <p>One <b>bold</b>ly<p>Two<br>lines<div hidden>gone</div><div style="display: none">gone</div>
    <script>if (a < b) {}</script><ul><li>a<li>b<ol><li>x<li>y</ol></ul>
    <table><tr><th>Name<th>N<tr><td>long name<td>1</table><pre>a
  b</pre>&copy; end<!-- c --></body></html>"""
    assert render(page) == "Head line\n\nOne boldly\n\nTwo\nlines\n\n- a\n- b\n  1. x\n  2. y\n\nName       N\nlong name  1\n\na\n  b\n\n© end"


def test_stray_and_deep_markup():
    assert render("a</p></b>b<td>c") .split() == ["a", "bc"]
    assert render("<b>" * 5000 + "x" + "</i>" * 5000) == "x"
    assert render("1 < 2 & 3 <unclosed") == "1 < 2 & 3 <unclosed"
    assert render("") == ""


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>x"), (1, "<p>x"), (None, None), (2, "")], "page_id long, html string")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == [(1, "x"), (1, "x"), (2, ""), (None, None)]
    assert extract(df.limit(0)).count() == 0


def test_spanning_cells_keep_columns():
    page = "<table><tr><th colspan=2>Head<th>Z<tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>"
    assert render(page) == "Head  Z\na  b  c\n   d  e\nf  g  h"
    assert render("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a  b\n   c\n   d"
    assert render("<table><tr><td colspan=900>a<td>b<tr><td>c<td>d</table>") == "a     b\nc  d"


def test_visibility_and_style_rules():
    assert render("<div style='visibility:hidden'>no<p style='visibility: visible'>yes</div>") == "yes"
    assert render("<style>.x{display:none} p.y , #z {visibility:hidden} @media print{b{display:none}} div > i{display:none}</style><p class='x w'>no<p class=y>no<b>no</b><p id=z>no<p>yes <b>b</b><div><i>i</i></div>") == "yes b\n\ni"
    assert render("<style>.x{display:none}#y{display:block}</style><p class=x id=y>yes<p hidden style='display:block'>too") == "yes\n\ntoo"
    assert render("a<![CDATA[b]]>c</3 d>e<?php f ?>g") == "aceg"
