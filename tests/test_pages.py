"""The main content of pages."""

import re

import pytest

from stratum.operators import pages
from stratum.sources.tables import load

LONG = "This sentence of the article has more than ten words, so that it counts alone."
SHAPE = "page_id bigint, html string"


def content(spark, html):
    rows = pages.main_content(spark.createDataFrame([(1, html)], SHAPE)).orderBy("block_no").collect()
    assert [r["block_no"] for r in rows] == list(range(len(rows)))
    at = 0
    for r in rows:
        assert r["byte_start"] == at
        at += len(r["text"].encode()) + 2
    return [(r["block_type"], r["section_path"], r["text"]) for r in rows]


def test_menus_and_asides_go(spark):
    html = f"""<html><head><title>T</title></head><body><div class="top-menu"><p>{LONG}</p></div><ul><li><a href=x>One</a><li><a href=y>Two</a></ul>
<!-- {LONG} --><script>var x = "<p>{LONG}</p>"</script><main><h1>Caf&eacute; &amp; Co</h1><p>{LONG}</p><p>Short one.</p><h2>Part</h2><p>{LONG}<br>More&nbsp;here.</p><h2>See also</h2><ul><li><a href=z>Link</a></li></ul></main>
<aside><p>{LONG}</p></aside><div id='cookie-box'><div><p>{LONG}</p></div><p>{LONG}</p></div><footer>&copy; {LONG}</footer></body>"""
    assert content(spark, html) == [
        ("heading", "Café & Co", "Café & Co"), ("paragraph", "Café & Co", LONG), ("paragraph", "Café & Co", "Short one."),
        ("heading", "Café & Co > Part", "Part"), ("paragraph", "Café & Co > Part", f"{LONG} More here."),
    ]


def test_elements_end_at_their_own_depth(spark):
    html = f'</div><div class=ad><div>x</div><section><p>{LONG}</p></div><p>after: {LONG}</p></section></nav><p>last: {LONG}</p>'
    assert [t for _, _, t in content(spark, html)] == [f"after: {LONG}", f"last: {LONG}"]


def test_a_lone_short_text_takes_after_its_neighbours(spark):
    assert [t for _, _, t in content(spark, f"<p>{LONG}<p>no stop<p>{LONG}<p>tail<div class=ads>{LONG}</div><p>Stop.")] == [LONG, "no stop", LONG]
    assert [t for _, _, t in content(spark, f"<p>{LONG}<p>tail")] == [LONG, "tail"]


@pytest.mark.parametrize("html,want", [
    (None, []), ("", []), ("<p></p>", []), ("&nbsp;", []), ("plain text", ["plain text"]), ("<p>a<p>b<nav>c</nav>", ["a", "b"]),
    ("<nav><p>only this</nav>", ["only this"]), ("<aside>open", ["open"]), ("\x01\x02<p>a\x01b</p>", ["a b"]), ("<p title='", ["<p title='"]), ("&#0;&#x110000;<p>ok", None),
])
def test_edges(spark, html, want):
    got = [t for _, _, t in content(spark, html)]
    assert want is None or got == want


def test_a_long_page_of_deep_elements(spark):
    html = "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000 + "<nav>" + f"<li>{LONG}</li>" * 3000 + "</nav>" + f"<p>{LONG}</p>" * 3000
    assert len(content(spark, html)) == 3001


def test_pages_keep_their_article_alone(spark):
    """Against the articles cut out of the pages' own source."""
    d = "/root/testdata/sf0.001"
    got = {}
    for r in pages.main_content(load(spark, d, "pages")).orderBy("page_id", "block_no").collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    for r in load(spark, d, "pages").collect():
        article = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r["html"])[1]
        menus, ads = re.findall(r"(?s)<nav>(.*?)</nav>", r["html"]), re.findall(r'<div class="ad">(.*?)</div>', r["html"])
        texts = got[r["page_id"]]
        long = [p for p in re.findall(r"(?s)<p>([^<]*)</p>", article) if len(p.split()) >= 10 and "&" not in p]
        assert set(" ".join(p.split()) for p in long) <= set(texts)
        assert not set(ads) & set(texts) and not any(x in texts for menu in menus for x in re.findall(r">([^<]+)</a>", menu))
