"""HTML text: rendering cases, and all visible words of the sample pages."""

from html.parser import HTMLParser

from conftest import SF_SMALL
from emberline.llm import html


def test_blocks_lists_and_entities():
    page = ("<html><head><title>no</title><style>x</style></head><body><h1>A &amp; B</h1><p>one<br>two<p>three"
            "<ul><li>x<li>y<ol start=3><li>deep<li>er</ol></ul><script>var a='<p>';</script><div hidden>gone</div>"
            "<div style='color:red; display : none'>gone</div><pre>a\n  b</pre>end")
    assert html.render(page) == "A & B\n\none\ntwo\n\nthree\n\n- x\n- y\n  3. deep\n  4. er\n\na\n  b\n\nend"


def test_tables_align():
    page = "<table><tr><th>name<th>n<tr><td>a<td>1<tr><td>longer</td><td>22</td></tr></table>after"
    assert html.render(page) == "name   | n\na      | 1\nlonger | 22\n\nafter"
    assert html.render("<table><td>x</table>") == "x"
    wide = "w" * 500
    assert html.render(f"<table><tr><td>{wide}<td>1<tr><td>b<td>2</table>") == f"{wide} | 1\nb | 2"


def test_broken_markup_never_fails():
    for page in (None, "", "<", "<p", "</p>", "<a href='x>y", "a<b c", "<!-- open", "<table><table><tr>", "</td></tr>x",
                 "<li>" * 5000, "<div>" * 20_000 + "deep", "<td>x</td>", "&#xD800;&bogus;", "<textarea><b></textarea>t"):
        assert isinstance(html.render(page), str)
    assert html.render("<div>" * 20_000 + "deep") == "deep"
    assert html.render("a < b") == "a < b"
    assert html.render("<details><summary>s</summary>no</details>yes") == "s\nyes"


class Visible(HTMLParser):
    """All words outside elements that are not rendered, by the standard library."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "").lower()
        if tag in html.VOID:
            return
        if self.hidden or tag in html.UNSEEN or "hidden" in a or "display:none" in style or "visibility:hidden" in style:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def test_all_visible_words_of_sample_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages).collect()}
    assert len(got) == pages.count()
    for row in pages.collect():
        v = Visible()
        v.feed(row["html"])
        v.close()
        want = sorted("".join(v.words).replace("|", " ").replace("-", " ").split())
        have = sorted(got[row["page_id"]].replace("|", " ").replace("-", " ").split())
        numbers = [w for w in have if w.rstrip(".").isdigit()]
        joined = lambda ws: sorted("".join(ws))  # noqa: E731  list numbers are ours
        assert joined([w for w in want if not w.rstrip(".").isdigit()]) == joined([w for w in have if w not in numbers])


def test_rows_of_odd_tables(spark):
    rows = [(1, None, "x"), (None, "<p>a", "y"), (2, "<b>t</b>", "z"), (2, "<b>t</b>", "z")]
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, "a"), (1, ""), (2, "t"), (2, "t")]
    assert html.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_head_ends_where_other_content_starts():
    assert html.render("<html><head><title>t</title><p>all text<p>more") == "all text\n\nmore"
    assert html.render("<head><meta charset=utf-8>\n<style>p{}</style> plain <b>text</b>") == "plain text"
    assert html.render("<head><title>t</title>&amp; so") == "& so"
    assert html.render("<head><title>t</title><noscript>no<p>no</noscript><template><p>no</template>\n<link rel=x><div>yes") == "yes"
    assert html.render("<head>\n<title>t</title>\n</head>\n<body>b</body>") == "b"


def test_xmp_and_plaintext_are_preformatted():
    assert html.render("<p>a<xmp>x  <b>y</b>\n  &amp;</xmp>b") == "a\n\nx  <b>y</b>\n  &amp;\n\nb"
    assert html.render("a<plaintext>x  y\n</plaintext><p>z") == "a\n\nx  y\n</plaintext><p>z"
    assert html.render("<div hidden><xmp>no</xmp></div>yes") == "yes"
