import html
import re

from cohortloom.llm import html_extract as he


def test_pages_of_the_table(spark, sf):
    """Here every page has one article element without anything foreign in it."""
    for r in he.extracted(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inside))
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_without_their_article_element(spark, sf):
    """The distribution alone finds the text: same result where only neutral elements hold it."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()
    for r in pages:
        bare = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert he.main_text(bare) == he.main_text(r.html)


def test_windows_and_threshold_decide(spark, sf):
    pages = [r.html.replace("<article>", "<div>").replace("</article>", "</div>") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    texts = {kind: [he.main_text(p, *kind) for p in pages] for kind in ((3, 86), (1, 400))}
    assert texts[3, 86] != texts[1, 400]
    long = "A paragraph of some length that surges over the threshold on its own because it has enough characters."
    gap = f"<p>{long}</p><p><a href=x>A link between</a></p><p>{long}</p>"
    assert he.main_text(gap) == f"{long} A link between {long}" and he.main_text(gap, 1) == f"{long} {long}"
    assert he.main_text(f"<p>Small talk.</p><p><a>x</a></p><p><a>y</a></p><p><a>z</a></p><p>{long}</p>") == long
    inside = "<article><p>Short text.</p></article>"
    outside = "<div><p>" + "A long paragraph outside of the article. " * 30 + "</p></div>"
    assert he.main_text(inside + "<p>(c) 2020</p>") == "Short text."
    assert len(he.main_text(inside + outside)) > 1000 and he.main_text(inside + outside, 3, 5000) == "Short text."


def test_names_that_only_contain_such_words():
    work = "We follow earlier work on sliding windows."
    page = (
        f"<article><h1>T</h1><p>First.</p><div class='related-work'><p>{work}</p></div><div class=content-header><p>Second part.</p></div>"
        "<div class='related links'><p>See also</p></div><div class='cookie-notice'><p>We use cookies</p></div><p>Last.</p></article>"
    )
    assert he.main_text(page) == f"T First. {work} Second part. Last."
    assert he.named("related-work") == he.named("content-header") == "part"
    assert he.named("ad-slot") == he.named("cookieNotice big") == he.named("comment-list") == "other" and he.named("leader board") is None


def test_surge_and_dive():
    assert he.between([0, 0, 5, 90, 0, 0, 0, 3, 0, 0, 0, 200], 86) == [(1, 4), (9, 12)]
    assert he.between([], 86) == [] and he.between([1, 1], 86) == []


def test_page_without_main_element():
    long = "Long paragraph of text that goes on and on with many words so that it surges over the threshold."
    page = (
        "<body><div id=menu><a href=x>Home</a></div><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul>"
        f"<div><h1>Title</h1><div>{long}</div><div>More.</div></div><div class='side-bar sidebar'>Side {long}</div>"
        "<p><a>l1</a><p><a>l2</a><p><a>l3</a><p>(c) 2020</body>"
    )
    assert he.main_text(page) == f"Title {long} More."


def test_foreign_parts_of_an_article():
    page = (
        "<header>Site</header><main><article><header><h1>T &amp; x</h1><p>by me</p></header><p>a<b>b</b>\n  c</p><aside>no</aside>"
        "<form>f<input></form><div class='cookie-notice'>n</div><script>if (a < b) '</p>'</script><style>p{}</style><!-- <p>c</p> -->"
        "<p>x < y &lt;p&gt;<br>z<section id=comments><article><p>reader</p></article></section><p>end</article></main><footer>f</footer>"
    )
    assert he.main_text(page) == "T & x ab c x < y <p> z end"


def test_odd_pages(frame, spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, "u", "plain"), (3, "u", "<p>x<script>var t='</p>'"), (4, "u", "<a href=\"x>y"), (5, "u", "<p>a" * 20_000)]
    pages = spark.createDataFrame([(*r, "extra", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = sorted((str(r.page_id), r.text) for r in he.extracted(pages).collect())
    assert got[:5] == [("1", ""), ("1", ""), ("2", "plain"), ("3", "x"), ("4", "")] and got[6] == ("None", "")
    assert got[5][1] == " ".join(["a"] * 20_000)
    assert he.extracted(pages.limit(0)).collect() == []
