from html.parser import HTMLParser

import pytest

from postloom.llm.extraction import extract, main_text

WORDS = "Some longer sentence that belongs to the article and goes on for a while. "
PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{margin:0}</style><script>var t="<p>no</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now %(w)s</div>
%(open)s<h1>Title &amp; more</h1><p>Short.</p><p>%(w)s<b>bold</b>  and
 on.</p><!-- note --><aside>Side %(w)s</aside><p>After &lt;it&gt;&nbsp;&eacute; %(w)s</p><form>Name: <input></form><p>End.</p>%(close)s
<div id="comments"><p>Nice post! %(w)s</p></div><div class="cookie-notice">We use cookies %(w)s</div><footer>&copy; us %(w)s</footer></body></html>"""
WANT = ["Title & more", "Short.", f"{WORDS}bold and on.", f"After <it> é {WORDS}".strip(), "End."]


@pytest.mark.parametrize(("start", "end"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("", "")])
def test_article(start, end):
    assert main_text(PAGE % {"w": WORDS, "open": start, "close": end}).split("\n") == WANT


def test_pages_without_article():
    assert main_text("") == ""
    assert main_text("<nav><a href=x>Home</a></nav><footer>f</footer>") == ""
    assert main_text("<p>Only a little.</p>") == "Only a little."
    assert main_text("plain text &amp; no markup") == "plain text & no markup"


def test_cut_pages_and_odd_markup():
    assert main_text("<article><p>One two.</p><p>Three &am").split("\n") == ["One two.", "Three &am"]
    assert main_text("<article><p>One two.</p><p cla") == "One two."
    assert main_text("<article><p>a < b and c > d</p><P>Next<BR>line</P></article>").split("\n") == ["a < b and c > d", "Next line"]
    assert main_text('<article><p title="a > b">x</p></article>') == "x"
    assert main_text("<article><p>&#233;&#x41;&zzz;</p></article>") == "éA&zzz;"
    assert main_text("<article><p>before<script>x</script> after</p></article>") == "before after"


def test_long_pages_are_kept_whole():
    text = main_text("<article>" + "".join(f"<p>Paragraph {i} with several words.</p>" for i in range(20_000)) + "</article>")
    assert text.count("\n") == 19_999
    assert main_text("<div>" * 5000 + WORDS + "</div>" * 5000) == WORDS.strip()


def test_rows(spark):
    rows = [(1, "u", "<p>Hello there.</p>", "x"), (1, "u", "<p>Hello there.</p>", "x"), (2, None, None, "x"), (None, "v", "", "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "u", "Hello there.", 12)] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_short_lines_around_what_is_left_out_stay():
    page = "<article><h1>T</h1><div class=ad>x</div><p>S.</p><p>" + WORDS + "</p>" + "<aside>a</aside><form>f</form><div class=adSlot>x</div>" * 3 + "<p>End.</p></article>"
    assert main_text(page).split("\n") == ["T", "S.", WORDS.strip(), "End."]
    assert main_text(page.replace("article>", "div>")).split("\n") == ["T", "S.", WORDS.strip(), "End."]


ARTICLE = f"<h1>Title</h1><p>{WORDS}</p><p>{WORDS}</p>"


@pytest.mark.parametrize(
    "attributes",
    ['style="overflow:hidden"', 'data-hidden="false"', 'data-id="comment"', 'class="no-sidebar"', 'class="content with-sidebar"', 'class="left-side"', "class=has-comments", 'title="a class=ad here"', 'class="content-sidebar-wrap"', "id=nav", 'class="comments"', 'class="post comments-open"', 'class="article-with-ads"'],
)
@pytest.mark.parametrize("tag", ["div", "article", "section", "main"])
def test_attributes_that_do_not_delete_the_article(tag, attributes):
    """Some say nothing about the element, others name something else, and no name deletes nearly all of a page."""
    page = f"<body><nav><a href=/>Home</a></nav><{tag} {attributes}>{ARTICLE}</{tag}><footer>{WORDS}</footer></body>"
    assert main_text(page).split("\n") == ["Title", WORDS.strip(), WORDS.strip()]


@pytest.mark.parametrize("attributes", ["class=comments", "id=sidebar", 'class="site-footer"', 'class="cookie-banner"', "class=adSlot", 'class="widget related-posts"', "hidden", "aria-hidden=true", "role=navigation", 'class = "ad"', "CLASS='Newsletter'", 'class="comment-list"', 'class="main-nav"'])
def test_attributes_that_delete(attributes):
    for page in (f"<div>{ARTICLE}</div><div {attributes}><p>{WORDS}</p></div>", f"<div><div {attributes}><p>{WORDS}</p></div>{ARTICLE}</div>"):
        assert main_text(page).split("\n") == ["Title", WORDS.strip(), WORDS.strip()]


def test_reader_comments_in_article_elements():
    comment = f"<p>{WORDS}</p>"
    for page in (
        f"<article>{ARTICLE}<section id=discussion><article>{comment}</article></section></article>",
        f"<article>{ARTICLE}</article><article class='comment depth-1'>{comment}</article><article class=comment>{comment}</article>",
        f"<article>{ARTICLE}<article>{comment}</article></article>",
        f"<main><article>{ARTICLE}</article><div class=comments><article>{comment}</article></div></main>",
    ):
        assert main_text(page).split("\n") == ["Title", WORDS.strip(), WORDS.strip()], page


def test_closing_paragraph_behind_links():
    links = "<ul>" + "".join(f"<li><a href=/{i}>Source {i}</a></li>" for i in range(3)) + "</ul>"
    lines = ["Title", WORDS.strip(), WORDS.strip(), "Source 0", "Source 1", "Source 2", "The end."]
    assert main_text(f"<article>{ARTICLE}{links}<p>The end.</p></article>").split("\n") == lines
    assert main_text(f"<div>{ARTICLE}{links}<p>The end.</p></div><div>About us</div><footer>x</footer>").split("\n")[: len(lines)] == lines


def test_slashes_in_tags():
    assert main_text(f"<nav class=x/><a href=/foo/>Home</a> sweet</nav><div>{ARTICLE}</div>").split("\n")[0] == "Title"
    assert main_text(f"<ul><li><a href=/foo/>Go home</a></li></ul><hr><hr><div>{ARTICLE}</div>").split("\n")[-3:] == ["Title", WORDS.strip(), WORDS.strip()]
    assert main_text("<article><p>a<svg/>b<svg><g/><text>no</text></svg>c</p></article>") == "abc"


HOSTILE = ["<script", "<div><p></b>", "<a href='", '<a href="', "<!--", "<![CDATA[", "</", "<", "<div", "<i><div></i>", "<nav>", "</div>", "<a \" ", "<p class='", "&#", "&amp", "<li>", "<script>", "<td><ul>", "<article>", "<div class=ad>", "= '"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_take_linear_time(piece):
    import time

    page = f"<article><p>{WORDS}</p></article>" + piece * (300_000 // len(piece))
    began = time.process_time()
    main_text(page)
    main_text(page.replace("</article>", ""))
    assert time.process_time() - began < 10


class Reader(HTMLParser):
    """A plain second reading of pages: text by block of the article elements, without what is left out by tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.words, self.inside, self.skip = [], [], 0, 0

    def flush(self):
        text = " ".join("".join(self.words).split())
        if text:
            self.blocks.append(text)
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.words.append(" ")
        elif tag not in ("b", "i", "a", "span", "em"):
            self.flush()
        self.inside += tag == "article"
        self.skip += tag in ("script", "style", "aside", "form")

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "span", "em"):
            self.flush()
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style", "aside", "form")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.words.append(data)


def test_pages_of_the_tables_against_a_second_reading(spark, data):
    rows = extract(spark.read.parquet(f"{data}/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        reader = Reader()
        reader.feed(pages[r.page_id] or "")
        reader.close()
        reader.flush()
        assert r.text.split("\n") == (reader.blocks or [""]) and r.n_chars == len(r.text)


def _joined(*parts):
    return "\n".join(parts)


def test_articles_in_main_stay():
    three = "".join(f"<article><h2>Part {i}</h2><p>{WORDS}{i}</p></article>" for i in range(3))
    assert main_text(f"<main>{three}</main>") == _joined(*(x for i in range(3) for x in (f"Part {i}", f"{WORDS}{i}")))
    assert main_text(f"<main><article><p>{WORDS}</p></article><section><p>{WORDS * 2}</p></section></main>") == _joined(WORDS.strip(), (WORDS * 2).strip())
    comments = "".join(f"<div class=comment-body><p>{WORDS}{i}</p></div>" for i in range(30))
    assert main_text(f"<main id=content><article class=post>{ARTICLE}</article><div id=comments>{comments}</div></main>") == _joined("Title", WORDS.strip(), WORDS.strip())
    # nested articles that no text of the outer one comes before are its content
    assert main_text(f"<article><h1>News</h1>{three}</article>").startswith("News\nPart 0\n")


@pytest.mark.parametrize("times", [1, 3, 60])
@pytest.mark.parametrize(
    "attributes",
    ["class=reader-comments", "class=cookie-notice", "class=cookie-banner", "class=advert-box", "class=main-footer", "id=sidebar-left", "id=comments", "class='comment-list'", "class=sidebar", "class='comments-wrapper'", "class='footer-content'", "itemprop=comment", "class='widget'", "class=adSlot"],
)
def test_what_is_beside_an_article_goes_whatever_its_length(attributes, times):
    beside = f"<div {attributes}>" + f"<p>{WORDS}</p>" * times + "</div>"
    short = "<p>A short article.</p>"
    for page in (f"<article>{short}</article>{beside}", f"{beside}<article>{short}</article>", f"<article>{short}{beside}</article>", f"<main>{short}{beside}</main>", f"<main><article>{short}</article>{beside}</main>", f"<main>{beside}<section>{short}</section></main>"):
        assert main_text(page) == "A short article.", page[:200]
    for page in (f"<div>{ARTICLE}</div>{beside}", f"<div>{beside}{ARTICLE}</div>", f"<div id=page><div>{ARTICLE}</div>{beside}</div>"):
        assert main_text(page) == _joined("Title", WORDS.strip(), WORDS.strip()), page[:200]


def test_long_comments_in_article_elements():
    long = f"<p>{WORDS}</p>" * 40
    for page in (f"<article>{ARTICLE}<article>{long}</article></article>", f"<article>{ARTICLE}</article><article class='comment-body'>{long}</article>", f"<main><article>{ARTICLE}</article><ol class=commentlist><li><article>{long}</article></li></ol></main>", f"<article>{ARTICLE}<article itemtype='https://schema.org/Comment'>{long}</article></article>"):
        assert main_text(page) == _joined("Title", WORDS.strip(), WORDS.strip())


def test_names_of_what_holds_the_article():
    around = "<div>About us and more of it here</div>"
    for attributes in ("class='container sidebar-right'", "class=article-with-ads", "class='comments-open'", "class=sidebar", "class=layout-sidebar"):
        assert main_text(f"<div {attributes}><main>{ARTICLE}</main><div class=sidebar>{WORDS}</div></div>{around}") == _joined("Title", WORDS.strip(), WORDS.strip()), attributes
        assert main_text(f"<div {attributes}><article>{ARTICLE}</article></div>{around}") == _joined("Title", WORDS.strip(), WORDS.strip()), attributes
    # teasers in a list of related ones aren't the article
    teasers = "<div class=related>" + f"<article><h3>More</h3><p>{WORDS}</p></article>" * 3 + "</div>"
    assert main_text(f"<div><h1>Title</h1><p>{WORDS * 2}</p></div>{teasers}") == _joined("Title", (WORDS * 2).strip())


def test_generated_layouts():
    """Every arrangement of an article and what may stand before and behind it, short and long."""
    import itertools

    bodies = [("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<div class=content>", "</div>"), ("<main><section>", "</section></main>"), ("<section class=post>", "</section>")]
    others = ["", "<nav><a href=/>Home</a></nav>", "<div class=comments>%s</div>", "<section id=discussion>%s</section>", "<aside>%s</aside>", "<div class='cookie-notice'>%s</div>", "<footer>%s</footer>", "<div id=sidebar-left>%s</div>"]
    for (start, end), before, behind, long, size in itertools.product(bodies, others, others, (1, 30), (1, 5)):
        text = f"<p>{WORDS}</p>"
        fill = lambda x: x.replace("%s", text * long)  # noqa: E731, B023
        page = f"<html><body>{fill(before)}{start}<h1>Title</h1>{text * size}{end}{fill(behind)}</body></html>"
        assert main_text(page) == _joined("Title", *[WORDS.strip()] * size), page[:300]
