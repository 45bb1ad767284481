from talelake.llm.html_extract import extract, extract_pages, smoothed, threshold


def test_article_only():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li>x</ul></nav><!-- ad --><div class="ad">Buy <b>now</b></div>
    <article><h1>A&amp;B</h1><p><b>One<br>two <i>th</i>ree&nbsp;four.<p>Short.</p><ul><li>i<li>j</ul>
    <div class="comments"><p>Nice post</p></div><form>mail</form><aside>side</aside></article>
    <div id="cookie-notice">We use cookies</div><footer>&copy; me</footer></body>"""
    assert extract(html) == "A&B One two three four. Short. i j"


def test_without_article():
    long = "plain words of a paragraph that goes on for quite a while, and then some more of it. " * 3
    html = f"<body><div><ul><li><a>Home</a></li><li><a>News</a></li><li><a>More</a></li></ul></div><div><p>{long}</p><p>End.</p><p>{long}</p></div><div><a>x</a><a>y</a></div>"
    assert extract(html) == " ".join(f"{long} End. {long}".split())


def test_odd_pages():
    assert extract(None) == extract("") == extract("<p></p>") == extract("<script>x") == ""
    assert extract("just text &lt;b&gt;") == "just text <b>"
    assert extract("<div class=ad>never closed<article><p>kept</article>") == "kept"
    assert extract("<article>" + "<p>w" * 20000) == " ".join("w" * 20000)
    assert extract("<article></p></div>a<b>b</b>c</article>") == "abc"


def test_helpers():
    assert smoothed([5.0]) == [5.0] and threshold([1.0, 1.0, 9.0]) == 5.0 and threshold([2.0]) == 2.0


def test_table(spark):
    rows = [(1, "u", "<p>é a</p>", "q"), (1, "u", "<p>é a</p>", "q"), (2, None, None, "q"), (None, "v", "", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(str, map(tuple, extract_pages(pages).collect()))) == sorted(map(str, [(1, "u", "é a", 3), (1, "u", "é a", 3), (2, None, "", 0), (None, "v", "", 0)]))
    assert extract_pages(pages.limit(0)).count() == 0


LONG = "plain words of a paragraph that goes on for quite a while, and then some more of it. " * 3


def test_low_parts_of_links_inside_the_article():
    links = "".join(f"<li><a href=/{k}>Story {k}</a></li>" for k in range(8))
    page = f"<body><article><h1>Title</h1><p>{LONG}</p><div><a>Tweet</a> <a>Pin</a></div><p>Short.</p><ul><li>one<li>two <a>x</a></ul><p>{LONG}</p><ul>{links}</ul></article></body>"
    assert extract(page) == f"Title {LONG}Short. one two x {LONG}".strip()


def test_comments_stay_noise():
    comments = "".join(f"<article><p>{LONG}</p></article>" for _ in range(3))
    for mark in ("class=comments", 'id="post-comments"'):
        assert extract(f"<body><article><p>Main. {LONG}</p></article><section {mark}>{comments}</section></body>") == f"Main. {LONG}".strip()
        assert extract(f"<body><div><p>Main. {LONG}</p></div><section {mark}>{comments}</section></body>") == f"Main. {LONG}".strip()


def test_articles_in_forms_menus_and_sidebars():
    assert extract("<form><div>a</div><article><p>kept</p></article></form>") == "kept"
    for tag in ("nav", "aside"):
        assert extract(f"<{tag}><a>x</a><article><p>kept</p></article>") == "kept"
        assert extract(f"<article><p>main</p></article><{tag}><article><p>teaser</p></article></{tag}>") == "main"


def test_names_inside_an_article():
    """Parts of an article whose names look like those of menus, adverts or comments."""
    said = "The shares fell by three percent on the day, as readers of the market had expected for some weeks. "
    for part in (f'<section id="discussion"><h2>Discussion</h2><p>{LONG}</p></section>', f'<section class="related-work"><h2>Related work</h2><p>{LONG}</p><p>Short.</p></section>'):
        assert LONG.strip() in extract(f"<article><h1>T</h1><p>{LONG}</p>{part}<p>End.</p></article>")
        assert extract(f"<article><h1>T</h1><p>{LONG}</p>{part}<p>End.</p></article>").startswith(f"T {LONG}") and extract(f"<article><h1>T</h1><p>{LONG}</p>{part}<p>End.</p></article>").endswith("End.")
    assert extract(f'<article><h1>T</h1><p>{LONG}</p><p class="market-share">{said}</p><p class="market-share">Fell.</p></article>') == f"T {LONG}{said}Fell."
    assert extract(f'<article><div class="article-header"><h1>Title</h1></div><p>{LONG}</p></article>') == f"Title {LONG}".strip()
    # and those that are what they are called
    links = "".join(f"<a href=/{k}>Tell {k}</a> " for k in range(5))
    for noise in (f'<div class="share">{links}</div>', f'<div class="post-share">{links}</div>', '<div class="post-widget">Rate it</div>', f'<div class="comments"><p>{LONG}</p></div>', f'<ol class="comments-list"><li>{LONG}</li></ol>', '<div class="ad-slot"><p>Buy now, only today, and get one more of it for nothing at all.</p></div>'):
        assert extract(f"<article><h1>T</h1><p>{LONG}</p>{noise}<p>End.</p></article>") == f"T {LONG}End.", noise


def test_articles_that_are_comments():
    for around in ("<main><h1>T</h1><p>{}</p>{}</main>", "<main><article><h1>T</h1><p>{}</p></article>{}</main>", "<article><h1>T</h1><p>{}</p>{}</article>", "<article><h1>T</h1><p>{}</p></article>{}"):
        page = around.format(LONG, f'<article class="comment"><p>Nice. {LONG}</p></article>' * 3)
        assert extract(page) == f"T {LONG}".strip(), around
    assert extract(f'<main><article class="no-comments post"><p>{LONG}</p></article><article class="post"><p>More. {LONG}</p></article></main>') == f"{LONG}More. {LONG}".strip()
