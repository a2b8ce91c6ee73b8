import re

from lodestone.llm import html_text as ht

TREE = ht.grow(*ht.labelled())

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no</p>";</script></head>
<body class="has-sidebar"><header class="site"><h1>Site name</h1><p>Tag line of the site</p></header>
<nav><ul><li><a href="/">Home</a></li><li><a href="/x">About</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for everybody who reads it.</div>
<main><article><h1>A title &amp; more</h1><p>First  paragraph with <b>bold</b>text,\n and an &eacute; and &#x41;.<br>After the break.
<p>Short.</p><div class="ad">Buy this very good product today and save a lot of money.</div>
<ul><li>One item</li><li>Two <a href="/l">linked words</a> here</li></ul>
<aside>Related: something else that is quite long but still not the article at all.</aside>
<form><label>Name</label><input name=a><button>Send it</button></form>
<section id="comments"><h2>Comments</h2><p>A reader says that this is a long comment with many words in it.</p></section>
</article></main><footer>&copy; 2020 Someone, all rights are reserved in every country.</footer></body></html>"""


def test_article_only():
    text = ht.main_text(PAGE, TREE)
    assert text == "A title & more\nFirst paragraph with boldtext, and an é and A. After the break.\nShort.\nOne item\nTwo linked words here"


def test_without_article_neighbours_decide():
    long = "Many words make up this paragraph, which says a good deal about its subject and goes on for some time so that it is long. " * 2
    page = f"<div><a href=1>One</a> <a href=2>Two</a></div><div>{long}</div><div>{long}</div><div class='footer-links'><a href=3>Imprint</a></div>"
    assert ht.main_text(page, TREE) == "\n".join([long.strip()] * 2)


def test_broken_markup():
    for page in (None, "", "   ", "<", "<p", "<!-- open", "<script>never closed", "<a href='x>y", "</div></p>", "a < b & c", "<p>x</p" * 50):
        assert isinstance(ht.main_text(page, TREE), str)
    assert ht.main_text("<article><p>a < b &amp c &unknown; d</p></article>", TREE) == "a < b & c &unknown; d"
    assert ht.main_text("<article><p>one<p>two<div>three</article><footer>four", TREE) == "one\ntwo\nthree"
    assert len(ht.main_text("<article><p>" + "word " * 300000 + "</p></article>", TREE)) == 1499999


def test_tree_learns_its_table():
    x, y = ht.labelled()
    assert [ht.decide(TREE, row) for row in x] == [bool(v) for v in y]


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", "<article><p>é\U0001f600</p></article>"), (1, "u", PAGE)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = ht.extract(pages).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got)[:2] == [0, 2]
    assert all(r.n_chars == len(r.text) for r in got)
    assert ht.extract(pages.limit(0)).count() == 0


def splits(tree):
    return set() if isinstance(tree, int) else {ht.FEATURES[tree[0]]} | splits(tree[2]) | splits(tree[3])


def test_the_tree_asks_about_neighbours():
    assert splits(TREE) & {"words_before", "words_after", "words_around"} and splits(TREE) & {"density_before", "density_after", "density_around"}


PROSE = "This paragraph says a good deal about its subject, in whole sentences, and goes on for long enough that nobody takes it for anything else than prose. "


def test_names_alone_do_not_decide():
    page = f"""<body><nav><a href=/>Home</a></nav><article><h1>Markets today</h1><div><a href=1>Read</a> <a href=2>Print</a></div><p>{PROSE}</p>
<div class="share-price"><p>{PROSE}The shares rose.</p></div><p>{PROSE * 2}</p>
<div class="zq-thread"><div><a href=u1>Anna B</a></div><p>I do not agree with any of this, sorry.</p><div><a href=r>Reply</a></div>
<div><a href=u2>Carl</a></div><p>Well said, thank you for writing it down so clearly.</p><div><a href=r>Reply</a></div></div></article></body>"""
    assert ht.main_text(page, TREE) == "\n".join(["Markets today", PROSE.strip(), f"{PROSE}The shares rose.", (PROSE * 2).strip()])


def test_held_out_pages_with_other_names():
    for article, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class=x9>", "</div>")):
        page = f"""<div class=k1><ul><li><a href=a>News</a></li><li><a href=b>Sport</a></li><li><a href=c>About us</a></li></ul></div>
{article}<h2>What happened in the town</h2><p>{PROSE}</p><p>{PROSE * 3}</p><ul><li>{PROSE}</li><li>{PROSE}</li></ul><p>{PROSE}</p>{close}
<footer><p>Published by somebody who keeps all rights.</p></footer>"""
        want = ["What happened in the town", PROSE.strip(), (PROSE * 3).strip(), *[PROSE.strip()] * 3]
        assert ht.main_text(page, TREE) == "\n".join(want)


def test_empty_foreign_elements_hide_nothing():
    assert ht.main_text(f'<article><svg class="i"/><p>{PROSE}</p><math/><p>{PROSE}</p><svg><text>no</text></svg></article>', TREE) == "\n".join([PROSE.strip()] * 2)


def test_features_are_those_of_a_plain_reading():
    """Brute force: words and link densities counted by hand on a page of simple blocks."""
    parts = [("one two three", 0), ("<a href=x>four five</a> six", 2), ("seven", 0), ("<a href=x>eight</a>", 1), ("nine ten", 0)]
    page = "".join(f"<p>{t}</p>" for t, _ in parts)
    plain = [(len(re.sub("<[^>]*>", "", t).split()), n) for t, n in parts]
    x = ht.describe(ht.blocks(page))
    for i, (words, linked) in enumerate(plain):
        before = plain[i - 1] if i else (0, 0)
        after = plain[i + 1] if i + 1 < len(plain) else (0, 0)
        want = [words, linked / words, before[0], before[1] / max(1, before[0]), after[0], after[1] / max(1, after[0])]
        want += [max(before[0], after[0]), min(want[3], want[5]), 0, 0, 0, 0, 0]
        assert x[i].tolist() == want


PARAGRAPH = "<p>The committee met on Tuesday to discuss the new budget, and after three hours of debate the members agreed that the plan should go forward with small changes to the schedule.</p>"
BOX = "This is what I wanted to say about it because it seems to me that nobody else has noticed the point that was made before by others in the room."


def boxed(name, layout, attribute="class"):
    a, b = {"article": ("<article>", "</article>"), "div": ("<div>", "</div>"), "main": ('<main id="content"><div class="post">', "</div></main>")}[layout]
    return f"<html><body><h1>The new budget</h1>{a}{PARAGRAPH}{PARAGRAPH}<div {attribute}='{name}'><p>{BOX}</p></div>{PARAGRAPH}{b}</body></html>"


def test_names_of_boxes():
    tree = ht.grow(*ht.labelled())
    noise = "ad-container comment-body comment-text user-comment related-posts newsletter-box cookie-bar notice-box disclaimer-text post-footer talkback user-review sidebar adBox commentList__item reader-opinions site-footer-inner js-cookie-consent promo_unit_2 notice".split()
    prose = "share-price main-content post-body article-text entry-content pull-quote review-body story-2 address lead loader shadow canadian".split()
    for layout in ("article", "div", "main"):
        for attribute in ("class", "id"):
            for name in noise:
                text = ht.main_text(boxed(name, layout, attribute), tree)
                assert BOX not in text and text.count("committee") == 3, (name, layout)
            for name in prose:
                assert BOX in ht.main_text(boxed(name, layout, attribute), tree), (name, layout)
