"""Main text of pages with all the parts that must go."""

import random
import time

from strandset.llm import htmltext as h

LONG = "The river and the old stone bridge are in the valley, and the people of the village walk to it in the morning for the water and the view of the hills."
TWO = "In the afternoon the sun is on the wall of the house and the birds are in the trees by the garden, so that it is a good place to sit and to read."


def test_synthetic_page_shape():
    page = (
        '<!DOCTYPE html><html lang="en"><head><title>Short title</title><style>p{margin:0}</style><script>var t="</p>";track(1);</script></head><body>'
        '<nav><ul><li><a href="/a">one</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy it in the shop for the best of the prices.</div>'
        f"<article><h1>Short title</h1><p><b>{LONG}<br><p>On.</p><p>A &amp; B &eacute;  x\n y</p></article><footer>&copy; site &middot; {LONG}</footer>"
    )
    assert h.main_text(page) == f"Short title\n{LONG}\nOn.\nA & B é x y"


def test_everything_else_goes():
    page = f"""<body><header><h1>Site</h1><p>{TWO}</p></header>
    <div id="cookie-notice"><p>{LONG}</p></div><aside><p>{LONG}</p></aside>
    <main><article class="post"><header class="post-header"><h1>Title of it</h1></header><p>{LONG}</p><p>Short one.</p>
    <div class="share">Share this</div><form><label>Name</label><input><textarea>{LONG}</textarea></form>
    <p>{TWO}</p><noscript>{LONG}</noscript><p style="display: none">{LONG}</p>
    <section class="comments"><h2>Comments</h2><p>{LONG}</p></section></article></main>
    <div class="sidebar"><p>{TWO}</p></div><div role="contentinfo">{TWO}</div></body>"""
    assert h.main_text(page) == f"Title of it\n{LONG}\nShort one.\n{TWO}"


def test_without_an_article_mark():
    page = f"""<body><div><a href="/">Home</a> <a href="/b">About us</a></div><h2>A heading</h2><div>{LONG} {TWO}</div><div>Yes.</div><div>{TWO} {LONG}</div>
    <div>Made with care.</div><div><a href="x">{LONG}</a></div></body>"""
    assert h.main_text(page) == f"A heading\n{LONG} {TWO}\nYes.\n{TWO} {LONG}"


def test_second_pass_inherits():
    good = h.Block(LONG + TWO, 0, False, False, -1)
    bad = h.Block("x" * 300, 0, False, False, -1)
    short = h.Block("So.", 0, False, False, -1)
    assert h.label([good, short, good]) == [True, True, True]
    assert h.label([bad, short, bad]) == [False, False, False]
    assert h.label([bad, short, good]) == [False, False, True]
    near = h.Block(LONG, 0, False, False, -1)
    assert h.label([bad, near, good]) == [False, True, True] and h.label([bad, near, bad]) == [False] * 3


def test_names_of_state_layout_and_page_say_nothing():
    art = f"<p>{LONG} {TWO}</p>"
    for before, after in (("<body class='single no-sidebar'>", ""), ("<body class='comments-open'>", ""), ("<div class='content has-sidebar'>", "</div>"), ("<main class='with-widget'>", "</main>"), ("<body id='page-menu'>", ""), ("<div class='widget-area'><h1>T</h1>", "</div>")):
        assert f"{LONG} {TWO}" in h.main_text(f"<html>{before}{art}{after}</html>"), before
    assert h.main_text(f"<body><div class='post'>{art}</div><div class='widget'>{art}</div></body>") == f"{LONG} {TWO}"
    assert h.main_text(f"<body><article>{art}</article><div class='comment-list'><p>{LONG}</p><p>{TWO}</p><p>{LONG}</p></div></body>") == f"{LONG} {TWO}"


def test_languages_with_and_without_a_list():
    russian = "Река медленно течёт мимо старого дома, где жили три поколения рыбаков. Каждое утро туман поднимается над водой, и лодки уходят далеко за мыс. " * 3
    unknown = "Wuku maraliti benu salakodo firumita zanu. Berokali tumisade wakoru lini fadu. Hemiraso tulakima berodani wuku sili. " * 3
    chinese = "清晨的河水缓缓流过老房子，三代渔民曾经住在那里。雾气从水面升起，小船驶向远方。" * 8
    for text in (russian, unknown, chinese):
        assert h.main_text(f"<body><div><a href='/'>Menu</a></div><div><p>{text}</p></div><div>2020</div></body>") == " ".join(text.split())


def plain_labels(blocks):
    """Two passes without an article mark, looking for the nearest decided block each time."""
    limits = h.stop_limits(blocks)
    kinds = [h.classify(b, limits) for b in blocks]
    out = []
    for k, kind in enumerate(kinds):
        before = next((x for x in reversed(kinds[:k]) if x in ("good", "bad")), "bad")
        after = next((x for x in kinds[k + 1 :] if x in ("good", "bad")), "bad")
        out.append({"good": True, "bad": False, "near": "good" in (before, after), "short": before == after == "good"}[kind])
    for k, b in enumerate(blocks):  # a heading goes with the good block it precedes
        if b.heading and kinds[k] == "short" and not out[k]:
            reach = 0
            for j in range(k + 1, len(blocks)):
                if out[j] and not blocks[j].heading:
                    out[k] = reach <= h.HEADING_REACH
                    break
                if blocks[j].bad:
                    break
                reach += len(blocks[j].text)
    return out


def test_labels_equal_a_plain_labeller():
    rng = random.Random(4)
    texts = [LONG + TWO, LONG, "x" * 300, "x y " * 30, "So.", "Title"]
    for _ in range(400):
        blocks = [h.Block(rng.choice(texts), rng.choice([0, 0, 0, 2]), rng.random() < 0.2, rng.random() < 0.15, -1) for _ in range(rng.randint(0, 12))]
        assert h.label(blocks) == plain_labels(blocks)


def test_broken_and_empty(spark):
    assert h.main_text(None) == "" and h.main_text("") == "" and h.main_text("<p") == ""
    assert h.main_text("<article>one <b>two &am three") == "one two &am three"
    assert h.main_text("<article>a < b and c > d</article>") == "a < b and c > d"
    assert h.main_text("<article><p>x</p><!-- open " + "y" * 9000) == "x"
    deep = "<div>" * 3000 + "<article>" + LONG + "</article>"
    assert h.main_text(deep) == LONG
    rows = [(1, "u", f"<article>{LONG}</article>", "t", 9), (1, "u", f"<article>{LONG}</article>", "t", 9), (None, None, None, "t", 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in h.extract(df).collect())
    assert got == [("1", "u", LONG, len(LONG))] * 2 + [("None", "None", "", 0)]
    assert h.extract(df.where("page_id = 5")).count() == 0


P195 = "The house of the old man is on the hill by the sea, and in the winter the wind is so loud that he and his dog are in the kitchen for most of the day with a book and a cup of tea by the fire."
VERSE = ["The rain is in the hills", "and all the birds are still", "a bell is in the town"] * 4


def test_pages_of_short_paragraphs_stay():
    assert 180 <= len(P195) <= 200
    page = "<body><h1>A title</h1>" + "".join(f"<p>{P195}</p>" for _ in range(3)) + "</body>"
    assert h.main_text(page) == "\n".join(["A title", *[P195] * 3])
    with_more = f"<body><nav><a href='/'>Home</a></nav><h1>A title</h1><p>{P195}</p><p>Yes.</p><p>{P195}</p><footer>Made by us</footer></body>"
    assert h.main_text(with_more) == f"A title\n{P195}\nYes.\n{P195}"
    assert h.main_text("<body><nav><a href='/'>Home</a></nav>" + "".join(f"<p>{v}</p>" for v in VERSE) + "<footer>x</footer></body>") == "\n".join(VERSE)


def test_code_and_linked_paragraphs_between_good_blocks_stay():
    code = "for (i = 0; i < n; i++) { total += values[i] * weight[i]; if (total > limit) break; } return total / n;"
    link = f"<p>See <a href='x'>{LONG}</a></p>"
    for before, after in (("<div>", "</div>"), ("<article>", "</article>")):
        page = f"<body>{before}<p>{LONG} {TWO}</p><pre><code>{code}</code></pre><p>{TWO} {LONG}</p>{link}<p>{LONG} {TWO}</p>{after}</body>"
        assert h.main_text(page) == f"{LONG} {TWO}\n{code}\n{TWO} {LONG}\nSee {LONG}\n{LONG} {TWO}"


def test_names_of_boilerplate_and_of_subjects():
    art, other = f"<p>{LONG} {TWO}</p>", f"<p>{TWO} {LONG}</p>"
    for name in ("post-comments", "single-comments", "content-comments", "page-sidebar", "sidebar-content", "content-sidebar", "entry-footer", "main-nav", "comment-list", "related-posts", "share-buttons", "sidebar-left", "ad-slot"):
        assert h.main_text(f"<body><div class='post'>{art}</div><div class='{name}'>{other}</div></body>") == f"{LONG} {TWO}", name
        assert h.main_text(f"<body><div class='post'>{art}</div><section id='{name}'>{other}</section></body>") == f"{LONG} {TWO}", name
    for name in ("social-science", "cookie-recipe", "related-work", "no-sidebar", "has-widget", "comments-open", "main-content", "post", "search-theory"):
        assert h.main_text(f"<body><div class='{name}'>{art}</div></body>") == f"{LONG} {TWO}", name


def test_deep_and_unmatched_tags_take_linear_time():
    page = "<div>" * 20_000 + "x" + "</b>" * 20_000 + "<div class='ad'>" * 5_000 + f"<p>{LONG}</p>"
    started = time.perf_counter()
    h.main_text(page)
    assert time.perf_counter() - started < 2
