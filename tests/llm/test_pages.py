"""Main text of pages whose names mislead."""

import pytest

from textlab.llm import wrappers

POST = "The post itself, which is long enough to be told from what surrounds it."


@pytest.mark.parametrize(
    "others",
    [
        '<ol class="comment-list"><li class="comment"><article class="comment-body"><p>Nice!</p></article></li></ol>',
        '<div id="comments"><article><p>Nice!</p></article><article><p>Me too!</p></article></div>',
        '<article class="comment-body"><p>Nice one, and thank you very much for it.</p></article>' * 3,
        '<article class="related-teaser"><p>Another post that may be worth your while today.</p></article>' * 3,
        "<article> &nbsp; </article>",
    ],
)
def test_post_beside_articles_that_are_not_it(others):
    assert wrappers.main_text(f'<body><div class="post"><p>{POST}</p></div>{others}</body>', set()) == POST


@pytest.mark.parametrize(
    "opening",
    [
        '<article class="post has-sidebar">',
        '<main class="no-comments">',
        '<main id="skip-target">',
        '<article id="skip-target">',
        '<article class="hentry comments-open">',
        '<article class="sponsored">',
        '<article class="comment">',
        '<div class="layout has-sidebar"><article>',
        '<div class="sidebar-right"><article>',
        '<div class="sidebar-right"><main>',
        '<main><article class="post no-sidebar">',
    ],
)
def test_names_do_not_set_aside_the_main_part(opening):
    page = f'<body><nav>Menu</nav>{opening}<p>{POST}</p><div class="comments">Nice!</div>'
    assert wrappers.main_text(page, set()) == POST


def test_what_is_set_aside_by_state_or_tag_stays_so():
    page = '<div hidden><main><p>Gone</p></main></div><aside><article>Gone</article></aside><p>Here</p>'
    assert wrappers.main_text(page, set()) == "Here"


ROWS = "page_id bigint, url string, html string"


def site(i, article, front=""):
    return f"<body><div><p>Welcome to us</p></div>{front}{article}<div><div><p>All rights held</p></div></div></body>"


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in wrappers.extract_main_text(spark.createDataFrame(rows, ROWS)).collect()}


@pytest.mark.parametrize("odd", [None, "", "<table><tr><td>Another layout</td></tr></table>"])
def test_one_odd_page_leaves_the_template(spark, odd):
    rows = [(i, "http://h.example/", site(i, f"<h2>Title {i}</h2><p>Body {i}</p>")) for i in range(9)]
    found = extracted(spark, [(90, "http://h.example/", odd), *rows, (91, "http://h.example/", odd)])
    assert [found[i] for i in range(9)] == [f"Title {i} Body {i}" for i in range(9)]
    assert found[90] == found[91] == ("Another layout" if odd else "")


def test_template_in_marked_parts_optional_places_and_long_pages(spark):
    long = "".join(f"<h{k % 5 + 1}>Head {{i}} {k}</h{k % 5 + 1}><p>Text {{i}} {k}</p>" for k in range(400))
    share = "<section><p>Tell your friends</p></section>"
    rows = [
        (i, "http://h.example/", site(i, f"<article>{long.format(i=i)}{share if i % 4 else ''}</article>"))
        for i in range(8)
    ]
    rows += [(i, "http://u.example/", site(i, f"{long.format(i=i)}{share if i % 4 else ''}")) for i in range(10, 18)]
    found = extracted(spark, rows)
    for i, text in found.items():
        assert text == " ".join(f"Head {i} {k} Text {i} {k}" for k in range(400))


def test_copies_of_a_page_are_no_template(spark):
    page = site(0, "<article><p>The same post</p></article>")
    rows = [(i, "http://h.example/", page) for i in range(6)]
    rows += [(6, "http://h.example/", site(6, "<article><p>A second post</p></article>"))]
    assert extracted(spark, rows)[0] == "The same post"


@pytest.mark.parametrize("name", ["svg-icon", "select-box", "title-x", "object-view", "style-guide"])
def test_elements_named_like_raw_ones(name):
    page = f"<article><p>one</p><{name} a='b'></{name}><p>two</p></article>"
    assert wrappers.main_text(page, set()) == "one two"
    raw = name.split("-")[0]
    if raw != "title":
        assert wrappers.main_text(f"<article><p>one</p><{raw} a='b'>not this</{raw}><p>two</p></article>", set()) == "one two"


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!-- > -->", "<!---->", "<!--a--!>"])
def test_comments_end_where_html_ends_them(comment):
    assert wrappers.main_text(f"<article><p>one</p>{comment}<p>two</p><!-- x --></article>", set()) == "one two"


@pytest.mark.parametrize("name", ["share-price", "social-history", "menu-of-the-day", "widget-factory", "comment-culture"])
def test_names_that_only_hold_a_word(name):
    assert wrappers.main_text(f'<article><p>one</p><div class="{name}">two</div></article>', set()) == "one two"


@pytest.mark.parametrize("name", ["share-buttons", "social-links", "ad-slot-2", "sidebar-left", "related_posts", "cookieNotice", "commentBox"])
def test_names_of_what_is_set_aside(name):
    assert wrappers.main_text(f'<article><p>one</p><div class="{name}">two</div></article>', set()) == "one"
