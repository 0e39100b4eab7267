"""Main text of generated sites whose main text is known."""

import random

import pytest

from evalweave.llm.html_main import extract_main, main_text

FIELDS = "page_id bigint, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def texts(spark, rows):
    return {r.page_id: r.text for r in extract_main(spark.createDataFrame(rows, FIELDS)).collect()}


def test_generated_sites(spark):
    """Menus, notices and closing lines without any telling name go as their host's template,
    on hosts of three pages and more, whatever their share of the page.
    """
    rng, rows, want = random.Random(5), [], {}
    for site in range(12):
        menu = [words(rng, 2) for _ in range(rng.choice((3, 30)))]
        notice, closing = words(rng, 60), words(rng, 9)
        shape = site % 3
        for k in range((3, 5, 24)[site % 3 if site > 5 else 0]):
            title, body = words(rng, 4), [words(rng, rng.choice((2, 40))) for _ in range(rng.randint(1, 5))]
            entries = "".join(f"<li><a href='/{j}'>{m}</a></li>" for j, m in enumerate(menu))
            text = f"<h1>{title}</h1>" + "".join(f"<p title='it's {j}' x=\"1\" y\">{b}</p>" for j, b in enumerate(body))
            html = (
                f"<body><div class=top{site}><ul>{entries}</ul></div><div class=mid><p>{notice}</p></div><div class=own>{text}</div><p>{closing}</p></body>",
                f"<body><table><tr><td><ul>{entries}</ul></td><td>{text}</td></tr></table><div>{notice}</div><section>{closing}</section></body>",
                f"<body><div><div class='x1'>{notice}</div><div class='y2'><section>{text}</section></div></div><ul>{entries}</ul><div class='z'>{closing}</div></body>",
            )[shape]
            page_id = 1000 * site + k
            rows.append((page_id, f"http://s{site}.org/{k}", html))
            want[page_id] = "\n".join([title, *body])
    got = texts(spark, rows)
    assert got == want
    assert all(main_text(html) != want[i] for i, _, html in rows)  # without the host's template nothing is right


def test_copies_count_once(spark):
    """Copies of one page are no template for each other, nor for the host's other pages."""
    page = "<body><ul><li>menu a<li>menu b</ul><h1>{0}</h1><p>text of {0}</p></body>"
    rows = [(k, "http://c/", page.format("one")) for k in range(30)] + [(30, "http://c/", page.format("two")), (31, "http://d/", page.format("one"))]
    got = texts(spark, rows)
    assert all(got[k] == "one\ntext of one" for k in range(30)) and got[30] == "two\ntext of two"
    assert got[31] == "menu a\nmenu b\none\ntext of one"  # nothing to compare with
    assert texts(spark, [(k, "http://e/", page.format("one")) for k in range(5)])[0] == got[31]


@pytest.mark.parametrize(
    "source, text",
    [
        ("<p title='it's fine'>Lead words here</p><p>it isn't over</p>", "Lead words here\nit isn't over"),
        ('<p title="5" wide">shown</p>', "shown"),
        ('<p title = "a > b" data-x=\'<p>\'>shown</p>', "shown"),
        ('<p title="open>shown</p><p>more</p>', "shown\nmore"),
        ("<a href=/x?a=\"b>link</a> text", "link text"),
        ("<!-->shown<!-- hidden --!> too", "shown too"),
        ("<p>before <svg/> after</p><svg><text>x</text></svg>", "before after"),
        ("<titles>shown</titles>", "shown"),
        ("<article><p>text of it</p><div class='comments-area'><ol class='comment-list'><li>said so</ol></div></article>", "text of it"),
        ("<p>short</p><div id=comment_list><p>" + "a long reply " * 40 + "</p></div>", "short"),
        ("<article><pre>x = 1 <span class='token comment'># note</span></pre></article>", "x = 1 # note"),
        ("<article><p class='legal'>the law</p><p class='search'>the search</p><p class=ad>buy</p></article>", "the law\nthe search"),
        ("<form id=aspnet><div><h1>head</h1><p>all the text of the page</p><div class='login-box'>name</div></div></form>", "head\nall the text of the page"),
        ("<p>some text</p><form>name <input> send</form>", "some text"),
        ("<main><h1>head</h1><article><p>text</p></article><p>beside</p></main><p>after</p>", "head\ntext\nbeside"),
        ("<div class=has-sidebar><p>text</p></div><div class='site-footer'>foot</div><div class='post-header'><h1>head</h1></div>", "text\nhead"),
        ("", ""), ("<nav>m</nav>", ""), ("&lt;b&gt;&#x41;&nbsp; x", "<b>A x"),
    ],
)
def test_single_pages(source, text):
    assert main_text(source) == text


def test_long_and_broken_markup():
    for source in ("<p a=\"" * 20_000, "<div " * 50_000, "<!--" * 50_000, "='" * 50_000, "<ul><li>" * 3_000 + "x"):
        main_text(source)
    assert main_text("<p>" + "y " * 300_000) == "y " * 299_999 + "y"
