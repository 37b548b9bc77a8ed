import time

import pytest

from cohortspark.llm import htmltext

BODY = "<h1>Head</h1><p>" + "Words of the article go on and on. " * 10 + "</p><p>" + "More words of it follow here, quite a few. " * 8 + "</p><p>The end.</p>"
TEXT = " ".join(["Head", ("Words of the article go on and on. " * 10).strip(), ("More words of it follow here, quite a few. " * 8).strip(), "The end."])
LINKS = "<ul><li><a href=x>Home</a><li><a href=y>About us</a></ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='layout has-sidebar'><article>{BODY}</article><div class=sidebar><p>Other things</p></div></div>",
        f"<div id=page class='no-comments'><article>{BODY}</article></div>",
        f"<div id=page class='no-comments'>{BODY}</div>",
        f"<nav>{LINKS}<article>{BODY}</article>",
        f"<nav>{LINKS}{BODY}",
        f"<form id=aspnet><div class='site-header'>Welcome</div>{BODY}<div class='share-buttons'><a>Tweet</a></div></form>",
        f"<body><header><p>Site</p></header><main>{BODY}<aside>Read this too</aside></main><footer>Rights</footer>",
        f"<table><tr><td class=menu>{LINKS}</td><td>{BODY}</td></tr></table>",
        f"<div class=cookieNotice><p>We bake cookies for you.</p></div><section>{BODY}</section><div class='comments-area'><p>Nice post</p></div>",
    ],
)
def test_one_article_in_many_wrappers(page):
    assert htmltext.extract(page) == TEXT


def test_a_telling_word_in_a_name_is_no_verdict():
    page = f"<article>{BODY}<p class='share-price'>{'The share price rose today by a lot. ' * 4}</p></article>"
    assert htmltext.extract(page).endswith("by a lot.")


def test_edges():
    assert htmltext.extract(None) == htmltext.extract("") == htmltext.extract("<script>x</script>") == ""
    assert htmltext.extract("<p>short") == "short"
    long = "<article>" + "<p>one &amp; two</p>" * 30000 + "</article>"
    assert htmltext.extract(long) == " ".join(["one & two"] * 30000)


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars int")
    assert htmltext.main_text(none).count() == 0


def test_time_grows_with_the_number_of_tags():
    for unit in ("<b>x</i>", "<div>x</span>", "<b>y<p>x", "<!-- x", "</", "<a ", "<![CDATA[ x", "<article><header>x"):
        took = []
        for n in (5000, 20000):
            began = time.time()
            htmltext.extract(unit * n)
            took.append(time.time() - began)
        assert took[1] < 8 * took[0] + 0.5, unit
    began = time.time()
    htmltext.extract("<div>" * 50000 + "<li>x</li>" * 150000)
    assert time.time() - began < 30


def test_marks_that_nothing_closes_are_text():
    assert htmltext.extract("<p>aaa</p><!-- x <p>b</p> <b>d</b") == "aaa <!-- x b d</b"
