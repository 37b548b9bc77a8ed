import pytest

from cohortspark.llm import htmltext

LONG = "Long paragraph of the article with many words in it, and then some more of them. " * 12


@pytest.mark.parametrize("mark", ["<![foo]>", "<![ if x]>", "<![if !IE]>", "<![endif]-->", "<![CDATA[open", "<![CDATA[x]]>", "<![>"])
def test_broken_declarations_do_not_end_the_page(mark):
    page = f"<html><body><article><p>before the mark</p>{mark}<p>x</p><p>after the mark ]&gt;</p></article></body></html>"
    text = htmltext.extract(page)
    assert text.startswith("before the mark") and text.endswith("after the mark ]>")


@pytest.mark.parametrize("page", ["<div><h1>Title</h1><p>{}</p><p>ok.</p></div>", "<div><h1>Title</h1><div>{}</div><div>ok.</div></div>", "<section><h1>Title</h1><ul><li>{}</ul><p>ok.</section>"])
def test_region_is_no_leaf(page):
    nav = "<div class=nav><a>Home</a></div>"
    assert htmltext.extract(f"<html><body>{nav}{page.format(LONG)}<footer>x</footer></body></html>") == f"Title {LONG.strip()} ok."


def test_region_holds_all_content():
    page = f"<html><body><div><div>{f'<p>{LONG}</p>' * 10}</div><div><p>{LONG}</p></div></div></body></html>"
    assert htmltext.extract(page) == " ".join([LONG.strip()] * 11)
