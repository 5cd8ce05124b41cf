import pytest

from shelfline.llm import site_style

STORY = "\n".join(f"Sentence {i} of a story that goes on for a good while." for i in range(12))
PARAGRAPHS = "".join(f"<p>{line}</p>" for line in STORY.split("\n"))
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>topic number {i}</a>" for i in range(80)) + "</ul>"

WRAPPERS = [
    "<div id=content class='with-sidebar'>{}</div>",
    "<div class='no-comments'>{}</div>",
    "<div class='social-policy'>{}</div>",
    "<section id=related-work>{}</section>",
    "<form action=/><nav>" + LINKS + "</nav>{}</form>",
    "<form><article>{}</article></form>",
    "<div class=widget>{}</div><div class=sidebar>other things</div>",
    "<nav>" + LINKS + "</nav>{}<footer>imprint</footer>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_marked_wrappers_keep_the_article(wrapper):
    assert site_style.main_text(wrapper.format(PARAGRAPHS)) == STORY


def test_a_section_with_a_marked_word_stays():
    page = f"<article>{PARAGRAPHS}<section id=related-work><p>Others did this.</p></section></article>"
    assert site_style.main_text(page) == STORY + "\nOthers did this."


def test_teaser_articles_do_not_hide_the_text():
    teasers = "".join(f"<article><a href=/{i}>Read story {i}</a></article>" for i in range(5))
    assert STORY in site_style.main_text(f"<div>{PARAGRAPHS}</div>{teasers}")


def test_the_tree_alone_cuts_marked_and_plain_branches(llm):
    def page(i):
        menu = "<form><p>" + "search all of our pages " * 60 + "</p></form>"
        return f"{menu}<div class=x>Same words</div><div class=with-sidebar><p>story {i}</p></div>"

    pages = llm.createDataFrame([(f"http://a.example/{i}", page(i)) for i in range(20)], "url string, html string")
    found = site_style.extract_main_text(pages, ["url"]).collect()
    assert sorted(r["text"] for r in found) == sorted(f"story {i}" for i in range(20))
