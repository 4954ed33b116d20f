"""Pages whose article once was lost to boilerplate names."""

import pytest

from pathloom.llm import html_text

STORY = "The river rose in the night, and by the morning half of the town stood under water. " * 4
NAV = "<div class='nav'><a href='/'>Home</a> <a href='/b'>More</a></div>"


@pytest.mark.parametrize("wrapper", [
    "<div class='layout has-sidebar'>{}</div>", "<div class='content no-sidebar'>{}</div>",
    "<div class='comments-open'>{}</div>", "<div class='search-result-page'>{}</div>", "<form action='/x'>{}</form>",
    "<div class='sidebar'>{}</div>", "<article class='post comments-open'>{}</article>",
    "<div id='search'><article>{}</article></div>"])
def test_wrappers_keep_their_article(wrapper):
    page = f"<html><body>{NAV}{wrapper.format(f'<p>{STORY}</p>')}<footer>Imprint</footer></body></html>"
    assert html_text.main_text(page) == STORY.strip()


def test_parts_of_an_article_with_boilerplate_words():
    page = (f"<body>{NAV}<article><p>{STORY}</p><h2 id='related-work'>Related work</h2><h2 id='related'>Other</h2>"
            "<section id='social-impact'><p>Impact here.</p></section><div class='share-prices'>Prices fell.</div>"
            "<div class='share'>Share this</div><div class='cookie-banner'>Cookies</div></article></body>")
    assert html_text.main_text(page) == f"{STORY}Related work Other Impact here. Prices fell."


def test_a_page_of_boilerplate_names_still_has_text():
    assert html_text.main_text("<div class='menu'><p>One part.</p></div><div class='promo'><p>Two parts.</p></div>") != ""
    long = f"<div class='comments'><article class='comment-body'>So true!</article></div><main><p>{STORY}</p></main>"
    assert html_text.main_text(long) == STORY.strip()
