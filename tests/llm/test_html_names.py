"""What names and places of elements do and don't take out of an article."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lensmere.llm import html_main  # noqa: E402

PROSE = "A sentence that goes on for some time, with commas, so that it counts as prose, and ends here."


def page(*blocks):
    return f"<html><body><nav><a href=/>Home</a></nav><article><header><h1>Title</h1></header><p>{PROSE}</p>{''.join(blocks)}<p>{PROSE}</p></article></body></html>"


def lines(*blocks):
    out = html_main.main_text(page(*blocks)).split("\n")
    assert out[:2] == ["Title", PROSE] and out[-1] == PROSE
    return out[2:-1]


def test_names_of_the_articles_own_parts():
    assert lines('<h2 id="ad-hoc-networks">Ad hoc</h2>', '<h2 id="related-work">Work</h2>', '<p id="notice-of-change">Change</p>',
                 f'<div class="social-history"><p>{PROSE}</p></div>', '<section id="header-files"><p>Files</p></section>', '<p id="ad">Own</p>') == [
        "Ad hoc", "Work", "Change", PROSE, "Files", "Own"]


def test_names_of_what_is_no_part():
    for name in ("ad", "ad-slot", "advert box", "social-share", "related-posts", "share-buttons", "cookie-notice", "newsletter", "comments", "comment-list-2", "sidebar_left"):
        assert lines(f'<div class="{name}"><p>{PROSE}</p></div>') == [], name
        assert lines(f'<div id="{name.split()[0]}"><p>{PROSE}</p></div>') == [], name
    assert lines('<p class="advert">Buy</p>', '<p class="promo-text">Buy</p>', "<aside>Beside</aside>", "<footer>Foot</footer>", '<div role="complementary">x</div>',
                 '<p hidden>x</p>', '<form><p>Name</p></form>') == []


def test_several_articles_and_nested_containers():
    text = html_main.main_text(f"<body><div class='related-work'><p>{PROSE}</p></div><main><div><div><p>{PROSE} One.</p></div><div><p>{PROSE} Two.</p></div></div></main>"
                               f"<div class='site-comments'><p>{PROSE}</p></div></body>")
    assert text == f"{PROSE} One.\n{PROSE} Two."
