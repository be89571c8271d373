"""Names of parts: what they rule out, and what they leave to differencing."""
import pytest

from obsweave.llm import html


@pytest.mark.parametrize("name", ["ad", "ads", "related-posts", "site_header-2", "comments-area", "comment-12", "share-buttons", "newsletter-signup-form", "cookie-notice", "main-menu", "sidebar", "ad-slot-3", "post-footer"])
def test_names_that_rule_out(name):
    assert html.names_part(name) == html.DROP


@pytest.mark.parametrize("name", ["share-price", "related-work", "menu-planning", "banner-history", "comment-on-kant"])
def test_names_in_doubt(name):
    assert html.names_part(name) == html.DOUBT


@pytest.mark.parametrize("name", ["side-by-side", "ad-hoc", "advent", "navigator", "socialism", "", "content", "header-image-story"])
def test_names_that_say_nothing(name):
    assert html.names_part(name) == 0


def test_doubtful_parts_stay_unless_the_nearest_page_has_them(spark):
    page = lambda own, bar: f"<body><nav>Home</nav><article><p>Story {own}.</p><div class='share-price'><p>{bar}</p></div><div class='related-posts'><p>More</p></div></article><footer>F</footer></body>"
    rows = [(1, "http://h/a/1", page("one", "Shares rose")), (2, "http://h/a/2", page("two", "Shares fell")), (3, "http://g/a/1", page("x", "Tell a friend")), (4, "http://g/a/2", page("y", "Tell a friend"))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Story one.\nShares rose", 2: "Story two.\nShares fell", 3: "Story x.", 4: "Story y."}
