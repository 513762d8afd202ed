"""Marked elements that hold or belong to the content."""

import pytest

from surveymend.llm import htmltext

BODY = "<p>Long enough words to be the content of the page, of which there are several.</p><p>And more of them, which say something else at some length.</p>"
TEXT = "Long enough words to be the content of the page, of which there are several. And more of them, which say something else at some length."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='content-sidebar-wrap'><article>{BODY}</article></div>", TEXT),
        (f"<div class='container has-sidebar'><main>{BODY}</main><div class='sidebar'><p>Other</p></div></div>", TEXT),
        (f"<div id='page' class='header-fixed skip'>{BODY}</div>", TEXT),
        (f"<article>{BODY}<h2 id='comments'>Remarks</h2><p class='notice'>Note</p></article>", TEXT + " Remarks Note"),
        (f"<article>{BODY}<section id='discussion'><p>What was found is weighed against earlier work here.</p></section></article>", TEXT + " What was found is weighed against earlier work here."),
        (f"<article>{BODY}<div class='share'><a href=x>Send</a><a href=y>Post</a></div></article>", TEXT),
        (f"<article>{BODY}</article><div id='comments'><article class='comment'><p>I disagree.</p></article></div>", TEXT),
        (f"<article>{BODY}<ul><li><a href=x>Home</a></li><li><a href=y>More</a></li><li><a href=z>Up</a></li></ul></article>", TEXT),
    ],
)
def test_marked_parts_of_the_content_stay(page, want):
    assert htmltext.text_of(page) == want
