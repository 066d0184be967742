"""Names of furniture beside names of content, inside and after an article."""

import random

import pytest

from lattica.llm import html_text
from tests.llm.conftest import prose

LEAKS = "comment-body post-comments sidebar-content entry-footer page-footer newsletter-text cookie-wrapper reader-reactions comments related-posts share-buttons".split()
OWN = ["no-sidebar text", "article-text", "post-body comments-open", "entry has-related"]


@pytest.mark.parametrize("wrapper", ['<div class="content">{}</div>', "<article>{}</article>", '<main><div class="post-content">{}</div></main>'])
@pytest.mark.parametrize("name", LEAKS)
def test_furniture_by_name_goes(wrapper, name):
    rng = random.Random(name)
    parts = [prose(rng, rng.randint(25, 70)) + "." for _ in range(6)]
    aside = f'<div class="{name}"><p>{prose(rng, 24)}. {prose(rng, 12)}.</p><p>{prose(rng, 18)}.</p></div>'
    inside = "".join(f"<p>{p}</p>" + (aside if k == 2 else "") for k, p in enumerate(parts))
    head = "<html><body><nav><a href=/a>A</a></nav>"
    for page in (wrapper.format(f"<h1>A title</h1>{inside}"), wrapper.format("<h1>A title</h1>" + "".join(f"<p>{p}</p>" for p in parts) + aside), wrapper.format("<h1>A title</h1>" + "".join(f"<p>{p}</p>" for p in parts)) + aside):
        assert html_text.main_text(f"{head}{page}</body></html>") == "\n".join(["A title", *parts])


@pytest.mark.parametrize("name", OWN)
def test_content_by_name_stays(name):
    rng = random.Random(name)
    parts = [prose(rng, rng.randint(25, 70)) + "." for _ in range(6)]
    body = "".join(f'<div class="{name}"><p>{p}</p></div>' for p in parts) + f'<blockquote class="social-share-quote"><p>{parts[0]}</p></blockquote>'
    assert html_text.main_text(f"<html><body><article><h1>A title</h1>{body}</article></body></html>") == "\n".join(["A title", *parts, parts[0]])
