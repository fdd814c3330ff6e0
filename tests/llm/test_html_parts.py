"""What html_text keeps and drops, whatever its length; pages built from known parts against what they were built from."""

from __future__ import annotations

import html
import random

import pytest

from microbook.llm import html_text

SHORT = "A line of its own."
LONG = "This paragraph goes on for a while, with a clause or two in it, so that it has a few hundred characters in all. " * 4


def shown(page: str) -> list[str]:
    return [t for t in html_text.main_text(page).split("\n\n") if t]


@pytest.mark.parametrize("text", [SHORT, LONG[:205], LONG])
@pytest.mark.parametrize("name", ["share-price", "related-work", "form-factor", "search-engine", "login-security", "share price", "cookie-recipes", "ad-hoc", "comment-culture", "notice-period", "main-content", "entry-content", "news-body"])
def test_names_of_text_keep_it(name, text):
    page = "<body><article><h1>Title</h1><p>{0}</p><div class='{1}'><p>{2}</p></div></article></body>"
    assert shown(page.format("First. " * 20, name, text)) == ["Title", ("First. " * 20).strip(), text.strip()]


@pytest.mark.parametrize("text", [SHORT, LONG[:205], LONG])
@pytest.mark.parametrize(
    "part",
    [
        *[f"<div class='{n}'>{{}}</div>" for n in ("comment-list", "comment-section", "user-comments", "commentlist", "replies", "cookie-notice", "sponsored-box", "ad", "ad-banner-300x250", "sidebar-left", "related-posts", "share-buttons", "search-box", "newsletter-signup", "wp-comments-area", "post-comments", "menu-main", "related")],
        "<section id=comments>{}</section>", "<ol class='comment-list'><li>{}</ol>", "<aside>{}</aside>", "<nav>{}</nav>", "<footer>{}</footer>", "<form><input name=q>{}</form>", "<form class='login-form'><label>{}</label><input><button>Go</button></form>", "<div role=search>{}</div>", "<div hidden>{}</div>", "<noscript>{}</noscript>",
        "<template>{}</template>", "<select><option>{}</select>", "<button>{}</button>",
    ],
)
def test_other_parts_go_at_any_length(part, text):
    body = "Body text of the article. " * 10
    for page in ("<article><h1>Title</h1><p>{0}</p>{1}<p>End.</p></article>", "<main><p>Title</p><p>{0}</p>{1}<p>End.</p></main>"):
        assert shown(page.format(body, part.format(f"<p>{text}</p>" * 3 if "form" not in part else text))) == ["Title", body.strip(), "End."]


def test_headers_stay_in_article_elements_only():
    body = "Body text of the article. " * 10
    assert shown(f"<main><header><p>{LONG}</p></header><p>{body}</p></main>") == [body.strip()]
    assert shown(f"<header>Site</header><main><header>Site</header><article><header><h1>Title</h1></header><p>{body}</p></article></main>") == ["Title", body.strip()]


def test_a_form_around_the_page_is_no_form():
    body = "Body text of the article. " * 10
    assert shown(f"<form><input type=hidden name=state><p>{body}</p></form>") == [body.strip()]
    assert shown(f"<form><input name=q><article><p>{body}</p></article></form>") == [body.strip()]
    assert shown(f"<form><input name=q>{''.join(f'<p>{body}{i}</p>' for i in range(4))}</form>") == [f"{body}{i}" for i in range(4)]
    assert shown(f"<p>{body}</p><form><p>{body}</p><input name=mail></form>") == [body.strip()]


@pytest.mark.parametrize("tag", ["svg", "select", "object", "iframe", "noscript", "template"])
def test_unclosed_parts_end_with_their_parent(tag):
    body = "Body text of the article. " * 10
    assert shown(f"<article><div><{tag}>x</div><p>{body}</p></article>") == [body.strip()]
    assert shown(f"<article><{tag} a=b/><p>{body}</p></article>") == [body.strip()]


def built(rng: random.Random) -> tuple[str, list[str]]:
    """A page of random parts and the blocks of its article."""
    words = ["word", "über", "a<b", "R&D", "naïve", "x", "…", "longer-words", "日本"]
    said = lambda n: " ".join(rng.choices(words, k=n))
    junk = lambda: rng.choice(["<nav><ul><li><a href=/a>{}</a></li></ul></nav>", "<div class=ad>{}</div>", "<div class='user-comments'><p>{}</p><p>{}</p></div>", "<footer><p>{}</p></footer>", "<aside>{}</aside>", "<!-- {} -->", "<script>var a = '<p>{}</p>';</script>", "<style>p {{ {} }}</style>", "<form><label>{}</label><input></form>", "<div class='cookie-notice'><p>{}</p></div>"]).replace("{}", html.escape(said(rng.randrange(1, 90))).replace("--", ""))
    blocks, out = [], []
    for _ in range(rng.randrange(3, 12)):
        text = said(rng.randrange(1, 80))
        blocks.append(" ".join(text.split()))
        own = html.escape(text)
        if rng.random() < 0.3:
            own = own.replace(" ", rng.choice(["\n\t ", " <b>", "<br>", "&nbsp;", "&#32;", "<!-- x --> "]), 1)
        out.append(rng.choice(["<p>{}</p>", "<p class=form>{}", "<h2 id='search-engines'>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<div class='related-work'><div>{}</div></div>", "<ul><li>{}</ul>"]).format(own))
        if rng.random() < 0.3:
            out.append(junk())
    text = said(60)
    inside = "".join(out) + f"<p>{html.escape(text)}</p>"
    tag = rng.choice(["article", "main", "article class='post entry'"])
    page = f"<html><head><title>{html.escape(said(3))}</title></head><body>{junk()}{junk()}<{tag}>{inside}</{tag.split()[0]}>{junk()}</body></html>"
    return page, [*blocks, text]


def test_pages_give_back_what_they_were_built_from():
    for seed in range(400):
        page, blocks = built(random.Random(seed))
        assert shown(page) == blocks, (seed, page)
