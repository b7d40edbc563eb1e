"""Labelled pages to train on: made from a seed, so that every run learns the same weights.

Layouts differ in element names, class names, nesting, order and amount of everything around the article, and in
what the article itself holds.  Words are random, so nothing can be learned from them.
"""

from __future__ import annotations

import random

MARK = "\u2063"     # stands at the head of a content block; the trainer strips it


def _words(rng: random.Random, low: int, high: int) -> str:
    out = ["".join(rng.choice("etaoinshrdlcum") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
    return " ".join(out).capitalize() + rng.choice(("", ".", ".", "!"))


def _wrap(rng: random.Random, options: tuple[str, ...], inner: str) -> str:
    """``inner`` in an element given as ``tag attributes``."""
    chosen = rng.choice(options)
    return f"<{chosen}>{inner}</{chosen.split()[0]}>"


def _links(rng: random.Random, most: int = 8) -> str:
    items = [f'<a href="/{n}">{_words(rng, 1, 3)}</a>' for n in range(rng.randint(2, most))]
    if rng.random() < 0.6:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    return rng.choice((" | ", " ", "")).join(items)


def _article_block(rng: random.Random, brief: float) -> str:
    kind = rng.random()
    text = MARK + _words(rng, *((1, 6) if rng.random() < brief else (5, 90)))
    if kind < 0.62:
        if rng.random() < 0.2:
            text += f' <a href="/x">{_words(rng, 1, 4)}</a> ' + _words(rng, 2, 20)
        if rng.random() < 0.25:
            text = f"<b>{text}<br>"
        return f"<p>{text}</p>" if rng.random() < 0.8 else f"<p>{text}"
    if kind < 0.72:
        level = rng.randint(2, 4)
        return f"<h{level}>{MARK}{_words(rng, 1, 8)}</h{level}>"
    if kind < 0.80:
        return "<ul>" + "".join(f"<li>{MARK}{_words(rng, 1, 15)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
    if kind < 0.85:
        return f"<blockquote><p>{text}</p></blockquote>"
    if kind < 0.89:
        return "<table>" + "".join(f"<tr><td>{MARK}{_words(rng, 1, 3)}</td><td>{MARK}{_words(rng, 1, 3)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
    if kind < 0.92:
        return f"<figure><img src=x><figcaption>{MARK}{_words(rng, 3, 12)}</figcaption></figure>"
    return f"<div>{text}</div>"


_ADS = ('div class="ad"', 'div class="ads banner"', 'aside class="advert"', 'div id="sponsored"', 'section class="promo"', 'div class="advertisement"')


def _around(rng: random.Random, kind: str) -> str:
    if kind == "menu":
        return _wrap(rng, ("nav", 'nav class="main-menu"', 'div class="menu"', 'div id="navbar"', 'ul class="nav"', 'div role="navigation"', "menu"), _links(rng))
    if kind == "crumbs":
        return _wrap(rng, ('div class="breadcrumbs"', 'nav aria-label="breadcrumb"', 'ol class="breadcrumb"'), _links(rng, 4))
    if kind == "header":
        inner = rng.choice((f"<h1>{_words(rng, 1, 3)}</h1>", f"<div>{_words(rng, 1, 4)}</div>", f"<a href='/'>{_words(rng, 1, 2)}</a>", f"<p>{_words(rng, 2, 12)}</p>"))
        return _wrap(rng, ("header", 'header class="site-header"', 'div id="header"', 'div class="masthead"', 'div role="banner"'), inner + (_around(rng, "menu") if rng.random() < 0.4 else ""))
    if kind == "footer":
        inner = rng.choice((_words(rng, 3, 25), f"&copy; x.example &middot; {_words(rng, 3, 25)}", f"<p>{_words(rng, 3, 20)}</p>" + _links(rng), _links(rng)))
        return _wrap(rng, ("footer", 'footer class="site-footer"', 'div id="footer"', 'div class="footer"', 'div role="contentinfo"'), inner)
    if kind == "side":
        inner = "".join(rng.choice((f"<h3>{_words(rng, 1, 4)}</h3>", f"<p>{_words(rng, 4, 40)}</p>", _links(rng), f"<div>{_words(rng, 4, 30)}</div>")) for _ in range(rng.randint(1, 4)))
        return _wrap(rng, ("aside", 'aside class="sidebar"', 'div class="sidebar"', 'div id="side"', 'div class="widget"', 'div role="complementary"'), inner)
    if kind == "notice":
        inner = rng.choice((_words(rng, 4, 30), f"<p>{_words(rng, 4, 40)}</p>")) + rng.choice(("", f"<button>{_words(rng, 1, 2)}</button>"))
        return _wrap(rng, ('div class="cookie-notice"', 'div id="consent"', 'div class="notice"', 'div role="alert"', 'div class="popup"', 'dialog', 'section class="gdpr-banner"', 'div role="dialog"', 'aside class="notice"'), inner)
    if kind == "ad":
        return _wrap(rng, _ADS, rng.choice((_words(rng, 2, 30), f"<p>{_words(rng, 3, 25)}</p>", f"<a href='/'>{_words(rng, 2, 10)}</a>")))
    if kind == "form":
        inner = f"<label>{_words(rng, 1, 4)}</label><input><button>{_words(rng, 1, 2)}</button>" + rng.choice(("", f"<p>{_words(rng, 3, 20)}</p>", f"<select><option>{_words(rng, 1, 2)}<option>{_words(rng, 1, 2)}</select>", f"<textarea>{_words(rng, 1, 4)}</textarea>"))
        return _wrap(rng, ("form", 'form class="newsletter"', 'div class="subscribe"', 'div class="search-form"', 'div id="signup"', 'form id="contact"'), inner)
    if kind == "comments":
        one = lambda: rng.choice((
            f"<div class='comment'><p>{_words(rng, 3, 50)}</p></div>", f"<li><p>{_words(rng, 3, 50)}</p></li>",
            f"<article class='comment'><p>{_words(rng, 3, 40)}</p></article>", f"<p>{_words(rng, 3, 50)}</p>", f"<div><b>{_words(rng, 1, 2)}</b> {_words(rng, 3, 40)}</div>"))
        inner = rng.choice(("", f"<h3>{_words(rng, 1, 3)}</h3>", f"<h2>{_words(rng, 1, 3)}</h2>")) + "".join(one() for _ in range(rng.randint(1, 5)))
        return _wrap(rng, ('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'section id="respond"', 'div class="reader-comments"', 'ul class="comments"'), inner)
    if kind == "share":
        return _wrap(rng, ('div class="share"', 'div class="social-links"', 'ul class="sharing"'), _links(rng, 4))
    inner = f"<h3>{_words(rng, 1, 4)}</h3>" * (rng.random() < 0.6) + rng.choice((_links(rng), "".join(f"<div><a href='/'>{_words(rng, 2, 8)}</a><p>{_words(rng, 3, 20)}</p></div>" for _ in range(rng.randint(1, 4)))))
    return _wrap(rng, ('div class="related"', 'section class="recommended"', 'aside class="related-posts"', 'div id="trending"'), inner)


KINDS = ("menu", "crumbs", "header", "footer", "side", "notice", "ad", "form", "comments", "share", "related")


def labelled_page(rng: random.Random) -> str:
    """One page; each content block begins with ``MARK``."""
    count, brief = rng.choice((0, 1, 1, 1, 2, 2, 3, 4, 6, 10, 16)), rng.choice((0.1, 0.3, 1.0))
    blocks = [f"<h1>{MARK}{_words(rng, 1, 10)}</h1>"] * (rng.random() < 0.8) + [_article_block(rng, brief) for _ in range(count)]
    if not blocks and rng.random() < 0.8:
        blocks = [_article_block(rng, 1.0)]
    if blocks and rng.random() < 0.25:
        blocks[0] = f"<header>{blocks[0]}</header>"
    for _ in range(rng.choice((0, 0, 0, 1, 2))):     # things inside the article that are not of it
        blocks.insert(rng.randint(1, len(blocks)) if blocks else 0, _around(rng, rng.choice(("ad", "share", "related", "form", "comments", "notice", "menu", "side", "footer"))))
    inner = "".join(blocks)
    style = rng.random()
    if style < 0.55:
        article = _wrap(rng, ("article", "article", 'article class="post"', 'article id="story"'), inner)
    elif style < 0.75:
        article = _wrap(rng, ("main", 'main id="content"', 'main role="main"'), inner)
    elif style < 0.92:
        article = _wrap(rng, ('div class="content"', 'div id="article"', 'div class="post-content"', 'div class="entry"', 'div role="main"', 'section class="story"'), inner)
    else:
        article = _wrap(rng, ("div", "section"), inner)
    if rng.random() < 0.3:
        article = _wrap(rng, ("main", "div", 'div class="container"', 'div id="page"', 'div class="wrapper"', "section"), article)
    before = [_around(rng, k) for k in rng.sample(("menu", "header", "notice", "ad", "crumbs", "form", "side"), rng.randint(0, 4))]
    after = [_around(rng, k) for k in rng.sample(("footer", "comments", "related", "side", "ad", "form", "notice", "share", "menu"), rng.randint(0, 5))]
    body = "".join(before) + article + "".join(after)
    if rng.random() < 0.3:
        body = _wrap(rng, ("div", 'div class="wrapper"', 'div id="container"'), body)
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 1, 8)}</title></head><body>{body}</body></html>"
