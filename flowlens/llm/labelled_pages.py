"""Labelled pages to train the extraction of main text on, made from parts that pages of many kinds share.

Each page is drawn from a seed: a frame for the article, menus, headers, adverts, notices, forms, sidebars, reader
comments and footers in several styles, around prose of made-up words. Some pages have no frame: their article lies
right in the body, in a table's cell or in center, or is text without any element. data-content marks what is content.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

PAGES, FRAMELESS, SEED = 1500, 500, 5
_SYLLABLES = "ba co de fi ga lu mo ne pi ro sa ti vu wen dar lis tor mel an es".split()


def _words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choices(_SYLLABLES, k=r.choice((1, 1, 2, 2, 3)))) for _ in range(n)]


def _sentences(r: random.Random, n_words: int) -> str:
    out = []
    while n_words > 0:
        k = min(n_words, r.randint(2, 16))
        ws = _words(r, k)
        if k > 6:
            ws[k // 2] += ","
        out.append(" ".join(ws).capitalize() + r.choice(("....?!"[k % 6], ".")))
        n_words -= k
    return " ".join(out)


def _prose(r: random.Random, n_words: int) -> str:
    """Text of an article, which needn't be clean: bare words, shouting, signs behind words, one word again and again."""
    kind = r.random()
    if kind < 0.6:
        return _sentences(r, n_words)
    words = _words(r, n_words)
    if kind < 0.75:
        return " ".join(words)
    if kind < 0.83:
        return " ".join(f"{w}{r.choice(('***', '%%%', '!!', '|'))}" for w in words)
    if kind < 0.9:
        return " ".join(words[:1] * n_words)
    return " ".join(words).upper() if kind < 0.95 else " | ".join(words)


def _list(r: random.Random, n: int, tag: str = "ul", attrs: str = "") -> str:
    return f"<{tag}{attrs}>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in _words(r, n)) + f"</{tag}>"


def _article(r: random.Random) -> str:
    tag, names = r.choice((("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("section", ' class="entry story"'), ("div", ' class="article-body"')))
    parts = [f"<h1>{_prose(r, r.randint(2, 12))}</h1>"]
    if r.random() < 0.3:
        parts = [f"<header>{parts[0]}<p>{_prose(r, 6)}</p></header>"]
    for _ in range(r.randint(1, 12)):
        prose = _prose(r, r.choice((2, 4, 8, 20, 40, 80, 160)))
        kind = r.random()
        if kind < 0.7:
            parts.append(f"<p>{prose}" + "</p>" * (r.random() < 0.85))
        elif kind < 0.76:
            parts.append(f"<h2>{_prose(r, r.randint(1, 6))}</h2><p><b>{prose}<br></p>")
        elif kind < 0.82:
            parts.append("<ul>" + "".join(f"<li>{_prose(r, r.randint(2, 12))}</li>" for _ in range(3)) + "</ul>")
        elif kind < 0.87:
            parts.append(f"<blockquote><p>{prose}</p></blockquote>")
        elif kind < 0.9:
            parts.append(f"<table><tr><td>{_prose(r, 2)}<td>{_prose(r, 3)}</tr></table>")
        elif kind < 0.93:
            parts.append(f"<pre>{prose}</pre>")
        elif kind < 0.96:
            parts.append(f'<p>{prose} <a href="/x">{_prose(r, 4)}</a> {_prose(r, 6)}</p>')
        else:
            parts.append(r.choice((_advert, _related, _notice))(r))
    return f'<{tag}{names} data-content="1">' + "".join(parts) + f"</{tag}>"


def _menu(r: random.Random) -> str:
    inner = _list(r, r.randint(2, 10))
    return r.choice((f"<nav>{inner}</nav>", f'<div class="menu" data-content="0">{inner}</div>', _list(r, 6, "ul", ' class="nav navbar"'), f'<div id="breadcrumbs">{inner}</div>', f'<div role="navigation">{inner}</div>'))


def _header(r: random.Random) -> str:
    name = " ".join(_words(r, 2))
    return r.choice((f'<header><a href="/">{name}</a><p>{_sentences(r, 5)}</p></header>', f'<div class="header"><h1>{name}</h1></div>', f'<div id="masthead"><p>{_sentences(r, 4)}</p></div>', f"<header><nav>{_list(r, 5)}</nav></header>"))


def _advert(r: random.Random) -> str:
    text = _sentences(r, r.choice((4, 10, 25)))
    return r.choice((f'<div class="ad" data-content="0">{text}</div>', f'<div class="ads sponsored" data-content="0"><p>{text}</p></div>', f'<aside class="promo" data-content="0">{text}</aside>', f'<div id="advert" data-content="0"><a href="/b">{text}</a></div>'))


def _notice(r: random.Random) -> str:
    text = _sentences(r, r.choice((8, 20)))
    return r.choice((f'<div class="cookie-notice" data-content="0"><p>{text}</p></div>', f'<div class="notice" role="alert" data-content="0">{text}</div>', f'<dialog data-content="0"><p>{text}</p></dialog>', f'<div id="newsletter" data-content="0"><p>{text}</p></div>'))


def _form(r: random.Random) -> str:
    return f'<form data-content="0"><p>{_sentences(r, 6)}</p><label>{_words(r, 1)[0]}</label><input name="q"><button>{_words(r, 1)[0]}</button></form>'


def _related(r: random.Random) -> str:
    return r.choice((f'<aside data-content="0"><h3>{_sentences(r, 2)}</h3>{_list(r, 4)}</aside>', f'<div class="sidebar" data-content="0"><p>{_sentences(r, 20)}</p>{_list(r, 5)}</div>', f'<div class="related" data-content="0">{_list(r, 4)}</div>', f'<section class="widget" data-content="0"><p>{_sentences(r, 12)}</p></section>'))


def _comments(r: random.Random) -> str:
    each = [_sentences(r, r.choice((5, 15, 40))) for _ in range(r.randint(1, 4))]
    return r.choice((
        '<section class="comments" data-content="0"><h2>' + _sentences(r, 2) + "</h2>" + "".join(f'<div class="comment"><p>{t}</p></div>' for t in each) + "</section>",
        '<div id="comments" data-content="0"><ol>' + "".join(f"<li><p>{t}</p></li>" for t in each) + "</ol></div>",
        '<div class="discussion" data-content="0">' + "".join(f"<article class='reply'><p>{t}</p></article>" for t in each) + "</div>",
    ))


def _footer(r: random.Random) -> str:
    text = _sentences(r, r.choice((3, 10, 25)))
    return r.choice((f"<footer>&copy; {text}</footer>", f'<div class="footer"><p>{text}</p>{_list(r, 3)}</div>', f"<footer><p>{text}</p><nav>{_list(r, 4)}</nav></footer>", f'<div id="copyright"><p>{text}</p></div>'))


def labelled_page(seed: int) -> str:
    r = random.Random(seed)
    before = [f(r) for f, p in ((_notice, 0.3), (_header, 0.6), (_menu, 0.8), (_advert, 0.5), (_form, 0.3), (_related, 0.3)) if r.random() < p]
    after = [f(r) for f, p in ((_related, 0.4), (_comments, 0.5), (_form, 0.3), (_advert, 0.3), (_notice, 0.2), (_footer, 0.9)) if r.random() < p]
    middle = _article(r)
    if r.random() < 0.3:
        middle = f'<div class="wrapper">{middle}</div>' if r.random() < 0.5 else f"<div>{middle}{after.pop() if after else ''}</div>"
    head = f"<head><meta charset=utf-8><title>{_sentences(r, 5)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{middle}{''.join(after)}</body></html>"


def _apart(part: str) -> str:
    """A part of a page, marked as no content."""
    return part if re.match(r"<[^>]*data-content", part) else re.sub(r"^<(\w+)", r'<\1 data-content="0"', part)


def frameless_page(seed: int) -> str:
    """A page without an element of its own for the article."""
    r = random.Random(seed)
    kind = r.randrange(6)
    paragraphs = [_prose(r, r.choice((3, 8, 20, 40, 80))) for _ in range(r.randint(1, 6))]
    parts = "".join(f"<p>{t}" + "</p>" * (r.random() < 0.85) for t in paragraphs)
    if r.random() < 0.5:
        parts = f"<h1>{_prose(r, r.randint(2, 8))}</h1>" + parts
    lines = r.choice(("<br><br>", "<br>", "<p>")).join(paragraphs)
    before = "".join(_apart(f(r)) for f, p in ((_header, 0.3), (_menu, 0.5), (_advert, 0.2)) if r.random() < p)
    after = "".join(_apart(f(r)) for f, p in ((_related, 0.2), (_comments, 0.2), (_footer, 0.5)) if r.random() < p)
    if kind < 2:
        return f'<html><head data-content="0"><title>{_sentences(r, 3)}</title></head><body data-content="1">{before}{(parts, lines)[kind]}{after}</body></html>'
    if kind == 2:
        return f'<html><body>{before}<center data-content="1"><font size=2>{r.choice((parts, lines))}</font></center>{after}</body></html>'
    if kind == 3:
        side = f'<td data-content="0">{_list(r, 5)}</td>' * (r.random() < 0.5)
        return f'<body>{before}<table><tr>{side}<td data-content="1">{r.choice((parts, lines))}</td></tr></table>{after}</body>'
    return f'<html data-content="1">{r.choice((parts, lines, paragraphs[0]))}'


def labelled_pages(spark: SparkSession, pages: int = PAGES, seed: int = SEED, frameless: int = FRAMELESS) -> DataFrame:
    """(html): labelled pages, the same for the same seed; so many with a frame and so many without."""
    drawn = [labelled_page(seed * 1_000_003 + k) for k in range(pages)] + [frameless_page(seed * 1_000_003 + k) for k in range(frameless)]
    return spark.createDataFrame([(html,) for html in drawn], "html string")
