"""Labelled pages to learn layouts from.

Fixed values: parts of pages, written for this purpose. A page is made of one main part, in one of ``WRAPS``, and of others around and within
it; ``data-label-main`` marks what belongs to the main text, ``data-label-not`` what does not within it. ``{s}`` stands for a few words,
``{t}`` for a title, ``{m}`` for a sentence, ``{l}`` for a paragraph; the words and the choice of parts are made by rule from a seed.
"""

from __future__ import annotations

import random

HEAD = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>{t}</title><style>p{margin:0}</style><script>var a="</p>";</script></head>'
LINKS = "".join("<li><a href=x>{s}</a></li>" for _ in range(6))
LINK_ROW = "<a href=x>{s}</a> | <a href=x>{s}</a> | <a href=x>{s}</a>"
COMMENT = "<a href=x>{s}</a><p>{l}</p><a href=x class=reply>{s}</a>"

MAIN = [
    "<h1>{t}</h1><p>{l}</p><p>{l}</p><h2>{s}</h2><p>{l}</p><ul><li>{m}</li><li>{m}</li></ul><p>{l}</p>",
    "<h1>{t}</h1><p>{m}</p>",
    "<h1>{t}</h1><p>{l}</p>",
    "<p>{l}</p><p>{l}</p>",
    "<h1>{t}</h1><p>{m} <a href=x>{s}</a> {m}</p><p>{l} <a href=x>{s}</a>, <em>{s}</em> {m}</p><blockquote>{l}</blockquote><p><a href=x>{s}</a></p>",
    "<h1>{t}</h1><p><b>{m}<br><p>{l}<p>{l}<p><b>{m}<br><p>{l}",
    "<h2>{t}</h2><p>{l}</p><figure><img src=x><figcaption>{m}</figcaption></figure><pre>{m}</pre><table><tr><td>{s}<td>{m}</table><p>{l}</p><dl><dt>{s}<dd>{m}</dl>",
    "<header><h1>{t}</h1><p class=byline>{s}</p></header><p>{l}</p><p>{m}</p><p>{l}</p>",
    "<h1>{t}</h1><time>{s}</time><section><h2>{s}</h2><p>{l}</p></section><section><h2>{s}</h2><p>{l}</p><p>{l}</p></section>",
    "<h1>{t}</h1>{l}<br><br>{l}<br>{m}<br><br>{l}",
    "<h1>{t}</h1><div><div>{l}</div><div>{m}</div><div>{l}</div></div>",
]
WRAPS = [
    "<article data-label-main>", "<main data-label-main>", "<main data-label-main><article>", "<div id=content data-label-main>", "<div class='post entry' data-label-main>",
    "<div class=article-body data-label-main>", "<div class='main-content story' data-label-main>", "<div class='page text' data-label-main>",
    "<div role=main data-label-main>", "<div role=article data-label-main>", "<div itemprop=articleBody data-label-main>", "<section data-label-main>", "<div data-label-main>",
    "<article class='post single' data-label-main>", "<section class=content data-label-main>", "<div id=main><div class=article data-label-main>", "<td class=body data-label-main>",
]
BEFORE = [
    f"<nav><ul>{LINKS}</ul></nav>", f"<nav>{LINK_ROW}</nav>", f"<div id=top-menu class=menu><ul>{LINKS}</ul></div>", f"<div class=navigation>{LINK_ROW}</div>", f"<div role=navigation>{LINK_ROW}</div>",
    "<header><h1>{s}</h1><p>{m}</p></header>", "<header><a href=x>{s}</a><form action=x><input><label>{s}</label></form></header>", "<div class=header><div class=logo>{s}</div><p>{m}</p></div>",
    "<div role=banner>{s}</div>", "<div class=breadcrumbs><a href=x>{s}</a> &gt; <a href=x>{s}</a></div>", f"<ul>{LINKS}</ul>", f"<div>{LINK_ROW}</div>", f"<header>{LINK_ROW}<p>{{s}}</p></header>",
    "<div class=skip><a href=x>{s}</a></div>", "<header class=site-header><h2>{s}</h2></header>",
]
ANYWHERE = [
    "<div class=ad>{m}</div>", "<div class=advertisement><p>{m}</p><p>{l}</p></div>", "<div class='sponsored ads'><a href=x>{m}</a><p>{m}</p></div>", "<div class='banner promo'>{m}</div>", "<div class=ad-slot>{m}</div>",
    "<div class=cookie-notice><p>{l}</p><button>{s}</button></div>", "<div class='alert notice warning'>{m}</div>", "<div role=alert class='gdpr consent privacy'><p>{m} {m}</p></div>", "<div class='cookie banner'>{l}</div>",
    "<div class='notice message'><p>{m}</p></div>", "<div class='modal popup overlay' hidden><p>{l}</p></div>", "<aside>{l}</aside>", "<aside><h3>{s}</h3><p>{l}</p></aside>", f"<aside class=sidebar><h4>{{s}}</h4><ul>{LINKS}</ul><p>{{m}}</p></aside>",
    "<div class=sidebar><h3>{s}</h3><p>{l}</p></div>", "<div class=widget><h4>{s}</h4><p>{l}</p></div>", "<div role=complementary><p>{l}</p></div>", "<div class='share social'><a href=x>{s}</a><a href=x>{s}</a></div>",
    f"<div class=related><h3>{{s}}</h3><ul>{LINKS}</ul></div>", "<form><p>{s}</p><label>{s}</label><input><button>{s}</button></form>", "<div class='newsletter subscribe signup'><p>{m}</p><form><input><label>{m}</label></form></div>",
    "<form class=search><input><label>{s}</label></form>", "<form action=x><fieldset><legend>{s}</legend><label>{s} <input></label><p>{m}</p></fieldset></form>", "<section class=newsletter><h2>{s}</h2><p>{m}</p></section>",
    "<div class=tags><a href=x>{s}</a><a href=x>{s}</a></div>", "<div class='author bio'><p>{m}</p></div>", "<div id=sidebar><p>{l}</p></div>", "<aside class=ads><p>{m}</p></aside>",
]
AFTER = [
    "<footer>&copy; {s} &middot; {m}</footer>", "<footer><p>{l}</p></footer>", "<footer>{m} {m}</footer>", f"<footer><ul>{LINKS}</ul></footer>", "<div id=footer>{m}</div>", "<div class=site-footer><p>{m}</p></div>",
    "<div class=copyright>{m}</div>", "<div class='legal disclaimer'><small>{m}</small></div>", "<div role=contentinfo>{m}</div>", "<div>&copy; {s}</div>", "<p>&copy; {m}</p>", f"<div>{LINK_ROW}</div>",
    f"<section class=comments id=comments><h3>{{s}}</h3><div class=comment>{COMMENT}</div><div class=comment>{COMMENT}</div><form><label>{{s}}</label><textarea></textarea><button>{{s}}</button></form></section>",
    "<div class=comments-area><ol><li class=comment><p>{l}</p><li class=comment><p>{l}</p><li class=comment><p>{l}</p></ol></div>", f"<div class=comment>{COMMENT}</div><div class=comment>{COMMENT}</div>",
    "<section><h2>{s}</h2><article class=comment><p>{l}</p></article><article class=comment><p>{m}</p></article></section>", "<div class='disqus thread'><div class='post-comment reply'><p>{l}</p></div><div class='post-comment reply'><p>{m}</p></div></div>",
    "<ul id=comments><li>{l}</li><li>{l}</li></ul>", "<div class='reader-comments discussion'><p>{l}</p><p>{l}</p></div>", "<div id=respond><h3>{s}</h3><form><p>{s}</p><input></form></div>",
]

_SYLLABLES = "an ba che der en fi gra hou in je ka lo men no or pra que ri sta the un ver wi xa you zen".split()


def _words(rng: random.Random, least: int, most: int) -> list[str]:
    return ["".join(rng.choices(_SYLLABLES, k=rng.choice((1, 1, 2, 2, 3)))) for _ in range(rng.randint(least, most))]


def _sentence(rng: random.Random) -> str:
    words = _words(rng, 3, 22)
    if len(words) > 8 and rng.random() < 0.6:
        words[len(words) // 2] += ","
    return " ".join(words).capitalize() + rng.choice("....!?")


def _fill(rng: random.Random, kind: str) -> str:
    if kind == "s":
        return " ".join(_words(rng, 1, 4))
    if kind == "t":
        return " ".join(_words(rng, 2, 10)).capitalize()
    return " ".join(_sentence(rng) for _ in range(1 if kind == "m" else rng.randint(1, 9)))


def _not_main(part: str) -> str:
    """``part`` marked as not belonging to the main text that it stands in."""
    end = part.index(">")
    return f"{part[:end]} data-label-not{part[end:]}"


def _page(rng: random.Random) -> str:
    main, wrap = rng.choice(MAIN), rng.choice(WRAPS)
    if rng.random() < 0.4:
        within = _not_main(rng.choice(ANYWHERE + AFTER[:3]))
        cut = rng.choice([i for i in range(len(main) + 1) if main[i : i + 3] in ("<p>", "<h2") or i == len(main)])
        main = main[:cut] + within + main[cut:]
    ends = "".join(f"</{t.split()[0]}>" for t in reversed(wrap.replace(">", "").split("<")[1:]))
    body = wrap + main + ends
    if wrap.startswith("<td"):
        body = f"<table><tr><td>{rng.choice(BEFORE[1:5])}</td>{body}</table>"
    before = rng.sample(BEFORE, rng.randint(0, 3)) + rng.sample(ANYWHERE, rng.randint(0, 2))
    after = rng.sample(ANYWHERE, rng.randint(0, 2)) + rng.sample(AFTER, rng.randint(0, 3))
    around = rng.choice(["{}", "{}", "<div class=wrapper>{}</div>", "<div id=container>{}</div>", "<div>{}</div>"])
    rng.shuffle(before)
    if rng.random() < 0.3:
        return "<body>" + "".join(before) + around.replace("{}", body + "".join(after[:1])) + "".join(after[1:]) + "</body></html>"
    return "<body>" + around.replace("{}", "".join(before) + body + "".join(after)) + rng.choice(["</body></html>", ""])


def labelled_pages(pages: int, seed: int = 11) -> list[str]:
    """``pages`` labelled pages; the same for the same ``seed``."""
    rng, made = random.Random(seed), []
    for _ in range(pages):
        text = _page(rng)
        if rng.random() < 0.8:
            text = HEAD + text
        for kind in "stml":
            pieces = text.split(f"{{{kind}}}")
            text = pieces[0] + "".join(_fill(rng, kind) + p for p in pieces[1:])
        made.append(text)
    return made
