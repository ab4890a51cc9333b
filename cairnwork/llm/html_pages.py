"""Labelled pages to learn from: layouts with known main text, filled with made-up words.

The words carry no meaning and differ between pages, so a model that learns from these pages has only structure,
tags, attributes and the shape of text to go by. Each page comes as a list of (html fragment, label or None): label
True for a fragment that is one block of main text, False for one of boilerplate, None for bare markup.
"""

from __future__ import annotations

import random

Fragment = tuple[str, bool | None]
SYLLABLES = "ba de fi go lu ma ne pi ro su ta ve wi xo yu zen kor lim nas tor il an er on ui ée ö ñ ß".split()
CONTENT_BOXES = [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
    ('<div class="content">', "</div>"), ('<div id="content"><div class="post-body">', "</div></div>"),
    ('<div class="entry-content">', "</div>"), ('<section class="article-text">', "</section>"),
    ('<div role="main">', "</div>"), ('<div class="wrap"><div class="story">', "</div></div>"),
]


def words(r: random.Random, low: int, high: int, stop: bool = True) -> str:
    out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    if r.random() < 0.15:
        out = [w + r.choice(["###", "&amp;&amp;", "$$$", "***", "!!", "%%%"]) for w in out]
    out = [w + "," if r.random() < 0.08 else w for w in out]
    text = " ".join(out)
    return (text.capitalize() + ("." if stop else "")) if r.random() < 0.95 else text.upper()


def paragraph(r: random.Random) -> str:
    size = r.choice([(2, 6), (8, 30), (30, 90), (90, 200)])
    text = " ".join(words(r, max(2, size[0] // 3), max(3, size[1] // 3)) for _ in range(3))
    if r.random() < 0.2:
        text = text.replace(" ", f' <a href="/{words(r, 1, 1, False)}">', 1).replace(". ", "</a>. ", 1) if ". " in text else text
        text += "</a>" if text.count("<a ") > text.count("</a>") else ""
    if r.random() < 0.15:
        text = f"<b>{text}" + ("<br>" if r.random() < 0.5 else "</b>")
    return text


def links(r: random.Random, low: int, high: int) -> list[Fragment]:
    style = r.choice(["<li>{}</li>", "<span>{}</span> ", "<div>{}</div>", "<p>{}</p>"])
    items = [f'<a href="/{i}">{words(r, 1, 3, r.random() < 0.2)}</a>' for i in range(r.randint(low, high))]
    if "<span>" in style:
        return [("".join(style.format(x) for x in items), False)]
    body = [(style.format(x), False) for x in items]
    return [("<ul>", None), *body, ("</ul>", None)] if "<li>" in style else body


def boxed(open_: str, inside: list[Fragment], close: str) -> list[Fragment]:
    return [(open_, None), *inside, (close, None)]


def advert(r: random.Random) -> list[Fragment]:
    tag = r.choice(['div class="ad"', 'div class="ads-banner"', 'div id="sponsor"', 'aside class="promo"', 'div class="advert"', 'p class="ad"'])
    return [(f"<{tag}>{words(r, 3, 25)}</{tag.split()[0]}>", False)]


def notice(r: random.Random) -> list[Fragment]:
    tag = r.choice(["cookie-notice", "notice", "consent-banner", "newsletter", "subscribe-box", "alert"])
    inside: list[Fragment] = [(f"<p>{words(r, 5, 30)}</p>", False)]
    if r.random() < 0.5:
        inside.append((f"<button>{words(r, 1, 2, False)}</button>", False))
    return boxed(f'<div class="{tag}">', inside, "</div>")


def form(r: random.Random) -> list[Fragment]:
    inside: list[Fragment] = [(f"<label>{words(r, 1, 4, False)}</label><input name=q>", False)]
    if r.random() < 0.5:
        inside = [(f"<p>{words(r, 3, 12)}</p>", False), *inside]
    return boxed(r.choice(["<form>", '<form class="search" action="/s">']), inside, "</form>")


def comments(r: random.Random) -> list[Fragment]:
    box = r.choice([('<div class="comments">', "</div>"), ('<section id="comments">', "</section>"), ('<div id="disqus" class="comment-list">', "</div>")])
    inside: list[Fragment] = [(f"<h3>{words(r, 1, 3, False)}</h3>", False)] if r.random() < 0.7 else []
    for _ in range(r.randint(1, 5)):
        one = r.choice(['<div class="comment">', "<li>", '<article class="comment">', "<div>"])
        inside += [(one, None), (f"<p>{paragraph(r)}</p>", False), (f"</{one[1:].split()[0].rstrip('>')}>", None)]
    return boxed(box[0], inside, box[1])


def article(r: random.Random, title: str) -> list[Fragment]:
    out: list[Fragment] = [(f"<h1>{title}</h1>", True)] if r.random() < 0.9 else []
    for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14])):
        kind = r.random()
        close = "" if r.random() < 0.1 else "</p>"
        if kind < 0.72:
            out.append((f"<p>{paragraph(r)}{close}", True))
        elif kind < 0.80:
            out.append((f"<h2>{words(r, 1, 8, False)}</h2>", True))
        elif kind < 0.86:
            out += [("<ul>", None), *[(f"<li>{words(r, 2, 15)}</li>", True) for _ in range(r.randint(1, 6))], ("</ul>", None)]
        elif kind < 0.90:
            out += boxed("<blockquote>", [(f"<p>{paragraph(r)}</p>", True)], "</blockquote>")
        elif kind < 0.93:
            out.append((f"<pre>{words(r, 3, 20)}</pre>", True))
        elif kind < 0.95:
            out += [("<table><tr>", None), *[(f"<td>{words(r, 1, 4, False)}</td>", True) for _ in range(4)], ("</tr></table>", None)]
        elif kind < 0.98:
            out += advert(r)
        else:
            out += boxed('<div class="share">', links(r, 2, 4), "</div>")
    if not any(label for _, label in out):
        out.append((f"<p>{paragraph(r)}</p>", True))
    return out


def page(seed: int) -> list[Fragment]:
    r = random.Random(seed)
    title = words(r, 3, 12)
    out: list[Fragment] = [(f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>", None)]
    if r.random() < 0.4:
        out += boxed("<header>", [(f"<div>{words(r, 1, 6)}</div>", False), *(links(r, 1, 4) if r.random() < 0.5 else [])], "</header>")
    if r.random() < 0.85:
        out += boxed(*(lambda b: (b[0], links(r, 2, 10), b[1]))(r.choice([("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<div id="navbar">', "</div>")])))
    for part, chance in ((advert, 0.5), (notice, 0.3), (form, 0.15)):
        if r.random() < chance:
            out += part(r)
    aside = [(f"<h3>{words(r, 1, 3, False)}</h3>", False), *links(r, 2, 6), *([(f"<p>{paragraph(r)}</p>", False)] if r.random() < 0.5 else [])]
    side = boxed(*(lambda b: (b[0], aside, b[1]))(r.choice([("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<div id="related">', "</div>")])))
    if r.random() < 0.2:
        out += side
    box = r.choice(CONTENT_BOXES) if r.random() < 0.6 else CONTENT_BOXES[0]
    body = article(r, title)
    if r.random() < 0.08:  # comments inside the box of the article
        body += comments(r)
    out += boxed(box[0], body, box[1])
    for part, chance in ((comments, 0.3), (notice, 0.15), (form, 0.15), (advert, 0.2)):
        if r.random() < chance:
            out += part(r)
    if r.random() < 0.3:
        out += side
    if r.random() < 0.85:
        foot = [(f"<footer>&copy; {words(r, 1, 2, False)} &middot; {words(r, 2, 20)}</footer>", False)]
        out += r.choice([foot, boxed("<footer>", [(f"<p>{words(r, 3, 15)}</p>", False), *links(r, 0, 4)], "</footer>"), boxed('<div class="footer">', [(f"<p>{words(r, 3, 15)}</p>", False)], "</div>")])
    out.append((r.choice(["</body></html>", ""]), None))
    return out
