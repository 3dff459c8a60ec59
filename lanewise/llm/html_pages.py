"""Labelled pages for training the extractor: page layouts written at random from a seed.

Each page has a main text in one of many containers, with menus, headers, footers, sidebars, notices,
adverts, forms and reader comments around and sometimes inside it, named by element, by class or id, or by
nothing that helps. Texts are invented words, so the model learns structure and shape, not vocabulary.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

_ONSETS = "b c d f g h j l m n p r s t v w br ch cl dr fl gr pl sch st th tr é ñ ö ü".split()
_CODAS = "a e i o u an en in on er el is ar um ou ai ei ío ä".split()


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.main: set[str] = set()
        common = rng.sample(["the", "of", "and", "to", "in", "der", "die", "und", "de", "la", "que", "el", "le", "et", "is", "for", "on", "with"], 10)
        self.words = common * 6 + ["".join(rng.choice(_ONSETS) + rng.choice(_CODAS) for _ in range(rng.randint(1, 4))) for _ in range(300)]

    def few(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        text = self.few(3, 18)
        end = self.rng.choice(["."] * 12 + ["!", "?", "...", ":"])
        return text[0].upper() + text[1:] + end

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def numbered(self) -> str:
        """A short line with numbers: a licence, a date, a price, an address."""
        rng = self.rng
        text = self.few(1, 6) + " " + rng.choice([f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", f"{rng.randint(1, 31)}/{rng.randint(1, 12)}/{rng.randint(1990, 2025)}", f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", f"{self.few(1, 1)}@example.com", f"{rng.randint(1, 9999)} {self.few(1, 3)}"])
        return text[0].upper() + text[1:] + rng.choice([".", ".", ""])

    def title(self) -> str:
        text = self.few(2, 9)
        return text[0].upper() + text[1:] + self.rng.choice(["", "", "", ".", "?"])

    def inline(self, text: str) -> str:
        """Mark up some words of a text, and write it as HTML."""
        rng, out = self.rng, []
        for word in text.split():
            word = escape(word, quote=False)
            roll = rng.random()
            if roll < 0.02:
                word = f'<a href="/{rng.randint(1, 999)}">{word}</a>'
            elif roll < 0.05:
                tag = rng.choice(["b", "em", "i", "strong", "span", "code"])
                word = f"<{tag}>{word}</{tag}>"
            out.append(word)
        return rng.choice([" ", " ", "\n"]).join(out)

    def keep(self, text: str) -> str:
        """A main block's text: noted, and written as HTML."""
        self.main.add(" ".join(text.split()))
        return self.inline(text)


_CONTAINERS = [
    "<article>|</article>", '<article class="post">|</article>', "<main>|</main>", '<main id="main"><article>|</article></main>', '<div id="content">|</div>', '<div class="content">|</div>', '<div class="post-content entry">|</div>', '<section class="story">|</section>',
    '<div class="article-body">|</div>', '<div class="container"><div class="row"><div class="col main">|</div></div></div>', "<table><tr><td>|</td></tr></table>", '<div class="k7a">|</div>', '<div><div><div>|</div></div></div>', "|", '<div role="main">|</div>', '<div itemprop="articleBody">|</div>',
    '<div class="entry-content">|</div>', '<section><div class="text">|</div></section>', '<div class="page"><div class="body">|</div></div>', '<div id="wrapper"><div id="article">|</div></div>',
]


def _links(w: _Writer, low: int, high: int, last: str = "") -> str:
    rng = w.rng
    items = [f'<a href="/{rng.randint(1, 9999)}">{escape(w.few(1, 3))}</a>' for _ in range(rng.randint(low, high))]
    shape = rng.random()
    if shape < 0.55:
        close = rng.choice(["</li>", "</li>", ""])
        return "<ul>" + "".join(f"<li>{i}{close}" for i in items) + "</ul>"
    if shape < 0.75:
        return rng.choice([" | ", " ", " &middot; ", " › "]).join(items)
    tag = rng.choice(["div", "p", "li", "span"])
    return "".join(f"<{tag}>{i}</{tag}>" for i in items)


def _box(w: _Writer, tags: str, names: str, inside: str) -> str:
    """An element that tells what it is by its tag or by a name, seldom by neither."""
    rng = w.rng
    tag, name = rng.choice(tags.split()), rng.choice(names.split())
    roll = rng.random()
    if roll < 0.35 and tag != "div":
        return f"<{tag}>{inside}</{tag}>"
    if roll < 0.95 or tag != "div":
        where = rng.choice(["class", "class", "id"])
        extra = rng.choice(["", "", " box", " clearfix", " wide"]) if where == "class" else ""
        return f'<{tag} {where}="{name}{extra}">{inside}</{tag}>'
    return f"<div>{inside}</div>"


def _menu(w):
    return _box(w, "nav nav div ul", "nav menu navigation navbar main-menu topnav site-nav breadcrumb breadcrumbs pagination pager toc", _links(w, 3, 9))


def _header(w):
    rng = w.rng
    tag = rng.choice(["h1", "p", "div", "a", "span", "h2"])
    inside = f"<{tag}>{escape(w.few(1, 4))}</{tag}>" + rng.choice(["", f"<p>{escape(w.few(3, 8))}</p>", _links(w, 2, 5), f"<p>{escape(w.sentence())}</p>"])
    return _box(w, "header header div", "header masthead site-header top banner branding logo topbar", inside)


def _footer(w):
    rng = w.rng
    bits = [rng.choice(["&copy;", "©", "Copyright", "&copy; 2024"]) + f" {w.few(1, 4)} &middot; {escape(w.sentence())}", f"<p>&copy; {w.few(1, 3)}. All rights reserved.</p>", _links(w, 2, 6), f"<p>{escape(w.prose(1, 2))}</p>", f"<small>{escape(w.sentence())}</small>"]
    return _box(w, "footer footer div", "footer site-footer bottom colophon foot legal", "".join(rng.sample(bits, rng.randint(1, 3))))


def _aside(w):
    rng = w.rng
    head = rng.choice(["", f"<h3>{escape(w.few(1, 3))}</h3>", f"<h2>{escape(w.title())}</h2>"])
    inside = head + rng.choice([_links(w, 3, 8), f"<p>{escape(w.prose(1, 4))}</p>", f"<ul><li>{escape(w.title())}</li><li>{escape(w.title())}</li></ul>"])
    return _box(w, "aside aside div section", "sidebar side widget related related-posts recommended popular trending right-col secondary teaser more-stories author-box share social sharing tags", inside)


def _notice(w):
    rng = w.rng
    lead = rng.choice(["We use cookies. ", "", "", "Cookies: ", "Please note: "])
    inside = f"<p>{lead}{escape(w.prose(1, 2))}</p>" + rng.choice(["", "<button>Accept</button>", f'<a href="#">{w.few(1, 2)}</a>'])
    if rng.random() < 0.3:
        inside = lead + escape(w.prose(1, 2))
    return _box(w, "div div section dialog aside", "cookie cookie-banner cookies consent notice alert gdpr popup modal message overlay notification paywall disclaimer banner-notice announcement", inside)


def _advert(w):
    rng = w.rng
    inside = rng.choice([escape(w.sentence()), escape(w.prose(1, 3)), f"<p>{escape(w.prose(1, 3))}</p>", f'<a href="/x">{escape(w.few(2, 6))}</a>', f"<span>Advertisement</span><p>{escape(w.sentence())}</p>", f"<h4>{escape(w.title())}</h4><p>{escape(w.prose(1, 2))}</p>"])
    return _box(w, "div div aside section", "ad ads advert advertisement sponsored sponsor promo promotion ad-slot adbox banner-ad commercial outbrain partner", inside)


def _form(w):
    rng = w.rng
    bits = [f"<label>{escape(w.few(1, 3))}</label><input name=q>", f"<p>{escape(w.prose(1, 2))}</p>", "<button>Send</button>", f"<select><option>{w.few(1, 2)}<option>{w.few(1, 2)}</select>", f"<legend>{escape(w.few(1, 4))}</legend>", escape(w.sentence()), f"<h3>{escape(w.title())}</h3>"]
    inside = "".join(rng.sample(bits, rng.randint(2, 5)))
    form = f"<form>{inside}</form>" if rng.random() < 0.6 else f'<form class="{rng.choice("search subscribe newsletter login signup contact poll".split())}">{inside}</form>'
    return form if rng.random() < 0.7 else _box(w, "div section aside", "newsletter subscribe signup login search contact", form)


def _comments(w):
    rng = w.rng
    one = rng.choice(['<div class="comment">{}</div>', "<li>{}</li>", '<article class="comment">{}</article>', "<div>{}</div>", '<li class="comment reply">{}</li>', "<p>{}</p>", "<blockquote>{}</blockquote>"])
    out = []
    for _ in range(rng.randint(1, 6)):
        by = rng.choice(["", f"<b>{w.few(1, 2)}</b> ", f'<div class="author">{w.few(1, 2)}</div>', f"<cite>{w.few(1, 2)}</cite><time>{rng.randint(1, 28)} May</time> "])
        text = escape(w.prose(1, 4))
        out.append(one.format(by + (f"<p>{text}</p>" if rng.random() < 0.6 and not one.startswith("<p") else text)))
    inside = rng.choice(["", f"<h2>{rng.randint(1, 40)} comments</h2>", f"<h3>{w.few(1, 2)}</h3>"]) + "".join(out)
    if one.startswith("<li"):
        inside = f"<ol>{inside}</ol>"
    return _box(w, "section div div", "comments comment-list discussion replies responses disqus reader-comments thread user-comments feedback", inside)


_AROUND = (_menu, _header, _footer, _aside, _notice, _advert, _form, _comments)


def _body(w: _Writer) -> str:
    rng, out = w.rng, []
    if rng.random() < 0.85:
        title = f"<h1>{w.keep(w.title())}</h1>"
        out.append(f"<header>{title}</header>" if rng.random() < 0.12 else title)
    long = rng.random() < 0.75
    for _ in range(rng.randint(2, 14) if long else rng.randint(1, 3)):
        roll = rng.random()
        text = w.prose(1, 7) if rng.random() < 0.85 else rng.choice([w.sentence(), w.few(1, 6), w.numbered()])
        if rng.random() < 0.04:  # an article may use the words that mark what surrounds articles
            text += " " + rng.choice("Copyright Terms Privacy Comments Share Contact Home Search Register Sponsors Tags Posted".split()) + " " + w.sentence()
        if roll < 0.62:
            kind = rng.random()
            if kind < 0.7:
                out.append(f"<p>{w.keep(text)}</p>")
            elif kind < 0.8:
                out.append(f"<p>{w.keep(text)}")
                out.append("" if rng.random() < 0.5 else "\n")
                if not out[-1]:
                    out[-2] += "</p>"
            elif kind < 0.9:
                out.append(f"<p><b>{w.keep(text)}<br>")
                out[-1] += "</p>" if rng.random() < 0.3 else "<p></p>"
            else:
                out.append(f"<div>{w.keep(text)}</div>")
        elif roll < 0.7:
            out.append(f"<h2>{w.keep(w.title())}</h2>")
        elif roll < 0.78:
            tag = rng.choice(["ul", "ol"])
            out.append(f"<{tag}>" + "".join(f"<li>{w.keep(rng.choice([w.few(1, 8), w.sentence()]))}</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>")
        elif roll < 0.83:
            out.append(f"<blockquote><p>{w.keep(text)}</p></blockquote>" if rng.random() < 0.5 else f"<blockquote>{w.keep(text)}</blockquote>")
        elif roll < 0.86:
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{w.keep(w.few(1, 3))}</td>" for _ in range(2)) + "</tr>" for _ in range(rng.randint(2, 4))) + "</table>")
        elif roll < 0.88:
            out.append(f"<pre>{w.keep(w.few(3, 20))}</pre>")
        elif roll < 0.9:
            out.append(f"<figure><img src=x.png><figcaption>{w.keep(w.sentence())}</figcaption></figure>")
        else:
            out.append(rng.choice([_advert, _advert, _form, _aside, _notice, _menu])(w))
    return "".join(out)


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """``n`` pages, each with the texts of its main blocks."""
    rng = random.Random(seed)
    for _ in range(n):
        w = _Writer(rng)
        main = rng.choice(_CONTAINERS).replace("|", _body(w))
        before = [_header] * (rng.random() < 0.6) + [_menu] * (rng.random() < 0.75) + [rng.choice((_notice, _advert, _form, _aside, _menu)) for _ in range(rng.choice((0, 1, 1, 2)))]
        after = [rng.choice((_aside, _advert, _form, _menu, _notice)) for _ in range(rng.choice((0, 1, 2)))] + [_comments] * (rng.random() < 0.45) + [_aside] * (rng.random() < 0.25) + [_footer] * (rng.random() < 0.85)
        html = "".join(f(w) for f in before) + main + "".join(f(w) for f in after)
        head = f"<head><meta charset=utf-8><title>{escape(w.title())}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>" if rng.random() < 0.9 else ""
        if rng.random() < 0.3:
            html = html.replace("><", ">\n  <")
        if rng.random() < 0.2:
            html = f'<div class="{rng.choice("wrap site container page outer".split())}">{html}</div>'
        yield f"<!DOCTYPE html><html>{head}<body>{html}</body></html>" if rng.random() < 0.95 else html, w.main
