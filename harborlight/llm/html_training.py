"""Labelled pages to train the extraction model: layouts written for this purpose, with texts of invented words.

Every run of main text carries :data:`MARK`; everything else is menus, headers, footers, sidebars, notices, adverts, forms,
sharing links and reader comments in the many ways sites mark them up (and some without any telling name).
"""

from __future__ import annotations

import random

MARK = "\x02"
PAGES = 800

# Class and id words by the part of a page they name.
_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs main-menu top-nav site-nav pagination tabs toc",
    "header": "header masthead branding site-header page-header topbar logo banner",
    "footer": "footer site-footer page-footer bottom copyright legal colophon credits",
    "side": "sidebar aside rail widget related related-posts recommended popular trending more-stories teaser promo right-column",
    "ad": "ad ads advert advertisement sponsor sponsored ad-box ad-slot banner-ad adsense promo promoted commercial",
    "notice": "notice cookie cookie-notice consent gdpr alert popup modal overlay newsletter subscribe paywall disclaimer message warning banner",
    "form": "form search search-form login signup contact-form subscribe-form",
    "comment": "comment comments comment-list comment-body discussion replies reply disqus thread responses user-comment",
    "share": "share social follow social-links share-buttons",
    "main": "article content post entry main story post-content entry-content article-body story-body text page-content main-content body prose",
}
NAMES = {k: v.split() for k, v in _NAMES.items()}
_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo an er in os ul en tion ment ing ly".split()


class _Writer:
    def __init__(self, r: random.Random):
        self.r = r

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self, low: int, high: int) -> str:
        words = [self.word() + ("," if self.r.random() < 0.08 else "") for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + self.r.choice(["."] * 8 + ["!", "?", "", "..."])

    def prose(self, high: int = 6) -> str:
        return " ".join(self.sentence(1, 18) for _ in range(self.r.randint(1, high)))

    def inline(self, text: str) -> str:
        if self.r.random() < 0.25 and " " in text:
            words = text.split(" ")
            i = self.r.randrange(len(words))
            words[i] = self.r.choice([f"<b>{words[i]}</b>", f"<em>{words[i]}</em>", f'<a href="/{self.word()}">{words[i]}</a>', f"<span>{words[i]}</span>"])
            text = " ".join(words)
        return text

    def attrs(self, kind: str, sure: float = 1.0) -> str:
        if self.r.random() > sure:
            return ""
        name = self.r.choice(NAMES[kind])
        name += self.r.choice(["", "", "", f"-{self.r.randint(1, 9)}", f" {self.word()}"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def links(self, n: int) -> str:
        item = self.r.choice(["<li><a href='/{0}'>{0}</a></li>", "<li><a href='/{0}'>{0}</a>", "<a href='/{0}'>{0}</a> "])
        body = "".join(item.format(self.word()) for _ in range(n))
        return f"<ul>{body}</ul>" if item.startswith("<li") else body

    def nav(self) -> str:
        tag = self.r.choice(["nav", "nav", "div", "ul", "menu"])
        sure = 0.4 if tag == "nav" else 0.85
        return f"<{tag}{self.attrs('nav', sure)}>{self.links(self.r.randint(2, 12))}</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(["header", "header", "div"])
        inside = self.r.choice([f"<h1>{self.sentence(1, 4)}</h1>", f"<a href='/'>{self.word()}</a>", f"<p>{self.sentence(2, 8)}</p>", f"<h2>{self.sentence(1, 4)}</h2><p>{self.sentence(2, 8)}</p>"])
        return f"<{tag}{self.attrs('header', 0.3 if tag == 'header' else 1)}>{inside}{self.nav() if self.r.random() < 0.4 else ''}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(["footer", "footer", "footer", "div"])
        inside = f"&copy; {self.word()}.example &middot; {self.sentence(2, 8)}" if self.r.random() < 0.6 else f"<p>{self.prose(2)}</p>{self.links(self.r.randint(0, 6))}"
        return f"<{tag}{self.attrs('footer', 0.3 if tag == 'footer' else 1)}>{inside}</{tag}>"

    def boxed(self, kind: str, body: str, tags: tuple[str, ...] = ("div", "div", "section")) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}{self.attrs(kind)}>{body}</{tag}>"

    def ad(self) -> str:
        body = self.r.choice([self.sentence(2, 14), f"<p>{self.prose(2)}</p>", f"<a href='/buy'>{self.sentence(2, 6)}</a>", f"<h3>{self.sentence(1, 5)}</h3><p>{self.sentence(3, 12)}</p>"])
        return self.boxed("ad", body, ("div", "div", "aside", "p", "section"))

    def side(self) -> str:
        body = f"<h3>{self.sentence(1, 3)}</h3>" * self.r.randint(0, 1) + self.r.choice([self.links(self.r.randint(2, 8)), f"<p>{self.prose(2)}</p>", f"<ul><li>{self.sentence(2, 8)}<li>{self.sentence(2, 8)}</ul>"])
        if self.r.random() < 0.5:
            return f"<aside{self.attrs('side', 0.4)}>{body}</aside>"
        return self.boxed("side", body)

    def notice(self) -> str:
        body = self.r.choice([self.sentence(4, 18), f"<p>{self.prose(2)}</p><button>OK</button>", f"<p>{self.sentence(4, 18)} <a href='/p'>{self.word()}</a></p>"])
        tag = self.r.choice(["div", "div", "section", "aside", "p", "dialog"])
        role = self.r.choice(["", "", ' role="alert"', ' role="dialog"'])
        return f"<{tag}{self.attrs('notice')}{role}>{body}</{tag}>"

    def form(self) -> str:
        body = f"<label>{self.word()}</label><input name='q'><button>{self.word()}</button>" + f"<p>{self.sentence(3, 10)}</p>" * self.r.randint(0, 1) + f"<select><option>{self.word()}</select>" * self.r.randint(0, 1)
        return f"<form{self.attrs('form', 0.5)}>{body}</form>"

    def comments(self) -> str:
        tag = self.r.choice(["div", "li", "article", "section"])
        one = lambda: f"<{tag}{self.attrs('comment', 0.8)}>" + self.r.choice([f"<b>{self.word()}</b> <p>{self.prose(4)}</p>", f"<p>{self.prose(4)}</p>", self.prose(3), f"<h4>{self.word()}</h4><div>{self.prose(3)}</div>"]) + f"</{tag}>"
        many = "".join(one() for _ in range(self.r.randint(1, 6)))
        title = f"<h{self.r.randint(2, 4)}>{self.sentence(1, 3)}</h3>" * self.r.randint(0, 1)
        outer = self.r.choice(["section", "div", "div", "ol", "aside"])
        return f"<{outer}{self.attrs('comment')}>{title}{many}{self.form() if self.r.random() < 0.3 else ''}</{outer}>"

    def share(self) -> str:
        return self.boxed("share", self.links(self.r.randint(2, 5)), ("div", "ul"))

    def block(self) -> str:
        x = self.r.random()
        m = lambda high=6: MARK + self.inline(self.prose(high))
        if x < 0.72:
            close = "</p>" if self.r.random() < 0.8 else ""
            return f"<p>{m()}{close}"
        if x < 0.8:
            return f"<p><b>{m(1)}<br>"
        if x < 0.88:
            return f"<h{(h := self.r.randint(2, 4))}>{MARK}{self.sentence(1, 8)}</h{h}>"
        if x < 0.92:
            return f"<{(t := self.r.choice(['ul', 'ol']))}>" + "".join(f"<li>{m(1)}</li>" for _ in range(self.r.randint(2, 5))) + f"</{t}>"
        if x < 0.95:
            return f"<blockquote><p>{m(2)}</p></blockquote>"
        if x < 0.97:
            return f"<table><tr><td>{m(1)}</td><td>{m(1)}</td></tr></table>"
        if x < 0.985:
            return f"<pre>{m(2)}</pre>"
        return f"<figure><figcaption>{m(1)}</figcaption></figure>"

    def article(self) -> str:
        title = f"<h1>{MARK}{self.sentence(2, 12)}</h1>"
        if self.r.random() < 0.25:
            title = f"<header>{title}</header>"
        if self.r.random() < 0.1:
            title = ""
        blocks = [self.block() for _ in range(self.r.choice([1, 2, 3, 5, 8, 13]))]
        if self.r.random() < 0.35:
            blocks.insert(self.r.randrange(len(blocks) + 1), self.r.choice([self.ad, self.side, self.share, self.notice, self.form])())
        body = title + "".join(blocks)
        tail = "".join(part() for part, p in ((self.share, 0.2), (self.comments, 0.15), (self.side, 0.1)) if self.r.random() < p)
        x = self.r.random()
        if x < 0.5:
            return f"<article{self.attrs('main', 0.3)}>{body}{tail}</article>"
        if x < 0.65:
            return f"<main{self.attrs('main', 0.3)}>{body}{tail}</main>"
        if x < 0.9:
            return f"<{(t := self.r.choice(['div', 'section', 'div']))}{self.attrs('main')}>{body}{tail}</{t}>"
        if x < 0.95:
            return f"<main><article>{body}</article>{tail}</main>"
        return f"<div>{body}</div>{tail}"

    def page(self) -> str:
        before = "".join(part() for part, p in ((self.notice, 0.35), (self.header, 0.5), (self.nav, 0.75), (self.form, 0.2), (self.ad, 0.5), (self.side, 0.2)) if self.r.random() < p)
        after = "".join(part() for part, p in ((self.comments, 0.35), (self.side, 0.4), (self.ad, 0.3), (self.form, 0.15), (self.share, 0.15), (self.nav, 0.15), (self.notice, 0.15), (self.footer, 0.8)) if self.r.random() < p)
        body = before + self.article() + after
        if self.r.random() < 0.3:
            name = self.r.choice(["page", "wrapper", "container", "content", "site", "main", "layout"])
            body = f'<div {self.r.choice(["class", "id"])}="{name}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.word()}</title><style>p{{}}</style></head><body>{body}</body></html>"


def pages(n: int = PAGES, seed: int = 5) -> list[str]:
    w = _Writer(random.Random(seed))
    return [w.page() for _ in range(n)]
