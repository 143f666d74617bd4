"""Pages with known main text, from which the extractor of ``html_extract`` is trained.

Real pages carry no labels here, so the trees learn from composed ones: an article
with titles, paragraphs, lists, tables and quotations among menus, headers, footers,
sidebars, notices, adverts, forms, share bars, related links and reader comments, each
under semantic tags or under plain ones with class and id tokens.  Every element says
in ``data-y`` whether it (still) holds main text.
"""

from __future__ import annotations

import random
import re

#: Class and id tokens that pages commonly use for each kind of part.
TOKENS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs topnav pagination pager tabs toc".split(),
    "header": "header masthead site-header topbar branding logo page-header".split(),
    "footer": "footer site-footer page-footer copyright colophon bottom legal".split(),
    "side": "sidebar side aside rail widget widgets secondary column-right".split(),
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo banner ad-slot adbox dfp".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay disclaimer banner-notice toast".split(),
    "form": "form search search-box login signup subscribe newsletter contact-form input-group".split(),
    "comment": "comment comments comment-list replies reply discussion disqus thread responses user-comments".split(),
    "related": "related recommended share sharing social more-stories tags tag-list most-read trending".split(),
    "content": "content article article-body post post-body entry entry-content story main main-content text body-text".split(),
}

_SYLLABLES = "an er th in ou re on at es ed nd to st en or ti hi as te et ng of al de se le sa si ar ve ra ld ur".split()


def page_label(attrs: str) -> int:
    """The label in a composed element's attributes, -1 without one."""
    found = re.search(r'data-y="([01])"', attrs)
    return int(found[1]) if found else -1


class Composer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for k in range(len(out)):
            if r.random() < 0.08:
                out[k] += r.choice(",.;:")
        text = " ".join(out).capitalize() + r.choice([".", ".", "", "!"])
        if r.random() < 0.1:
            text = text.replace(" ", r.choice([" &amp; ", "*** ", " | ", "&nbsp; "]))
        return text

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.randint(0, 999)}">{self.words(low, high)}</a>'

    def attrs(self, kind: str | None, y: int) -> str:
        r, out = self.r, f' data-y="{y}"'
        if kind:
            names = r.sample(TOKENS[kind], r.randint(1, 2))
            out += f' class="{" ".join(names)}"' if r.random() < 0.75 else f' id="{names[0]}"'
        return out

    def element(self, tag: str, inner: str, y: int, kind: str | None = None) -> str:
        close = "" if tag in ("p", "li") and self.r.random() < 0.2 else f"</{tag}>"
        return f"<{tag}{self.attrs(kind, y)}>{inner}{close}"

    def part(self, kind: str, semantic: list[str], inner: str) -> str:
        """A part without main text: a semantic tag, or a plain one that its tokens tell."""
        r = self.r
        if semantic and r.random() < 0.5:
            return self.element(r.choice(semantic), inner, 0, kind if r.random() < 0.4 else None)
        return self.element(r.choice(["div", "div", "section", "ul" if inner.startswith("<li") else "div"]), inner, 0, kind)

    def links(self, low: int, high: int) -> str:
        items = [self.element("li", self.link(), 0) for _ in range(self.r.randint(low, high))]
        return self.element("ul", "".join(items), 0) if self.r.random() < 0.6 else " ".join(self.link() for _ in items)

    def prose(self, y: int, low: int = 4, high: int = 60) -> str:
        return self.element(self.r.choice(["p", "p", "div"]), self.words(low, high), y)

    def boilerplate(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.part(kind, ["nav"], self.links(2, 10))
        if kind == "header":
            return self.part(kind, ["header"], self.element(r.choice(["h1", "h2", "div", "a"]), self.words(1, 4), 0) + (self.links(2, 6) if r.random() < 0.6 else self.prose(0, 2, 10)))
        if kind == "footer":
            return self.part(kind, ["footer"], r.choice(["&copy; ", ""]) + self.words(2, 40) + (self.links(2, 6) if r.random() < 0.5 else ""))
        if kind == "side":
            return self.part(kind, ["aside"], self.element("h3", self.words(1, 4), 0) + "".join(self.prose(0, 3, 40) for _ in range(r.randint(1, 3))) + (self.links(2, 8) if r.random() < 0.6 else ""))
        if kind == "form":
            inner = f'<label>{self.words(1, 3)}</label><input type="text" name="q"><button>{self.words(1, 2)}</button>'
            if r.random() < 0.4:
                inner = self.prose(0, 3, 20) + inner
            return self.element("form", inner, 0, kind if r.random() < 0.5 else None)
        if kind == "comment":
            one = lambda: self.element(r.choice(["div", "li", "article"]), self.element("span", self.words(1, 2), 0) + "".join(self.prose(0, 3, 50) for _ in range(r.randint(1, 2))), 0, kind if r.random() < 0.7 else None)
            return self.element(r.choice(["div", "section", "ol"]), self.element("h3", self.words(1, 3), 0) + "".join(one() for _ in range(r.randint(1, 5))), 0, kind)
        if kind == "related":
            return self.part(kind, [], self.element("h4", self.words(1, 3), 0) + self.links(2, 6))
        return self.part(kind, [], self.words(2, 30) if r.random() < 0.6 else self.prose(0, 3, 40) + (self.link() if r.random() < 0.5 else ""))

    def block(self) -> str:
        r, k = self.r, self.r.random()
        if k < 0.62:
            text = self.words(1, 90)
            if r.random() < 0.25:
                text = f"<b>{text}<br>" if r.random() < 0.5 else f"<em>{self.words(1, 4)}</em> {text} {self.link()} {self.words(1, 9)}"
            return self.element("p", text, 1)
        if k < 0.72:
            return self.element(r.choice(["h2", "h3"]), self.words(1, 7), 1)
        if k < 0.82:
            return self.element(r.choice(["ul", "ol"]), "".join(self.element("li", self.words(1, 15) if r.random() < 0.8 else self.link(1, 6), 1) for _ in range(r.randint(1, 6))), 1)
        if k < 0.88:
            return self.element("blockquote", self.element("p", self.words(3, 30), 1), 1)
        if k < 0.92:
            return self.element("table", "".join(self.element("tr", "".join(self.element("td", self.words(1, 4), 1) for _ in range(3)), 1) for _ in range(r.randint(1, 4))), 1)
        if k < 0.95:
            return self.element("pre", self.words(2, 20), 1)
        return self.element("div", self.words(3, 60), 1)

    def page(self) -> str:
        r = self.r
        blocks = [self.element("h1", self.words(1, 12), 1)] if r.random() < 0.85 else []
        blocks += [self.block() for _ in range(r.choice([1, 1, 2, 3, r.randint(1, 14)]))]
        for _ in range(r.choice([0, 0, 1, 2])):
            blocks.insert(r.randint(1, len(blocks)), self.boilerplate(r.choice(["ad", "related", "notice", "form", "side"])))
        if r.random() < 0.15:
            blocks.append(self.boilerplate("comment"))
        kind = r.choice(["content", "content", None])
        article = self.element(r.choice(["article", "article", "main", "div", "section"]) if kind else r.choice(["article", "main"]), "".join(blocks), 1, kind)
        if r.random() < 0.4:
            article = self.element(r.choice(["main", "div"]), (self.boilerplate("nav") if r.random() < 0.2 else "") + article, 1, r.choice(["content", None]))
        before = [self.boilerplate(k) for k in ("notice", "header", "nav", "ad", "form", "side") if r.random() < 0.55]
        after = [self.boilerplate(k) for k in ("related", "comment", "side", "ad", "form", "nav", "notice", "footer") if r.random() < 0.4]
        r.shuffle(before)
        inner = "".join(before) + article + "".join(after)
        if r.random() < 0.4:
            inner = self.element("div", inner, 1, None)
        return f'<!DOCTYPE html><html data-y="1"><head><title>{self.words(1, 6)}</title><style>p{{}}</style></head><body data-y="1">{inner}</body></html>'


def pages(n: int, seed: int) -> list[str]:
    composer = Composer(seed)
    return [composer.page() for _ in range(n)]
