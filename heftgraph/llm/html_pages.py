"""Made-up web pages with known main text, on which the block labeller is trained.

Every main block's text starts with MARK, which the trainer strips again. Layouts, class names and
nesting vary at random; words are made of random syllables, so only structure and length can tell. Some
pages have no telling names at all: their classes are random letters and their parts plain containers,
or cells of a layout table.
"""

from __future__ import annotations

import random
import re

MARK = "\ue000"
_MAIN = ["article", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "div.story", "div#main-content", "section.post-body", "div#content", "div.article", "div.post-content", "div.text", "div.page-content", "div@main", "main.site-main", "div#primary", "div.single", "section.body", "div.prose", "div.article__text", "div.rich-text", "article.hentry"]
_NAV = ["nav", "div.menu", "ul.nav", "div#navigation", "div.navbar", "ol.breadcrumb", "div.breadcrumbs", "nav.main-menu", "div.topbar", "div.pagination", "ul.menu", "div.toc", "nav@navigation", "div.subnav", "ul.pager", "div.crumbs", "div.tabs", "div.skip-links", "div.site-nav"]
_SIDE = ["aside", "div.sidebar", "div#sidebar", "aside.related", "div.widget", "section.related", "div.recommended", "div.side-column", "div.more-stories", "div.tags", "aside.sidebar", "div.author-bio", "aside@complementary", "div.rail", "div.trending", "div.most-popular", "section.read-next", "div.share-bar", "div.social", "div.see-also"]
_AD = ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div.banner", "aside.ad", "section.sponsor", "div.ad-slot", "ins.adsbygoogle", "div.partner-offer", "div.dfp-slot", "div.advertorial", "div.affiliate", "div.leaderboard"]
_NOTE = ["div.cookie", "div.cookie-banner", "div.notice", "div.consent", "div.alert", "section.gdpr", "div#cookie-notice", "div.newsletter", "div.subscribe", "div.popup", "div.modal", "div.paywall", "div.disclaimer", "p.notice", "div@alert", "div@dialog", "div.signup", "div.toast", "div.overlay", "div.privacy-banner"]
_TALK = ["div#comments", "section.comments", "div.comments", "ol.comment-list", "div.disqus", "section#comments", "div.reader-comments", "div.discussion", "div.responses", "section.replies", "ul.thread", "div.user-comments", "div#respond"]
_FOOT = ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.legal", "div.bottom", "footer@contentinfo", "div.page-footer", "div.colophon", "div.imprint"]
_HEAD = ["header", "div.header", "div#header", "header.site-header", "div.masthead", "div.logo", "header@banner", "div.top", "div.brand", "div.site-title"]
_HINT = {"note": "cookies accept privacy settings subscribe newsletter consent notice", "form": "name email password search login submit send", "talk": "reply says comment posted likes answer", "foot": "copyright rights reserved contact imprint terms privacy", "ad": "sponsored offer buy now deal advertisement"}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        c, v = "bcdfghklmnprstvwzçñßj", "aeiouéèêäöüáíó"
        self.opaque, self.dressed = False, ""
        self.syllables = [self.r.choice(c) + self.r.choice(v) + self.r.choice(["", "n", "r", "s", "t"]) for _ in range(80)]

    def words(self, lo: int, hi: int, hint: str = "") -> str:
        out = ["".join(self.r.choices(self.syllables, k=self.r.randint(1, 3))) for _ in range(self.r.randint(lo, hi))]
        if hint and self.r.random() < 0.5:
            out += self.r.sample(_HINT[hint].split(), 2)
        out[0] = out[0].capitalize()
        return " ".join(out) + self.r.choice([".", ".", ".", "", "!"])

    def prose(self, most: int = 80) -> str:
        return " ".join(self.words(1, 14) for _ in range(self.r.randint(1, max(1, most // 10))))

    def tag(self, spec: str, inner: str) -> str:
        name, _, cls = spec.partition(".")
        name, _, role = name.partition("@")
        name, _, ident = name.partition("#")
        if self.opaque:
            name = name if name in ("ul", "ol", "li", "p") else self.r.choice(["div", "div", "div", "section"])
            cls, ident, role = self.r.choice(["", self.letters()]), "", ""
        extra = (f' class="{cls}"' if cls else "") + (f' id="{ident}"' if ident else "") + (f" role={role}" if role else "")
        if self.r.random() < 0.1:
            extra += f' data-x="{self.r.randint(0, 99)}"'
        return f"<{name}{extra}>{inner}</{name}>"

    def letters(self) -> str:
        return "".join(self.r.choices("abcdefghjkmnpqrstuvwxyz0123456789", k=self.r.randint(2, 8)))

    def links(self, n: int) -> str:
        style = self.r.random()
        a = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in a) + "</ul>" if style < 0.6 else self.r.choice([" | ", " ", "<br>"]).join(a)

    def block(self, spec_list: list[str], hint: str = "", most: int = 30) -> str:
        r, spec = self.r, self.r.choice(spec_list)
        if self.opaque:  # where no name tells, links must
            return self.tag(spec, r.choice(["", f"<h3>{self.words(1, 4)}</h3>"]) + self.links(r.randint(2, 6)))
        body = r.choice([lambda: self.words(2, 12, hint), lambda: f"<p>{self.prose(most)}</p>", lambda: f"<h3>{self.words(1, 4, hint)}</h3><p>{self.prose(most)}</p>", lambda: f"<h4>{self.words(1, 4, hint)}</h4>" + self.links(r.randint(2, 6))])()
        return self.tag(spec, body)

    def comments(self) -> str:
        spec = self.r.choice(_TALK)
        item = "li" if spec.startswith(("ol", "ul")) else self.r.choice(["div.comment", "article.comment", "div.comment-body"])
        inner = "".join(self.tag(item, self.r.choice(["", f"<span>{self.words(1, 2, 'talk')}</span>"]) + self.r.choice([self.prose(50), f"<p>{self.prose(50)}</p>", f"<p>{self.prose(30)}</p><p>{self.prose(30)}</p>"])) for _ in range(self.r.randint(1, 6)))
        return self.tag(spec, self.r.choice(["", f"<h2>{self.words(1, 3, 'talk')}</h2>"]) + inner)

    def form(self) -> str:
        inner = "".join(f"<label>{self.words(1, 3, 'form')}</label><input name=x>" for _ in range(self.r.randint(1, 3))) + self.r.choice([f"<button>{self.words(1, 2, 'form')}</button>", f"<p>{self.words(3, 10, 'form')}</p>", f"<select><option>{self.words(1, 1)}</option></select>"])
        return f"<form action=/x>{inner}</form>"

    def main(self) -> str:
        r, m = self.r, MARK
        out = []
        if r.random() < 0.85:
            h = f"<h1>{m}{self.words(1, 12)}</h1>"
            out.append(f"<header>{h}</header>" if r.random() < 0.15 else h)
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12, 20])):
            x = r.random()
            if x < 0.7:
                out.append(f"<p>{m}{self.prose()}</p>" if r.random() < 0.8 else f"<p><b>{m}{self.prose()}<br>")
            elif x < 0.78:
                level = r.randint(2, 4)
                out.append(f"<h{level}>{m}{self.words(1, 8)}</h{level}>")
            elif x < 0.84:
                out.append(r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{m}{self.words(2, 20)}</li>" for _ in range(r.randint(2, 6)))))
            elif x < 0.88:
                out.append(f"<blockquote>{m}{self.prose(40)}</blockquote>")
            elif x < 0.91:
                out.append(f"<pre>{m}{self.prose(40)}</pre>")
            elif x < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{m}{self.words(1, 4)}</td><td>{m}{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(r.choice([lambda: self.block(_AD, "ad"), lambda: self.block(_SIDE), lambda: self.block(_NOTE, "note"), self.form])())
        if r.random() < 0.15 and not self.opaque:
            out.append(self.comments())
        if r.random() < 0.1 and not self.opaque:
            out.append(self.tag(r.choice(["footer", "div.share", "div.meta"]), self.words(1, 6, "foot")))
        spec = r.choice(["article", "article", *_MAIN])
        text = "".join(out)
        if self.dressed:  # classes on the text's own elements
            text = re.sub(r"<(p|h[1-4]|li|ul|ol|td)>", lambda x: f"<{x[1]}{self.dressed}>", text)
        page = self.tag(spec, text)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            page = self.tag(r.choice(["div", "main", "div.container", "div.wrapper", "section"]), page)
        return page

    def cells(self, before: list[str], after: list[str]) -> str:
        """The parts in a layout table, the main one beside one or two others."""
        k = self.r.randint(0, min(2, len(after)))
        row = [*(f"<td width=20%>{x}</td>" for x in after[:k]), f"<td>{self.main()}</td>"]
        if self.r.random() < 0.5:
            row.reverse()
        wide = lambda parts: "".join(f"<tr><td colspan={k + 1}>{x}</td></tr>" for x in parts)
        return f"<table border=0>{wide(before)}<tr>{''.join(row)}</tr>{wide(after[k:])}</table>"

    def page(self) -> str:
        r = self.r
        style = r.random()
        self.opaque = style < 0.22
        self.dressed = r.choice(["", "", f' class="{self.letters()}"', f' class="{self.letters()}-{self.letters()} {self.letters()}"'])
        before = [f() for f in (lambda: self.tag(r.choice(_HEAD), self.words(1, 4)), lambda: self.tag(r.choice(_NAV), self.links(r.randint(2, 8))), lambda: self.block(_AD, "ad"), lambda: self.block(_NOTE, "note"), lambda: self.block(_SIDE), self.form) if r.random() < 0.5]
        after = [f() for f in (self.form if self.opaque else self.comments, lambda: self.block(_SIDE), lambda: self.block(_AD, "ad"), lambda: self.block(_NOTE, "note"), self.form, lambda: self.tag(r.choice(_NAV), self.links(r.randint(2, 6)))) if r.random() < 0.4]
        if r.random() < 0.85:
            after.append(self.tag(r.choice(_FOOT), r.choice(["&copy; ", ""]) + self.words(2, 14, "foot")))
        r.shuffle(before)
        r.shuffle(after[:-1])
        body = self.cells(before, after) if 0.18 < style < 0.26 else "".join(before) + self.main() + "".join(after)
        html = f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style></head><body>{body}</body></html>"
        return html if r.random() < 0.9 else html[: int(len(html) * r.uniform(0.6, 1))]
