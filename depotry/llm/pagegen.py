"""Generated web pages with a known main text, to train the extraction model on.

Pages vary in what sites vary in: semantic tags or plain div elements with telling, neutral or no
class names, one to many wrappers, unclosed tags, and parts around the article in any number.
"""

from __future__ import annotations

import random

# Class and id words that sites give to parts of a page.
NAMES = {
    "nav": ("nav", "navbar", "menu", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "navigation", "pagination", "pager"),
    "header": ("header", "masthead", "site-header", "topbar", "branding", "banner", "logo"),
    "footer": ("footer", "site-footer", "copyright", "legal", "colophon", "bottom"),
    "side": ("sidebar", "side", "aside", "widget", "related", "popular", "recommended", "rail", "more-stories", "tags"),
    "notice": ("notice", "cookie", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "disclaimer", "message"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "ad-slot"),
    "form": ("form", "newsletter", "subscribe", "signup", "login", "search", "search-form", "contact-form"),
    "social": ("social", "share", "sharing", "share-buttons", "follow"),
    "comments": ("comments", "comment-list", "disqus", "responses", "replies", "discussion", "user-comments", "respond"),
    "content": ("content", "main", "article", "post", "entry", "entry-content", "article-body", "story", "text", "post-body", "main-content"),
    "neutral": ("box", "row", "col", "wrap", "container", "inner", "block", "module", "x1", "grid", "panel", "s3"),
}
PUNCTUATION = "!#$%*+-./:;=?@^_|~"
SEMANTIC = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section", "content": "article"}
WORDS = tuple(a + b for a in ("ta", "re", "mo", "li", "sun", "ver", "o", "ka", "pel", "in", "th", "an") for b in ("", "n", "ra", "to", "ling", "s", "der", "e", "mis", "ous"))


class Pages:
    """Seeded maker of (html, blocks of the main text)."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.mark = lambda text: text  # what a page's article does to its sentences
        self.cells = False  # whether parts are cells of a table that lays out the page

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(WORDS) for _ in range(self.rng.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        text = self.words(low, high)
        if self.rng.random() < 0.3:
            text = text.replace(" ", ", ", 1)
        return text[0].upper() + text[1:] + self.rng.choice(".....!?")

    def styles(self) -> list:
        """Ways in which a text may look unlike prose: its words with marks, parted by marks, in one case, or one word over and over."""
        r = self.rng
        mark, between = ("".join(r.choice(PUNCTUATION) for _ in range(r.randint(1, 3))) for _ in range(2))
        return [
            lambda t: " ".join(w + mark for w in t.split()),
            lambda t: f" {between} ".join(t.split()),
            lambda t: r.choice((str.upper, str.lower, str.title))(t) + mark,
            lambda t: " ".join("".join(c for c in w if c.isalpha()) for w in t.split()),
            lambda t: " ".join([r.choice(t.split())] * len(t.split())),
        ]

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def attrs(self, kind: str, telling: float) -> str:
        r = self.rng.random()
        name = self.rng.choice(NAMES[kind]) if r < telling else self.rng.choice(NAMES["neutral"]) if r < telling + 0.2 else ""
        if name and self.rng.random() < 0.2:
            name += " " + self.rng.choice(NAMES["neutral"])
        return f' {self.rng.choice(("class", "class", "id"))}="{name}"' if name else ""

    def wrap(self, kind: str, inside: str, semantic: float) -> str:
        tag = SEMANTIC.get(kind, "div") if self.rng.random() < semantic else self.rng.choice(("div", "div", "section"))
        if self.cells:
            tag = "td"
        telling = 0.45 if tag == SEMANTIC.get(kind) and tag != "section" else 0.93  # a section says nothing of what it holds
        return f"<{tag}{self.attrs(kind, telling)}>{inside}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" if self.rng.random() < 0.9 else f"<li>{x}" for x in items) + "</ul>"
        return self.rng.choice((" | ", " ", "<br>")).join(items)

    def part(self, kind: str, semantic: float) -> str:
        r, cells, self.cells = self.rng, self.cells, False
        heading = f"<h{r.randint(2, 4)}>{self.words(1, 4)}</h3>" if r.random() < 0.5 else ""
        short = f"<p>{self.prose(2)}</p>" if r.random() < 0.6 else self.sentence()
        if kind == "nav":
            inside = self.links(3, 10)
        elif kind == "header":
            inside = r.choice((heading, f"<a href='/'>{self.words(1, 2)}</a>", self.words(1, 5))) + (self.links(2, 6) if r.random() < 0.5 else "")
        elif kind == "footer":
            inside = "&copy; " * (r.random() < 0.6) + r.choice((self.words(2, 8), short, self.prose(2), f"{self.words(1, 3)} {self.rng.choice(('&copy;', '&middot;', '-', '/', '2019', '&reg;'))} {self.prose(2)}")) + (self.links(2, 8) if r.random() < 0.5 else "")
        elif kind == "side":
            inside = heading + r.choice((self.links(3, 8), short, self.links(2, 5) + short, f"<p>{self.prose(3)}</p>"))
        elif kind == "notice":
            inside = short + (f"<button>{self.words(1, 2)}</button>" if r.random() < 0.6 else "")
        elif kind == "ad":
            inside = r.choice((self.sentence(), short, f"<a href='http://ad.test'>{self.sentence()}</a>", self.prose(3), f"<p>{self.prose(2)}</p>"))
        elif kind == "form":
            inside = heading + f"<label>{self.words(1, 3)}</label><input name=q>" * r.randint(1, 3) + (short if r.random() < 0.4 else "") + f"<button>{self.words(1, 2)}</button>"
        elif kind == "social":
            inside = self.links(2, 5)
        else:
            one = r.choice(("li", "div", "article"))
            own = ' class="comment"' if r.random() < 0.6 else ""
            body = [f"<{one}{own}><{r.choice(('b', 'span', 'h4'))}>{self.words(1, 2)}</b><p>{self.prose(4)}</p></{one}>" for _ in range(r.randint(1, 6))]
            inside = heading + ("<ul>" + "".join(body) + "</ul>" if one == "li" else "".join(body)) + (self.part("form", semantic) if r.random() < 0.3 else "")
        self.cells = cells
        return self.wrap(kind, inside, semantic)

    def fragment(self, simple: bool) -> tuple[str, list[str]]:
        """One piece of an article's body and its blocks."""
        r, kind = self.rng, self.rng.random()
        text = r.choice((self.prose(8), self.prose(3), self.sentence(1, 4)))
        if kind < 0.74 or simple:
            inner = text
            if r.random() < 0.2:
                tag = r.choice(("b", "em", "span", "i", "strong", "small", "code"))
                inner = f"<{tag}>{text}" + r.choice((f"</{tag}>", f"</{tag}>", "<br>", "<wbr>", "", "</u>"))
            if r.random() < 0.15:
                link = self.words(1, 2)
                inner, text = f"{inner} <a href=/y>{link}</a>", f"{text} {link}"
            return f"<p>{inner}" + ("</p>" if r.random() < 0.85 else ""), [text]
        if kind < 0.82:
            text = self.words(1, 6)
            return f"<h{r.randint(2, 4)}>{text}</h2>", [text]
        if kind < 0.87:
            items = [self.sentence(1, 12) for _ in range(r.randint(2, 5))]
            tag = r.choice(("ul", "ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{tag}>", items
        if kind < 0.90:
            items = [f(*size) for _ in range(r.randint(1, 4)) for f, size in ((self.words, (1, 4)), (self.sentence, (2, 14)))]
            return "<dl>" + "".join(f"<{t}>{x}</{t}>" for t, x in zip(("dt", "dd") * len(items), items, strict=False)) + "</dl>", items
        if kind < 0.92:
            cells = [self.words(1, 3) for _ in range(4)]
            return "<table><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table>".format(*cells), cells
        if kind < 0.94:
            text = r.choice((self.sentence(1, 12), self.words(1, 8)))
            return f"<figure><img src=/i.png><figcaption>{text}</figcaption></figure>", [text]
        if kind < 0.96:
            text = "\n".join(self.words(1, 5) + r.choice((";", "()", " = 1", "")) for _ in range(r.randint(1, 5)))
            return f"<pre>{text}</pre>" if r.random() < 0.5 else f"<pre><code>{text}</code></pre>", [text]
        return f"<blockquote><p>{text}</p></blockquote>" if r.random() < 0.5 else f"<div>{text}</div>", [text]

    def sections(self, simple: bool, depth: int = 0) -> tuple[str, list[str]]:
        """An article's body in elements of their own, with headings or without, some of them nested."""
        r, out, blocks = self.rng, [], []
        tag, titled, named = r.choice(("section", "section", "div", "div")), r.random() < 0.7, r.choice((0.0, 0.0, 0.4, 0.8))
        for _ in range(r.randint(1, 6 - 2 * depth)):
            inside = ""
            if titled:
                blocks.append(self.words(1, 6))
                level = min(6, 2 + depth + (r.random() < 0.2))
                inside = f"<h{level}>{blocks[-1]}</h{level}>"
            for _ in range(r.choice((1, 1, 2, 2, 3, 5))):
                html, own = self.fragment(simple)
                inside += html
                blocks += own
            if depth < 2 and r.random() < 0.15:
                html, own = self.sections(simple, depth + 1)
                inside += html
                blocks += own
            out.append(f"<{tag}{self.attrs('neutral', named)}>{inside}</{tag}>")
        return "".join(out), blocks

    def article(self) -> tuple[str, list[str]]:
        r, out, blocks = self.rng, [], []
        simple = r.random() < 0.1
        self.mark = r.choice(self.styles()) if r.random() < 0.25 else lambda text: text
        if r.random() < 0.85:
            blocks.append(self.mark(self.words(2, 12)))
            level = r.choice((1, 1, 1, 1, 1, 1, 2, 3))
            title = f"<h{level}>{blocks[-1]}</h{level}>"
            out.append(f"<header>{title}</header>" if r.random() < 0.08 else title)
        parted = r.random() < 0.35
        for _ in range(r.choice((0, 1)) if parted else r.choice((0, 1, 1, 1, 2, 2, 4, 8, 14, 25)) if blocks else r.choice((1, 2, 5))):
            html, own = self.fragment(simple)
            out.append(html)
            blocks += own
        if parted:
            html, own = self.sections(simple)
            out.append(html)
            blocks += own
        return "".join(out), blocks

    def page(self) -> tuple[str, list[str]]:
        r = self.rng
        semantic = r.choice((0.0, 0.5, 1.0, 1.0))
        body, blocks = self.article()
        if r.random() < 0.12:  # a bare page
            return f"<html><body>{body}</body></html>", blocks
        mixed = []
        for chunk in body.replace("<p>", "\x00<p>").split("\x00"):
            mixed.append(chunk)
            if r.random() < 0.04 and "<ul>" not in chunk and "<blockquote>" not in chunk and (chunk.endswith("</p>") or not chunk):
                mixed.append(self.part(r.choice(("ad", "ad", "social", "side", "form", "notice")), semantic))
        for kind in ("comments", "social", "side", "footer"):
            if r.random() < 0.07:
                mixed.append(self.part(kind, semantic))
        self.cells = r.random() < 0.1
        main = self.wrap("content", "".join(mixed), semantic) if self.cells or r.random() < 0.95 else "".join(mixed)
        for _ in range(0 if self.cells else r.choice((0, 0, 1, 2))):
            main = f"<div{self.attrs(r.choice(('neutral', 'content')), 0.7)}>{main}</div>"
        before = [self.part(k, semantic) for k in ("header", "nav", "notice", "ad", "form", "social") if r.random() < (0.75 if k == "nav" else 0.35)]
        after = [self.part(k, semantic) for k in ("comments", "side", "ad", "social", "form", "notice", "nav", "footer") if r.random() < (0.75 if k == "footer" else 0.3)]
        r.shuffle(before)
        aside = [self.part("side", semantic)] if r.random() < 0.3 else []
        head = f"<head><title>{self.words(2, 5)}</title><style>p{{margin:0}}</style></head>" if r.random() < 0.8 else ""
        body = "".join(before + aside) + main + "".join(after)
        if self.cells:
            self.cells, rows = False, [""]
            for cell in [*before, *aside, main, *after]:
                rows[-1] += cell
                if r.random() < 0.6:
                    rows.append("")
            body = "<table>" + "".join(f"<tr>{x}</tr>" for x in rows if x) + "</table>"
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>", blocks
