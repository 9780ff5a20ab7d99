"""Training pages for the block labeller: layouts of many kinds whose labels are known.

The pages are made from words of a bounded sample of real pages.  Class names, nesting and order
vary; some layouts name nothing, so that length, links and neighbours must tell.
"""

from __future__ import annotations

import random

# Names that layouts give their parts.
MAIN = (
    "content main-content article-body article post post-content entry entry-content story story-body page-content text "
    "body-text article__text main blog-post td-post-content prose single-content"
).split()
MENU = "menu navbar nav main-nav navigation topbar breadcrumbs site-menu tabs toc-nav links pagination pager skip-links language-switch".split()
HEAD = "header site-header masthead top page-header branding logo banner-top hero-head".split()
FOOT = "footer site-footer colophon copyright bottom legal foot footer-links credits".split()
SIDE = "sidebar side widget related related-posts aside recommended trending rail popular tag-cloud also-read more-stories recent".split()
NOTICE = "notice cookie-notice cookie-banner consent alert gdpr message popup modal announcement warning privacy-notice paywall infobar".split()
ADVERT = "ad ads advert advertisement sponsored promo banner ad-slot sponsor adsense promotion partner-content ad-container".split()
FORM = "form newsletter subscribe signup search login search-form contact-form poll subscription register".split()
COMMENT = "comments comment comment-list discussion replies disqus responses reader-comments comment-body user-comments feedback reply".split()
SHARE = "share social social-links sharing follow-us author-bio byline-box share-buttons post-meta meta tags tools".split()
PLAIN = "wrap container row col inner box section block item panel wrapper layout grid".split()


class Maker:
    def __init__(self, words: list[str], seed: int) -> None:
        self.words, self.r = words, random.Random(seed)
        self.leaves: list[bool] = []

    def some(self, low: int, high: int) -> str:
        return " ".join(self.r.choices(self.words, k=self.r.randint(low, high)))

    def leaf(self, text: str, main: bool) -> str:
        self.leaves.append(main)
        return text

    def sentence(self, low: int, high: int) -> str:
        return self.some(low, high).capitalize() + self.r.choice(("", ".", ".", "."))

    def prose(self, low: int, high: int) -> str:
        text = " ".join(self.some(4, 14).capitalize() + "." for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.3:
            words = text.split()
            i = self.r.randrange(len(words))
            words[i] = self.r.choice(('<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "{}<br>")).format(words[i])
            text = " ".join(words)
        return text

    def named(self, names: list[str], tags: tuple[str, ...], inside: str, bare: float = 0.2) -> str:
        tag, name = self.r.choice(tags), self.r.choice(names)
        roll = self.r.random()
        attr = "" if roll < bare and tag != "div" else f' class="{name}"' if roll < 0.8 else f' id="{name}"'
        return f"<{tag}{attr}>{inside}</{tag}>"

    def nest(self, inside: str) -> str:
        for _ in range(self.r.choice((0, 0, 1, 2))):
            inside = f'<div class="{self.r.choice(PLAIN)}">{inside}</div>'
        return inside

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.leaf(self.some(1, 3), False)}</a>' for i in range(self.r.randint(low, high))]
        if self.r.random() < 0.8:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in items)

    def short(self) -> str:
        tag = self.r.choice(("p", "div", "h3", "h4", "span"))
        text = self.leaf(self.sentence(1, 14), False)
        return f"<div>{text}</div>" if tag == "span" else f"<{tag}>{text}</{tag}>"

    def boiler(self) -> str:
        r = self.r
        kind = r.randrange(9)
        if kind == 0:
            return self.nest(self.named(MENU, ("nav", "div", "ul", "nav"), self.links(2, 8)))
        if kind == 1:
            parts = [f"<h1>{self.leaf(self.some(1, 4), False)}</h1>" if r.random() < 0.4 else self.short()]
            return self.named(HEAD, ("header", "div"), "".join(parts) + (self.links(2, 6) if r.random() < 0.4 else ""))
        if kind == 2:
            return self.foot()
        if kind == 3:
            inside = (f"<h3>{self.leaf(self.some(1, 3), False)}</h3>" if r.random() < 0.6 else "") + (self.links(2, 6) if r.random() < 0.6 else "")
            inside += "".join(self.paragraph(False, 1, 3) for _ in range(r.randint(0, 3)))
            return self.named(SIDE, ("aside", "div", "section"), inside or self.short())
        if kind == 4:
            inside = "".join(self.paragraph(False, 1, 3) if r.random() < 0.5 else self.short() for _ in range(r.randint(1, 2)))
            if r.random() < 0.5:
                inside += f"<button>{self.leaf(self.some(1, 2), False)}</button>"
            return self.named(NOTICE, ("div", "div", "section"), inside, 0)
        if kind == 5:
            bare = r.random() < 0.4
            inside = self.leaf(self.sentence(3, 20), False) if bare else "".join(self.short() for _ in range(r.randint(1, 3)))
            return self.named(ADVERT, ("div", "div", "aside", "section"), inside, 0)
        if kind == 6:
            inside = f"<label>{self.leaf(self.some(1, 4), False)}</label><input>" + (self.short() if r.random() < 0.5 else "")
            inside += f"<button>{self.leaf(self.some(1, 2), False)}</button>"
            return self.named(FORM, ("form", "form", "div"), inside)
        if kind == 7:
            return self.comments()
        return self.named(SHARE, ("div", "ul", "p"), self.leaf(self.some(1, 4), False) if r.random() < 0.5 else self.links(2, 4), 0)

    def foot(self) -> str:
        inside = self.leaf(f"&copy; {self.some(1, 3)} &middot; {self.sentence(2, 12)}", False)
        if self.r.random() < 0.6:
            inside = f"<p>{inside}</p>" + "".join(self.short() for _ in range(self.r.randint(0, 2)))
            inside += self.links(2, 6) if self.r.random() < 0.4 else ""
        return self.named(FOOT, ("footer", "footer", "div"), inside, 0.5)

    def comments(self) -> str:
        each = []
        for _ in range(self.r.randint(1, 5)):
            who = f"<b>{self.leaf_inline()}</b> " if self.r.random() < 0.3 else ""
            said = f"<p>{who}{self.leaf(self.prose(1, 4), False)}</p>"
            each.append(self.r.choice(('<div class="comment">{}</div>', "<li>{}</li>", "<article>{}</article>", "{}")).format(said))
        head = f"<h3>{self.leaf(self.some(1, 3), False)}</h3>" if self.r.random() < 0.6 else ""
        # The title's leaf precedes those of the comments.
        if head:
            self.leaves[-1:] = []
            self.leaves[len(self.leaves) - len(each) :] = [False] * (len(each) + 1)
        return self.named(COMMENT, ("div", "section", "ol", "ul"), head + "".join(each), 0)

    def leaf_inline(self) -> str:
        return self.some(1, 2)

    def paragraph(self, main: bool, low: int, high: int) -> str:
        return f"<p>{self.leaf(self.prose(low, high), main)}</p>"

    def article(self, name: bool) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            title = f"<h1>{self.leaf(self.sentence(2, 12), True)}</h1>"
            out.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        use_p = r.random() < 0.85
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            roll = r.random()
            if roll < 0.72:
                text = self.leaf(self.prose(1, 8) if r.random() < 0.8 else self.sentence(1, 6), True)
                out.append(("<p>{}" if r.random() < 0.05 else "<p>{}</p>").format(text) if use_p else f"<div>{text}</div>")
            elif roll < 0.8:
                out.append("<h{0}>{1}</h{0}>".format(2 + r.randrange(2), self.leaf(self.some(1, 8), True)))
            elif roll < 0.85:
                out.append("<ul>" + "".join(f"<li>{self.leaf(self.sentence(2, 16), True)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif roll < 0.88:
                out.append(f"<blockquote>{self.leaf(self.prose(1, 3), True)}</blockquote>")
            elif roll < 0.9:
                out.append(f"<pre>{self.leaf(self.some(3, 20), True)}</pre>")
            elif roll < 0.92:
                cells = "".join(f"<td>{self.leaf(self.some(1, 3), True)}</td>" for _ in range(r.randint(2, 4)))
                out.append(f"<table><tr>{cells}</tr></table>")
            elif name:
                out.append(self.boiler())
        inside = self.nest("".join(out)) if r.random() < 0.4 else "".join(out)
        if not name:
            return f"<div>{inside}</div>" if r.random() < 0.5 else inside
        roll = r.random()
        if roll < 0.45:
            return f"<article>{inside}</article>"
        if roll < 0.6:
            return f"<main>{inside}</main>"
        return self.named(MAIN, ("div", "div", "section", "article"), inside, 0)

    def page(self) -> tuple[str, list[bool]]:
        """(html, whether each leaf belongs to the article)."""
        self.leaves = []
        before = "".join(self.boiler() for _ in range(self.r.randint(0, 4)))
        article = self.article(self.r.random() < 0.85)
        after = "".join(self.boiler() for _ in range(self.r.randint(0, 3)))
        after += self.foot() if self.r.random() < 0.7 else ""
        body = f"{before}{self.r.choice(('<main>{}</main>', '{}', '{}', '{}')).format(article)}{after}"
        return f"<html><head><title>{self.some(2, 5)}</title></head><body>{self.nest(body)}</body></html>", self.leaves
