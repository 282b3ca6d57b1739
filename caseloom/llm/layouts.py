"""Made web pages whose blocks are labelled, for learning what is an article's text."""

from __future__ import annotations

import random

# What parts of pages are called, by what they are. ``tag.name`` is an element with that class.
PARTS = {
    "menu": "nav nav.menu ul.nav ul.menu div.navigation div#nav div.navbar div.main-menu div.breadcrumbs nav.breadcrumb div.topnav div.pagination "
    "nav.pager div.toc div.tabs ul.links div.menubar ul.topmenu div.skip-links div.sitemap div.navi",
    "header": "header header.site-header div#header div.header div.masthead div.topbar div.site-title div.branding div.logo div.page-header div.kopf",
    "footer": "footer footer.site-footer div#footer div.footer div.bottom div.copyright div.legal div.imprint div.foot div.colophon div.credits",
    "sidebar": "aside aside.sidebar div#sidebar div.sidebar div.side div.widget section.widget div.related aside.related-posts div.recommended "
    "div.popular div.trending div.recent-posts div.tags div.archives div.more-stories div.teaser-list div.rail div.toplist td.sidebar",
    "notice": "div.cookie div.cookie-notice div#cookie-banner div.consent div.gdpr div.notice div.alert div.alert-info div.message div.warning "
    "div.popup div.modal div.overlay div.toast div.newsletter div.subscribe div.paywall div.announcement div.hint div.disclaimer section.notification div.banner",
    "advert": "div.ad div.ads div.advert div.advertisement div.ad-slot div.sponsored div.sponsor div.promo div.promotion aside.ad ins.adsbygoogle "
    "div.commercial div.werbung div.anzeige div.publicidad div.publicite div.partner section.ad-container div.adbox div.banner-ad",
    "form": "form form.search form.login div.search-form form.signup div.contact-form form.newsletter-form div.login-box form#commentform",
    "comments": "section.comments div#comments div.comments section#comments div.comment-list ol.commentlist div.discussion div.disqus div#disqus_thread "
    "div.responses div.replies div.user-comments div.reader-comments section.feedback div.kommentare div.commentaires div.comentarios div.guestbook div.thread",
    "share": "div.share div.social ul.social-links div.sharing div.share-buttons div.toolbar div.follow div.likes",
    "main": "article main article.post main#main div.article div.article-body div.content div#content div.post div.post-content div.entry div.entry-content "
    "div.story section.story div.story-body div.text div.body-text div.main-text td.content div.prose div.markdown section.article article.entry div.artikel div.texte div.hentry",
    "wrap": "div div.container div.wrapper div#page div.row div.col div.site div.inner div.layout section div.grid div.outer div.column div.wrap",
}
PARTS = {kind: names.split() for kind, names in PARTS.items()}
# What such parts say.
SAYS = {
    "menu": ["Home", "About", "About us", "News", "Contact", "Products", "Blog", "Archive", "Next", "Previous", "Services", "Sports", "Politics", "FAQ", "Startseite", "Accueil", "Inicio", "Login"],
    "header": ["The Daily News", "My Blog", "Search", "Sign in", "Subscribe", "Example", "Just another site", "Skip to content"],
    "footer": ["© 2024 Example Inc.", "All rights reserved.", "Privacy policy", "Terms of use", "Impressum", "Copyright 2023 by Example · Contact", "Powered by Example", "Mentions légales", "Alle Rechte vorbehalten."],
    "sidebar": ["Related articles", "Popular posts", "Most read", "Recent posts", "Tags", "Archives", "You may also like", "Read more", "Trending now", "About the author"],
    "notice": ["We use cookies to improve your experience.", "This site uses cookies. By continuing you accept our policy.", "Accept all", "Please enable JavaScript.", "Subscribe to our newsletter!", "Breaking: the site will be down tonight.", "You have 2 free articles left."],
    "advert": ["Advertisement", "Sponsored", "Buy now and save 50%!", "Limited offer: get yours today.", "Anzeige", "Ad", "Shop the sale"],
    "form": ["Search", "Your email", "Name", "Password", "Submit", "Leave a reply", "Send", "Post comment", "Sign up"],
    "comments": ["3 Comments", "Comments", "Reply", "Leave a comment", "Anonymous says:", "John on May 3, 2021", "Report", "Log in to reply"],
    "share": ["Share", "Tweet", "Facebook", "Print", "Email this", "Like", "Follow us"],
}
SYLLABLES = "an be co de er fa ge hi in ka lo mi no or pa qu re sa ti un ve wo za th ing ch el ou".split()


class Maker:
    def __init__(self, dice: random.Random):
        self.dice = dice

    def word(self) -> str:
        return "".join(self.dice.choice(SYLLABLES) for _ in range(self.dice.choice([1, 1, 2, 2, 3])))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.dice.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        ends = [self.dice.choice("....!?") for _ in range(self.dice.randint(low, high))]
        return " ".join(self.words(1, 14).capitalize() + self.dice.choice(["", "", ", " + self.words(2, 8)]) + end for end in ends)

    def inside(self, kind: str, content: str, label: int | None) -> str:
        """Content in an element of some kind."""
        tag, mark, name = "".join(self.dice.choice(PARTS[kind])).replace("#", ".#").partition(".")
        named = f' {"id" if name[0] == "#" else "class"}="{name.lstrip("#")}"' if mark else ""
        if tag == "td":
            content, tag, named = f"<tr><td{named}>{content}</td></tr>", "table", ""
        labelled = "" if label is None else f' data-main="{label}"'
        return f"<{tag}{named}{labelled}>{content}</{tag}>"

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def phrase(self, kind: str) -> str:
        return self.dice.choice([self.dice.choice(SAYS[kind]), self.words(1, 5).capitalize()])

    def links(self, kind: str) -> str:
        found = [self.link(self.phrase(kind)) for _ in range(self.dice.randint(2, 8))]
        return self.dice.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>", " | ".join(found), "".join(f"<div>{x}</div>" for x in found)])

    def paragraph(self, low: int = 1, high: int = 9) -> str:
        text = self.sentences(low, high)
        if self.dice.random() < 0.2:
            text = text.replace(" ", f" {self.link(self.words(1, 3))} ", 1)
        if self.dice.random() < 0.15:
            text = f"<b>{text}"
        return self.dice.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>"]).format(text)

    def other(self, kind: str) -> str:
        """A part that is no content."""
        dice = self.dice
        if kind == "menu":
            content = self.links(kind)
        elif kind == "comments":
            one = lambda: self.dice.choice(["<div class=\"comment\">{}</div>", "<li>{}</li>", "<article class=\"comment\">{}</article>", "<div class=\"comment-body\">{}</div>"]).format(
                f"<div class=\"comment-author\">{self.phrase(kind)}</div>" * dice.randint(0, 1) + self.paragraph(1, 5) + self.link("Reply") * dice.randint(0, 1)
            )
            content = f"<h3>{self.phrase(kind)}</h3>" * dice.randint(0, 1) + "".join(one() for _ in range(dice.randint(1, 6))) + self.other("form") * (dice.random() < 0.3)
        elif kind == "form":
            content = "".join(f"<label>{self.phrase(kind)}</label><input>" for _ in range(dice.randint(1, 3))) + f"<button>{self.phrase(kind)}</button>"
        elif kind == "sidebar":
            heads = lambda: f"<h3>{self.phrase(kind)}</h3>" * dice.randint(0, 1)
            content = "".join(heads() + dice.choice([self.links(kind), self.paragraph(1, 3), "".join(f"<div>{self.link(self.words(3, 9))} {self.sentences(1, 1)}</div>" for _ in range(3))]) for _ in range(dice.randint(1, 3)))
        elif kind == "header":
            content = f"<div>{self.phrase(kind)}</div>" + self.other("menu") * dice.randint(0, 1) + self.other("form") * (dice.random() < 0.2)
        else:
            said = self.phrase(kind) if dice.random() < 0.6 else self.sentences(1, 3)
            content = dice.choice(["<p>{}</p>", "{}", "{} " + self.link(self.phrase(kind)), "<span>{}</span>"]).format(said)
            content += self.links(kind) * (kind in ("footer", "share") and dice.random() < 0.5)
        return self.inside(kind, content, 0)

    def article(self) -> str:
        dice = self.dice
        parts = [f"<h1>{self.words(2, 12).capitalize()}</h1>"] * (dice.random() < 0.8)
        for _ in range(dice.choice([1, 2, 3, 5, 8, 13])):
            parts.append(self.paragraph())
            extra = dice.random()
            if extra < 0.1:
                parts.append(f"<h2>{self.words(2, 7).capitalize()}</h2>")
            elif extra < 0.15:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 12)}</li>" for _ in range(dice.randint(2, 5))) + "</ul>")
            elif extra < 0.19:
                parts.append(f"<blockquote>{self.paragraph(1, 3)}</blockquote>")
            elif extra < 0.22:
                parts.append("<table>" + "".join(f"<tr><th>{self.word()}</th><td>{dice.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>")
            elif extra < 0.25:
                parts.append(f"<figure><img><figcaption>{self.sentences(1, 2)}</figcaption></figure>")
            elif extra < 0.28:
                parts.append(f"<pre><code>{self.words(3, 20)} = {dice.randint(1, 99)};</code></pre>")
            elif extra < 0.42:
                parts.append(self.other(dice.choice(["advert", "share", "sidebar", "notice", "form"])))
        if dice.random() < 0.15:
            parts.append(self.other("comments"))
        return self.inside("main", "".join(parts), 1)

    def page(self) -> str:
        dice = self.dice
        some = lambda kind, chance: [self.other(kind)] * (dice.random() < chance)
        before = some("notice", 0.3) + some("header", 0.6) + some("menu", 0.6) + some("advert", 0.4)
        middle = some("sidebar", 0.2) + [self.article()] + some("share", 0.2) + some("comments", 0.4) + some("sidebar", 0.4)
        after = some("notice", 0.15) + some("form", 0.25) + some("advert", 0.2) + some("footer", 0.75)
        if dice.random() < 0.6:
            middle = [self.inside("wrap", "".join(middle), None)]
        whole = "".join(before + middle + after)
        if dice.random() < 0.6:
            whole = self.inside("wrap", whole, None)
        return f'<html><head><title>{self.words(2, 6)}</title></head><body data-main="0">{whole}</body></html>'


def made_pages(count: int, seed: int) -> list[str]:
    """Pages whose ``data-main`` attributes label what is in them; the same for the same seed."""
    maker = Maker(random.Random(seed))
    return [maker.page() for _ in range(count)]
