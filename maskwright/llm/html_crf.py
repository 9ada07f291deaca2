"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is a sequence of leaf blocks (see html_blocks). Each block has binary features of its ancestors (tags, parts of class,
id and role values, the innermost tag) and of its text (length, share of links, sentence marks, digits, a few words of
notices in several languages, place in the page). The field scores each label (article or not) by those features and each
pair of neighbouring labels; it is trained by maximum likelihood with forward-backward and L-BFGS on labelled pages, and a
page is decoded by Viterbi. Articles' own words are never features, so the language of a page does not matter.

`labelled_pages` generates the training pages: layouts of news, blog, wiki, forum and plain pages, with semantic elements
or with class names only, and with unclosed and misnested tags, all from one seed. Training takes a few seconds on the
driver, and only the weights go to the tasks; extraction is one map pass and nothing is shuffled.

Defined cases: null html is the empty page, whose text is empty; a page without an article block has the empty text; tags
that are cut off, unclosed or misnested are read as browsers do as far as blocks go; repeated rows are extracted each; null
ids and urls stay null; an empty table gives no rows; extra columns pass by unread.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import slices
from maskwright.llm.html_blocks import Block, leaf_blocks
from maskwright.llm.toxicity import minimize

#: Words that notices and controls use, as prefixes of lower-cased words.
CUES = {
    "cookie": ("cookie",), "rights": ("©", "copyright", "rights", "rechte", "droits", "derechos"),
    "comment": ("comment", "repl", "kommentar", "antwort", "commentaire", "répon", "comentario", "respuesta"),
    "advert": ("advert", "sponsor", "anzeige", "werbung", "publicit", "publicid", "annonce"),
    "account": ("login", "log", "sign", "subscrib", "newsletter", "anmeld", "abonn", "connexion", "suscri"),
    "share": ("share", "tweet", "teilen", "partag", "compart"),
}


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        size, words = len(b.text), b.text.lower().split()
        f = ["1", f"t:{b.tags[-1] if b.tags else ''}"]
        f += [f"a:{t}" for t in set(b.tags)]
        f += [f"n:{p}" for p in b.names]
        f.append(f"size:{min(6, size.bit_length() - 3) if size >= 8 else 0}")
        f.append(f"link:{min(4, 4 * b.linked // max(1, size))}")
        f.append(f"end:{b.text[-1] in '.!?…»”\"'}")
        f.append(f"stops:{min(3, sum(b.text.count(x) for x in '.,;'))}")
        f.append(f"digits:{sum(map(str.isdigit, b.text)) * 5 > size}")
        f.append(f"place:{0 if i == 0 else 2 if i == n - 1 else 1}")
        head = words[:40]
        f += [f"cue:{k}" for k, cues in CUES.items() if any(w.startswith(cues) for w in head)]
        f.append(f"semantic:{'article' in b.tags or 'main' in b.tags}")
        out.append(f)
    return out


class Crf:
    """Weights of (feature, label) and of label pairs; labels 0 (other) and 1 (article)."""

    def __init__(self, pages: list[tuple[list[list[str]], list[int]]], penalty: float = 0.01, rounds: int = 80):
        self.place: dict[str, int] = {}
        pages = [p for p in pages if p[0]]
        for fs, _ in pages:
            for f in fs:
                for x in f:
                    self.place.setdefault(x, len(self.place))
        n_f, n_p, longest = len(self.place), len(pages), max(len(fs) for fs, _ in pages)
        row = np.concatenate([np.repeat(i * longest + t, len(f)) for i, (fs, _) in enumerate(pages) for t, f in enumerate(fs)])
        col = np.array([self.place[x] for fs, _ in pages for f in fs for x in f])
        size = np.array([len(fs) for fs, _ in pages])
        gold = np.full((n_p, longest), -1)
        for i, (_, y) in enumerate(pages):
            gold[i, : len(y)] = y
        live = gold >= 0
        lab = np.stack([gold == 0, gold == 1], axis=2).astype(float)
        pair_gold = np.einsum("ptj,ptk->jk", lab[:, :-1], lab[:, 1:])

        def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
            w, tr = v[: 2 * n_f].reshape(n_f, 2), v[2 * n_f :].reshape(2, 2)
            e = np.stack([np.bincount(row, w[col, j], n_p * longest) for j in (0, 1)], axis=1).reshape(n_p, longest, 2)
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for t in range(1, longest):
                step = np.logaddexp.reduce(fwd[:, t - 1, :, None] + tr, axis=1) + e[:, t]
                fwd[:, t] = np.where(live[:, t, None], step, fwd[:, t - 1])
            for t in range(longest - 2, -1, -1):
                step = np.logaddexp.reduce(tr + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
                bwd[:, t] = np.where(live[:, t + 1, None], step, 0.0)
            z = np.logaddexp.reduce(fwd[:, -1], axis=1)
            p = np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None]
            pair = np.exp(fwd[:, :-1, :, None] + tr + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
            value = z.sum() - (e * lab).sum() - (pair_gold * tr).sum()
            g = (p - lab).reshape(-1, 2)
            grad = np.concatenate((np.stack([np.bincount(col, g[row, j], n_f) for j in (0, 1)], axis=1).reshape(-1), (pair.sum((0, 1)) - pair_gold).reshape(-1)))
            return value / n_p + 0.5 * penalty * (v @ v) / n_f, grad / n_p + penalty * v / n_f

        v = minimize(loss, np.zeros(2 * n_f + 4), rounds)
        self.weight, self.pair = v[: 2 * n_f].reshape(n_f, 2), v[2 * n_f :].reshape(2, 2)
        assert size.min() > 0

    def decode(self, fs: list[list[str]]) -> list[int]:
        """The most probable labels (Viterbi); ties go to label 0."""
        if not fs:
            return []
        lean = self.weight[:, 1] - self.weight[:, 0]
        e = [float(lean[[self.place[x] for x in f if x in self.place]].sum()) for f in fs]
        (a, b), (c, d) = self.pair.tolist()
        zero, one, back = 0.0, e[0], []
        for x in e[1:]:
            to0, to1 = (zero + a, one + c), (zero + b, one + d)
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            zero, one = max(to0), max(to1) + x
        y = [int(one > zero)]
        for step in reversed(back):
            y.append(step[y[-1]])
        return y[::-1]


# ---- labelled pages -------------------------------------------------------------------------------------------------


class _Writer:
    """Random pages whose article words all contain the letter q and whose other words never do: that is the labelling."""

    def __init__(self, rng: random.Random):
        self.r, self.out = rng, []

    def words(self, n: int, article: bool) -> str:
        w = ["".join(self.r.choice("abdeilmnorstuv") for _ in range(self.r.randint(1, 9))) for _ in range(n)]
        return " ".join(x + "q" if article else x for x in w)

    def sentences(self, n: int, article: bool) -> str:
        return " ".join(self.words(self.r.randint(2, 18), article).capitalize() + self.r.choice(".....!?") for _ in range(n))

    def tag(self, name: str, inner: str, names: tuple[str, ...] = (), close: float = 0.0) -> str:
        attr = f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(names)}"' if names else ""
        return f"<{name}{attr}>{inner}" + ("" if self.r.random() < close else f"</{name}>")

    def links(self, n: int) -> str:
        return "".join(self.tag("li", f'<a href="/{i}">{self.words(self.r.randint(1, 4), False)}</a>', close=0.1) for i in range(n))

    def menu(self) -> str:
        names = ("menu", "nav", "navbar", "main-menu", "navigation", "breadcrumb", "topnav", "toc")
        inner = self.tag(self.r.choice(("ul", "ul", "ol")), self.links(self.r.randint(2, 9)))
        return self.tag("nav", inner, names if self.r.random() < 0.4 else ()) if self.r.random() < 0.6 else self.tag("div", inner, names)

    def header(self) -> str:
        inner = self.tag(self.r.choice(("h1", "h2", "p", "div", "a")), self.words(self.r.randint(1, 6), False)) + (self.tag("p", self.sentences(1, False)) if self.r.random() < 0.5 else "")
        return self.tag("header", inner) if self.r.random() < 0.6 else self.tag("div", inner, ("header", "site-header", "masthead", "banner", "topbar", "logo"))

    def footer(self) -> str:
        cue = self.r.choice(("&copy; ", "&copy; 2024 ", "Copyright ", "")) + self.words(2, False) + self.r.choice((" &middot; ", " | ", " "))
        inner = cue + self.sentences(self.r.randint(1, 4), False)
        if self.r.random() < 0.4:
            inner = self.tag("p", inner) + self.tag("ul", self.links(3))
        return self.tag("footer", inner, close=0.05) if self.r.random() < 0.7 else self.tag("div", inner, ("footer", "site-footer", "colophon", "bottom", "legal", "copyright"))

    def advert(self) -> str:
        names = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "adBox", "sponsor")
        inner = self.sentences(self.r.randint(1, 4), False)
        return self.tag(self.r.choice(("div", "div", "section", "aside", "p")), self.tag("p", inner) if self.r.random() < 0.4 else inner, names)

    def sidebar(self) -> str:
        inner = self.tag(self.r.choice(("h2", "h3", "h4")), self.words(2, False)) + (self.tag("ul", self.links(4)) if self.r.random() < 0.6 else self.tag("p", self.sentences(2, False)))
        return self.tag("aside", inner) if self.r.random() < 0.55 else self.tag("div", inner, ("sidebar", "side", "widget", "related", "recommended", "aside", "rail", "trending", "popular", "more"))

    def notice(self) -> str:
        cue = self.r.choice(("Cookie ", "This site uses cookies ", "Subscribe ", "Newsletter ", ""))
        inner = cue + self.sentences(self.r.randint(1, 3), False) + (self.tag("button", "OK") if self.r.random() < 0.5 else "")
        return self.tag(self.r.choice(("div", "div", "section", "p")), self.tag("p", inner) if self.r.random() < 0.4 else inner, ("cookie", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "disclaimer", "warning"))

    def form(self) -> str:
        return self.tag("form", self.tag("label", self.words(2, False)) + '<input name="x">' + self.tag("button", self.words(1, False)) + (self.tag("p", self.sentences(1, False)) if self.r.random() < 0.4 else ""))

    def share(self) -> str:
        return self.tag("div", self.tag("ul", self.links(3)) if self.r.random() < 0.5 else self.words(3, False), ("share", "social", "tags", "meta", "byline", "tools", "pagination", "author"))

    def comments(self) -> str:
        one = lambda: self.tag(self.r.choice(("div", "li", "p", "article")), self.tag("p", self.sentences(self.r.randint(1, 5), False)), ("comment", "reply", "comment-body", "user-comment"))
        inner = (self.tag("h3", self.r.choice(("Comments", "Kommentare", "Commentaires", "Comentarios", "Responses"))) if self.r.random() < 0.7 else "") + "".join(one() for _ in range(self.r.randint(1, 6)))
        return self.tag(self.r.choice(("section", "div", "ol")), inner, ("comments", "comment-list", "responses", "discussion", "comments-area", "replies", "disqus"))

    def article(self) -> str:
        r, parts = self.r, []
        title = self.words(r.randint(1, 10), True)
        if r.random() < 0.85:
            parts.append(self.tag(r.choice(("h1", "h1", "h2")), title))
        if r.random() < 0.15:
            parts.append(self.tag("header", self.tag("h1", title)))
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            kind = r.random()
            text = self.sentences(r.choice((1, 1, 1, 2, 3, 5, 9)), True)
            if kind < 0.12:
                text = self.words(r.choice((1, 1, 2, 3)), True) + r.choice(("", ".", ".", ":"))
            if kind < 0.55:
                parts.append(self.tag("p", text, close=0.15))
            elif kind < 0.68:
                parts.append("<p><b>" + text + "<br>" + (self.sentences(1, True) if r.random() < 0.5 else ""))
            elif kind < 0.74:
                parts.append(self.tag(r.choice(("h2", "h3")), self.words(r.randint(1, 6), True)))
            elif kind < 0.80:
                parts.append(self.tag(r.choice(("ul", "ol")), "".join(self.tag("li", self.words(r.randint(1, 12), True)) for _ in range(r.randint(1, 5)))))
            elif kind < 0.84:
                parts.append(self.tag("blockquote", self.tag("p", text)))
            elif kind < 0.88:
                parts.append(self.tag("table", "".join(self.tag("tr", self.tag("td", self.words(2, True)) * 2) for _ in range(3))))
            elif kind < 0.92:
                parts.append(self.tag(r.choice(("pre", "div", "section")), text))
            else:
                parts.append(self.tag("p", f'{text} <a href="/x">{self.words(3, True)}</a> <em>{self.words(2, True)}</em>'))
            if r.random() < 0.05:
                parts.append(r.choice((self.advert, self.share, self.sidebar, self.notice, self.form))())
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        body = [f() for f, p in ((self.notice, 0.25), (self.header, 0.45), (self.menu, 0.75), (self.advert, 0.45), (self.sidebar, 0.2)) if r.random() < p]
        inner = self.article()
        if r.random() < 0.25:
            inner += r.choice((self.comments, self.share, self.sidebar, self.form))()
        kind = r.random()
        if kind < 0.55:
            main = self.tag("article", inner, close=0.03)
        elif kind < 0.70:
            main = self.tag("main", inner)
        elif kind < 0.90:
            main = self.tag(r.choice(("div", "section")), inner, ("content", "post", "entry", "story", "article-body", "main-content", "post-content", "text", "page", "body"))
        else:
            main = inner
        if r.random() < 0.2:
            main = self.tag("div", main, ("wrapper", "container", "page", "main", "row"))
        body.append(main)
        body += [f() for f, p in ((self.sidebar, 0.3), (self.share, 0.15), (self.comments, 0.35), (self.advert, 0.15), (self.form, 0.15), (self.menu, 0.1), (self.notice, 0.1), (self.footer, 0.8)) if r.random() < p]
        head = f"<head><title>{self.words(4, True)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        end = "" if r.random() < 0.1 else "</body></html>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(body)}{end}"


def labelled_pages(n: int = 700, seed: int = 5) -> list[tuple[str, list[int]]]:
    """(page, label of each leaf block): generated pages of many layouts."""
    out = []
    for i in range(n):
        page = _Writer(random.Random(seed * 1_000_003 + i)).page()
        out.append((page, [int("q" in b.text) for b in leaf_blocks(page)]))
    return out


@lru_cache(maxsize=4)
def trained(n: int = 700, seed: int = 5) -> Crf:
    return Crf([(features(leaf_blocks(p)), y) for p, y in labelled_pages(n, seed)])


def main_text(page: str | None, model: Crf) -> str:
    blocks = leaf_blocks(page)
    return " ".join(b.text for b, y in zip(blocks, model.decode(features(blocks))) if y)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            text = pa.array([main_text(h, model) for h in b.column("html").to_pylist()], pa.string())
            yield pa.record_batch([b.column("page_id"), b.column("url"), text], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
