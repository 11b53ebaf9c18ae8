"""Main text of web pages by boosted trees over DOM blocks.

The trees see what a block holds, its depth and siblings, and its attribute words
as hash buckets, its own and those of the blocks around it; which words speak for
main text is learned.  They give each block the probability that it is main text.
Choices are then made for the whole tree at once: a block is kept whole, dropped whole, or left to
its children, and the likeliest such labelling is found bottom-up, so nothing
kept lies in something dropped or the other way round.

There are no labels for pages.  The trees are trained on pages that
:func:`sample_page` writes in many layouts, where the main text is known.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import by_parts
from .boosting import Boosted
from .dom import Page, features

#: Pages that the trees are trained on, and their seed.
TRAINING_PAGES = 1_500
SEED = 11
TREES = 140
#: Blocks that must hold a bucket, in training, for the trees to see it.
LEAST_BLOCKS = 25
#: Of training pages, the part whose attributes say nothing.
NAMELESS = 0.15
#: Pages, bytes of them, and blocks that are taken together.
PART_PAGES, PART_BYTES, PART_BLOCKS = 64, 4 << 20, 8_192
#: Names that the writer of training pages gives to elements, by what they hold.
NAMES = {
    "main": "content article articleBody post entry story main post-body entry-content text page single prose main-content post-content blog-post news-article body-copy",
    "wrapper": "wrapper container page site row content main layout grid inner outer col center shell app root",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav nav-menu main-menu tabs pagination pager toc mega-menu skip-links",
    "header": "header masthead branding topbar site-header page-header logo banner-top hero",
    "footer": "footer copyright bottom colophon site-footer legal foot credits",
    "side": "sidebar side widget related recommended popular rail trending aside right-col widgets tag-cloud more-stories related-posts",
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion banner teaser ad-slot ad-container adsense",
    "comment": "comments comment-list commentlist discussion respond replies disqus reviews user-comments responses",
    "reply": "comment reply response user-comment comment-body",
    "notice": "cookie cookies consent notice alert gdpr popup cookie-banner modal overlay warning message announcement privacy-notice newsletter-popup",
    "form": "search newsletter login subscribe signup contact share social search-form login-form subscribe-box share-buttons",
}
#: What leaving a block to its children costs, in nats.
MIXED_COST = 0.8


class _Writer:
    """Random pages with marks around main text."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        letters = rng.choice(["etaoinshrdlu", "enirstadhul", "easnrtlouié", "aeosrnidlcñ"])
        self.nameless = rng.random() < NAMELESS
        self.words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        out, size = [], self.rng.randint(low, high)
        while size > 0:
            k = min(size, self.rng.randint(1, 14))
            out.append(self.phrase(k, k).capitalize() + self.rng.choice([".", ".", ",", "!", ""]))
            size -= k
        return " ".join(out)

    def pick(self, *options: str) -> str:
        return self.rng.choice(options)

    def attribute(self, role: str, chance: float = 0.85) -> str:
        if self.rng.random() > chance:
            return ""
        name = self.phrase(1, 1) if self.nameless else self.rng.choice(NAMES[role].split())
        if self.rng.random() < 0.3:
            name = self.pick("x-", "site-", "js_", "c") + name
        if self.rng.random() < 0.3:
            name += self.pick(" ", "-", "__") + self.pick("inner", "box", "block", "wide", "left", "item", "xs", "clearfix", self.phrase(1, 1))
        other = self.pick("", "", "", f' title="{self.phrase(1, 3)}"', f' data-x="{self.phrase(1, 1)}"')
        return f' {self.pick("class", "class", "id")}="{name}"{other}'

    def links(self, low: int, high: int) -> str:
        items = "".join(f'<li><a href="/{self.phrase(1, 1)}">{self.phrase(1, 4)}</a></li>' for _ in range(self.rng.randint(low, high)))
        return f"<ul>{items}</ul>" if self.rng.random() < 0.7 else "".join(f'<a href="#">{self.phrase(1, 3)}</a> | ' for _ in range(self.rng.randint(low, high)))

    def boilerplate(self, kind: str) -> str:
        rng, tag = self.rng, self.pick
        if kind == "nav":
            t = tag("nav", "div", "nav", "header", "ul")
            return f"<{t}{self.attribute('nav', 0.3 if t == 'nav' else 0.9)}>{self.links(2, 9)}</{t}>"
        if kind == "header":
            t = tag("header", "header", "div")
            return f"<{t}{self.attribute('header', 0.3 if t == 'header' else 0.95)}>{tag('<h1>', '<p>', '<div>')}{self.phrase(1, 5)}{self.links(0, 4) if rng.random() < 0.4 else ''}{'<p>' + self.prose(3, 12) + '</p>' if rng.random() < 0.4 else ''}</{t}>"
        if kind == "footer":
            t = tag("footer", "footer", "div")
            return f"<{t}{self.attribute('footer', 0.3 if t == 'footer' else 0.95)}>{tag('<p>', '', '<div>')}&copy; {self.phrase(1, 4)} &middot; {self.prose(2, 30)}{self.links(0, 5) if rng.random() < 0.4 else ''}</{t}>"
        if kind == "side":
            t = tag("aside", "div", "section")
            return f"<{t}{self.attribute('side', 0.5 if t == 'aside' else 0.97)}>{tag('<h3>', '<h2>', '<h4>')}{self.phrase(1, 3)}{tag('</h3>', '</h2>', '</h4>')}{self.links(2, 6) if rng.random() < 0.6 else ''}{'<p>' + self.prose(4, 60) + '</p>' if rng.random() < 0.6 else ''}</{t}>"
        if kind == "advert":
            t = tag("div", "div", "aside", "section", "p")
            return f"<{t}{self.attribute('advert', 1)}>{tag('', '<p>')}{self.prose(2, 50)}</{t}>"
        if kind == "comment":
            t, inner = tag("section", "div", "ol", "ul"), tag("div", "li", "p", "article")
            items = "".join(f"<{inner}{self.attribute('reply', 0.7)}>{'<b>' + self.phrase(1, 2) + '</b> ' if rng.random() < 0.5 else ''}{'<p>' if rng.random() < 0.4 else ''}{self.prose(3, 70)}</{inner}>" for _ in range(rng.randint(1, 6)))
            return f"<{t}{self.attribute('comment', 0.98)}>{'<h3>' + self.phrase(1, 3) + '</h3>' if rng.random() < 0.5 else ''}{items}</{t}>"
        if kind == "notice":
            t = tag("div", "div", "section", "aside")
            return f"<{t}{self.attribute('notice', 0.98)}>{tag('<p>', '', '<span>')}{self.prose(3, 50)} {'<a href=/ok>' + self.phrase(1, 2) + '</a>' if rng.random() < 0.5 else ''}{'<button>ok</button>' if rng.random() < 0.4 else ''}</{t}>"
        t = tag("form", "div")
        return f"<{t}{self.attribute('form', 0.4 if t == 'form' else 0.98)}><label>{self.phrase(1, 5)}</label>{'<p>' + self.prose(3, 30) + '</p>' if rng.random() < 0.4 else ''}<input name=q><button>{self.phrase(1, 1)}</button></{t}>"

    def main(self) -> tuple[str, list[str]]:
        rng, texts = self.rng, []

        def mark(text: str) -> str:
            texts.append(text)
            return text

        parts, style = [], rng.random()
        if rng.random() < 0.85:
            h = self.pick("h1", "h1", "h2")
            parts.append(f"<{h}>{mark(self.prose(1, 12))}</{h}>")
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 20])):
            kind = rng.random()
            size = rng.choice([(1, 3), (4, 20), (15, 60), (40, 120), (40, 200)])
            if style < 0.15:
                parts.append(mark(self.prose(*size)) + self.pick("<br>", "<br><br>"))
            elif style < 0.25:
                parts.append(f"<div>{mark(self.prose(*size))}</div>")
            elif kind < 0.08:
                parts.append("<ul>" + "".join(f"<li>{mark(self.prose(1, 20))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.12:
                parts.append(f"<blockquote>{self.pick('', '<p>')}{mark(self.prose(*size))}</blockquote>")
            elif kind < 0.18:
                parts.append(f"<{(h := self.pick('h2', 'h3'))}>{mark(self.prose(1, 8))}</{h}>")
            elif kind < 0.21:
                parts.append("<table>" + "".join(f"<tr><td>{mark(self.phrase(1, 4))}</td><td>{mark(self.phrase(1, 4))}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.23:
                parts.append(f"<figure><img src=a.png><figcaption>{mark(self.prose(2, 12))}</figcaption></figure>")
            elif kind < 0.33:
                parts.append(f"<p><b>{mark(self.prose(*size))}<br>")  # never closed
            elif kind < 0.4:
                first, second = self.prose(*size), self.phrase(1, 4)
                texts.append(f"{first} {second}")
                parts.append(f'<p>{first} <a href="/x">{second}</a></p>')
            elif kind < 0.47 and len(parts) > 1:
                parts.append(self.boilerplate(self.pick("advert", "form", "side", "notice")))
            else:
                parts.append(f"<p>{mark(self.prose(*size))}{self.pick('</p>', '</p>', '')}")
        body = "".join(parts)
        if rng.random() < 0.2:
            body = f"<div{self.attribute('main', 0.6)}>{body}</div>"
        t = self.pick("article", "article", "main", "div", "section", "div", "td")
        body = f"<{t}{self.attribute('main', 0.25 if t in ('article', 'main') else 0.9)}>{body}</{t}>"
        if t == "td":
            body = f"<table><tr>{'<td>' + self.links(2, 5) + '</td>' if rng.random() < 0.5 else ''}{body}</tr></table>"
        return body, texts

    def page(self) -> tuple[str, list[str]]:
        rng = self.rng
        body, texts = self.main()
        before = [k for k in ("notice", "header", "nav", "form", "advert", "side") if rng.random() < 0.4]
        after = [k for k in ("comment", "side", "form", "advert", "notice", "footer", "nav") if rng.random() < 0.4]
        rng.shuffle(before)
        inside = "".join(map(self.boilerplate, before)) + body + "".join(map(self.boilerplate, after))
        for _ in range(rng.choice([0, 0, 1, 2])):
            inside = f"<div{self.attribute('wrapper', 0.7)}>{inside}</div>"
        if rng.random() < 0.7:
            inside = f"<body>{inside}{self.pick('</body></html>', '')}"
        return f"<!DOCTYPE html><html><head><title>{self.phrase(1, 6)}</title><script>var t='</p>';</script></head>{inside}", texts


def sample_page(seed: int) -> tuple[str, str]:
    """A random page and its main text."""
    html, texts = _Writer(random.Random(seed)).page()
    return html, " ".join(" ".join(t.split()) for t in texts if t.split())


def _labels(page: Page, texts: list[str]) -> np.ndarray | None:
    """1 for blocks whose text is all main text, by walking both lists in order; nan where they mix."""
    good = np.zeros(len(page.parent))
    k = 0
    for i, text in enumerate(page.texts):
        if not text:
            continue
        joined, j = "", k
        while j < len(texts) and len(joined) < len(text):
            joined, j = (joined + " " + texts[j]).strip(), j + 1
        if joined == text:
            good[i], k = 1, j
    if k != len(texts):
        return None
    size = np.concatenate(([0], np.cumsum([len(t) for t in page.texts])))
    part = np.concatenate(([0], np.cumsum([len(t) * g for t, g in zip(page.texts, good, strict=True)])))
    end = np.array(page.end)
    total, mine = size[end] - size[:-1], part[end] - part[:-1]
    return np.where(total == 0, np.nan, np.where(mine == total, 1.0, np.where(mine == 0, 0.0, np.nan)))


@dataclass
class Model:
    """Trees, and the attribute buckets that follow the other features."""

    trees: Boosted
    used: np.ndarray

    def features(self, page: Page) -> np.ndarray:
        return np.column_stack((features(page.columns()), page.buckets(self.used)))

    def chances(self, page: Page) -> np.ndarray:
        """Probability of each block to be main text."""
        return self.trees.probability(self.features(page))


@lru_cache(2)
def train(pages: int = TRAINING_PAGES, seed: int = SEED) -> Model:
    """Trees fitted on blocks that are wholly main text or wholly not."""
    made, y = [], []
    for k in range(pages):
        html, texts = _Writer(random.Random(seed * 1_000_003 + k)).page()
        page = Page(html)
        texts = [" ".join(t.split()) for t in texts]
        label = _labels(page, [t for t in texts if t])
        if label is not None:
            made.append(page)
            y.append(label)
    times = sum(page.buckets().sum(0, dtype=np.int64) for page in made)
    used = np.flatnonzero(times >= LEAST_BLOCKS)
    known = [~np.isnan(label) for label in y]
    x = [np.column_stack((features(page.columns()), page.buckets(used)))[k] for page, k in zip(made, known, strict=True)]
    return Model(Boosted().fit(np.concatenate(x).astype(np.float32), np.concatenate([label[k] for label, k in zip(y, known, strict=True)]), TREES), used)


def decode(parent: np.ndarray, own: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The likeliest consistent labelling: True for blocks whose own text is kept.

    ``own``: the block has text of its own.  Blocks without text in them are free.
    """
    n = len(parent)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    keep, drop = (-np.log(p)).tolist(), (-np.log1p(-p)).tolist()
    best, mixed, filled = [0.0] * n, [MIXED_COST] * n, own.astype(bool).tolist()
    choice = [0] * n  # 0 children decide, 1 keep, 2 drop
    up = parent.tolist()
    whole_keep, whole_drop = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if not filled[i]:
            continue
        k, d = keep[i] + whole_keep[i], drop[i] + whole_drop[i]
        options = (mixed[i] if not own[i] else np.inf, k, d)
        choice[i] = min((1, 2, 0), key=options.__getitem__)
        best[i] = options[choice[i]]
        if up[i] >= 0:
            filled[up[i]] = True
            whole_keep[up[i]] += k
            whole_drop[up[i]] += d
            mixed[up[i]] += best[i]
    for i in range(1, n):
        if choice[up[i]]:
            choice[i] = choice[up[i]]
    return np.array(choice) == 1


def main_text(pages: list[Page], model: Model) -> list[str]:
    out, at = [], 0
    while at < len(pages):  # short pages share one pass over the trees
        end, blocks = at + 1, len(pages[at].parent)
        while end < len(pages) and blocks + len(pages[end].parent) <= PART_BLOCKS:
            blocks += len(pages[end].parent)
            end += 1
        chances = model.trees.probability(np.concatenate([model.features(p) for p in pages[at:end]]))
        begin = 0
        for page in pages[at:end]:
            n = len(page.parent)
            own = np.array([bool(t) for t in page.texts])
            kept = decode(np.array(page.parent), own, chances[begin : begin + n])
            begin += n
            out.append(" ".join(page.texts[i] for i in np.flatnonzero(kept & own)))
        at = end
    return out


def extract(df: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, ``text``, ``n_chars``.

    Null and empty pages, and pages without main text, give the empty string.
    Pages may be of any length and nesting; the time is linear in them.  Ties: a
    block as likely kept as dropped is kept.  Null and repeated ids are kept,
    each row by its own page; an empty table gives no rows; other columns are
    ignored.
    """

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = main_text([Page(x.as_py() or "") for x in part.column(2)], model)
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

        return one

    source = df.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("page"))
    kinds = [kind for _, kind in source.dtypes]
    return source.mapInArrow(by_parts(make, 2, PART_PAGES, PART_BYTES), f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
