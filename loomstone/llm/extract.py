"""Main-text extraction from HTML by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text between tags that start or end a block. A block's features are the tags, classes
and ids of its ancestors and properties of its text. The field labels the sequence of blocks as text or not, with a weight for each
feature and each pair of neighbouring labels; it is trained on labelled pages by gradient ascent of the
penalised likelihood and decoded by Viterbi. The pages it is trained on are made by ``labelled_pages``: layouts with menus,
headers, sidebars, notices, adverts, forms, comments and footers around articles, whose blocks are
labelled as they are made. ``train`` takes any other labelled pages.

Inside a block character references are decoded, white space becomes one space and ends are trimmed; ``br`` is white
space. Scripts, styles and the like are never text. Kept blocks are joined by two line feeds.

Edge cases: null and empty html give an empty text; tags left open, crossed or unknown are read as browsers
would roughly; elements nested deeper than 512 count as lying in the 512th; very long pages are read whole, in time in proportion to
their length; a page without tags is one block; repeated rows give equal results, null ids and urls travel along, other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import html as htmllib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, slices, table

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe title".split())
#: Elements with no text of the page in them, nested as others are and ended with their parent at the latest.
HIDDEN = frozenset("noscript template svg object canvas select option optgroup datalist annotation annotation-xml".split())
#: Those of them that the start of a block ends, as in browsers.
LEFT = frozenset("svg select option optgroup datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"button", "label"}
NOTICE = re.compile(r"cookie|subscri|newsletter|advert|sponsor|sign in|log in|copyright|all rights|©|share|follow us|read more|privacy|comment|reply", re.I)


#: Elements nested deeper than this are laid into the last one, as browsers do; their text stays.
DEEPEST = 512


class Node:
    """An open element with what its path says about a block in it, made from the parent's in constant time for most elements.

    ``key`` numbers the chain of block elements (tag and words); ``top`` is the last article or main in it, ``inner`` the last two
    block tags below that, ``named`` whether one of those has words; ``path`` is the set of features of the whole path.
    """

    __slots__ = ("depth", "inner", "key", "last", "named", "path", "top")

    def __init__(self, parent: Node | None, tag: str, words: str, chains: dict):
        if parent is None:
            self.depth, self.key, self.last, self.top, self.inner, self.named, self.path = 0, 0, "none", "", (), False, frozenset()
            return
        self.depth = parent.depth + 1
        new = {f"word:{w}" for w in words.split()}
        self.key, self.last, self.top, self.inner, self.named = parent.key, parent.last, parent.top, parent.inner, parent.named
        if tag in BLOCK:
            new.add(f"in:{tag}")
            self.key = chains.setdefault((parent.key, tag, words), len(chains) + 1)
            self.last = tag
            if tag in ("article", "main"):
                self.top, self.inner, self.named = tag, (), False
            else:
                self.inner, self.named = (*parent.inner[-1:], tag), parent.named or bool(words)
        self.path = parent.path if new <= parent.path else parent.path | new


class Open:
    """The stack of open elements, with the places of each tag, so that no question walks the stack."""

    def __init__(self):
        self.chains: dict = {}
        self.root = Node(None, "", "", self.chains)
        self.tags: list[str] = []
        self.nodes: list[Node] = [self.root]
        self.at: dict[str, list[int]] = {}
        self.hidden: list[int] = []
        self.blocks: list[int] = []

    def push(self, tag: str, words: str) -> None:
        i = len(self.tags)
        self.tags.append(tag)
        above = self.nodes[-1]
        self.nodes.append(above if above.depth >= DEEPEST else Node(above, tag, words, self.chains))
        self.at.setdefault(tag, []).append(i)
        if tag in HIDDEN:
            self.hidden.append(i)
        if tag in BLOCK:
            self.blocks.append(i)

    def cut(self, size: int) -> None:
        while len(self.tags) > size:
            tag = self.tags.pop()
            self.nodes.pop()
            self.at[tag].pop()
            if tag in HIDDEN:
                self.hidden.pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        """The place of the innermost of the tags, -1 if none is open."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=-1)


ENDS = ((("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (("td", "th"), ("table", "tr")), (("tr",), ("table",)))


def blocks(page: str | None) -> list[tuple[str, Node, int]]:
    """(text, innermost element, characters in links) of each leaf block. Time is in proportion to the page, whatever is left open in it."""
    out: list = []
    stack = Open()
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, stack.nodes[-1], linked))
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not stack.hidden:
            parts.append(text)
            if stack.at.get("a"):
                linked += len(text)

    at, page = 0, page or ""
    pattern, final = TAG, page.rfind(">")
    endings: dict[str, re.Pattern] = {}
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        say(page[at:start])
        sign = page[start + 1 : start + 2]
        if sign in ("!", "?") and sign:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", start)
                at = len(page) if end < 0 else end + 1
            continue
        m = pattern.match(page, start) if start < final else None
        if m is None and start < final and pattern is TAG and (page[start + 1 : start + 2].isalpha() or sign == "/"):
            if (m := BARE.match(page, start)) is not None:
                pattern = BARE  # a quote pairs up to the page's end: from here on quotes are not looked at
        if m is None:
            say("<")
            at = start + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            i = stack.last(tag)
            if stack.hidden and stack.hidden[0] < i:
                stack.cut(i)
                continue
            if tag in BLOCK:
                close()
            if i >= 0 and (tag in BLOCK or tag in HIDDEN or not stack.blocks or stack.blocks[-1] < i):
                stack.cut(i)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if stack.hidden and tag in BLOCK and not stack.at.get("foreignobject") and stack.tags[stack.hidden[0]] in LEFT:
            stack.cut(stack.hidden[0])
        if tag in ("option", "optgroup"):
            while stack.tags and stack.tags[-1] in ("option", tag):
                stack.cut(len(stack.tags) - 1)
        if tag in BLOCK and not stack.hidden:
            close()
            if tag in CLOSES_P and (i := stack.last("p")) >= 0 and stack.last("table", "div", "button") < i:
                stack.cut(i)
            for same, scope in ENDS:
                if tag in same and (i := stack.last(*same)) > stack.last(*scope):
                    stack.cut(i)
        attributes = m[3]
        shut = attributes.endswith("/")
        if tag in RAW:
            if not shut:
                ending = endings.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*+>", re.I)).search(page, at)
                at = ending.end() if ending else len(page)
            continue
        if tag in VOID or shut and tag not in BLOCK:
            continue
        words = " ".join(w.lower() for a in ATTRIBUTE.finditer(attributes) for w in ([a[1]] if a[1].lower() in ("hidden",) else PIECE.findall(a[2] or a[3] or a[4] or ""))) if attributes else ""
        stack.push(tag, words)
    close()
    return out


def features(found: list[tuple[str, Node, int]]) -> list[list]:
    """A list of features for each block; one of its entries is the frozenset of its path's."""
    rows, n = [], len(found)
    mass, total = {}, sum(len(b[0]) for b in found) or 1
    for text, node, _ in found:
        mass[node.key] = mass.get(node.key, 0) + len(text)
    most = max(mass.values(), default=0)
    for k, (text, node, linked) in enumerate(found):
        words = text.count(" ") + 1
        f = ["bias", f"len{min(6, int(math.log2(words + 1)))}", f"link{min(4, int(4 * linked / len(text)))}", f"at{int(4 * k / n)}", "tag:" + node.last, node.path]
        if text[-1] in ".!?…:\"'”»":
            f.append("stop")
        if text.count(",") + text.count(".") > 2:
            f.append("pointed")
        if NOTICE.search(text):
            f.append("notice" if words < 25 else "notice-long")
        if not node.top:
            f.append("outside")
        elif not node.named:
            f.append("plain:" + (">".join(node.inner) if node.inner else node.top))
        share = mass[node.key]
        f.append(f"share{min(3, int(4 * share / total))}")
        if share == most:
            f.append("most-in" if node.top else "most")
        rows.append(f)
    return rows


def spelled_out(row: list) -> list[str]:
    return [g for f in row for g in (f if isinstance(f, frozenset) else (f,))]


class Field:
    """Two labels; ``weights`` of label 1 by feature, ``step[a, b]`` of going from a to b, ``start`` of beginning with 1."""

    def __init__(self, weights: dict[str, float], step: np.ndarray, start: float):
        self.weights, self.step, self.start = weights, step, start

    def decode(self, rows: list[list[str]]) -> list[int]:
        get, s, back = self.weights.get, self.step.tolist(), []
        if not rows:
            return []
        paths: dict[frozenset, float] = {}
        e = []
        for r in rows:
            x = 0.0
            for f in r:
                if isinstance(f, frozenset):
                    if (w := paths.get(f)) is None:
                        w = paths[f] = sum(get(g, 0.0) for g in f)
                    x += w
                else:
                    x += get(f, 0.0)
            e.append(x)
        v0, v1 = 0.0, self.start + e[0]
        for x in e[1:]:
            a0, b0, a1, b1 = v0 + s[0][0], v1 + s[1][0], v0 + s[0][1], v1 + s[1][1]
            back.append((int(b0 > a0), int(b1 > a1)))
            v0, v1 = max(a0, b0), max(a1, b1) + x
        out = [int(v1 > v0)]
        for b in reversed(back):
            out.append(b[out[-1]])
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, rate: float = 0.15, ridge: float = 0.5, min_count: int = 3) -> Field:
    """Maximises the penalised likelihood of labelled sequences of feature lists, by Adam on the full gradient."""
    pages = [([spelled_out(r) for r in rows], labels) for rows, labels in pages]
    counts: dict[str, int] = {}
    for rows, _ in pages:
        for r in rows:
            for f in r:
                counts[f] = counts.get(f, 0) + 1
    names = sorted(f for f, c in counts.items() if c >= min_count)
    at = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max(len(r) for r, _ in pages)
    x = np.zeros((n, longest, len(names)), np.float32)
    y, mask = np.zeros((n, longest)), np.zeros((n, longest), bool)
    for p, (rows, labels) in enumerate(pages):
        for k, r in enumerate(rows):
            x[p, k, [at[f] for f in r if f in at]] = 1
        y[p, : len(rows)], mask[p, : len(rows)] = labels, True
    flat = x.reshape(-1, len(names))
    both = mask[:, 1:] & mask[:, :-1]
    seen = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], np.float64)
    theta = np.zeros(len(names) + 5)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)

    def lse(a, axis):
        top = a.max(axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)

    for t in range(1, rounds + 1):
        step, start = theta[-5:-1].reshape(2, 2), theta[-1]
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = (flat @ theta[:-5].astype(np.float32)).reshape(n, longest)
        e[:, 0, 1] += start
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for k in range(1, longest):
            alpha[:, k] = np.where(mask[:, k, None], lse(alpha[:, k - 1, :, None] + step, 1) + e[:, k], alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            beta[:, k] = np.where(mask[:, k + 1, None], lse(step + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2), 0)
        z = lse(alpha[:, -1], 1)
        p1 = np.where(mask, np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]), 0)
        pair = np.exp(alpha[:, :-1, :, None] + step + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        g = np.concatenate([flat.T @ (y * mask - p1).ravel(), (seen - pair.sum((0, 1))).ravel(), [(y[:, 0] - p1[:, 0]).sum()]]) - ridge * theta
        g /= n
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta += rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Field({f: float(w) for f, w in zip(names, theta[:-5], strict=True)}, theta[-5:-1].reshape(2, 2), float(theta[-1]))


# What page authors customarily call the parts of a page.
AROUND = {
    "menu": ("nav navigation menu navbar breadcrumb breadcrumbs toolbar tabs topnav sitenav links toc", "nav ul div header"),
    "header": ("header masthead banner top topbar site branding logo tagline", "header div section"),
    "side": ("sidebar side aside widget related recommended popular trending rail recent tags archive more promo", "aside div section"),
    "notice": ("cookie consent notice gdpr alert popup modal overlay newsletter subscribe signup paywall announcement", "div section aside dialog p"),
    "ad": ("ad ads advert advertisement sponsor sponsored promo banner promoted dfp adsense", "div aside section"),
    "form": ("form search login subscribe contact signup feedback poll", "form div"),
    "social": ("share social sharing buttons follow tools byline meta author tags pagination pager", "div ul p"),
    "comments": ("comments comment discussion disqus replies reply responses thread respond", "section div ol ul"),
    "footer": ("footer foot bottom copyright legal colophon credits disclaimer", "footer div section"),
}
MAIN = "content article post entry story main text body single page wrapper container inner copy"


def labelled_pages(n: int = 600, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(html, main blocks) of made pages in many layouts."""
    rng = random.Random(seed)
    pick, chance = rng.choice, rng.random

    def word() -> str:
        return "".join(pick("bcdfglmnprst") + pick("aeiou") for _ in range(rng.randint(1, 4)))

    mark = [""]

    def sentence(lo: int, hi: int) -> str:
        ws = [word() + ("," if chance() < 0.08 else "") for _ in range(rng.randint(lo, hi))]
        text = " ".join(ws).capitalize().rstrip(",") + pick("....?!")
        return text.replace(" ", mark[0] + " ") + mark[0] if mark[0] else text

    def prose(lo: int = 1, hi: int = 7) -> str:
        return " ".join(sentence(3, 22) for _ in range(rng.randint(lo, hi)))

    def attrs(names: str, bare: float = 0.4) -> str:
        if chance() < bare:
            return ""
        words = rng.sample(names.split(), min(rng.randint(1, 2), len(names.split())))
        sep = pick("-_ ")
        return f' {pick(("class", "class", "id"))}="{sep.join(words)}{pick(("", "", "-1", " wide", " box"))}"'

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def around(kind: str) -> str:
        names, tags = AROUND[kind]
        tag = pick(tags.split())
        bare = 0.5 if tag in ("nav", "aside", "header", "footer", "form", "dialog") else 0.0
        a = attrs(names, bare)
        if kind == "menu":
            items = [link(" ".join(word() for _ in range(rng.randint(1, 3)))) for _ in range(rng.randint(2, 9))]
            inner = "".join(f"<li>{i}</li>" for i in items)
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>" if chance() < 0.7 else " | ".join(items)
        elif kind == "header":
            inner = pick((f"<div>{sentence(1, 5)}</div>", f"<p>{sentence(2, 9)}</p>", f"<h1>{word()}</h1><p>{sentence(2, 8)}</p>", link(word()), f"<span>{word()}</span>"))
        elif kind == "side":
            inner = f"<h{(h := rng.randint(2, 4))}>{pick(('Related', 'Popular', 'Recent posts', word()))}</h{h}>" * (chance() < 0.7)
            inner += "".join(pick((f"<p>{prose(1, 3)}</p>", f"<li>{link(sentence(2, 8))}</li>", f"<div>{link(word())} {sentence(3, 15)}</div>")) for _ in range(rng.randint(1, 5)))
        elif kind == "notice":
            inner = pick(("We use cookies. ", "Subscribe to our newsletter. ", "", "Please sign in. ")) + prose(1, 3)
            inner = pick((inner, f"<p>{inner}</p>", f"<p>{inner}</p><button>{pick(('OK', 'Accept', word()))}</button>"))
            tag = tag if tag != "p" or "<p>" not in inner else "div"
        elif kind == "ad":
            inner = pick((prose(1, 2), f"<p>{prose(1, 3)}</p>", link(sentence(2, 9)), f"<span>Advertisement</span><p>{sentence(4, 12)}</p>"))
        elif kind == "form":
            inner = f"<label>{word()}</label><input name=q><p>{sentence(2, 12)}</p><button>{pick(('Search', 'Send', word()))}</button>"
            tag = "form" if chance() < 0.8 else tag
        elif kind == "social":
            inner = " ".join(link(pick(("Share", "Tweet", "Print", word()))) for _ in range(rng.randint(1, 4))) if chance() < 0.6 else sentence(2, 6)
            inner = f"<li>{inner}</li>" if tag == "ul" else inner
        elif kind == "comments":
            one = lambda: pick((f"<p>{prose(1, 4)}</p>", f"<b>{word()}</b> {prose(1, 3)}", f"<div>{word()}</div><p>{prose(1, 4)}</p>"))
            each = "li" if tag in ("ol", "ul") else pick(("div", "article", "div"))
            inner = f"<h3>{pick(('Comments', word()))}</h3>" * (tag not in ("ol", "ul") and chance() < 0.6)
            inner += "".join(f"<{each}{attrs('comment reply response', 0.3)}>{one()}</{each}>" for _ in range(rng.randint(1, 6)))
        else:
            inner = pick((f"&copy; {rng.randint(1999, 2030)} {word()}", f"&copy; {word()}.example &middot; {sentence(3, 14)}", f"<p>{prose(1, 2)}</p>", f"<p>Copyright {word()}. All rights reserved.</p>", "<ul>" + "".join(f"<li>{link(word())}</li>" for _ in range(4)) + "</ul>"))
        return f"<{tag}{a}>{inner}</{tag}>"

    out = []
    for _ in range(n):
        main: list[str] = []
        mark[0] = pick(("", "", "", "", "", "#", "***", "!!", "|"))
        def keep(tag: str, text: str, close: bool = True, main=main) -> str:
            main.append(" ".join(text.split()))
            inline = text
            if chance() < 0.15 and " " in text:
                a, b = text.split(" ", 1)
                inline = f"{a} {pick(('<b>', '<em>', '<a href=x>', '<span>'))}{b}" + "" if chance() < 0.1 else f"<{(t := pick(('b', 'em', 'strong', 'span')))}>{a}</{t}> {b}"
            if chance() < 0.1:
                inline = inline.replace(" ", "<br>", 1)
            return f"<{tag}{attrs('text para lead intro', 0.9)}>{inline}" + (f"</{tag}>" if close else "")

        body = []
        if chance() < 0.85:
            body.append(keep(pick(("h1", "h1", "h2")), sentence(2, 14)))
        if chance() < 0.3:
            body.append(around("social"))
        loose = chance() < 0.2
        for _ in range(rng.randint(1, pick((2, 12)))):
            r = chance()
            if r < 0.72:
                body.append(keep("p", prose(), close=not loose))
            elif r < 0.79:
                body.append(keep(pick(("h2", "h3")), sentence(1, 7)))
            elif r < 0.84:
                body.append("<ul>" + "".join(keep("li", sentence(2, 14)) for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.88:
                body.append(keep("blockquote", prose(1, 3)))
            elif r < 0.91:
                body.append(keep("div", prose(1, 5)))
            elif r < 0.94:
                body.append("<table><tr>" + "".join(keep("td", sentence(1, 6)) for _ in range(rng.randint(2, 4))) + "</tr></table>")
            else:
                body.append(around(pick(("ad", "side", "notice", "social", "form", "ad"))))
        if chance() < 0.25:
            body.append(around(pick(("social", "comments", "ad", "side"))))
        frame = pick(("article", "article", "main", "div", "div", "section", "main article", "div article"))
        inner = "".join(body)
        for tag in reversed(frame.split()):
            inner = f"<{tag}{attrs(MAIN, 0.0 if tag in ('div', 'section') else 0.5)}>{inner}</{tag}>"
        top = [around(k) for k in ("header", "menu", "notice", "ad", "form", "side") if chance() < 0.45]
        end = [around(k) for k in ("side", "comments", "ad", "form", "social", "menu", "notice") if chance() < 0.35]
        rng.shuffle(top)
        end += [around("footer")] * (chance() < 0.9)
        middle = "".join([*top, "<script>var a = '<p>';</script>" * (chance() < 0.3), inner, *end])
        if chance() < 0.3:
            middle = f"<div{attrs('wrapper container page site outer', 0.2)}>{middle}</div>"
        out.append((f"<html><head><title>{word()}</title></head><body>{middle}</body></html>", main))
    return out


@lru_cache(maxsize=4)
def train_on_made_pages(n: int = 600, seed: int = 11) -> Field:
    data = []
    for page, main in labelled_pages(n, seed):
        found, left = blocks(page), list(main)
        labels = []
        for text, _, _ in found:
            hit = text in left
            if hit:
                left.remove(text)
            labels.append(int(hit))
        if found:
            data.append((features(found), labels))
    return train(data)


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page)
    return "\n\n".join(b[0] for b, keep in zip(found, field.decode(features(found)), strict=True) if keep)


def extract_main_text(pages: DataFrame, field: Field) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""
    shipped = pages.sparkSession.sparkContext.broadcast(field)  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shipped.value
        for batch in slices(batches, "html", 1 << 20):
            texts = [main_text(p, f) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"), train_on_made_pages())
