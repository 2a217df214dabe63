"""Main text of HTML pages: a recurrent labeller decides block by block, with the whole page as context.

A page becomes the sequence of its leaf blocks. Each block is a vector of its tag path (tags, classes, ids and roles
of all elements around it, hashed), of its hashed words, and of a few numbers. A bidirectional LSTM, written and
trained in numpy, reads the sequence both ways and says for each block whether it belongs to the article. It is
trained on made-up pages of two kinds with known labels (elements and names that speak; layouts that say nothing, where
only the text and its surroundings tell), and on a bounded sample of the table's own pages whose semantic elements
(article, nav, ...) label their blocks.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of the table that training may look at (of fewer than 400 blocks), and made-up pages.
SAMPLE_PAGES, MADE_PAGES = 300, 1350
#: Rows of each hashed embedding table, their width, width of the LSTM, training passes.
ROWS, WIDTH, HIDDEN, PASSES, RATE = 4096, 12, 16, 6, 0.01
TABLE_WORDS, BATCH_PAGES = 300_000, 128

# Fixed values of HTML: elements that start a block, that are empty, whose content isn't text, that end an open p.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea iframe object svg math canvas audio video xmp noembed noframes".split())
FOREIGN_TAGS = frozenset(("svg", "math"))
INLINE_BREAKS = frozenset("br td th img hr".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose labels training believes on real pages.
INSIDE, OUTSIDE = {"article", "main"}, {"nav", "footer", "aside", "form", "header", "menu", "head"}

PART = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?|<[!?/][^>]*+>?|[^<]++|<", re.S)
NAMES = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
TOKENS = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    path: str
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order: text with references decoded and white space folded, and the path around it."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # tag, tag with its names
    pieces: list[str] = []
    linked = links = 0
    pos, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, ">".join(n for _, n in stack), linked))
            pieces.clear()
        linked = 0

    while pos < size:
        m = PART.match(page, pos)
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            part = m[0]
            if part[0] != "<" or part == "<":
                pieces.append(part)
                linked += len(part) if links else 0
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in BLOCK_TAGS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    links = sum(t == "a" for t, _ in stack)
                    break
            continue
        attrs = m[3] or m[6] or ""
        if tag in RAW_TAGS:
            if tag not in FOREIGN_TAGS or not attrs.endswith("/"):  # elsewhere HTML ignores a closing slash
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, pos)
                pos = end.end() if end else size
            pieces.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SELF_CLOSING.get(tag, ()) or (stack[k][0] == "p"):
                    del stack[k:]
                    links = sum(t == "a" for t, _ in stack)
                    break
                if stack[k][0] in ("ul", "ol", "table", "div", "article", "section", "body"):
                    break
        elif tag in INLINE_BREAKS:
            pieces.append(" ")
        if tag == "plaintext":  # all that follows is text as it stands
            flush()
            if rest := " ".join(page[pos:].split()):
                out.append(Block(rest, ">".join(n for _, n in stack), 0))
            return out
        if tag not in VOID_TAGS:
            named = ".".join(x.lower() for _, *v in NAMES.findall(attrs) for x in TOKENS.findall(next(filter(None, v), "").lower())) if attrs else ""
            stack.append((tag, f"{tag}.{named}" if named else tag))
            links += tag == "a"
    flush()
    return out


def _row(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % ROWS


class PathRows(dict):
    """Embedding rows of a path: its last tag, every tag, every name on the way, bounded."""

    def __missing__(self, path: str) -> list[int]:
        if len(self) >= 20_000:
            self.clear()
        steps = [s.split(".") for s in path.split(">")] if path else [["none"]]
        names = {f"t:{s[0]}" for s in steps} | {f"n:{n}" for s in steps for n in s[1:]} | {f"l:{steps[-1][0]}", f"d:{steps[-1][0]}<{steps[-2][0] if len(steps) > 1 else ''}"}
        value = self[path] = sorted(_row(n) for n in names)
        return value


class WordRows(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= TABLE_WORDS:
            self.clear()
        value = self[word] = _row("w:" + word.lower().strip(".,;:!?()[]\"'"))
        return value


class Labeller:
    """Embeddings, a forward and a backward LSTM, and a logistic layer over both states."""

    INPUT = 2 * WIDTH + 7

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"paths": 0.3 * r.standard_normal((ROWS, WIDTH)).astype(np.float32), "words": 0.1 * r.standard_normal((ROWS, WIDTH)).astype(np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": w(self.INPUT, 4 * HIDDEN), f"U{d}": w(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, dtype=np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1.0
        self.p |= {"out": w(2 * HIDDEN, 1), "bias": np.zeros(1, dtype=np.float32)}

    def rows(self, pages: list[list[Block]], paths: PathRows, words: WordRows):
        """Flat embedding rows and numbers of all blocks of some pages."""
        flat = [b for page in pages for b in page]
        p = [paths[b.path] for b in flat]
        w = [b.text.split() for b in flat]
        n_p, n_w = np.array([len(x) for x in p]), np.array([len(x) for x in w])
        ids_p = np.array([i for x in p for i in x], dtype=np.int64)
        ids_w = np.fromiter(map(words.__getitem__, (i for x in w for i in x)), dtype=np.int64, count=int(n_w.sum()))
        size = np.array([len(b.text) for b in flat], dtype=np.float32)
        place = np.concatenate([np.arange(len(page)) / max(1, len(page) - 1) for page in pages]) if flat else np.zeros(0)
        ends = np.array([b.text[-1] in ".!?:…\"'”" for b in flat], dtype=np.float32)
        numbers = np.stack([np.log1p(size) / 5, np.minimum(1.0, np.array([b.linked for b in flat]) / np.maximum(size, 1)), ends, place, (place == 0), np.array([b.text.count(",") for b in flat]) / np.maximum(n_w, 1), np.log1p(n_w) / 4], axis=1).astype(np.float32)
        return ids_p, n_p, ids_w, n_w, numbers

    def inputs(self, rows) -> np.ndarray:
        ids_p, n_p, ids_w, n_w, numbers = rows
        mean = lambda e, ids, n: np.add.reduceat(e[ids], np.cumsum(n) - n, axis=0) / n[:, None]
        return np.concatenate([mean(self.p["paths"], ids_p, n_p) * 2, mean(self.p["words"], ids_w, n_w), numbers], axis=1).astype(np.float32)

    def states(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction over padded ``x`` (steps, pages, inputs)."""
        steps, pages, _ = x.shape
        z_all = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((pages, HIDDEN), dtype=np.float32)
        out = np.zeros((steps, pages, HIDDEN), dtype=np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_all[t] + h @ self.p[f"U{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tc = np.tanh(new)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, new, c)
            out[t] = h
        return out

    def padded(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = int(lengths.max(initial=1))
        mask = np.arange(steps)[:, None] < lengths[None, :]
        pad = np.zeros((len(lengths), steps, x.shape[1]), dtype=np.float32)
        pad[mask.T] = x
        return pad.transpose(1, 0, 2), mask

    def logits(self, pages: list[list[Block]], paths: PathRows, words: WordRows) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pages])
        if not lengths.sum():
            return [np.zeros(0)] * len(pages)
        x, mask = self.padded(self.inputs(self.rows(pages, paths, words)), lengths)
        z = np.concatenate([self.states(x, mask, "f"), self.states(x, mask, "b")], axis=2) @ self.p["out"] + self.p["bias"]
        return [z[:n, k, 0] for k, n in enumerate(lengths)]

    def gradients(self, rows, lengths: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        x, mask = self.padded(self.inputs(rows), lengths)
        kept: dict[str, list] = {"f": [], "b": []}
        h = {d: self.states(x, mask, d, kept[d]) for d in "fb"}
        both = np.concatenate([h["f"], h["b"]], axis=2)
        z = (both @ self.p["out"] + self.p["bias"])[:, :, 0]
        y = np.zeros(mask.shape, dtype=np.float32)
        y.T[mask.T] = labels
        dz = np.where(mask, 1 / (1 + np.exp(-z)) - y, 0.0)[:, :, None].astype(np.float32) / max(1, mask.sum())
        g = {"out": np.einsum("tbh,tbo->ho", both, dz), "bias": dz.sum(axis=(0, 1))}
        dboth = dz @ self.p["out"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            dh_all = dboth[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            du = np.zeros_like(self.p[f"U{d}"])
            dh = dc = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
            for t, h0, c0, i, f, o, gg, tc, m in reversed(kept[d]):
                full = dh + dh_all[t]
                live, dcm = np.where(m, full, 0), np.where(m, dc, 0)
                dcell = dcm + live * o * (1 - tc * tc)
                step = np.concatenate([dcell * gg * i * (1 - i), dcell * c0 * f * (1 - f), live * tc * o * (1 - o), dcell * i * (1 - gg * gg)], axis=1)
                dz_all[t] = step
                du += h0.T @ step
                dh = step @ self.p[f"U{d}"].T + np.where(m, 0, full)
                dc = dcell * f + np.where(m, 0, dc)
            g[f"W{d}"], g[f"U{d}"], g[f"c{d}"] = np.einsum("tbi,tbz->iz", x, dz_all), du, dz_all.sum(axis=(0, 1))
            dx += dz_all @ self.p[f"W{d}"].T
        flat = dx.transpose(1, 0, 2)[mask.T]
        ids_p, n_p, ids_w, n_w, _ = rows
        for name, ids, n, part in (("paths", ids_p, n_p, flat[:, :WIDTH] * 2), ("words", ids_w, n_w, flat[:, WIDTH : 2 * WIDTH])):
            g[name] = np.zeros_like(self.p[name])
            np.add.at(g[name], ids, np.repeat(part / n[:, None], n, axis=0))
        return g

    def fit(self, pages: list[list[Block]], labels: list[np.ndarray], seed: int = 2) -> Labeller:
        r, paths, words = np.random.default_rng(seed), PathRows(), WordRows()
        some = [k for k, p in enumerate(pages) if p]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(PASSES):
            order = r.permutation(some)
            for at in range(0, len(order), 24):
                part = order[at : at + 24]
                chosen = [pages[k] for k in part]
                g = self.gradients(self.rows(chosen, paths, words), np.array([len(p) for p in chosen]), np.concatenate([labels[k] for k in part]))
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


# Words and names that made-up pages are built of; plain examples of what such elements are called.
CONTENT_NAMES = "content article post entry story text body main page-content post-body entry-content article-body".split()
ASIDE_NAMES = {
    "ad": "ad ads advert advertisement banner promo sponsor sponsored ad-slot adbox".split(),
    "sidebar": "sidebar side widget related recommended aside trending popular".split(),
    "notice": "notice cookie cookie-banner consent alert newsletter subscribe popup gdpr".split(),
    "comments": "comments comment comment-list discussion replies reader-comments disqus".split(),
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toolbar share social pagination tags".split(),
}
PLAIN_WORDS = "the of and to in a is that for on was with as by it from at an be this have are or not but had which one all were there been their has would what will when who more no if out so up said about into than them can only other new some time".split()
SITE_WORDS = "home about contact login register subscribe share cookies accept privacy terms policy rights reserved copyright advertisement sponsored reply comment newsletter search menu next previous read more related follow us".split()


def made_page(r: random.Random) -> tuple[str, list[int]]:
    """A made-up page and a label for each of its blocks (1: article)."""
    syllables = "an er ti on re th de la en ou st qu ch mo ve ar so li".split()
    word = lambda: r.choice(PLAIN_WORDS) if r.random() < 0.5 else "".join(r.choices(syllables, k=r.randrange(1, 5)))
    words = lambda a, b: " ".join(word() for _ in range(r.randrange(a, b)))
    sentence = lambda a=3, b=25: words(a, b).capitalize() + r.choice([".", ".", ".", "!", "?", ""])
    site = lambda a=1, b=5: " ".join(r.choices(SITE_WORDS if r.random() < 0.6 else PLAIN_WORDS, k=r.randrange(a, b)))
    parts: list[tuple[str, int]] = []
    add = lambda text, label: parts.append((text, label))

    def names(kind: str) -> str:
        return f' {r.choice(["class", "id"])}="{r.choice(ASIDE_NAMES[kind])}{r.choice(["", " box", " c1", "-1"])}"'

    def outside(kind: str) -> None:
        tag = r.choice(["div", "section", "aside"])
        body = [f"<p>{sentence()}</p>" if r.random() < 0.5 else f"<{(t := r.choice(['div', 'li', 'p']))}>{site() if r.random() < 0.3 else sentence(2, 20)}</{t}>" for _ in range(r.randrange(1, 4))]
        if r.random() < 0.4:
            add(f"<{tag}{names(kind)}>{sentence(2, 20)}</{tag}>", 0)
            return
        body[0], body[-1] = f"<{tag}{names(kind)}>" + body[0], body[-1] + f"</{tag}>"
        for b in body:
            add(b, 0)

    def navigation() -> None:
        n = r.randrange(2, 8)
        items = [f'<li><a href="/{word()}">{word() if r.random() < 0.6 else site(1, 3)}</a></li>' for _ in range(n)]
        tag, name = (r.choice(["nav", "header"]), "") if r.random() < 0.6 else ("div", names("menu"))
        items[0], items[-1] = f"<{tag}{name}><ul>" + items[0], items[-1] + f"</ul></{tag}>"
        for i in items:
            add(i, 0)

    def article() -> None:
        tag, name = [("article", ""), ("main", ""), ("article", f' class="{r.choice(CONTENT_NAMES)}"'), ("div", f' {r.choice(["class", "id"])}="{r.choice(CONTENT_NAMES)}"')][r.choices(range(4), [0.5, 0.15, 0.1, 0.25])[0]]
        n = r.randrange(1, 14)
        body = []
        for k in range(n):
            kind = r.random()
            text = " ".join(sentence() for _ in range(r.randrange(1, 5)))
            text = f"<b>{text}<br>" if kind < 0.08 else f'{text} <a href="#">{word()}</a> {sentence()}' if kind < 0.2 else text
            t = "p" if kind < 0.75 else r.choice(["li", "h2", "h3", "blockquote", "div", "pre", "td"])
            body.append(f"<{t}>{sentence(1, 12) if t in ('h2', 'h3', 'li', 'td') else text}</{t}>")
        if r.random() < 0.8:
            body.insert(0, f"<h1>{sentence(1, 14)}</h1>")
        begin = len(parts)
        for b in body:
            add(b, 1)
            if r.random() < 0.04:  # something else between its paragraphs
                outside(r.choice(["ad", "notice", "menu", "sidebar"]))
        if r.random() < 0.12:
            outside(r.choice(["comments", "menu", "ad"]))
        parts[begin] = (f"<{tag}{name}>" + parts[begin][0], parts[begin][1])
        parts[-1] = (parts[-1][0] + f"</{tag}>", parts[-1][1])

    add(f"<html><head><title>{sentence(1, 12)}</title><script>var x=1;</script></head><body>", 0)
    if r.random() < 0.85:
        navigation()
    for kind in r.sample(["ad", "notice", "menu", "form"], 4):
        if r.random() < 0.25:
            outside(kind) if kind != "form" else add(f'<form class="search"><label>{site()}</label><input type=text></form>', 0)
    if r.random() < 0.3:
        outside("ad")
    article()
    for kind in r.sample(["ad", "sidebar", "comments", "notice", "menu"], 5):
        if r.random() < 0.25:
            outside(kind)
    if r.random() < 0.85:
        add(f"<footer>&copy; {word()}.example.org &middot; {sentence(1, 16)}</footer>" if r.random() < 0.7 else f'<div class="footer">{site(2, 8)}</div>', 0)
    return "".join(p for p, _ in parts) + "</body></html>", [y for _, y in parts]


LAYOUT_NAMES = "wrap outer inner box top head left right col1 col2 col3 row cell side foot bottom mid area pane part block sec".split()


def made_layout(r: random.Random) -> tuple[str, list[int]]:
    """A made-up page whose elements and names say little: tables or bare containers, names without sense.

    What is article shows in whole sentences that stand together, what isn't in short linked lines around them.
    """
    syllables = "ba ro ti len mar co su ven dal pi gre to ny ska fel or um".split()
    word = lambda: r.choice(PLAIN_WORDS) if r.random() < 0.55 else "".join(r.choices(syllables, k=r.randrange(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(r.randrange(a, b))).capitalize()
    prose = lambda: " ".join(f"{line(7, 24)}{',' if r.random() < 0.3 else ''} {line(2, 8).lower()}." for _ in range(r.randrange(1, 4)))
    site = lambda: r.choice(SITE_WORDS).capitalize() if r.random() < 0.35 else line(1, 4)
    name = lambda: r.choice(["", f' class={r.choice(LAYOUT_NAMES)}', f' id="{r.choice(LAYOUT_NAMES)}{r.randrange(9)}"', f' class="{"".join(r.choices("abcdefqxyz", k=r.randrange(1, 5)))}{r.randrange(100)}"'])
    out: list[tuple[str, int]] = []
    table = r.random() < 0.3
    cell = lambda: ("<tr><td valign=top>", "</td></tr>") if table else ((t := r.choice(["div", "section", "center"])) and f"<{t}{name()}>", f"</{t}>")

    def part(rows: list[tuple[str, int]]) -> None:
        a, b = cell()
        rows = [(a + rows[0][0], rows[0][1]), *rows[1:]]
        rows[-1] = (rows[-1][0] + b, rows[-1][1])
        out.extend(rows)

    def links() -> list[tuple[str, int]]:
        some = [f"<a href=/{r.randrange(99)}>{site()}</a>" for _ in range(r.randrange(2, 9))]
        kind = r.random()
        if kind < 0.4:
            return [(f"<ul><li>{some[0]}</li>", 0), *[(f"<li>{a}</li>", 0) for a in some[1:-1]], (f"<li>{some[-1]}</li></ul>", 0)]
        if kind < 0.6:  # each on its own, as teasers are
            return [(f"<div>{a}</div>", 0) for a in some]
        return [(r.choice(["<br>", " | ", " ", " &middot; "]).join(some), 0)]

    short = lambda: [(r.choice([" | ", " - ", " &middot; "]).join(site() for _ in range(r.randrange(1, 5))), 0)]
    legal = lambda: [(r.choice([f"Copyright {r.randrange(1995, 2030)} {line(1, 4)}. All rights reserved.", f"&copy; {line(1, 4)}", f"This page was last changed on {r.randrange(1, 29)} {line(1, 2)}. {line(2, 7)}.", f"{line(2, 4)} by {line(1, 3)}. {line(2, 6)}."]), 0)]
    banner = lambda: [(f"<p>We use cookies {line(3, 9).lower()}.</p>", 0), (f"<button>{site()}</button>", 0)]
    remarks = lambda: [(f"<{(t := r.choice(['span', 'h4', 'div']))}>{r.randrange(40)} {r.choice(['comments', 'replies', 'reactions'])}</{t}>", 0), *[(f"<div>{line(2, 14)}</div>", 0) for _ in range(r.randrange(4))]]
    card = lambda: [(f"<h{r.choice('34')}>{line(1, 3)}</h3>", 0), *[(f"<p>{line(2, 7)}</p>", 0) for _ in range(r.randrange(1, 4))]]
    facts = lambda: [(f"<dl><dt>{line(1, 3)}</dt>", 0), (f"<dd>{line(1, 4)}</dd></dl>", 0)] if not table else [(f"<span>{line(1, 3)}</span>", 0)]
    sender = lambda: [(f"<address>{line(2, 5)}, {r.randrange(1990, 2030)}</address>", 0)]
    offer = lambda: [(f"<div{name()}>{r.choice(['Advertisement', 'Sponsored', 'Promotion'])}</div>", 0)] * r.randrange(2) + [(f"<div{name()}>{line(1, 2)}: {line(3, 12).lower()}{r.choice(['. Order now!', '! Save today.', '. Try it free.', ' - from 9 a month'])}</div>", 0)]

    def article() -> list[tuple[str, int]]:
        tag = r.choice(["p", "p", "div", "blockquote"])
        inner = name() if tag == "div" else ""
        rows = [(f"<div><b>{line(2, 8)}</b></div>" if r.random() < 0.2 else f"<div{name()}>{line(3, 9)}</div>" if r.random() < 0.15 else f"<h{r.choice('12')}>{line(2, 8)}</h2>", 1)]
        for k in range(r.randrange(2, 9)):
            kind = r.random()
            if k and r.random() < 0.06:
                rows += offer()
            if kind < 0.7:
                rows.append((f"<{tag}{inner}>{prose()}</{tag}>", 1))
            elif kind < 0.82:
                rows += [(f"<ul><li>{prose()}</li>", 1), (f"<li>{prose()}</li></ul>", 1)]
            elif kind < 0.92:
                rows += [(f"<dl><dt>{line(1, 3)}</dt>", 1), (f"<dd>{prose()}</dd></dl>", 1)]
            else:
                rows.append((f"<h3>{line(1, 5)}</h3>", 1))
        return rows

    for make, chance in ((banner, 0.2), (links, 0.6), (short, 0.4), (links, 0.5)):
        if r.random() < chance:
            part(make())
    part(article())
    for make, chance in ((remarks, 0.3), (card, 0.25), (facts, 0.15), (links, 0.4), (offer, 0.1), (short, 0.2), (sender, 0.1), (legal, 0.6)):
        if r.random() < chance:
            part(make())
    frame = ("<table>", "</table>") if table else ("<div>", "</div>")
    return f"<html><head><title>{line(1, 6)}</title></head><body>{frame[0]}" + "".join(p for p, _ in out) + f"{frame[1]}</body></html>", [0, *[y for _, y in out]]


def told_by_elements(found: list[Block]) -> np.ndarray | None:
    """Labels by the semantic elements around each block; None if the page has none that say what is the article."""
    tags = [{s.partition(".")[0] for s in b.path.split(">")} for b in found]
    if not any(INSIDE & t for t in tags):
        return None
    odd = {n for names in ASIDE_NAMES.values() for n in names}
    named = [bool(odd & {n for s in b.path.split(">") for n in s.split(".")[1:]}) for b in found]
    return np.array([int(bool(INSIDE & t) and not OUTSIDE & t and not x) for t, x in zip(tags, named, strict=True)])


def labeller(pages: DataFrame | None, html_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE_PAGES, made: int = MADE_PAGES, seed: int = 7, most_blocks: int = 400) -> Labeller:
    """Train on ``made`` made-up pages and at most ``sample`` pages of the table, picked by a hash of their id.

    Of those, pages of ``most_blocks`` blocks or more are left out of the training (never of the labelling).
    """
    r = random.Random(seed)
    found, labels = [], []
    for k in range(made):
        page, y = made_layout(r) if k % 3 == 0 else made_page(r)
        got = blocks(page)
        if len(got) == len(y):
            found.append(got)
            labels.append(np.array(y))
    if pages is not None:
        ids = pages.select(F.col(id_col).alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
        rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("h")).join(F.broadcast(ids), "id").filter("h is not null").groupBy("id").agg(F.min("h").alias("h")).orderBy("id")
        for (page,) in rows.select("h").toLocalIterator():
            got = blocks(page)
            y = told_by_elements(got)
            if y is not None and len(got) < most_blocks:
                found.append(got)
                labels.append(y)
    return Labeller().fit(found, labels)


def main_text(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars, n_blocks, n_kept`` for every row, from the whole page.

    Null, empty and text-free html give an empty text. Kept blocks come in page order, joined by an empty line. Rows are
    labelled page by page, so repeated rows repeat; other columns are ignored. Needs no shuffle.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model.p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, paths, words = Labeller(), PathRows(), WordRows()
        net.p = sent.value
        for pdf in batches:
            for at in range(0, len(pdf), BATCH_PAGES):
                part = pdf.iloc[at : at + BATCH_PAGES]
                found = [blocks(h or "") for h in part["html"]]
                order = sorted(range(len(found)), key=lambda k: len(found[k]))
                kept: list[list[str]] = [[] for _ in found]
                for few in (order[k : k + 32] for k in range(0, len(order), 32)):
                    for k, z in zip(few, net.logits([found[k] for k in few], paths, words), strict=True):
                        kept[k] = [b.text for b, yes in zip(found[k], z > 0, strict=True) if yes]
                texts = ["\n\n".join(k) for k in kept]
                yield pd.DataFrame({"id": part["id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": [len(f) for f in found], "n_kept": [len(k) for k in kept]})

    kinds = {n: pages.schema[c].dataType.simpleString() for n, c in (("id", id_col), ("url", url_col))}
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long, n_blocks long, n_kept long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
