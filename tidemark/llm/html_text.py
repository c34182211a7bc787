"""HTML extraction: a recurrent block labeller.

A page is read as the sequence of its leaf blocks. Each block is a vector of its hashed tag path (names, classes, ids), of
its hashed words and of a few measures; a bidirectional LSTM, in numpy, reads the sequence forwards and backwards, so that
each block is labelled in view of the whole page. The model is trained here, on pages that a generator makes up with
their labels: many layouts of menus, headers, footers, sidebars, notices, adverts, forms, comments and articles.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a tag holds up to its >, quoted or not. Possessive: no place is tried twice. Quotes permute the three states (outside, in
#: one kind, in the other), so scans from several tags differ in their state wherever they pass, and at most three pass a place.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Elements whose content is no markup and no text of a page, whose text is not shown or is a form's, that leave
# no trace in the path, that end no block, that have no end tag, and that a new one closes.
RAW = {"script", "style", "title", "textarea", "iframe"}
SILENT = {"template", "select"}
CLEAR = set("svg g defs symbol use path rect circle ellipse line polyline polygon text tspan textpath marker pattern clippath mask lineargradient radialgradient stop foreignobject desc metadata noscript object canvas audio video".split())
MATH = "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msup msub msubsup mover munder munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation annotation-xml"
MATHS = set(MATH.split())
INLINE = set(f"{MATH} a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}}
CHOICES = {"option", "optgroup", "hr", *INLINE}
FENCES = {"ul", "ol", "table", "dl", "article", "section", "div", "main", "body", "td", "blockquote"}
# An inline end tag looks through these for its element.
OPEN = CLEAR | {"select", "option", "optgroup"}


class Frame:
    """An element that is not inline, and the inline ones that stand open right in it, in order; closed ones are None."""

    __slots__ = ("name", "path", "silent", "fence", "inline")

    def __init__(self, name: str, path: tuple, silent: bool, fence: int):
        self.name, self.path, self.silent, self.fence = name, path, silent, fence
        self.inline: list[str | None] = []


def blocks_of(page: str) -> list[tuple[str, tuple, float]]:
    """(text, tag path with classes and ids, share of the text in links) of each leaf block that has text, in order.

    A path is (path of the parent, tag with its marks), the root's is (): blocks share their ancestors, so that time and
    memory grow with the page, however deep it is.

    A head is not an element of its own here: what may stand in it has no text of the page, and all else is the body's,
    whether or not its tags are there. A select ends where anything but its choices begins. A < without a > after it is text.

    Linear in the page, whatever its shape: no open element is moved or looked through. `depths` knows where each name is
    open, `inlines` the same of inline ones with their place in their frame, and a frame the innermost one at or below
    it that an inline end tag doesn't look through.
    """
    out: list = []
    frames = [Frame("", (), False, 0)]
    depths: defaultdict[str, list[int]] = defaultdict(list)
    inlines: defaultdict[str, list[tuple[int, int]]] = defaultdict(list)
    parts: list[str] = []
    linked = at = 0
    last = page.rfind(">")

    def push(name: str, mark: str = "") -> None:
        top = frames[-1]
        depths[name].append(len(frames))
        frames.append(Frame(name, (top.path, mark) if mark else top.path, top.silent or name in SILENT, top.fence if name in OPEN else len(frames)))

    def bare(frame: Frame, keep: int = 0) -> None:
        """Closes the frame's inline elements, but for the first ones."""
        for name in reversed(frame.inline[keep:]):
            if name:
                inlines[name].pop()
        del frame.inline[keep:]

    def drop(depth: int) -> None:
        """Closes the frame at that depth and all within it."""
        while len(frames) > depth:
            gone = frames.pop()
            bare(gone)
            depths[gone.name].pop()

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, frames[-1].path, min(1.0, linked / max(1, sum(map(len, parts))))))
        parts.clear()
        linked = 0

    found: dict[str, tuple[int, int] | None] = {}

    def ends(what: str, at: int) -> tuple[int, int] | None:
        """Start and end of the next such tag, if there is one; the page is read once for each kind."""
        known = found.get(what, (-1, -1))
        if known and known[0] < at:
            m = re.compile(rf"{what}\b", re.I).search(page, at)
            known = found[what] = (m.start(), page.find(">", m.end()) + 1) if m and m.end() <= last else None
        return known

    def skipped(name: str, at: int) -> int:
        """Where the page goes on after the content of a raw element; one without its end tag has no content, or is a script."""
        stop = ends(f"</{name}", at)
        if name == "title":
            body = ends("(?:</head|<body)", at)
            if body and (stop is None or body[0] < stop[0]):
                return body[0]
            if stop is None:
                return page.find("<", at) if page.find("<", at) >= 0 else len(page)
        return stop[1] if stop else len(page) if name in ("script", "style") else at

    def choose(name: str) -> None:
        """Ends an open select at the start of what is no choice of it; nothing but choices can be open within."""
        if name not in CHOICES and depths["select"]:
            drop(depths["select"][-1])

    def fenced(closable: set[str]) -> None:
        """Closes the outermost element that a new one closes, up to the next fence."""
        fence = max((depths[x][-1] for x in (FENCES | SILENT) - closable if depths[x]), default=0)
        outer = [depths[x][i] for x in closable if (i := bisect_right(depths[x], fence)) < len(depths[x])]
        if outer:
            drop(min(outer))

    while at < len(page):
        m, begun = None, at
        if page.startswith("<!--", at):
            at = page.find("-->", at + 4) + 3
            if at < 3:
                break
            continue
        if page[at] == "<" and at < last:
            if page[at + 1] in "!?":
                at = page.find(">", at) + 1
                continue
            m = TAG.match(page, at) or NAME.match(page, at)
        if m is None:
            at = page.find("<", at + 1) if page[at] != "<" else at + 1
            at = len(page) if at < 0 else at
            if not frames[-1].silent:
                parts.append(page[begun:at])
                if inlines["a"]:
                    linked += at - begun
            continue
        if m.re is NAME:
            at = page.find(">", m.end()) + 1
            attributes = page[m.end() : at - 1]
        else:
            at, attributes = m.end(), m.group(3)
        end, name = m.group(1), m.group(2).lower()
        closed = page[at - 2] == "/"
        if name == "head":
            close()
            continue
        if name in RAW:
            if not end and not closed:
                close()
                if name == "textarea":
                    choose(name)
                at = skipped(name, at)
            continue
        if not end:
            choose(name)
        top = frames[-1]
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                parts.append(" ")
            elif end:
                if inlines[name] and inlines[name][-1][0] >= top.fence:
                    depth, place = inlines[name][-1]
                    if depth == len(frames) - 1:  # what was opened after it stays open
                        inlines[name].pop()
                        top.inline[place] = None
                    else:
                        drop(depth + 1)
                        bare(frames[-1], place)
            elif not closed or name not in MATHS:
                inlines[name].append((len(frames) - 1, len(top.inline)))
                top.inline.append(name)
            continue
        close()
        if not end and (name in CLEAR or name in SILENT):
            if not closed and (name != "template" or ends("</template", at)):
                push(name)
            continue
        bare(top)
        if end:
            if depths[name] and (not depths["template"] or depths[name][-1] >= depths["template"][-1]):
                drop(depths[name][-1])
            if name == "template" and depths[name] and not ends("</template", at):
                drop(depths[name][0])
        elif name not in EMPTY:
            if name in CLOSES:
                fenced(CLOSES[name])
            marks = " ".join(filter(None, (a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)))) if attributes else ""
            push(name, f"{name} {marks.lower()}" if marks else name)
    close()
    return out


# ---- vectors

PATH, WORDS, MEASURES = 192, 32, 8
SIZE = PATH + WORDS + MEASURES


def slot(text: str, n: int) -> int:
    return zlib.crc32(text.encode()) % n


def vectors(blocks: list) -> np.ndarray:
    """A row per block: hashed path, hashed words, measures."""
    out = np.zeros((len(blocks), SIZE), np.float32)
    # For each path, a bit for each slot of its own and its ancestors' tags and marks.
    bits: dict[int, int] = {id(()): 0}
    rows: dict[int, np.ndarray] = {}
    for i, (text, path, linked) in enumerate(blocks):
        if id(path) not in rows:
            chain, at = [], path
            while id(at) not in bits and at:
                chain.append(at)
                at = at[0]
            for at in reversed(chain):
                name, *marks = at[1].split()
                own = {slot(f"t:{name}", PATH), *(slot(f"m:{m}", PATH) for x in marks for m in re.split(r"[-_]+", x) + [x])}
                bits[id(at)] = bits.get(id(at[0]), 0) | sum(1 << x for x in own)
            every = bits.get(id(path), 0) | 1 << slot(f"l:{path[1].split()[0] if path else ''}", PATH)
            rows[id(path)] = np.unpackbits(np.frombuffer(every.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little")
        out[i, :PATH] = rows[id(path)]
        words = text.lower().split()
        out[i, PATH : PATH + WORDS] = np.bincount([slot(w, WORDS) for w in words], minlength=WORDS)
        row = out[i, PATH : PATH + WORDS]
        row /= max(1.0, float(np.sqrt((row * row).sum())))
        n = len(text)
        stops = sum(text.count(c) for c in ".!?;:")
        out[i, PATH + WORDS :] = (np.log1p(n) / 8, np.log1p(len(words)) / 6, linked, min(1, 10 * stops / n), i / len(blocks), 1 / (1 + i), 1 / (len(blocks) - i), "©" in text)
    return out


# ---- the labeller

HIDDEN = 12


def gates(x: np.ndarray, w: dict, back: bool, mask: np.ndarray, training: bool = False):
    """One direction of the LSTM over (time, pages, size); for training, also what that needs of each step."""
    steps, pages = x.shape[:2]
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    a_in = x @ w["x"] + w["b"]
    out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        a = a_in[t] + h @ w["h"]
        s = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(a[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = f * c + i * g
        th = np.tanh(new)
        if training:
            kept.append((t, i, f, o, g, c, h, th, m))
        c, h = new * m, o * th * m
        out[t] = h
    return out, kept


def gates_back(x, w, kept, d_out):
    """Gradients of one direction."""
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    for t, i, f, o, g, c0, h0, th, m in reversed(kept):
        d = (d_out[t] + dh) * m
        dn = (dc * m) + d * o * (1 - th * th)
        a = np.concatenate([dn * g * i * (1 - i), dn * c0 * f * (1 - f), d * th * o * (1 - o), dn * i * (1 - g * g)], axis=1)
        grads["x"] += x[t].T @ a
        grads["h"] += h0.T @ a
        grads["b"] += a.sum(0)
        dh, dc = a @ w["h"].T, dn * f
    return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), SIZE), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, 1
    return x, mask


def scores(model: dict, x: np.ndarray, mask: np.ndarray, training: bool = False):
    fore, kept_f = gates(x, model["fore"], False, mask, training)
    back, kept_b = gates(x, model["back"], True, mask, training)
    both = np.concatenate([fore, back], axis=2)
    return both @ model["out"]["x"] + model["out"]["b"], both, kept_f, kept_b


def trained(pages: int = 3600, epochs: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 5) -> dict:
    """A model learned from made-up pages; the same each time."""
    rng, make = np.random.default_rng(seed), random.Random(seed)
    lstm = lambda: {"x": rng.normal(0, 0.1, (SIZE, 4 * HIDDEN)).astype(np.float32), "h": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32), "b": np.zeros(4 * HIDDEN, np.float32)}
    model = {"fore": lstm(), "back": lstm(), "out": {"x": rng.normal(0, 0.3, (2 * HIDDEN, 1)).astype(np.float32), "b": np.zeros(1, np.float32)}}
    data = []
    for _ in range(pages):
        page, main = made_up_page(make)
        blocks = blocks_of(page)
        data.append((vectors(blocks), np.array([b[0] in main for b in blocks], np.float32)))
    slots = [(part, k) for part in model for k in model[part]]
    first, second, step = {s: 0 for s in slots}, {s: 0 for s in slots}, 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)).tolist(), key=lambda i: (len(data[i][0]) // 8,))
        groups = [order[a : a + batch] for a in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            x, mask = padded([data[i][0] for i in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(groups[g]):
                y[: len(data[i][1]), j] = data[i][1]
            s, both, kept_f, kept_b = scores(model, x, mask, training=True)
            d = ((1 / (1 + np.exp(-s[:, :, 0])) - y) * mask / mask.sum())[:, :, None]
            d_both = d @ model["out"]["x"].T
            grads = {"fore": gates_back(x, model["fore"], kept_f, d_both[:, :, :HIDDEN]), "back": gates_back(x, model["back"], kept_b, d_both[:, :, HIDDEN:])}
            grads["out"] = {"x": np.tensordot(both, d, ((0, 1), (0, 1))), "b": d.sum((0, 1))}
            step += 1
            for part, k in slots:
                e = grads[part][k]
                first[part, k] = 0.9 * first[part, k] + 0.1 * e
                second[part, k] = 0.99 * second[part, k] + 0.01 * e * e
                pace = rate * (0.5 ** (epoch / 3))
                model[part][k] -= (pace * (first[part, k] / (1 - 0.9**step)) / (np.sqrt(second[part, k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


_MODEL: list[dict] = []


def model() -> dict:
    if not _MODEL:
        _MODEL.append(trained())
    return _MODEL[0]


# ---- made-up pages

SYLLABLES = "ba be bi bo da de di do ka ke la le li ma me mi na ne no pa po ra re ri sa se si ta te ti to va ve un er en ing ou ei sch tion eau ón ß".split()
# Words of page furniture, as a rule does not have them from anywhere else.
FURNITURE = "home about contact menu search login register subscribe newsletter cookies accept privacy terms copyright share tweet follow related popular advertisement sponsored reply comment comments submit email archive tags category next previous".split()
# Names that say where a box stands, not what it holds; any box may have them.
NEUTRAL = "col row grid span box wrap flex block panel unit inner outer left right center wide cell part area section group item view frame".split()


def made_up_page(r: random.Random) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks."""
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    main: set[str] = set()
    sentence = lambda: words(3, 14).capitalize() + r.choice([".", ".", ".", "?", "!", ":"])
    prose = lambda: " ".join(sentence() for _ in range(r.randint(1, 6)))
    named = lambda *names: r.choice(names)
    label = lambda: r.choice(FURNITURE).capitalize() if r.random() < 0.5 else words(1, 3)

    def keep(text: str) -> str:
        main.add(" ".join(text.split()))
        return text

    def marked(tag: str, names: list[str], inner: str, bare: float = 0.3) -> str:
        kind = "" if r.random() < bare else f' {r.choice(["class", "class", "class", "id"])}="{r.choice(names)}{r.choice(["", "", "-" + word(), " " + word()])}"'
        return f"<{tag}{kind}>{inner}</{tag}>"

    def neutral() -> str:
        size = lambda: r.choice(["", "", "-", "_"]) + str(r.randint(1, 16))
        one = lambda: r.choice([r.choice(NEUTRAL), r.choice(NEUTRAL), word()]) + r.choice(["", size(), f"-{r.choice(['xs', 'sm', 'md', 'lg', 'xl'])}{size()}", f"-{word()}"])
        return " ".join(one() for _ in range(r.randint(1, 3)))

    def boxed(inner: str, p: float = 0.15) -> str:
        """In one or more boxes with names that say nothing."""
        while inner and r.random() < p:
            inner, p = f'<{(n := named("div", "div", "div", "section"))} {named("class", "class", "id")}="{neutral()}">{inner}</{n}>', 0.4
        return inner

    def links(n: int) -> str:
        items = [f'<a href="/{word()}">{label()}</a>' for _ in range(n)]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if r.random() < 0.7 else r.choice([" ", " | ", ""]).join(items)

    def nav() -> str:
        return marked("nav", ["nav", "navbar", "menu", "main-menu"], links(r.randint(2, 9)), 0.6) if r.random() < 0.7 else marked("div", ["nav", "menu", "navigation", "breadcrumb", "breadcrumbs", "topbar"], links(r.randint(2, 9)), 0)

    def advert() -> str:
        return marked(named("div", "div", "aside", "section"), ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot"], r.choice([prose(), f"<p>{prose()}</p>", f"<a href=x>{words(2, 9)}</a>"]), 0)

    def notice() -> str:
        return marked(named("div", "section", "p"), ["notice", "cookie", "cookies", "cookie-notice", "consent", "alert", "popup", "modal", "newsletter", "subscribe", "gdpr"], r.choice([prose(), f"<span>{prose()}</span> <a href=x>{label()}</a>"]), 0)

    def form() -> str:
        parts = [f"<label>{label()}</label><input type=text>", f"<label>{label()}: <input></label>", f"<p>{sentence()}</p>", f"<p>{prose()}</p>", f"<div>{label()} <input></div>", f"<button>{label()}</button>", "<select><option>x</select>", f"<h3>{label()}</h3>", f"{words(1, 4)} <input type=submit>"]
        return marked("form", ["form", "search", "signup", "contact"], "".join(r.sample(parts, r.randint(1, 4))), 0.6)

    def side() -> str:
        inner = "".join(r.choice([lambda: f"<h3>{label()}</h3>", lambda: links(r.randint(2, 6)), lambda: f"<p>{prose()}</p>", form])() for _ in range(r.randint(1, 4)))
        return marked("aside", ["sidebar", "side", "widget"], inner, 0.6) if r.random() < 0.6 else marked("div", ["sidebar", "side", "widget", "related", "popular", "share", "social", "toc", "tags", "recommended"], inner, 0)

    def comments() -> str:
        one = lambda: r.choice([lambda: marked("div", ["comment", "reply"], f"<b>{word()}</b> <p>{prose()}</p>", 0.3), lambda: f"<li><p>{prose()}</p></li>", lambda: f"<p>{prose()}</p>", lambda: f"<article class=comment><p>{prose()}</p></article>"])()
        return marked(named("div", "section", "ol", "ul"), ["comments", "comment-list", "responses", "discussion", "disqus", "replies", "comment"], r.choice(["", f"<h3>{label()}</h3>"]) + "".join(one() for _ in range(r.randint(1, 6))), 0)

    def footer() -> str:
        inner = r.choice(["&copy; ", "&#169; ", "", "Copyright "]) + words(1, 4) + r.choice([" &middot; ", ". ", " | "]) + r.choice([prose(), sentence(), words(1, 5)])
        inner = r.choice([inner, f"<p>{inner}</p>", inner + links(r.randint(1, 5))])
        return marked("footer", ["footer", "site-footer"], inner, 0.7) if r.random() < 0.75 else marked("div", ["footer", "site-footer", "copyright", "legal", "bottom"], inner, 0)

    plain = named(*["p"] * 17, "div", "div", "pre")  # what holds the page's paragraphs

    def paragraph() -> str:
        text = prose()
        kind = r.random()
        if plain != "p" and kind < 0.73:
            return f"<{plain}>{keep(text)}</{plain}>"
        if kind < 0.5:
            return f"<p>{keep(text)}</p>"
        if kind < 0.55:
            return boxed(f"<p>{keep(text)}</p>", 0.5) if r.random() < 0.5 else f'<p class="{neutral()}">{keep(text)}</p>'
        if kind < 0.65:
            keep(text)
            first, _, rest = text.partition(" ")
            return f"<p><{r.choice(['b', 'em', 'strong', 'i'])}>{first} {rest}" + r.choice(["", "<br>"]) if r.random() < 0.5 else f"<p><b>{first}</b> {rest}</p>"
        if kind < 0.73:
            a, b = sentence(), words(1, 3)
            keep(f"{a} {b}")
            return f'<p>{a} <a href="/{word()}">{b}</a></p>'
        if kind < 0.81:
            return f"<h{(n := r.randint(2, 4))}>{keep(words(2, 6))}</h{n}>"
        if kind < 0.88:
            return f"<{(n := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{keep(sentence())}</li>" for _ in range(r.randint(2, 5))) + f"</{n}>"
        if kind < 0.93:
            return f"<blockquote>{r.choice(['<p>', ''])}{keep(text)}</blockquote>"
        if kind < 0.97:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{keep(words(1, 3))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>"
        return f"<figure><img src=x><figcaption>{keep(sentence())}</figcaption></figure>"

    def article() -> str:
        title = f"<h1>{keep(words(2, 10))}</h1>" if r.random() < 0.85 else ""
        inner = ""
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9, 14])):
            inner += paragraph()
            if r.random() < 0.1:
                inner += r.choice([advert, side, notice, form, form])()
        tag = r.random()
        if tag < 0.2:
            return boxed(boxed(title, 0.1) + boxed(inner, 0.2), 1)
        if tag < 0.55:
            return marked("article", ["article", "post", "entry", "hentry"], title + inner, 0.7)
        if tag < 0.7:
            return marked("main", ["main", "content"], title + inner, 0.6)
        if tag < 0.9:
            return marked("div", ["content", "article", "post", "entry", "article-body", "post-content", "entry-content", "main", "story", "text", "body"], title + inner, 0.1)
        return title + inner

    some = lambda f, p: boxed(f()) if r.random() < p else ""
    if r.random() < 0.06:  # nothing but text
        return "".join(paragraph() for _ in range(r.randint(1, 8))), main
    header = lambda: marked("header", ["header", "site-header"], r.choice([f"<h2>{words(1, 3)}</h2>", f"<p>{sentence()}</p>", f"<a href=/>{words(1, 2)}</a>", words(1, 4)]) + some(nav, 0.5), 0.6) if r.random() < 0.7 else marked("div", ["header", "site-header", "masthead", "top", "logo"], words(1, 5), 0)
    body = some(notice, 0.2) + some(header, 0.4) + some(nav, 0.75) + r.choice(["", "<!-- ad 1 -->"]) + some(advert, 0.5) + some(side, 0.2)
    if r.random() < 0.05:  # cells of a table
        cells = [f"<td>{some(nav, 1)}{some(side, 0.3)}</td>", f"<td>{article()}</td>"]
        body = f"<table><tr><td colspan=2>{some(header, 0.8)}</td></tr><tr>{''.join(cells)}</tr><tr><td colspan=2>{some(footer, 0.7)}</td></tr></table>"
        return f"<html><head><title>{words(2, 8)}</title></head><body>{body}</body></html>", main
    body += boxed(article(), 0.1) + some(advert, 0.2) + some(comments, 0.3) + some(side, 0.25) + some(form, 0.15) + some(notice, 0.1) + some(footer, 0.7)
    if r.random() < 0.3:
        body = marked("div", ["wrapper", "page", "container", "site", "layout"], body, 0)
    return f"<html><head><title>{words(2, 8)}</title></head><body>{body}</body></html>", main


# ---- pages to texts


def text_batches(model: dict, threshold: float, most: int = 20_000):
    """most: blocks, padding included, that one run of the labeller takes at once; a larger page is a run by itself."""

    def label(pages: list[list]) -> list[str]:
        texts = [""] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and len(pages[order[b]]) * (b + 1 - a) <= most:
                b += 1
            x, mask = padded([vectors(pages[i]) for i in order[a:b]])
            chosen = scores(model, x, mask)[0][:, :, 0] > np.log(threshold / (1 - threshold))
            for j, i in enumerate(order[a:b]):
                texts[i] = "\n".join(block[0] for block, yes in zip(pages[i], chosen[:, j]) if yes)
            a = b
        return texts

    def run(batches):
        for batch in batches:
            for rows in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                texts = label([blocks_of(page) for page in rows.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html): the blocks that are labelled main, joined by \\n.

    Null html counts as empty and gives an empty text, as does a page without main blocks. Nothing is cut: whole pages
    are read, and whole blocks are kept. Pages that repeat give equal rows; other columns play no part; an empty table
    gives no rows.
    """
    weights = {part: {k: v for k, v in w.items()} for part, w in model().items()}
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(text_batches(weights, threshold), "page_id long, url string, text string, n_chars long")
