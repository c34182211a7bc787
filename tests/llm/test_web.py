"""URL verdicts, main text, media and chats."""

import hashlib
import html
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.layouts import LAYOUTS, TEXTS, filled
from tidemark.llm import chat, html_text, media, queries, url_filter


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "https://A.Example.ORG/es/1?x", '<a href="https://spam.test/a">x</a>'),
        (2, "http://www.example.org/en/12#top", None),
        (3, "http://sub.site.com/fr/", "<a href='//friend.net/'>y</a>"),
        (4, "http://site.com/de/x", '<A HREF = "http://farm.net/q">z</A> <img src=http://farm.net/i>'),
        (5, "http://friend.net/x", ""),
        (6, "http://farm.net", "<a href=http://site.com/de/1>back</a>"),
        (7, None, None),
        (8, "nonsense", "<a href=http://x.y>"),
        (9, "http://example.org", None),
        (None, "http://notexample.org/es/", None),
        (10, "http://spam.test/?q=://a", None),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as rule", "2 as verdict", "3 as _salt")


def by_hand(pages, ratio=2.0):
    links, hosts, out = defaultdict(lambda: defaultdict(int)), set(), []
    seeds = {"allow": defaultdict(float), "block": defaultdict(float)}
    for page, url, text in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for v, r in queries.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        _, rule, verdict = max(fits, default=(0, None, None))
        if verdict:
            seeds[verdict][host] += 1
        hosts.add(host)
        for x in re.findall(url_filter.LINK.replace("(?is)", ""), text or "", re.I | re.S):
            if x.lower() != host:
                links[host][x.lower()] += 1
        out.append([page, host, path, rule, verdict])

    def flow(links, seed):
        mass, moving = defaultdict(float), dict(seed)
        for _ in range(20):
            new = defaultdict(float)
            for h, w in moving.items():
                if h not in links:
                    mass[h] += w
                    continue
                mass[h] += 0.15 * w
                for d, n in links[h].items():
                    new[d] += 0.85 * w * n / sum(links[h].values())
            moving = new
        for h, w in moving.items():
            mass[h] += w
        return mass

    back = defaultdict(dict)
    for h, d in links.items():
        for x, n in d.items():
            back[x][h] = n
    trust, distrust = flow(links, seeds["allow"]), flow(back, seeds["block"])
    return [[*row[:4], row[4] or ("block" if distrust[row[1]] > ratio * trust[row[1]] + 1e-5 else "allow")] for row in out]


def test_urls(spark, pages, sf_dir):
    for df in (pages, spark.read.parquet(f"{sf_dir}/pages.parquet")):
        want = by_hand([(r.page_id, r.url, r.html) for r in df.select("page_id", "url", "html").collect()])
        got = url_filter.url_verdicts(df, queries.RULES).collect()
        assert sorted(map(repr, want)) == sorted(repr([r.page_id, r.host, r.path, r.rule, r.verdict]) for r in got)
    assert url_filter.url_verdicts(pages.limit(0), queries.RULES).count() == 0
    assert {r.verdict for r in url_filter.url_verdicts(pages, []).collect()} == {"allow"}


def test_trust_and_distrust_over_a_web(spark):
    """Pages with absolute links, found here by an HTML parser; the flow as dense matrices; verdicts but for ties within 1e-4."""
    from html.parser import HTMLParser
    from urllib.parse import urlsplit

    rng = random.Random(4)
    hosts = [f"h{i}.{rng.choice(['org', 'net', 'com', 'net'])}" for i in range(40)]
    rows = []
    for i in range(300):
        mine = hosts[min(rng.randrange(40), rng.randrange(40))]  # a few hosts have many pages
        path = rng.choice(["/de/", "/fr/", "/x/"]) if mine.endswith("com") else "/p/"
        # Hosts 30 and up link nowhere.
        seen = [rng.choice(hosts) for _ in range(rng.randrange(5))] if hosts.index(mine) < 30 else []
        body = "".join(rng.choice([f'<a href="http://{h}/{i}">x</a>', f"<A HREF='//{h.upper()}'>y</A>", f"<img src=https://{h}/i.png>", f'<a href="/own">z</a><a href="http://{h}?q">q</a>']) for h in seen)
        rows.append((i, f"http://{mine}{path}{i}", body))

    class Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            self.found += [urlsplit(v).netloc.lower() for k, v in attrs if k in ("href", "src") and urlsplit(v).netloc]

    n = len(hosts)
    counts, seeds = np.zeros((n, n)), {"allow": np.zeros(n), "block": np.zeros(n)}
    for _, url, body in rows:
        reader = Links()
        reader.found = []
        reader.feed(body)
        at = hosts.index(urlsplit(url).netloc)
        for h in reader.found:
            counts[at, hosts.index(h)] += hosts.index(h) != at
        if hosts[at].endswith("org") or "/fr/" in url:
            seeds["allow"][at] += 1
        elif "com/de/" in url:
            seeds["block"][at] += 1

    def masses(links, seed):
        out = links.sum(1)
        shares = links / np.where(out, out, 1)[:, None]
        at, mass = seed, np.zeros(n)
        for _ in range(20):
            mass, at = mass + np.where(out, 0.15, 1.0) * at, 0.85 * shares.T @ at
        return mass + at

    trust, distrust = masses(counts, seeds["allow"]), masses(counts.T, seeds["block"])
    assert abs(trust.sum() - seeds["allow"].sum()) < 1e-9 and counts.sum() > 200
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = url_filter.url_verdicts(df, queries.RULES).collect()
    judged = set()
    for r in found:
        at = hosts.index(r.host)
        assert abs(r.trust - trust[at]) < 1e-5 and abs(r.distrust - distrust[at]) < 1e-5
        if r.rule is None and abs(distrust[at] - 2 * trust[at]) > 1e-4:
            judged.add(r.verdict)
            assert r.verdict == ("block" if distrust[at] > 2 * trust[at] else "allow")
    assert len(found) == len(rows) and judged == {"allow", "block"}


def test_blocks():
    page = "<head><title>t</title><body>a <b>c &amp; d</b><p class='x y'>one<p>two<br>three</p><script>var a='</p><p>no</p>';</script><ul><li>i<li>j</ul><!-- <p>no</p> --><p title='a>b'>q</p>&lt;z"
    assert [b[0] for b in html_text.blocks_of(page)] == ["a c & d", "one", "two three", "i", "j", "q", "<z"]
    assert html_text.blocks_of("<p>a < b <3</p>")[0][0] == "a < b <3"
    for odd in ("", "<", "<p", "<script>", '<a href="x', "</p></div>", "<p>" * 3000, "&#xZ; &#1114112;"):
        html_text.blocks_of(odd)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>t</title><meta charset=x><h1>a</h1><p>b", ["a", "b"]),
        ("<head><title>t</head><p>b", ["b"]),
        ("<head><script>'</head>'</script><style>x</style>c<p>b", ["c", "b"]),
        *((f"<div><p>a</p><{x}></div><p>b</p>", ["a", "b"]) for x in ("svg", "math", "object", "canvas", "audio", "video", "select", "noscript", "iframe", "template", "textarea")),
        *((f"<p>a</p><{x}><p>b</p>", ["a", "b"]) for x in ("svg", "math", "object", "canvas", "audio", "video", "select", "noscript", "iframe", "template")),
        ("<object><object>a</object><p>b</p></object><p>c", ["a", "b", "c"]),
        ("<svg><svg><path d='x'/></svg><title>t</title></svg><p>c", ["c"]),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><noscript>see <b>this</b></noscript>", ["if x=2 holds", "see this"]),
        ("<template><p>x<template>y</template>z</p></template><p>a", ["a"]),
        ("<template><p>x<template>y</template><p>a", ["a"]),
        ("<p>a<template><p>x</p>y</template>b", ["a", "b"]),
        ("<label>a <select><option>x<option>y</label> b <select><optgroup><option>z</select> c", ["a", "b", "c"]),
        ("<select><option>x<input>a", ["a"]),
    ],
)
def test_no_block_is_dropped(page, want):
    assert [b[0] for b in html_text.blocks_of(page)] == want
    assert html_text.blocks_of("<a href=x><svg><path></svg>abcd</a>")[0][2] == 1


def test_all_words_of_a_block_count():
    words = [f"w{i}" for i in range(900)]
    row = html_text.vectors([(" ".join(words), (), 0.0)])[0, html_text.PATH : html_text.PATH + html_text.WORDS]
    want = np.bincount([zlib.crc32(w.encode()) % html_text.WORDS for w in words], minlength=html_text.WORDS)
    assert np.allclose(row, want / np.sqrt((want * want).sum()))


def test_deep_pages_take_linear_time():
    import time

    spent = []
    for n in (10_000, 100_000):
        page = "".join(f"<div class=c{i % 7}>t{i} <b>x" for i in range(n)) + "</section></li></b></a>" * n
        at = time.process_time()
        blocks = html_text.blocks_of(page)
        rows = html_text.vectors(blocks)
        spent.append(time.process_time() - at)
        assert len(blocks) == n and rows[-1, : html_text.PATH].sum() > rows[0, : html_text.PATH].sum()
    assert spent[1] < 40 * max(spent[0], 0.05)


@pytest.mark.parametrize(
    "shape",
    [
        lambda n: "<i>" * n + "<b>" * n + "x" + "</i>" * n,
        lambda n: '<a "' * n,
        lambda n: "<a " * n,
        lambda n: '<a "\'>' * n + "<",
        lambda n: "<title><body>" * n + "</title>",
        lambda n: "<title>" * n + "</title " * n,
        lambda n: "<template>" * n + "</template>" * n,
        lambda n: "<b><div>" + "<svg>" * n + "</b>" * n,
        lambda n: "<div><template>" + "<p>" * n + "</div>" * n + "</template>",
        lambda n: "<p><center>" * n + "</div>" * n,
        lambda n: "<ul><li><form>" * n,
        lambda n: "<!" * n,
    ],
)
def test_hostile_pages_take_linear_time(shape):
    import time

    n = 1_000_000 // (len(shape(1000)) // 1000)
    at = time.process_time()
    html_text.blocks_of(shape(n))
    assert time.process_time() - at < 5


@pytest.mark.parametrize(
    "page, want",
    [
        ("<a>l<i>m<b>n</i>o</a>p", [("lmnop", 0.8)]),
        ("<b><i><svg></b><a>y</a></svg>z", [("y", 1.0), ("z", 0.0)]),
        ("<a>x<svg><text></a>y</svg>z", [("x", 1.0), ("y", 0.0), ("z", 0.0)]),
        ("<p 'a>b'>x<p \"a>b", [("x", 0.0), ("b", 0.0)]),
        ("<table><tr><td><p>a<td>b<tr><td>c", [("a", 0.0), ("b", 0.0), ("c", 0.0)]),
        ("<!-->a--><p>b<!-- c", [("b", 0.0)]),
    ],
)
def test_open_elements(page, want):
    assert [(b[0], round(b[2], 3)) for b in html_text.blocks_of(page)] == want


def test_path_slots():
    (block,) = html_text.blocks_of("<div class='Main-Menu x'><ul id=top><li><b>word</b></ul></div>")
    want = ["t:div", "t:ul", "t:li", "m:main", "m:menu", "m:main-menu", "m:x", "m:top", "l:li"]
    row = html_text.vectors([block])[0, : html_text.PATH]
    assert set(np.flatnonzero(row)) == {html_text.slot(x, html_text.PATH) for x in want}


def test_lstm_by_hand():
    """Scores and gradients of the labeller against plain loops and differences."""
    rng, n, size = np.random.default_rng(2), html_text.HIDDEN, html_text.SIZE
    make = lambda: {"x": rng.normal(0, 0.2, (size, 4 * n)), "h": rng.normal(0, 0.3, (n, 4 * n)), "b": rng.normal(0, 0.1, 4 * n)}
    model = {"fore": make(), "back": make(), "out": {"x": rng.normal(0, 0.3, (2 * n, 1)), "b": np.array([0.1])}}
    pages = [rng.normal(0, 1, (k, size)).astype(np.float32) for k in (5, 1, 3)]
    x, mask = html_text.padded(pages)
    got = html_text.scores(model, x, mask)[0][:, :, 0]
    sig = lambda v: 1 / (1 + np.exp(-v))

    def walk(rows, w):
        h, c, out = np.zeros(n), np.zeros(n), []
        for row in rows:
            a = row @ w["x"] + h @ w["h"] + w["b"]
            c = sig(a[n : 2 * n]) * c + sig(a[:n]) * np.tanh(a[3 * n :])
            h = sig(a[2 * n : 3 * n]) * np.tanh(c)
            out.append(h)
        return out

    for j, page in enumerate(pages):
        fore, back = walk(page, model["fore"]), walk(page[::-1], model["back"])[::-1]
        want = [np.concatenate([f, b]) @ model["out"]["x"][:, 0] + 0.1 for f, b in zip(fore, back)]
        assert np.allclose(got[: len(page), j], want, atol=1e-4)
    out, kept = html_text.gates(x, model["fore"], False, mask, training=True)
    grads = html_text.gates_back(x, model["fore"], kept, np.ones_like(out))
    for key, place in (("x", (3, 7)), ("h", (2, 30)), ("b", (5,))):
        change = []
        for step in (1e-3, -1e-3):
            moved = {k: v.copy() for k, v in model["fore"].items()}
            moved[key][place] += step
            change.append(float(html_text.gates(x.astype(np.float64), moved, False, mask)[0].astype(np.float64).sum()))
        assert abs((change[0] - change[1]) / 2e-3 - grads[key][place]) < 0.02 * max(1, abs(grads[key][place]))


def test_main_text(spark, pages, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    good = 0
    texts = {r.page_id: r.html for r in df.collect()}
    for r in html_text.main_text(df).collect():
        inner = re.search(r"<article>(.*)</article>", texts[r.page_id], re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        good += r.text == "\n".join(x for x in want if x)
        assert r.n_chars == len(r.text)
    assert good >= 0.97 * len(texts)
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert len(got) == pages.count() and got[7] == "" and got[2] == ""
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_labeller_on_new_layouts():
    model, r = html_text.model(), random.Random(77)
    wrong = blocks = 0
    for _ in range(150):
        page, main = html_text.made_up_page(r)
        found = html_text.blocks_of(page)
        if found:
            x, mask = html_text.padded([html_text.vectors(found)])
            said = html_text.scores(model, x, mask)[0][:, 0, 0] > 0
            wrong += sum((b[0] in main) != bool(s) for b, s in zip(found, said))
            blocks += len(found)
    assert wrong < 0.04 * blocks


def test_labeller_on_layouts_by_hand(spark):
    names = sorted(LAYOUTS)
    df = spark.createDataFrame([(i, None, filled(LAYOUTS[name])) for i, name in enumerate(names)], "page_id long, url string, html string")
    marks = {}
    for r in html_text.main_text(df).collect():
        got = r.text.split("\n") if r.text else []
        marks[names[r.page_id]] = 2 * len(set(got) & set(TEXTS)) / (len(got) + len(TEXTS))
    assert len(marks) == len(LAYOUTS) > 30 and min(marks.values()) >= 0.75, marks
    assert sum(marks.values()) / len(marks) >= 0.95, marks


@pytest.mark.parametrize("scheme", [media.PLAIN, media.LZW, media.DEFLATE, media.PACKBITS])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(scheme, order):
    rng = np.random.default_rng(4)
    for kind, predictor, tile, samples in [(np.uint8, 1, None, 1), (np.uint8, 2, None, 3), (np.uint16, 2, (16, 16), 1), (np.uint8, 2, (32, 16), 3)]:
        images = [rng.integers(0, top, (h, w, samples)).astype(kind) for h, w, top in ((1, 1, 9), (70, 33, 3), (50, 64, 250))]
        data = media.write_tiff(images, scheme, predictor, rows_per_strip=20, tile=tile, order=order)
        pages = list(media.pages_of(data))
        assert [p[0] for p in pages] == [0, 1, 2] and not any(p[3] for p in pages)
        assert all(p[2] == i.tobytes() for p, i in zip(pages, images))


def test_codecs():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 127, 128, 129, 5000, 40_000):
        for data in (bytes(n), rng.randbytes(n), b"ab" * (n // 2)):
            assert media.unpack_bits(media.pack_bits(data)) == data and media.lzw_decode(media.lzw_encode(data)) == data
    # Worked examples of the format's description, and streams written by hand.
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert media.unpack_bits(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    told = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in told)
    assert media.lzw_decode(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert media.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))
    assert len(media.lzw_decode(media.lzw_encode(bytes(10**7)), 1000)) < 9 * 10**6 and len(media.unpack_bits(b"\x81a" * 10**5, 1000)) < 1200


def plain_tiff(order, body, width, height, scheme=1, predictor=1, tags=()):
    """A file written by hand, apart from the module's writer."""
    entries = {256: (4, width), 257: (4, height), 258: (3, 8), 259: (3, scheme), 262: (3, 1), 273: (4, 8), 277: (3, 1), 278: (4, height), 279: (4, len(body)), 317: (3, predictor)} | dict(tags)
    at = 8 + len(body) + len(body) % 2
    out = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + body.ljust(at - 8, b"\0") + struct.pack(order + "H", len(entries))
    for tag, (kind, value) in sorted(entries.items()):
        out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "I", value) if kind == 4 else struct.pack(order + "HH", value, 0))
    return out + struct.pack(order + "I", 0)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_by_hand(order):
    image = bytes(range(7)) + b"\xff\0\1\2\3\4\5" + b"same..."
    steps = b"".join(bytes((r[i] - (r[i - 1] if i else 0)) & 255 for i in range(7)) for r in (image[:7], image[7:14], image[14:]))
    for body, scheme, predictor in ((image, 1, 1), (steps, 1, 2), (zlib.compress(image), 8, 1), (zlib.compress(steps), 32946, 2), (bytes([20]) + image, 32773, 1)):
        ((page, facts, data, error),) = media.pages_of(plain_tiff(order, body, 7, 3, scheme, predictor))
        assert (page, data, error) == (0, image, None) and facts["width"] == 7


def test_tiff_that_claims_too_much():
    for width, height in ((1_000_000, 2_000_000), (2**32 - 1, 2**32 - 1), (0, 5), (5, 0)):
        for scheme in (1, 5, 8, 32773):
            ((_, _, data, error),) = media.pages_of(plain_tiff("<", b"abcd", width, height, scheme))
            assert data is None and error
    tiled = plain_tiff("<", b"abcd", 4, 1, 1, 1, {322: (4, 2**31), 323: (4, 2**31), 324: (4, 8), 325: (4, 4)}.items())
    assert list(media.pages_of(tiled))[0][3]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("bits", [1, 2, 4, 8, 16, 32])
def test_sample_sizes_and_bit_order(bits, order):
    rng = random.Random(bits)
    rows = [[rng.randrange(1 << bits) for _ in range(13)] for _ in range(5)]
    if bits < 8:
        lines = ["".join(f"{v:0{bits}b}" for v in row) for row in rows]
        body = b"".join(int(x.ljust(-(-len(x) // 8) * 8, "0"), 2).to_bytes(-(-len(x) // 8)) for x in lines)
    else:
        body = b"".join(v.to_bytes(bits // 8, "little" if order == "<" else "big") for row in rows for v in row)
    turned = lambda data: bytes(int(f"{b:08b}"[::-1], 2) for b in data)
    for stored, scheme, fill in ((body, 1, 1), (turned(body), 1, 2), (turned(zlib.compress(body)), 8, 2), (zlib.compress(body), 8, 1)):
        ((_, facts, data, error),) = media.pages_of(plain_tiff(order, stored, 13, 5, scheme, 1, {258: (3, bits), 266: (3, fill)}.items()))
        assert error is None and facts["bits"] == bits
        assert np.frombuffer(data, f"u{max(1, bits // 8)}").tolist() == [v for row in rows for v in row]


def test_strips_that_share_their_bytes(spark):
    strip, n = zlib.compress(bytes(64_000), 9), 200
    tags = [(256, 4, 1, 1000), (257, 4, 1, 64 * n), (258, 3, 1, 8), (259, 3, 1, 8), (273, 4, n, None), (277, 3, 1, 1), (278, 4, 1, 64), (279, 4, n, None)]
    at = 8 + len(strip) + len(strip) % 2
    beyond = at + 2 + 12 * len(tags) + 4
    entries = b"".join(struct.pack("<HHII", tag, kind, count, beyond + 4 * n * (tag == 279) if value is None else value) for tag, kind, count, value in tags)
    file = (b"II*\0" + struct.pack("<I", at) + strip).ljust(at, b"\0") + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + struct.pack("<I", 8) * n + struct.pack("<I", len(strip)) * n
    assert len(file) < 2500
    ((_, facts, data, error),) = media.pages_of(file)
    assert error is None and data == bytes(64_000 * n) and facts["height"] == 64 * n
    df = spark.createDataFrame([(1, file)], "doc_id long, media binary")
    assert media.tiff_pages(df, most=64_000 * n - 1).first().error == f"a page of over {64_000 * n - 1} bytes"
    assert media.tiff_pages(df, most=64_000 * n).first().error is None


def test_lzw_without_clears():
    # A literal 0, then each code is the entry that the one before it makes: 1, 2, 3, ... zeros; then the longest ones again.
    codes = [256, 0, *range(258, 4094), *[4093, 258, 7, 4000] * 1000]
    width = lambda i: 9 if i < 255 else 10 if i < 767 else 11 if i < 1791 else 12
    bits = "".join(f"{c:0{width(i)}b}" for i, c in enumerate(codes))
    stored = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))
    want = bytes(sum(range(1, 3838))) + (bytes(4093 - 256 + 2) + b"\7" + bytes(4000 - 256)) * 1000
    assert media.lzw_decode(stored) == want
    assert len(media.lzw_decode(stored, 8_000_000)) < 8_010_000
    ((_, _, data, error),) = media.pages_of(plain_tiff("<", stored, len(want), 1, 5))
    assert error is None and data == want


def test_missing_strips_are_told():
    assert "missing" in list(media.pages_of(plain_tiff("<", bytes(30), 10, 9, 1, 1, {278: (4, 3)}.items())))[0][3]


def test_every_scheme_at_every_size():
    found = {n: set() for n in (10, 5_000, 300_000)}
    for n in found:
        for i in range(40):
            (_, tags), *_ = media.directories(media.stored(f"{i} ".encode() * (n // 2)))
            found[n].add((tags[media.COMPRESSION][0], tags[media.PREDICTOR][0], media.TILE_OFFSETS in tags))
    assert all({x[0] for x in kinds} == {1, *media.SCHEMES} - {1} and {x[2] for x in kinds} == {True, False} for kinds in found.values())


def test_damaged_tiff(spark):
    good = media.write_tiff([np.zeros((4, 4), np.uint8)] * 2)
    looped = bytearray(good)
    last = struct.unpack("<I", good[4:8])[0]
    end = last + 2 + 12 * struct.unpack("<H", good[last : last + 2])[0]
    second = struct.unpack("<I", good[end : end + 4])[0]
    looped[second + 2 + 12 * 11 : second + 2 + 12 * 11 + 4] = struct.pack("<I", last)
    rows = [(1, good), (2, None), (3, b""), (4, good[:-40]), (5, b"II*\0\0\0\0\0"), (6, bytes(looped)), (1, good)]
    got = defaultdict(list)
    for r in media.tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect():
        got[r.doc_id].append((r.page, r.width, r.error is None))
    assert sorted(got[1]) == [(0, 4, True)] * 2 + [(1, 4, True)] * 2
    assert [x[2] for x in got[2]] == [x[2] for x in got[3]] == [False] and not got[4][-1][2] and 5 not in got
    assert [x[0] for x in got[6]] == [0, 1]


def test_text_media(awkward, docs, empty):
    for df in (awkward, docs):
        want = sorted(((r.text or "").encode() for r in df.select("text").collect()))
        got = media.text_media(df).collect()
        padded = lambda t: t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")
        assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted((len(t), len(padded(t)), hashlib.sha256(padded(t)).hexdigest(), zlib.crc32(padded(t)[-64:])) for t in want)
        assert len({r.payload_sha256: (r.media_sha256, r.feature) for r in got}) == len({(r.payload_sha256, r.media_sha256, r.feature) for r in got})
    assert media.text_media(empty).count() == 0


def test_chat_digests(spark, sf_dir):
    odd = spark.createDataFrame(
        [(1, 1, "user", "a\\<|im_end|>\\\\ <\\| %0A"), (1, 0, "sys\ntem%", None), (1, 2, "assistant", "<"), (1, 2, "assistant", "<"), (2, None, None, "x"), (None, 0, "assistant", "|>é\n"), (3, 5, "user", "z" * 50_000)],
        "conv_id long, turn long, role string, text string",
    ).selectExpr("*", "'x' as formatted", "1 as place", "2 as learned")
    for df in (odd, spark.read.parquet(f"{sf_dir}/conversations.parquet")):
        turns = defaultdict(list)
        for r in df.select("conv_id", "turn", "role", "text").collect():
            turns[r.conv_id].append((r.turn is not None, r.turn, r.role or "", r.text or ""))
        said = "<|im_end|><|im_start|>assistant ok"
        turns[-1] = [(True, 0, "user", said), (True, 1, "assistant", said)]
        want = []
        for conv, rows in turns.items():
            rows.sort()
            all_, loss = "".join(f"{r[2]}\n{r[3]}\n" for r in rows), "".join(r[3] for r in rows if r[2] == "assistant")
            want.append((conv, len(rows), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
        got = chat.chat_digests(df).collect()
        assert sorted(map(repr, want)) == sorted(repr((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)) for r in got)
    assert [r.conv_id for r in chat.chat_digests(odd.limit(0)).collect()] == [-1]
    own = spark.createDataFrame([(-1, 0, "assistant", "mine"), (-1, 1, "user", "x")], odd.select("conv_id", "turn", "role", "text").schema)
    assert sorted((r.conv_id, r.n_turns, r.loss_chars) for r in chat.chat_digests(own).collect()) == [(-1, 2, 4), (-1, 2, len(said))]


def test_loss_spans_are_read_back(spark):
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("a\nb", "<|x"), ("assistant", "é<|im_end|>"), ("assistant", ""), ("user", "\\")])], "conv_id long, turn long, role string, text string")
    chats = chat.formatted(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).cache()
    whole, spans = chats.select("formatted", "loss_spans").first()
    assert [whole[s["from"] : s["to"]] for s in spans] == ["é<\\|im_end|>", ""]
    assert [(t.text, t.learned) for t in chat.read_back(chats).first().turns] == [("<|x", False), ("é<|im_end|>", True), ("", True), ("\\", False)]
    for wrong in ("transform(loss_spans, x -> named_struct('from', x.`from` + 1, 'to', x.`to`))", "slice(loss_spans, 1, 1)", "array_append(loss_spans, named_struct('from', 0L, 'to', 1L))"):
        with pytest.raises(Exception, match="no turn's content"):
            chat.read_back(chats.withColumn("loss_spans", F.expr(wrong))).collect()


def test_typed_parts(spark):
    form = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
    part = lambda t, text=None, ref=None, w=None, h=None, s=None, p=None: (t, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "see <|image|> "), part("image", None, "a.png", 280, 57), part("audio", None, "b.wav", None, None, 1.5), None]),
        (1, 1, "assistant", [part("document", None, "c.pdf", None, None, None, 2), part("other", "ok")]),
        (2, 0, "assistant", None),
    ]
    got = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, form)).collect()}
    assert got[1].formatted == "<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|im_end|>\n<|im_start|>assistant\n<|document|>ok<|im_end|>\n"
    assert [tuple(a) for a in got[1].attachments] == [("image", "a.png", 30), ("audio", "b.wav", 38), ("document", "c.pdf", 1024)]
    assert got[1].expanded_tokens == 1092 and got[2].expanded_tokens == 0 and got[2].attachments == []
    span = got[1].loss_spans[0]
    assert got[1].formatted[span["from"] : span["to"]] == "<|document|>ok"
    assert got[1].learned == [False, True]


def test_native_plans(spark, sf_dir):
    """The native operators run no Python."""
    for name in ("op4_stateful_exact_dedup", "op5_url_link_graph", "op10_chat_formatting"):
        plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
