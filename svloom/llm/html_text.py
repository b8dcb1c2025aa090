"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks: text between block-level tags, with the path of open tags. A bidirectional LSTM in numpy reads one
vector per block (hashed tag path, hashed words, a few sizes) and labels every block with the whole page as context. It is trained here,
on generated pages of many layouts whose main text is known.

Pages are labelled together with others of about their length, as many as CELLS padded blocks allow, so a long page does not make short ones
long; what a page needs by itself is linear in its own length.

Edge cases: null and empty html give an empty text; unclosed and stray tags are tolerated; scripts, styles, comments and other
markup never are text, while what other elements hold (math, object, noscript and so on) is labelled like any block; a tag with a quote that
is never closed ends at its first ``>``; a script, style or comment that is never closed hides the rest of the page, as in browsers;
very long pages are read whole; repeated rows give repeated results; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, slices

# Element names of the HTML standard, by how they take part in layout.
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main menu meta nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul video audio canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: what an opening tag closes, when it is the innermost block
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSE_P = BLOCKS - {"br", "button", "iframe", "option", "optgroup", "select", "textarea", "video", "audio", "canvas", "link", "meta"}
START = re.compile(r"<(?:(!--)|(/?)([a-z][^\s/>]*)|[!?/])", re.I)
#: a tag's attributes up to its end, the first > outside of quotes
ATTRIBUTES = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
RAW = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

PATH, WORDS, EXTRA, HIDDEN = 96, 48, 8, 24
INPUT = PATH + WORDS + EXTRA
#: Blocks, with padding, that are labelled at once (one page at least); each takes some 2 kB.
CELLS = 1 << 14


class Ends:
    """Ends of a page's tags. A quote that is never closed makes a search run to the page's end; the first one that does has all ends
    worked out at once, from the last character that matters to the first, so the time stays linear."""

    def __init__(self, page: str):
        self.page = page
        self.known: dict[int, int] | None = None

    def after(self, at: int) -> int:
        """Where the tag that is open at this place ends: after the first > outside of quotes, or else after the first >; 0 without any."""
        if self.known is None:
            if m := ATTRIBUTES.match(self.page, at):
                return m.end()
            self.places = [m.start() for m in re.finditer("[>\"']", self.page)]
            self.known, later = {}, {}
            for i in range(len(self.places) - 1, -1, -1):
                p = self.places[i]
                c = self.page[p]
                if c == ">":
                    self.known[p] = p + 1
                else:
                    close = later.get(c)  # the next quote of this kind, and what follows it
                    following = self.places[close + 1] if close is not None and close + 1 < len(self.places) else None
                    self.known[p] = self.known[following] if following is not None else 0
                    later[c] = i
        i = bisect_left(self.places, at)
        return (self.known[self.places[i]] if i < len(self.places) else 0) or self.page.find(">", at) + 1


def tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name, closing, attributes) of each piece of markup; name None for comments, scripts, styles and declarations."""
    at, last, ends = 0, page.rfind(">"), Ends(page)
    while m := START.search(page, at):
        start, name = m.start(), (m[3] or "").lower()
        if m[1]:
            found = page.find("-->", m.end())
            at = found + 3 if found >= 0 else len(page)
            yield start, at, None, False, ""
        elif start > last:
            return  # nothing that follows has an end
        elif not name:
            at = page.find(">", m.end()) + 1
            yield start, at, None, False, ""
        else:
            at = ends.after(m.end())
            if name in RAW and not m[2]:
                closed = RAW[name].search(page, at)
                at = closed.end() if closed else len(page)
                yield start, at, None, False, ""
            else:
                yield start, at, name, bool(m[2]), page[m.end() : at - 1]


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of the text inside links) of each leaf block. Path entries are tag names with their class and id words."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, str]] = []  # name, entry
    parts: list[str] = []
    linked, total = 0, 0

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((tuple(e for _, e in stack if e), text, linked / max(1, total)))
            parts.clear()
        linked = total = 0

    at, links = 0, 0
    for start, end, name, closing, attributes in tokens(page):
        if start > at:
            text = html.unescape(page[at:start])
            parts.append(text)
            total += len(text)
            linked += len(text) * (links > 0)
        at = end
        if name is None:
            continue
        is_block = name in BLOCKS
        if is_block:
            flush()
        if closing:
            if name == "a":
                links = max(0, links - 1)
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            if is_block and stack:
                closes = CLOSES.get(name, ())
                inner = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCKS), None)
                if inner is not None and (stack[inner][0] in closes or stack[inner][0] == "p" and name in CLOSE_P):
                    del stack[inner:]
            if name == "a":
                links += 1
            words = " ".join(x for g in NAMES.findall(attributes) for x in g if x) if "=" in attributes else ""
            stack.append((name, f"{name} {words}".strip().lower() if is_block else ""))
    if at < len(page):
        parts.append(html.unescape(page[at:]))
        total += len(page) - at
    flush()
    return out


@lru_cache(20_000)
def path_vector(path: tuple[str, ...]) -> bytes:
    """Hashed words of the path; the innermost entries count most."""
    v = np.zeros(PATH, np.float32)
    for depth, entry in enumerate(reversed(path)):
        for k, word in enumerate(re.split(r"[^a-z0-9]+", entry)):
            if word:
                h = xxhash.xxh32_intdigest(("tag " if k == 0 else "name ") + word)
                v[h % PATH] += 1.0 if depth < 3 else 0.5
    return np.minimum(v, 2).tobytes()


def vectors(page: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """[blocks, INPUT]."""
    n = len(page)
    out = np.zeros((n, INPUT), np.float32)
    out[:, :PATH] = np.frombuffer(b"".join(path_vector(p) for p, _, _ in page), np.float32).reshape(n, PATH)
    words = [t.split() for _, t, _ in page]
    sizes = np.array([len(w) for w in words])
    hashes = np.fromiter((xxhash.xxh32_intdigest(w) for r in words for w in r), np.int64, int(sizes.sum())) % WORDS
    bag = np.bincount(np.repeat(np.arange(n), sizes) * WORDS + hashes, minlength=n * WORDS).reshape(n, WORDS)
    out[:, PATH : PATH + WORDS] = bag / np.sqrt(np.maximum(sizes, 1))[:, None]
    chars = np.array([len(t) for _, t, _ in page])
    ends = np.array([t[-1] in ".!?:;" for _, t, _ in page])
    place = (np.arange(n) + 0.5) / n
    out[:, PATH + WORDS :] = np.stack([np.log1p(sizes) / 3, np.log1p(chars) / 5, [x for _, _, x in page], ends, place, np.log1p(n) * np.ones(n) / 4, sizes > 12, np.ones(n)], 1)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def padded(pages: list[np.ndarray], backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """[time, page, INPUT] and which places are filled; backward: each page from its end."""
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), INPUT), np.float32), np.zeros((t, len(pages), 1), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p[::-1] if backward else p, 1
    return x, mask


def run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, keep: bool = False):
    """Hidden states [time, page, HIDDEN] of one direction; with keep also what training needs."""
    t, n, _ = x.shape
    gates = (x.reshape(t * n, INPUT) @ w).reshape(t, n, 4 * HIDDEN)
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    hs = np.empty((t, n, HIDDEN), np.float32)
    kept = []
    for k in range(t):
        g = gates[k] + h @ u
        s = sigmoid(g[:, : 3 * HIDDEN])
        z = np.tanh(g[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        before_c, before_h = c, h
        c = f * c + i * z
        tc = np.tanh(c)
        h = o * tc
        c, h = np.where(mask[k] > 0, c, before_c), np.where(mask[k] > 0, h, before_h)
        hs[k] = h
        if keep:
            kept.append((i, f, o, z, tc, before_c, before_h))
    return (hs, kept) if keep else hs


def back(dh_all: np.ndarray, x: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of one direction's weights."""
    t, n, _ = x.shape
    dg = np.zeros((t, n, 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for k in range(t - 1, -1, -1):
        i, f, o, z, tc, before_c, before_h = kept[k]
        m = mask[k]
        h_in = (dh + dh_all[k]) * m
        c_in = dc * m + h_in * o * (1 - tc * tc)
        g = np.concatenate([c_in * z * i * (1 - i), c_in * before_c * f * (1 - f), h_in * tc * o * (1 - o), c_in * i * (1 - z * z)], 1)
        dg[k] = g
        du += before_h.T @ g
        dh = g @ u.T + dh * (1 - m)
        dc = c_in * f + dc * (1 - m)
    return x.reshape(t * n, INPUT).T @ dg.reshape(t * n, 4 * HIDDEN), du


class Labeller:
    """Two LSTM directions and a logistic output."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.weights = [small(INPUT, 4 * HIDDEN), small(HIDDEN, 4 * HIDDEN), small(INPUT, 4 * HIDDEN), small(HIDDEN, 4 * HIDDEN), small(2 * HIDDEN, 1), np.zeros((1, 1), np.float32)]

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Log odds of main text, per block of each page."""
        w = self.weights
        fx, mask = padded(pages, False)
        forward = run(fx, mask, w[0], w[1])
        bx, _ = padded(pages, True)
        backward = run(bx, mask, w[2], w[3])
        return [(np.concatenate([forward[: len(p), i], backward[: len(p), i][::-1]], 1) @ w[4] + w[5])[:, 0] for i, p in enumerate(pages)]

    def learn(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int, rate: float, seed: int) -> None:
        """Adam on the mean log loss of the blocks."""
        rng = np.random.default_rng(seed)
        m, v = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), 32):
                which = order[a : a + 32]
                some = [pages[i] for i in which]
                w = self.weights
                fx, mask = padded(some, False)
                bx, _ = padded(some, True)
                (fh, fk), (bh, bk) = run(fx, mask, w[0], w[1], True), run(bx, mask, w[2], w[3], True)
                dfh, dbh = np.zeros_like(fh), np.zeros_like(bh)
                grads = [np.zeros_like(x) for x in w]
                n = sum(map(len, some))
                for i, (p, k) in enumerate(zip(some, which, strict=True)):
                    both = np.concatenate([fh[: len(p), i], bh[: len(p), i][::-1]], 1)
                    d = ((sigmoid((both @ w[4] + w[5])[:, 0]) - labels[k]) / n)[:, None].astype(np.float32)
                    grads[4] += both.T @ d
                    grads[5] += d.sum()
                    back_h = d @ w[4].T
                    dfh[: len(p), i], dbh[: len(p), i] = back_h[:, :HIDDEN], back_h[::-1, HIDDEN:]
                grads[0], grads[1] = back(dfh, fx, mask, w[1], fk)
                grads[2], grads[3] = back(dbh, bx, mask, w[3], bk)
                step += 1
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    w[j] -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)


# --- generated pages


def sentence(rng: random.Random, words: int) -> str:
    syllables = "an ber ca do en fi gu ha in jo ke lo mi ne or pa qui re sta tu un ve wo xi ya zen th er on ing".split()
    out = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join([out[0].capitalize(), *out[1:]]) + rng.choice([".", ".", ".", "!", "?", ""])


def generated(rng: random.Random) -> list[tuple[tuple[str, ...], str, float, bool]]:
    """Blocks of a made-up page, each with whether it is main text."""
    main = rng.choice(["<article>", "<article>", '<article class="post">', '<main>', '<div class="content">', '<div id="article-body">', '<section class="entry-content">', '<div class="main-text">'])
    close = "</" + re.match(r"<(\w+)", main)[1] + ">"
    say = lambda a, b: sentence(rng, rng.randint(a, b))
    items = lambda n: "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(n))
    paragraph = lambda: (f"<p><b>{say(1, 20)}<br><p>{say(3, 90)}</p>" if rng.random() < 0.25 else f"<p>{say(1, 90)}</p>")
    body = [f"<h1>{say(1, 12)}</h1>"] * (rng.random() < 0.9) + [paragraph() for _ in range(rng.randint(1, 14))]
    for extra in (f"<h2>{say(1, 8)}</h2>", f"<ul><li>{say(3, 20)}</li><li>{say(3, 20)}</li></ul>", f"<blockquote>{say(5, 40)}</blockquote>", f"<pre>{say(5, 40)}</pre>"):
        if rng.random() < 0.2:
            body.insert(rng.randint(1, len(body)), extra)
    noise_in = [f'<div class="ad">{say(2, 12)}</div>', f'<aside class="related"><h3>{say(1, 3)}</h3><ul>{items(3)}</ul></aside>', f'<form><label>{say(1, 4)}</label><button>{say(1, 2)}</button></form>', f'<div class="share">{say(1, 4)}</div>']
    top = [f"<header><h1>{say(1, 4)}</h1><p>{say(2, 8)}</p></header>", f"<nav><ul>{items(rng.randint(2, 9))}</ul></nav>", f'<div class="{rng.choice(["menu", "navbar", "breadcrumb"])}"><ul>{items(rng.randint(2, 6))}</ul></div>', f'<div class="{rng.choice(["ad", "ads", "banner", "sponsored", "promo"])}">{say(3, 30)}</div>', f'<div class="{rng.choice(["cookie-notice", "notice", "alert", "consent"])}"><p>{say(5, 30)}</p><button>{say(1, 2)}</button></div>', f'<form action="/s"><input type="text"><button>{say(1, 2)}</button><select><option>{say(1, 2)}</option></select></form>']
    low = [f'<aside class="sidebar"><h3>{say(1, 3)}</h3><p>{say(4, 40)}</p><ul>{items(4)}</ul></aside>', f'<div class="sidebar" id="side"><p>{say(4, 40)}</p></div>', f'<div class="{rng.choice(["comments", "comment-list", "replies"])}">' + "".join(f'<div class="comment"><p>{say(3, 60)}</p></div>' for _ in range(rng.randint(1, 4))) + "</div>", f'<section id="comments"><h2>{say(1, 2)}</h2><article class="comment"><p>{say(3, 60)}</p></article></section>', f'<div class="ad">{say(3, 30)}</div>', f"<footer><p>{say(2, 30)}</p></footer>", f"<footer>&copy; {say(2, 12)} &middot; {say(2, 30)}</footer>", f'<div class="newsletter"><form><p>{say(3, 20)}</p></form></div>']
    before = [x for x in top if rng.random() < 0.45] or [top[1]]
    after = [x for x in low if rng.random() < 0.35]
    rng.shuffle(before)
    rng.shuffle(after)
    inside = [(x, True) for x in body]
    for x in noise_in:
        if rng.random() < 0.15:
            inside.insert(rng.randint(1, len(inside)), (x, False))
    head = f"<!DOCTYPE html><html><head><title>{say(1, 12)}</title><style>p{{}}</style></head><body>"
    wrap = rng.random() < 0.3
    # marks make the label of each block readable from its text
    yes, no = "\ue000", "\ue001"
    mark = lambda x, y: re.sub(r">(?=[^<])", lambda m: ">" + (yes if y else no), x)
    page = mark(head, False) + '<div class="wrapper">' * wrap + "".join(mark(x, False) for x in before) + main + "".join(mark(x, y) for x, y in inside) + close + "".join(mark(x, False) for x in after) + "</div>" * wrap + "</body></html>" * (rng.random() < 0.9)
    out = []
    for path, text, share in blocks(page):
        clean = text.replace(yes, "").replace(no, "").strip()
        if clean:
            out.append((path, clean, share, yes in text))
    return out


@lru_cache(1)
def trained(pages: int = 640, epochs: int = 12, seed: int = 3) -> Labeller:
    """The labeller, from ``pages`` generated pages; the same for the same arguments."""
    rng = random.Random(seed)
    made = [generated(rng) for _ in range(pages)]
    model = Labeller(seed)
    model.learn([vectors([b[:3] for b in p]) for p in made], [np.array([b[3] for b in p], np.float32) for p in made], epochs, 0.01, seed)
    return model


def together(lengths: list[int]) -> Iterator[list[int]]:
    """Indices of pages with blocks, shortest first, in groups of at most CELLS blocks after padding to the longest."""
    group: list[int] = []
    for i in sorted((i for i, n in enumerate(lengths) if n), key=lengths.__getitem__):
        if group and (len(group) + 1) * lengths[i] > CELLS:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def extracted(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    model = model or trained()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 2 << 20):
                found = [blocks(x or "") for x in part.column("html").to_pylist()]
                texts = [""] * len(found)
                for which in together([len(b) for b in found]):
                    for i, s in zip(which, model.scores([vectors(found[i]) for i in which]), strict=True):
                        texts[i] = " ".join(t for (_, t, _), y in zip(found[i], s.tolist(), strict=True) if y > 0)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(label, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extracted(read_table(spark, sf_dir, "pages"))
