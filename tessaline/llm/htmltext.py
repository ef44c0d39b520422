"""Main text of web pages by a conditional random field over DOM leaf blocks."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm import common
from tessaline.llm.crf import Model

#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag closes, up to the nearest element that holds them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol menu dl table tbody thead tfoot select body article section main div nav aside header footer form blockquote".split())
ENDS_P = BLOCK - {"button", "label", "option", "body", "html", "head"}
LABELS = ("main", "rest")
MOST_LABELLED = 2000

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What ends a tag or begins a quoted value in it; the end of a comment; the end of an element whose content isn't markup.
IN_TAG = re.compile(r">|=\s*([\"'])")
COMMENT_END = re.compile(r"--!?>")
RAW_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PARTS = re.compile(r"[A-Za-z]+")
#: Letters of a tag's attributes in which names are looked for.
NAMED_LETTERS = 4096


class Block:
    """A leaf block: its text, its nearest block element, features of all its ancestors, its words and those within links."""

    __slots__ = ("text", "own", "up", "words", "linked")

    def __init__(self, text: str, own: str, up: frozenset, linked: int) -> None:
        self.text, self.own, self.up, self.words, self.linked = text, own, up, text.count(" ") + 1, linked


class Open:
    """An open element: name, nearest block element, features of it and its ancestors, and where on the stack the nearest
    block and the nearest element that holds or ends list items and cells lie."""

    __slots__ = ("name", "own", "up", "block_at", "hold_at")

    def __init__(self, name: str, names: set, below: Open | None, place: int, known) -> None:
        own, up, self.block_at, self.hold_at = ("none", frozenset(), -1, -1) if below is None else (below.own, below.up, below.block_at, below.hold_at)
        new = {f"name:{x}" for x in names} | ({f"up:{name}"} if name in BLOCK or name == "a" else set())
        # Ancestors that add nothing that the model knows share their features, however deep a page is nested.
        new = {x for x in new if known is None or x in known} - up
        self.name, self.up = name, up | new if new else up
        self.own = name if name in BLOCK else own
        if name in BLOCK:
            self.block_at = place
        if name in HOLDS or name in CLOSES:
            self.hold_at = place


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where a tag ends whose name ends at `at`: behind the first > outside quoted values, or at the end of the page.

    A value whose quote isn't closed anywhere ends the tag at the next >.
    """
    while m := IN_TAG.search(page, at):
        if not m[1]:
            return m.end()
        if last.setdefault(m[1], page.rfind(m[1])) < m.end():
            end = page.find(">", m.end())
            return end + 1 if end >= 0 else len(page)
        at = page.index(m[1], m.end()) + 1
    return len(page)


def blocks(page: str, known=None) -> list[Block]:
    """Leaf blocks in page order: runs of text between the edges of block elements, references decoded.

    White space inside a block becomes one space. Scripts, styles, titles, comments and other elements
    whose content isn't text are no blocks. Unclosed paragraphs, list items and cells end as browsers end them.
    Time is linear in the page. known: features of ancestors that are wanted (all, if none are given).
    """
    out: list[Block] = []
    stack: list[Open] = []
    count: Counter = Counter()
    buffer: list[str] = []
    last: dict[str, int] = {}
    linked = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append(Block(text, stack[-1].own if stack else "none", stack[-1].up if stack else frozenset(), min(linked, text.count(" ") + 1)))
            buffer.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            buffer.append(piece)
            if count["a"]:
                linked += len(piece.split())

    def cut(k: int) -> None:
        for x in stack[k:]:
            count[x.name] -= 1
        del stack[k:]

    def close(name: str) -> None:
        if count[name]:
            k = len(stack) - 1
            while stack[k].name != name:
                k -= 1
            if stack[-1].block_at >= k:
                flush()
            cut(k)

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        text(page[at:begin])
        sign = page[begin + 1 : begin + 2]
        if page.startswith("<!--", begin):
            end = COMMENT_END.search(page, begin + 2)
            at = end.end() if end else n
            continue
        if sign in ("!", "?") or sign == "/" and not page[begin + 2 : begin + 3].isalpha():
            at = page.find(">", begin) + 1 or n
            continue
        if sign == "/":
            m = NAME.match(page, begin + 2)
            if not m:  # a letter beyond ASCII
                at = page.find(">", begin) + 1 or n
                continue
            at = page.find(">", m.end()) + 1 or n
            name = m[0].lower()
            if name == "p" and not count["p"]:
                flush()
            elif name == "br":
                buffer.append(" ")
            close(name)
            continue
        m = NAME.match(page, begin + 1)
        if not m:
            text("<")
            at = begin + 1
            continue
        at = _tag_end(page, m.end(), last)
        name, told = m[0].lower(), page[m.end() : min(at, m.end() + NAMED_LETTERS)]
        if name in RAW:
            end = RAW_ENDS[name].search(page, at)
            at = end.end() if end else n
            if name in ("textarea", "iframe"):
                flush()
            else:
                buffer.append(" " * (name == "noscript"))
            continue
        if name in BLOCK:
            flush()
        if name in ENDS_P and stack and stack[-1].block_at >= 0 and stack[stack[-1].block_at].name == "p":
            cut(stack[-1].block_at)
        k = stack[-1].hold_at if stack and name in CLOSES else -1
        while k >= 0:
            if stack[k].name in CLOSES[name]:
                cut(k)
                break
            if stack[k].name in HOLDS:
                break
            k = stack[k - 1].hold_at if k else -1
        if name == "br":
            buffer.append(" ")
        elif name not in VOID and not page.endswith("/>", max(at - 2, 0), at) or name in BLOCK - VOID:
            names = {x.lower() for v in NAMED.findall(told) for x in PARTS.findall("".join(v[1:]))} if told else set()
            stack.append(Open(name, names, stack[-1] if stack else None, len(stack), known))
            count[name] += 1
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Of each block: tags and class names of its ancestors, its own tag, its text, and its neighbours' tags."""
    out = []
    n = len(page)
    seen_head = False
    for i, b in enumerate(page):
        own = b.own
        density = b.linked / b.words
        f = ["bias", f"own:{own}", *b.up]
        f += [f"words:{min(b.words.bit_length(), 7)}", f"links:{int(4 * density)}"]
        last = b.text[-1]
        if last in ".!?":
            f.append("sentence")
        elif last == ":":
            f.append("colon")
        if "©" in b.text or "copyright" in b.text.lower():
            f.append("copyright")
        if "»" in b.text or "·" in b.text:
            f.append("bars")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        if seen_head:
            f.append("after-h1")
        seen_head = seen_head or own == "h1"
        for k, where in ((i - 1, "before"), (i + 1, "after")):
            if 0 <= k < n:
                f += [f"{where}:{page[k].own}", f"{where}-words:{min(page[k].words.bit_length(), 7)}"]
        out.append(f)
    return out


def seed_pages(n: int = 600, seed: int = 11) -> list[tuple[str, list[str]]]:
    """A small labelled table: invented pages with the label of each leaf block, made by rule."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a, b: some(a, b).capitalize() + rng.choice("...!?")
    rows = []
    for _ in range(n):
        labels: list[str] = []
        parts: list[str] = []

        def put(markup: str, *given: str) -> None:
            parts.append(markup)
            labels.extend(given)

        def links(k: int, wrap: str = "li") -> tuple[str, int]:
            return "".join(f'<{wrap}><a href="/{word()}">{some(1, 3)}</a></{wrap}>' for _ in range(k)), k

        def rest(kind: str) -> None:
            if kind == "nav":
                inner, k = links(rng.randint(2, 8))
                tag = rng.choice(['<nav><ul>%s</ul></nav>', '<div class="menu"><ul>%s</ul></div>', '<ul class="nav navbar">%s</ul>', '<div id="navigation">%s</div>', '<nav class="breadcrumb"><ol>%s</ol></nav>'])
                put(tag % inner, *["rest"] * k)
            elif kind == "header":
                put(rng.choice(["<header><div>%s</div></header>", '<div class="header top">%s</div>', '<div id="masthead"><span>%s</span></div>', '<header class="site-header"><p>%s</p></header>']) % some(1, 6), "rest")
            elif kind == "footer":
                put(rng.choice(["<footer>%s</footer>", "<footer><p>%s</p></footer>", '<div class="footer">%s</div>', '<div id="footer"><p>%s</p></div>']) % (rng.choice(["&copy; ", "Copyright ", ""]) + some(3, 20) + rng.choice([" &middot; " + some(2, 10), "", "."])), "rest")
            elif kind == "ad":
                put(rng.choice(['<div class="ad">%s</div>', '<div class="ads sponsored"><p>%s</p></div>', '<aside class="advert">%s</aside>', '<div id="banner-promo">%s</div>', '<div class="advertisement">%s</div>', '<ins class="adsbygoogle">%s</ins>']) % sentence(2, 18), "rest")
            elif kind == "side":
                inner, k = links(rng.randint(1, 6))
                put(rng.choice(["<aside><h3>%s</h3><ul>%s</ul></aside>", '<div class="sidebar"><h4>%s</h4><ul>%s</ul></div>', '<div class="related widget"><h3>%s</h3><ul>%s</ul></div>', '<section class="recommended"><h2>%s</h2><ul>%s</ul></section>']) % (some(1, 4), inner), *["rest"] * (k + 1))
            elif kind == "sideText":
                put(rng.choice(["<aside><p>%s</p></aside>", '<div class="sidebar"><p>%s</p></div>', '<aside class="sidebar">%s</aside>']) % sentence(5, 30), "rest")
            elif kind == "notice":
                put(rng.choice(['<div class="cookie notice">%s</div>', '<div class="alert banner"><p>%s</p></div>', '<div id="consent" role="dialog"><p>%s</p></div>', '<div class="cookie-banner">%s</div>', '<div class="notice"><p>%s</p></div>', '<div class="popup modal newsletter">%s</div>']) % sentence(5, 30), "rest")
            elif kind == "form":
                put(rng.choice(["<form><label>%s</label><input name=q><button>%s</button></form>", '<form class="newsletter subscribe"><p>%s</p><button type="submit">%s</button></form>', '<form action="/s"><p>%s</p><select><option>%s</option></select></form>']) % (some(1, 12), some(1, 2)), "rest", "rest")
            elif kind == "share":
                inner, k = links(rng.randint(2, 5), "span")
                put(f'<div class="{rng.choice(["share social", "share-buttons", "tags meta"])}">{inner}</div>', "rest")
            elif kind == "comments":
                k = rng.randint(1, 5)
                box, one = rng.choice([("<section id=\"comments\"><h3>%s</h3>%s</section>", "<p>%s</p>"), ('<div class="comments"><h2>%s</h2>%s</div>', '<div class="comment"><p>%s</p></div>'), ('<ol class="commentlist replies"><li>%s</li>%s</ol>', "<li>%s</li>"), ('<section class="comments"><h3>%s</h3>%s</section>', '<article class="comment"><p>%s</p></article>'), ('<div id="disqus_thread" class="discussion"><h3>%s</h3>%s</div>', "<p>%s</p>"), ('<div class="responses"><h4>%s</h4>%s</div>', '<div class="response user"><p>%s</p></div>'), ('<div class="feedback reactions"><h3>%s</h3>%s</div>', '<div class="reply"><p>%s</p></div>'), ('<ul class="talkback thread"><li>%s</li>%s</ul>', "<li><p>%s</p></li>")])
                said = "".join(one % " ".join(sentence(4, 25) for _ in range(rng.randint(1, 2))) for _ in range(k))
                if rng.random() < 0.3:  # without a heading
                    put(re.sub(r"<(h\d|li)>%s</\1>", "", box, count=1) % said, *["rest"] * k)
                else:
                    put(box % (some(1, 3), said), *["rest"] * (k + 1))

        def prose() -> str:
            if rng.random() < 0.2:  # without sentences: lists of words, bare words, one word again and again
                return rng.choice([some(1, 60), " | ".join(word() for _ in range(rng.randint(2, 40))), " ".join([word()] * rng.randint(2, 40)), some(2, 30).upper() + "!!"])
            return " ".join(sentence(1, 30) for _ in range(rng.randint(1, 5)))

        def body() -> tuple[str, list[str]]:
            inner, got = [], []
            if rng.random() < 0.8:
                inner.append(f"<h1>{some(3, 12).capitalize()}</h1>")
                got.append("main")
            for _ in range(rng.randint(1, 9)):
                kind = rng.random()
                lead = rng.choice(["", "", "<b>%s</b> " % some(1, 4), '<a href="/x">%s</a> ' % some(1, 2), "<em>%s</em> " % some(1, 2)])
                if kind < 0.62:
                    inner.append(f"<p>{lead}{prose()}" + rng.choice(["</p>", "</p>", "<br>"]))
                    got.append("main")
                elif kind < 0.7:
                    inner.append(f"<p>{sentence(1, 6)}</p>")
                    got.append("main")
                elif kind < 0.78:
                    inner.append(f"<h{rng.choice('234')}>{some(2, 7).capitalize()}</h2>".replace("</h2>", ""))
                    inner[-1] += f"</{inner[-1][1:3]}>"
                    got.append("main")
                elif kind < 0.84:
                    k = rng.randint(2, 4)
                    tag = rng.choice(["ul", "ol"])
                    inner.append(f"<{tag}>" + "".join(f"<li>{sentence(3, 15)}</li>" for _ in range(k)) + f"</{tag}>")
                    got += ["main"] * k
                elif kind < 0.88:
                    inner.append(f"<blockquote><p>{sentence(5, 30)}</p></blockquote>")
                    got.append("main")
                elif kind < 0.91:
                    inner.append(f"<pre>{some(3, 12)}</pre>")
                    got.append("main")
                elif kind < 0.94:
                    inner.append(f"<table><tr><td>{some(1, 4)}</td><td>{some(1, 4)}</td></tr></table>")
                    got += ["main", "main"]
                elif kind < 0.97:
                    inner.append(f"<figure><img src=x><figcaption>{sentence(3, 12)}</figcaption></figure>")
                    got.append("main")
                else:
                    inner.append(rng.choice(['<div class="ad">%s</div>', '<aside class="related"><p>%s</p></aside>', '<div class="share"><p>%s</p></div>']) % sentence(2, 12))
                    got.append("rest")
            return "".join(inner), got

        if rng.random() < 0.2:  # short pages, often of nothing but the article
            for kind in ("nav", "footer", "ad"):
                if rng.random() < 0.15:
                    rest(kind)
            k = rng.randint(1, 3)
            shape = rng.choice(["<article><p>%s</p></article>", "<article>%s</article>", "<p>%s</p>", "<div>%s</div>", "%s", "<main><p>%s</p></main>", "<body><p>%s</p></body>", "<section><p>%s</p></section>", "<article><h1>%s</h1></article>"])
            inner = [prose() for _ in range(k)] if "<p>" in shape else [prose()]
            put(shape % "</p><p>".join(inner), *["main"] * len(inner))
            if rng.random() < 0.15:
                rest("footer")
            rows.append((rng.choice(["%s", "%s", "<html><body>%s</body></html>", "<!DOCTYPE html><html><head><title>t</title></head><body>%s"]) % "".join(parts), labels))
            continue
        for kind in ("header", "nav", "notice", "ad", "form", "side"):
            if rng.random() < (0.7 if kind == "nav" else 0.35):
                rest(kind)
        inner, got = body()
        if rng.random() < 0.25:  # readers' comments within the article's element
            before, told = len(parts), len(labels)
            rest("comments")
            inner += "".join(parts[before:])
            got = got + labels[told:]
            del parts[before:], labels[told:]
        wrap = rng.choice(["<article>%s</article>", "<article>%s</article>", "<main><article>%s</article></main>", "<main>%s</main>", '<div class="content post">%s</div>', '<div id="content"><div class="entry article">%s</div></div>', '<article class="post">%s</article>', '<section class="story">%s</section>', '<div class="wrapper"><div class="main">%s</div></div>', "<div>%s</div>"])
        put(wrap % inner, *got)
        for kind in ("share", "comments", "side", "sideText", "ad", "nav", "form", "footer", "notice"):
            if rng.random() < (0.75 if kind == "footer" else 0.3):
                rest(kind)
        close = rng.choice(["</body></html>", "", "</body></html>"])
        rows.append((f"<!DOCTYPE html><html><head><title>{some(2, 6)}</title><style>p{{margin:0}}</style></head><body>{''.join(parts)}{close}", labels))
    return rows


def seed_table(spark: SparkSession) -> DataFrame:
    """The labelled table as rows (html, labels)."""
    return spark.createDataFrame(seed_pages(), "html string, labels array<string>")


def train(labelled: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fits on at most `most` rows (html, labels), the smallest by hash; rows whose labels don't fit the blocks are left out."""
    rows = labelled.where("html is not null and labels is not null").orderBy(F.xxhash64("html"), F.xxhash64("labels")).limit(most).collect()
    given = [(features(blocks(r[0])), r[1]) for r in rows]
    given = [(f, y) for f, y in given if f and len(f) == len(y) and set(y) <= set(LABELS)]
    model = Model(LABELS)
    return model.fit(*zip(*given), rounds=120) if given else model


def main_texts(model: Model, pages: list[str]) -> list[str]:
    """The blocks labelled main of each page, joined by line feeds."""
    known = {f for f in model.index if f.startswith(("up:", "name:"))}
    parsed = [blocks(p, known) for p in pages]
    length = np.array([len(p) for p in parsed], np.int64)
    label = model.decode(model.emissions([f for p in parsed for f in features(p)]), length)
    begin = np.cumsum(length) - length
    return ["\n".join(b.text for b, y in zip(p, label[s : s + len(p)]) if y == 0) for p, s in zip(parsed, begin)]


def extract(pages: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars): the main text of each page, from its whole html.

    The field is trained on `labelled` (html, labels; else the small table above) and decoded by Viterbi.
    A null or empty html has an empty text; null and repeated ids are rows like others; an empty table
    gives no rows; with an empty labelled table every block is main. Other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train(seed_table(pages.sparkSession) if labelled is None else labelled))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in common.slices(batch, "text", common.SLICE_BYTES // 4):
                texts = main_texts(model, [x or "" for x in part.column("text").to_pylist()])
                yield pa.record_batch([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, f"{id_col} long, {url_col} string, text string, n_chars long")
