"""Main text of web pages by site style trees.

All pages of a host are merged into one tree of element paths. Each text block adds, below its
path, its style (the inline tags it is made of) and its content; the content is a node of its
own below the path and below every branch above it, up to the body, main or article. The entropy
of style and content over the pages of the host tells how important a node is: what looks and
reads alike on every page is not. A branch is noise when all that is below it is, so it goes
with its leaves. The tree is built over all blocks. Elements that are menus, notices and the
like by element or class name go besides, on every host: adverts and menus often differ from
page to page, and single pages of small hosts show no entropy.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from paymend.llm.batches import chunks, emit, map_chunks
from paymend.sources.scratch import materialise

#: Weight of content against style, importance below which a node is noise, pages with different content that a host must show before its entropies count.
CONTENT, NOISE, LEAST_PAGES = 0.9, 0.3, 5
#: Share of a page's characters, longest blocks first, that tells it from other pages.
SAME = 2 / 3
#: What a row of the tree counts: a style of a path, a content of a path or of a branch above it, a page that has the path. The root stands for the host.
STYLE, LEAF, BRANCH, PAGE, ROOT = 0, 1, 2, 3, 0
#: Elements above which contents of different branches are not compared.
TRUNK = frozenset(("html", "body", "main", "article"))
#: Elements that never hold main text. Fixed values from the HTML standard.
DEAD = frozenset("head script style noscript template title nav footer aside form button select option textarea input label iframe object svg canvas dialog menu audio video map datalist".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Elements without end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are part of a line of text; all others end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements of a head. Any other start tag, or text, ends an open head.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Whole tokens of class, id or role that mark page furniture, a number at their end aside.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer "
    "discussion disqus dropdown footer header legal login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination paywall "
    "popup promo promoted promotion recommended related replies reply search share sharing sidebar signup site-header site-footer social sponsor sponsored "
    "subscribe subscription toolbar topbar widget widgets complementary contentinfo alert alertdialog feedback "
    "ad-banner ad-container ad-slot ad-unit comment-list cookie-banner cookie-consent cookie-notice main-menu page-footer page-header related-articles "
    "related-posts share-buttons social-links social-share".split()
)
#: Two-part tokens mark as well, in either order: what it is, and the frame it stands in. ``has-sidebar`` or ``search-content`` are none of them.
_WHAT = "ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies consent menu nav navbar navigation newsletter pagination promo related share sharing sidebar social sponsored subscribe".split()
_FRAME = "area bar block box bottom container inner item items link links list main page panel post primary secondary section site slot top unit wrap wrapper".split()
COMPOUND = frozenset(f"{a}-{b}" for what in _WHAT for frame in _FRAME for a, b in ((what, frame), (frame, what)))
#: Marks of what readers wrote, which may well be most of a page.
READERS = frozenset(t for t in FURNITURE | COMPOUND if {"comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "feedback"} & set(t.split("-")))
#: Those of the marks that mean nothing inside an article, where a header holds the title.
HEADERS = frozenset(("header", "masthead", "page-header"))
_MARKS = FURNITURE | COMPOUND
_INSIDE = _MARKS - HEADERS
_HEADINGS = frozenset(("h1", "h2", "h3"))
#: Elements that close an open paragraph.
_CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split())
#: A quoted value starts right after the equals sign; elsewhere in a tag a quote is a character like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|\S+))?")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[^a-z]+")
_NUMBER = re.compile(r"[-_]*[0-9]+\Z")
_JOINT = re.compile("[-_]+")


def blocks(page: str | None) -> list[tuple[str, bool, str, str]]:
    """(path, furniture, style, text) of each text block of a page, in order.

    A path has element names and the letters of their classes; ``furniture`` says that an
    element on it holds no main text by its name. A class, id or role never marks html, body,
    main, article or what one of the last two stands in, nor does a form around them; only an
    article inside an article (a comment, in the HTML standard) leaves the marks between the
    two. On a page without article and main a marked element or form that has a heading or two
    paragraphs and over half of the text holds the article, so its mark does not count, unless it
    names readers' comments. Null and empty pages have no blocks; a page that ends in the middle of a tag ends there.
    """
    page = page or ""
    # name, path, furniture by element, numbers of the marks by class, id or role on the path, in an article or main, in an article
    stack: list[tuple[str, str, bool, tuple[int, ...], bool, bool]] = []
    out, text, style = [], [], []
    lifted: set[int] = set()  # marks on what holds an article or main
    readers: set[int] = set()  # marks of comments
    made = at = 0
    told = False  # the page has an article or main

    def flush() -> None:
        if text:
            whole = "".join(text)
            whole = _SPACE.sub(" ", html.unescape(whole) if "&" in whole else whole).strip()
            if whole:
                out.append((*(stack[-1][1:4] if stack else ("", False, ())), ".".join(style), whole, stack[-1][0] if stack else ""))
            text.clear()
        style.clear()

    def close(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                flush()
                del stack[i:]
                return

    def leave_head(words: str) -> None:
        if stack and stack[-1][0] == "head" and not words.isspace():
            flush()
            stack.pop()

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            leave_head(page[at:])
            text.append(page[at:])
            break
        if start > at:
            leave_head(page[at:start])
            text.append(page[at:start])
        found = _TOKEN.match(page, start)
        if not found:  # a lone sign
            leave_head("<")
            text.append("<")
            at = start + 1
            continue
        at = found.end()
        name = found[1]
        if not name:
            continue
        name, closing = name.lower(), found[0][1] == "/"
        if not closing and name not in HEAD:
            leave_head(name)
        if name in INLINE:
            if name in ("br", "wbr", "img"):
                text.append(" " if name == "br" else "")
            if not closing:
                style.append(name)
            continue
        if closing:
            close(name)
            if name == "p":
                flush()
            continue
        flush()
        if name in _CLOSE_P and stack and stack[-1][0] == "p":
            stack.pop()
        while stack and stack[-1][0] == name and name in ("li", "dd", "dt", "tr", "td", "th", "option", "p"):
            stack.pop()
        if name in VOID or found[2].rstrip().endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\s*(?:>|\\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        tokens, marks, role = set(), [], ""
        for key, value in _ATTR.findall(found[2]) if found[2] else ():
            key = key.lower()
            if key not in ("class", "id", "role"):
                continue
            value = (value.strip(value[0]) if value[:1] in ("'", '"') else value).lower()
            tokens.update(_JOINT.sub("-", _NUMBER.sub("", t)) for t in value.split())
            if key == "role":
                role = value.strip()
            if key != "id":
                marks += [w for w in _NAME.split(value) if w]
        _, path, dead, names, inside, nested = stack[-1] if stack else ("", "", False, (), False, False)
        own = ".".join([name, *marks])
        main, article = name == "main" or role == "main", name == "article" or role == "article"
        if main or article and not nested:
            told = True
            lifted.update(names)
            names, dead = (), dead and not main  # HTML has no main in a menu, footer or the like: one that was not closed ends here
        elif name == "form" or name not in ("html", "body") and tokens & (_INSIDE if inside else _MARKS):
            made += 1
            names = (*names, made)
            if tokens & READERS:
                readers.add(made)
        dead = dead or name != "form" and name in DEAD or name == "header" and not inside
        stack.append((name, f"{path}/{own}" if path else own, dead, names, inside or main or article, nested or article))
    flush()
    if not told and made:
        lifted.update(_holders(out) - readers)
    return [(path, dead or not lifted.issuperset(names), style, text) for path, dead, names, style, text, _ in out]


def _holders(out: list[tuple[str, bool, tuple[int, ...], str, str, str]]) -> set[int]:
    """Marks on what has more than half of the text, and a heading or two paragraphs."""
    size, weight, whole = {}, {}, 0
    for _, dead, names, _, text, name in out:
        if not dead:
            whole += len(text)
            for k in names:
                size[k] = size.get(k, 0) + len(text)
                weight[k] = weight.get(k, 0) + (2 if name in _HEADINGS else name == "p")
    return {k for k, n in size.items() if 2 * n > whole and weight[k] >= 2}


def host_of(url: str | None) -> str:
    """Host of a url, A-Z lower-cased; empty without one, so such pages form one site."""
    rest = (url or "").partition("://")[2]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), re.split(r"[/?#]", rest, maxsplit=1)[0])


def _hash(text: str) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))))


def _branches(path: str) -> list[str]:
    """A path and the branches above it, below the last of html, body, main and article."""
    names = path.split("/")
    top = max((i for i, n in enumerate(names) if n.partition(".")[0] in TRUNK), default=-1)
    return [path, *("/".join(names[:i]) for i in range(len(names) - 1, top + 1, -1))]


def _content(node: str, text: str) -> int:
    return _hash(f"{node}\n{text}")


def _article(texts: list[str]) -> int:
    """Hash of the longest of a page's texts that make up ``SAME`` of its characters."""
    texts = sorted(texts, key=lambda t: (-len(t), t))
    most, n = SAME * sum(map(len, texts)), 0
    while n < len(texts) and most > 0:
        most -= len(texts[n])
        n += 1
    return _hash("\n".join(texts[:n]))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, noise): per host the hashes of the paths, and of the contents below a path or branch, whose importance is low.

    A path is judged by all its styles and contents over the pages that have it, a content by the
    pages of the host that have it, counted exactly: of M pages it may stand on M ** (1 - NOISE).
    Pages of a host that share the longest blocks, two thirds of their text, are one page here, so
    copies of an article do not make it look like furniture, nor does one long notice join all pages. Counting is by (host, path, value) with partial sums:
    a host with a third of all pages has no larger groups than others have values.
    """
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("kind", pa.int8()), ("value", pa.int64()), ("page", pa.int64())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            rows = set()
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                own = blocks(page)
                if own:
                    host, name = host_of(url), _article([b[3] for b in own if not b[1]])
                    rows.add((host, ROOT, PAGE, 0, name))
                    for path, _, style, text in own:
                        at = _hash(path)
                        rows.add((host, at, PAGE, 0, name))
                        rows.add((host, at, STYLE, _hash(style), name))
                        leaf, *above = _branches(path)
                        rows.add((host, at, LEAF, _content(leaf, text), name))
                        rows.update((host, ROOT, BRANCH, _content(node, text), name) for node in above)
            yield emit(schema, **dict(zip(schema.names, zip(*sorted(rows)) if rows else [[]] * 5)))

    rows = pages.select("url", "html").mapInArrow(parts, "host string, path long, kind byte, value long, page long").distinct()
    values = materialise(rows.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("k")), "site-values")
    sizes = values.where((F.col("kind") == PAGE) & (F.col("k") >= LEAST_PAGES)).withColumn("lm", F.log(F.col("k").cast("double")))
    # Style: entropy over the variants, zero for one. Content: one less the mean entropy of a value's spread over pages.
    # Only sums leave the tasks, so a host with a third of all pages costs no task more than others.
    total = values.where(F.col("kind").isin(STYLE, LEAF)).groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == STYLE, F.col("k"))).alias("n"),
        F.sum(F.when(F.col("kind") == STYLE, F.col("k") * F.log("k"))).alias("klogk"),
        F.count(F.when(F.col("kind") == STYLE, 1)).alias("styles"),
        F.avg(F.when(F.col("kind") == LEAF, F.log("k"))).alias("mean_log"),
    )
    total = total.join(sizes.select("host", "path", "lm"), ["host", "path"])
    shape = F.least(F.lit(1.0), (F.log("n") - F.col("klogk") / F.col("n")) / F.col("lm"))
    spread = F.least(F.lit(1.0), F.col("mean_log") / F.col("lm"))
    weight = F.pow(F.lit(CONTENT), F.col("styles"))
    paths = total.select("host", F.col("path").alias("node"), ((1 - weight) * shape + weight * (1 - spread)).alias("importance"))
    # A content has one style, so only its spread counts. Contents on a single page are left out before the join.
    often = values.where(F.col("kind").isin(LEAF, BRANCH) & (F.col("k") > 1))
    often = often.join(sizes.where(F.col("path") == ROOT).select("host", "lm"), "host")
    contents = often.select("host", F.col("value").alias("node"), (1 - F.log("k") / F.col("lm")).alias("importance"))
    return paths.unionByName(contents).where(F.col("importance") < NOISE).groupBy("host").agg(F.collect_set("node").alias("noise"))


def _noisy(path: str, text: str, low: set[int]) -> bool:
    return _hash(path) in low or any(_content(node, text) in low for node in _branches(path))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of ``pages``: the blocks that stay, joined by line feeds.

    Null and empty html give an empty text. Repeated rows get equal rows; pages with a null or
    odd url count as one site. Other columns are ignored. The planner joins the noise lists by
    broadcast while they are small and by shuffle, hot hosts split, beyond.
    """
    rows = pages.select("page_id", "url", "html")
    noise = materialise(style_tree(rows), "noise")
    # The same host rule as in the tasks: from the scheme to the first of / ? #, A-Z lower-cased.
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(F.coalesce(after, F.lit("")), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    joined = rows.withColumn("host", host).join(noise, "host", "left").select("page_id", "url", "html", "noise")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for page, low in zip(batch.column("html").to_pylist(), batch.column("noise").to_pylist()):
            low = set(low or ())
            texts.append("\n".join(t for path, dead, _, t in blocks(page) if not dead and not (low and _noisy(path, t, low))))
        return emit(schema, page_id=batch.column("page_id"), url=batch.column("url"), text=texts)

    return map_chunks(joined, work, "page_id long, url string, text string", "html")
