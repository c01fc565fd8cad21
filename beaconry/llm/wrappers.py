"""Main text of web pages by inferred wrappers.

A page is a stream of block tags and texts. The streams of one host are aligned one after the other into a union-free
regular expression: equal parts stay, what only some pages have becomes optional, what follows itself becomes a
repeated group, and texts become slots that remember whether they were always the same. A page that marks its article is
read by that mark alone. Every other page is read through its host's wrapper, whatever the host's other pages mark:
slots of links and slots of the template are left out.
"""

from __future__ import annotations

import functools
import hashlib
import html
import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import batches, cut, table, texts_of
from beaconry.llm.graph import hinted

#: Wrappers of so many hosts are held in a task before they are sent on; groups a hot host's wrappers meet in first.
HELD_HOSTS, SPLITS = 5_000, 32

# Elements of HTML by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt "
                   "ruby s samp small source span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "select", "object", "canvas", "math")
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                     "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
                 "th": ("tr", "table"), "option": ("select",)}
OUTSIDE = frozenset("nav header footer aside head button dialog menu fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox banner sponsor sponsored promo promoted promotion "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments respond reply replies disqus discussion cookie "
    "cookies notice notices consent gdpr popup modal overlay newsletter subscribe subscription share sharing social related "
    "recommended widget widgets footer foot masthead login signup toolbar pagination pager skip hidden copyright disclaimer "
    "alert".split())
#: Names that articles use too: they count where the wrapper bears them out.
UNSURE_NAMES = frozenset("alert banner comment copyright discussion disclaimer foot menu notice notices overlay promotion related reply replies "
                         "respond share sharing skip social subscription widget widgets".split())
#: Places in a layout, which may be what holds the article; readers' comments, consents and the like may outweigh it.
LAYOUT_NAMES = frozenset("alert banner foot footer form masthead menu nav navbar navigation notice notices promo promotion sidebar social toolbar "
                         "widget widgets".split())
#: Words of layout that may stand before such a name, and after it, in one class.
BEFORE_NAMES = frozenset("site page main top bottom global post entry article".split())
AROUND_NAMES = frozenset("box block container wrapper wrap area section slot unit list bar button buttons link links inner outer item".split())
NEVER_NAMED = frozenset("html body main article".split())

#: An attribute's quoted value; one with a tag in it is short, so an open quote is not searched for through the whole page.
_QUOTED = "|".join(f"{q}(?:[^{q}<]*+|[^{q}]{{0,500}}){q}" for q in ('"', "'"))
_LEXER = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<[!?][^>]*>"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:{_QUOTED}|[^'\"<>])*+)>", re.S | re.I)
#: Elements nested deeper stay part of the one at this depth; their texts are blocks there.
DEEPEST = 150
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS, _SPACE, _NAMES = re.compile(r"\d+"), re.compile(r"\s+"), re.compile(r"[^a-z]+")

TEXT, LINKS = "#", "#a"  # text, and text mostly in links
#: Elements that say nothing of what they hold: they are alike only if they hold the same kinds of parts.
GENERIC = frozenset(("div", "section", "td"))


def _label(tag: str, attributes: str) -> str:
    """A tag with what of its attributes tells its role; numbers in them are alike."""
    if not attributes or attributes.isspace():
        return tag
    kept = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).strip().lower()
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                kept.append("!hidden")
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            kept.append("!hidden")
        elif name == "role":
            kept.append(f"@{value}")
        elif name == "itemprop":
            if value == "articlebody":
                kept.append("@main")
        elif name != "aria-hidden" and value:
            kept.append(_DIGITS.sub("0", value))
    return f"{tag} {' '.join(kept)}" if kept else tag


def parse(page: str) -> list:
    """The page's blocks as a tree of [label, children]; a text is ["#", text], mostly in links ["#a", text]."""
    # Nothing behind the last ">" is a tag, and only a comment can begin there.
    end = page.rfind(">") + 1
    before, comment, rest = page[end:].partition("<!--")
    page = page[:end] + before.replace("<", "&lt;") + comment + rest
    root: list = ["", []]
    stack, buffer = [root], []
    deep: list[str] = []
    links, in_link, at = 0, 0, 0

    def end_text() -> None:
        nonlocal links
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                stack[-1][1].append([LINKS if 2 * links > len(text) else TEXT, text])
            buffer.clear()
        links = 0

    def close(tag: str, until: tuple[str, ...] = ()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            name = stack[i][0].partition(" ")[0]
            if name == tag:
                end_text()
                del stack[i:]
                return
            if name in until:
                return

    for m in _LEXER.finditer(page):
        if m.start() > at:
            raw = page[at:m.start()]
            buffer.append(raw)
            if in_link:
                links += len(raw)
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag, ends = tag.lower(), bool(m.group(2))
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if ends:
            in_link = 0
            if tag in deep:
                end_text()
                del deep[len(deep) - 1 - deep[::-1].index(tag):]
            elif tag == "p" and not any(s[0].partition(" ")[0] == "p" for s in stack):
                end_text()
            else:
                close(tag)
            continue
        end_text()
        in_link = 0
        if tag in CLOSES_P:
            close("p", ("td", "th", "table", "button"))
        if tag in CLOSES_ITSELF:
            close(tag, CLOSES_ITSELF[tag])
            if tag in ("dt", "dd"):
                close("dd" if tag == "dt" else "dt", ("dl",))
        if tag in EMPTY:
            continue
        if tag in ("html", "body") and len(stack) > 1 and any(s[0].partition(" ")[0] == tag for s in stack):
            continue
        if len(stack) > DEEPEST:
            if len(deep) < DEEPEST and tag not in CLOSES_ITSELF and tag != "p":
                deep.append(tag)
            continue
        node = [_label(tag, m.group(4)), []]
        stack[-1][1].append(node)
        if not (m.group(4) or "").rstrip().endswith("/") or tag in CLOSES_P:
            stack.append(node)
    if at < len(page):
        buffer.append(page[at:])
    end_text()
    return root


# A wrapper node: [label, optional, repeated, children, statistics]. Texts have no children; a group has the label "(" and
# a sequence of nodes. Statistics of a text: the smallest hashes of contents of pages that have it, of all pages and of those
# that mark no article, then smallest and largest hash of what it said. The root has the first two, of the host's pages.

GROUP = "("


def _shape(label: str, parts: set[str]) -> str:
    return f"{label}[{','.join(sorted(parts))}]" if label.partition(" ")[0] in GENERIC else label


def _parts(nodes: list[list]) -> set[str]:
    return {x for n in nodes for x in (_parts(n[3]) if n[0] == GROUP else (n[0],))}


def _key(node: list) -> str:
    """What two nodes must have in common to be one."""
    return GROUP + ",".join(_key(c) for c in node[3]) if node[0] == GROUP else _shape(node[0], _parts(node[3]))


def _text_hash(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:12]


def _content(node: list) -> Iterator[str]:
    """Texts of a page by which it is another than the host's other pages."""
    if node[0] == TEXT:
        yield node[1]
    elif node[0] != LINKS and not (node[0] and (outside(node[0], True) or listed(node[0]))):
        for c in node[1]:
            yield from _content(c)


def content_hash(page: list) -> str | None:
    """What tells a parsed page from the host's other pages; None if it has no text at all."""
    content = "\n".join(_content(page)) or "\n".join(_all_texts(page))
    return hashlib.md5(content.encode("utf-8", "surrogatepass")).hexdigest() if content else None


def _all_texts(node: list) -> Iterator[str]:
    if node[0] in (TEXT, LINKS):
        yield node[1]
    else:
        for c in node[1]:
            yield from _all_texts(c)


def wrapper_of(node: list) -> list:
    """A parsed page, or a part of it, alone as a wrapper: its repeated parts are groups already.

    A slot ends with the numbers it bears, whether a page is known to have it, and the least and greatest hash of its texts.
    """
    if node[0] in (TEXT, LINKS):
        h = _text_hash(node[1])
        return [node[0], 0, 0, [], [[], 1, h, h]]
    return [node[0], 0, 0, folded([wrapper_of(c) for c in node[1]]), []]


def merged(a: list, b: list) -> list:
    """The wrapper of both, which have one key."""
    stats = a[4]
    if stats:
        x, y = a[4], b[4]
        stats = [x[0] + y[0], x[1] | y[1], min(x[2], y[2]), max(x[3], y[3])]
    return [a[0], a[1] | b[1], a[2] | b[2], aligned(a[3], b[3]), stats]


def folded(nodes: list[list]) -> list[list]:
    """Parts that follow themselves, alone or as sequences of two or three, become repeated."""
    out = nodes
    for period in (1, 2, 3):
        keys, done, i = [_key(n) for n in out], [], 0
        while i < len(out):
            j = i + period
            if period > 1 and len(set(keys[i:j])) == 1 or keys[i:j] != keys[j:j + period] or j + period > len(out):
                done.append(out[i])
                i += 1
                continue
            group = out[i:j]
            while keys[i:i + period] == keys[j:j + period] and j + period <= len(out):
                group = [merged(a, b) for a, b in zip(group, out[j:j + period])]
                j += period
            if period == 1:
                group[0][2] = 1
                done.append(group[0])
            else:
                done.append([GROUP, 0, 1, group, []])
            i = j
        out = done
    return out


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Two sequences as one: common parts merged, the others optional, and what then follows itself repeated."""
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    if ka == kb:
        return [merged(x, y) for x, y in zip(a, b)]
    lo = 0
    while lo < min(len(a), len(b)) and ka[lo] == kb[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and ka[-1 - hi] == kb[-1 - hi]:
        hi += 1
    m, n = len(a) - lo - hi, len(b) - lo - hi
    length = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if ka[lo + i] == kb[lo + j] else max(length[i + 1][j], length[i][j + 1])
    out = [merged(x, y) for x, y in zip(a[:lo], b[:lo])]
    i = j = 0
    optional = lambda x: [x[0], 1, *x[2:]]
    while i < m or j < n:
        if i < m and j < n and ka[lo + i] == kb[lo + j]:
            out.append(merged(a[lo + i], b[lo + j]))
            i, j = i + 1, j + 1
        elif j >= n or i < m and length[i + 1][j] >= length[i][j + 1]:
            out.append(optional(a[lo + i]))
            i += 1
        else:
            out.append(optional(b[lo + j]))
            j += 1
    out += [merged(x, y) for x, y in zip(a[len(a) - hi:], b[len(b) - hi:])]
    return folded(out)


@functools.lru_cache(100_000)
def outside(label: str, in_main: bool) -> bool:
    """Whether an element holds no article text, by its tag and role."""
    tag, *names = label.split(" ")
    if tag in OUTSIDE and not (tag == "header" and in_main):
        return True
    return tag not in ("html", "body") and any(x == "!hidden" or x[:1] == "@" and x[1:] in OUTSIDE_ROLES for x in names)


@functools.lru_cache(100_000)
def listed(label: str) -> frozenset[str]:
    """Names of an element, whole classes and ids, that promise no article text; a form is one."""
    tag, *names = label.split(" ")
    found = {"form"} if tag == "form" else set()
    for name in names if tag not in NEVER_NAMED else ():
        words = [x for x in _NAMES.split(name) if x]
        if name[:1] in "@!" or not words:
            continue
        if "".join(words) in OUTSIDE_NAMES:
            found.add("".join(words))
            continue
        while words and words[0] in BEFORE_NAMES:
            del words[0]
        if all(x in OUTSIDE_NAMES or x in AROUND_NAMES for x in words):
            found.update(x for x in words if x in OUTSIDE_NAMES)
    return frozenset(found)


def is_main(label: str) -> bool:
    tag, *names = label.split(" ")
    return tag in ("article", "main") or "@main" in names or "@article" in names


def containers(page: list) -> tuple[bool, bool, set[int]]:
    """Whether a parsed page marks an article, whether one is in no listed element, and the listed elements of a layout
    that hold more than half of the page's text."""
    sizes: dict[int, tuple[int, str]] = {}
    mains: list[tuple[int, ...]] = []

    def walk(node: list, over: tuple[int, ...], in_main: bool) -> int:
        label = node[0]
        if label in (TEXT, LINKS):
            return len(node[1]) if label == TEXT else 0
        if label and outside(label, in_main):
            return 0
        if is_main(label):
            mains.append(over)
            in_main = True
        names = listed(label)
        inner = (*over, id(node)) if names else over
        size = sum(walk(c, inner, in_main) for c in node[1])
        if names:
            sizes[id(node)] = (size, label)
        return size

    total = walk(page, (), False)
    holders = {i for i, (size, label) in sizes.items() if 2 * size > total and listed(label) <= LAYOUT_NAMES}
    return any(holders.issuperset(over) for over in mains), () in mains, holders


def only_links(node: list) -> bool:
    return node[0] == LINKS if node[0] in (TEXT, LINKS) else all(only_links(c) for c in node[1])


def numbered(root: list) -> list:
    """A host's whole wrapper whose slots bear numbers, from 1; 0 stands for the page."""
    number = itertools.count(1)

    def done(node: list) -> list:
        if node[0] not in (TEXT, LINKS):
            return [*node[:3], [done(c) for c in node[3]], []]
        return [*node[:4], [[next(number)], 0, *node[4][2:]]]

    return done(root)


def slots_had(root: list, page: list) -> list[int]:
    """Numbers of the slots of a numbered wrapper that a parsed page has, by the alignment that wrappers are merged with."""
    found: set[int] = {0}

    def walk(node: list) -> None:
        if node[0] in (TEXT, LINKS):
            if node[4][1]:
                found.update(node[4][0])
        else:
            for c in node[3]:
                walk(c)

    walk(merged(root, wrapper_of(page)))
    return sorted(found)


def finished(root: list, pages: dict[int, int]) -> list:
    """A numbered wrapper with statistics as they are read: whether a text is the template's, whether it varies.

    ``pages``: the number of different pages that have slot i, at 2 * i; of those without a mark, at 2 * i + 1.
    """
    def most(numbers: list[int]) -> bool:
        """Whether most pages of the host, or most of those without a mark, have the slot, and two at least."""
        return any(n > 1 and 2 * n > pages[k] for i in numbers for k in (0, 1) for n in [pages.get(2 * i + k, 0)])

    def done(node: list) -> list:
        if node[0] not in (TEXT, LINKS):
            return [*node[:3], [done(c) for c in node[3]], []]
        varies = node[4][2] != node[4][3]
        return [*node[:4], [int(not varies and most(node[4][0])), int(varies)]]

    return done(root)


class Wrapper:
    """A host's finished wrapper, ready to read pages."""

    def __init__(self, root: list):
        self.root = root

    def _slots(self, node: list, links: bool = True) -> Iterator[list]:
        if node[0] in (TEXT, LINKS):
            if links or node[0] == TEXT:
                yield node[4]
        else:
            for c in node[3]:
                yield from self._slots(c, links)

    def blocks(self, page: list) -> list[str]:
        """The texts of a page that lie in slots of the article, in order."""
        out: list[str] = []
        self._read(page[1], [self.root], False, containers(page), out)
        return out

    def _left_out(self, node: list, at: list[list], in_main: bool, marks: tuple[bool, bool, set[int]]) -> bool:
        """Whether a part of a page holds no article text. In an article a name that articles use too counts only if
        the part is links or the template's; elsewhere it counts unless the part is seen to vary."""
        if outside(node[0], in_main):
            return True
        names = listed(node[0])
        if not names or id(node) in marks[2] and (in_main or not marks[1]):
            return False
        if not names <= UNSURE_NAMES or only_links(node):
            return True
        slots = [s for n in at for s in self._slots(n, False)]
        if in_main:
            return bool(slots) and all(s[0] for s in slots)
        return marks[0] or not any(s[1] for s in slots)

    def _places(self, nodes: list[list]) -> dict[str, list]:
        found: dict[str, list] = {}
        for n in nodes:
            for c in n[3]:
                if c[0] == GROUP:
                    for k, v in self._places([c]).items():
                        found.setdefault(k, []).extend(v)
                else:
                    found.setdefault(_key(c), []).append(c)
        return found

    def _read(self, children: list, at: list[list], in_main: bool, marks: tuple[bool, bool, set[int]], out: list[str]) -> None:
        places = self._places(at)
        for c in children:
            if c[0] in (TEXT, LINKS):
                here = places.get(c[0], [])
                if in_main or not marks[0] and c[0] == TEXT and not self._boilerplate(here):
                    out.append(c[1])
            else:
                here = places.get(_shape(c[0], {x[0] for x in c[1]}), [])
                if not self._left_out(c, here, in_main, marks):
                    self._read(c[1], here, in_main or is_main(c[0]), marks, out)

    def _boilerplate(self, slots: list[list]) -> bool:
        """Of a page without a marked article: text that is the template's."""
        return bool(slots) and all(s[4][0] for s in slots)


def host_of(url) -> F.Column:
    """The host of an address, lower-cased; addresses without one share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from (host, html). A task aligns its own pages of a host before anything is shuffled, and a hot
    host's partial wrappers meet in groups before they meet in one: a wrapper is a template, however many its pages."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> pa.RecordBatch:
            nonlocal held
            rows, held = held, {}
            return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array([json.dumps(w) for w in rows.values()], pa.string())],
                                              names=["host", "wrapper"])

        for b in batches(source, "html"):
            for host, page in zip(b.column("host").to_pylist(), texts_of(b.column("html"))):
                w = wrapper_of(parse(page))
                held[host] = merged(held[host], w) if host in held else w
            if len(held) >= HELD_HOSTS:
                yield flush()
        if held:
            yield flush()

    def join(p: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for w in sorted(p["wrapper"]):
            w = json.loads(w)
            whole = w if whole is None else merged(whole, w)
        return pd.DataFrame({"host": [p["host"].iloc[0]], "wrapper": [json.dumps(whole)]})

    def last(p: pd.DataFrame) -> pd.DataFrame:
        p = join(p)
        return p.assign(wrapper=[json.dumps(numbered(json.loads(w))) for w in p["wrapper"]])

    found = pages.mapInArrow(run, "host string, wrapper string").withColumn("split", F.pmod(F.xxhash64("wrapper"), F.lit(SPLITS)))
    some = found.groupBy("host", "split").applyInPandas(join, "host string, wrapper string")
    whole = cut(some.groupBy("host").applyInPandas(last, "host string, wrapper string"))

    def finish(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            done = [json.dumps(finished(json.loads(w), {x["slot"]: x["n"] for x in counts or ()}))
                    for w, counts in zip(b.column("wrapper").to_pylist(), b.column("counts").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(done, pa.string())], names=["host", "wrapper"])

    # a host's counts are as many as its template has slots
    counts = slot_counts(pages, whole).groupBy("host").agg(F.collect_list(F.struct("slot", "n")).alias("counts"))
    return whole.join(counts, "host", "left").select("host", "wrapper", "counts").mapInArrow(finish, "host string, wrapper string")


def slot_counts(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, slot, n): the different pages of a host that have a slot, see ``finished``; every page is counted.

    Pages of equal content count once, a page without any does not count. Only a hash and the slots' numbers are shuffled.
    """
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for b in batches(source, "html"):
            rows = []
            for host, w, html in zip(b.column("host").to_pylist(), b.column("wrapper").to_pylist(), texts_of(b.column("html"))):
                if host not in known:
                    if len(known) >= HELD_HOSTS:
                        known = {}
                    known[host] = json.loads(w)
                page = parse(html)
                content = content_hash(page)
                if content is not None:
                    had, marked = slots_had(known[host], page), containers(page)[0]
                    rows.append((host, content, [2 * i for i in had] + ([] if marked else [2 * i + 1 for i in had])))
            hosts, contents, slots = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(contents, pa.string()), pa.array(slots, pa.list_(pa.int32()))],
                names=["host", "content", "slots"])

    seen = pages.join(hinted(wrappers), "host").select("host", "wrapper", "html").mapInArrow(
        run, "host string, content string, slots array<int>")
    different = seen.groupBy("host", "content").agg(F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    return different.select("host", F.explode("slots").alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("n"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Blocks of the article in page order, two line ends between them; character references are decoded and white space
    is one space. Of a page that marks no article, text in links and text that is the same on most of the
    host's pages of different content is left out. A null or empty page gives the empty text; repeated rows are read alike; a host with one page is its own
    template; pages without a host share one. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    wrappers = cut(infer_wrappers(rows.select("host", "html")))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for b in batches(source, "html"):
            out = []
            for host, w, page in zip(b.column("host").to_pylist(), b.column("wrapper").to_pylist(), texts_of(b.column("html"))):
                if host not in known:
                    if len(known) >= HELD_HOSTS:
                        known = {}
                    known[host] = Wrapper(json.loads(w))
                out.append("\n\n".join(known[host].blocks(parse(page))))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()),
                                              pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(hinted(wrappers), "host").select("page_id", "url", "host", "wrapper", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
