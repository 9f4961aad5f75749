"""Main text of web pages by consensus paths of their hosts.

1. Every page's containers are scored: the text they hold, link text counting against them,
   more for elements that name an article, less for page furniture (menus, adverts, comments and
   so on, by element, role, or class). The best container's generalised path (tags with
   classes and ids, digits as N) is the page's vote.
2. Votes are counted per host and path by one aggregation; the ``winners`` paths with most votes
   win. A host that holds a third of all pages is only a counter.
3. Every page is read again: the first winning path that occurs on it gives the text; a page
   without any falls back to its own best container.

Furniture is a score, no verdict: what is marked only weighs less as a container, and is left out of the
containers around it. So an element that holds the article, whatever its class, takes nothing from the
article, and a host's votes can choose a marked path. A class marks an element only if all its parts
are furniture words or words of place (``sidebar-left``, not ``content-with-sidebar`` or ``notice-period``).
A headline (h1) that stands unmarked before a chosen container without one belongs to its text.

Winning paths travel to the pages while there are at most ``broadcast_paths`` of them; beyond,
pages meet them by a shuffle on the host.

Pages are read in linear time: every search for an end of a tag, comment or script that fails is not
repeated, containers know their parents only, and paths are numbers until one is chosen.

Defined cases: null html is empty and gives empty text; a null url, or one without host, is a
host of its own kind (no consensus, the page's own best container); repeated pages are
extracted each; unclosed elements end with their parent, an unclosed script, style, title or
textarea with the page; a tag whose quotes never close ends at the next ``>``, and if there is none what
is left is text; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tiercat.llm.common import col, parts, stored

# HTML's elements by their part in a page.
RAW = frozenset("script style textarea title xmp".split())  # hold no markup
SKIPPED = frozenset("iframe noscript noframes template svg math object select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption summary".split())
BLOCKS = LEAVES | frozenset(
    "address article aside body button center details dialog div dl fieldset figure footer form head header hr "
    "html legend main menu nav ol section table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("head nav footer aside form dialog menu button".split())
ROLES = frozenset("navigation banner contentinfo search complementary dialog alert".split())
HEADINGS = frozenset("p h1 h2 h3 h4 h5 h6".split())  # end where the next block begins
ENDS = {  # an opening tag -> open elements of the same parent that it ends
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
HOLDERS = (BLOCKS - LEAVES - frozenset("tr th thead tbody tfoot head".split())) | {"blockquote"}
# Words in a class or id that mark page furniture, words of place, number or shape that may
# stand beside them, and words that mark content.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner brand branding breadcrumb breadcrumbs comment "
    "comments consent cookie cookies copyright disqus footer gdpr login logo masthead menu modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar "
    "widget widgets alert tagline".split())
PLACES = frozenset(
    "area bar block bottom box button buttons col column container div fixed form global group holder home icon icons "
    "id inline inner item items left level link links list main middle module n outer page panel popular primary "
    "region reader right row secondary section site slot small sticky sub tools top unit user users wrap wrapper "
    "zone".split())
CONTENT = frozenset("article articlebody content entry main maincontent post story text".split())

BEGIN = re.compile(r"<(?=[A-Za-z!?/])")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")
PENALTY = 0.04  # of a marked container, and of those inside it
RANK = (1, 8, 32, 64)


def tokens(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag or "", closing, attributes) of every tag, then the text behind the last."""
    at = text_from = 0
    quotes, missing = True, set()  # what the rest of the page is known not to hold

    def end_of_tag(i: int) -> int:
        """Place of the > that ends a tag, or -1."""
        nonlocal quotes
        if quotes:
            j = i
            while True:
                m = STOP.search(html, j)
                if not m:
                    break
                if m[0] == ">":
                    return m.start()
                j = m.end()
                if html[max(i, m.start() - 16):m.start()].rstrip()[-1:] == "=":
                    if m[0] in missing:
                        continue
                    close = html.find(m[0], j)
                    if close < 0:
                        missing.add(m[0])
                    else:
                        j = close + 1
            quotes = False
        if ">" in missing:
            return -1
        j = html.find(">", i)
        if j < 0:
            missing.add(">")
        return j

    while True:
        begin = BEGIN.search(html, at)
        if not begin:
            break
        at = begin.start()
        c = html[at + 1]
        if c == "!" or c == "?" or c == "/" and not html[at + 2:at + 3].isalpha():
            if html.startswith("<!--", at):
                # an end that was not found once is not there later either
                end = -1 if "-->" in missing else html.find("-->", at + 4)
                if end < 0:
                    yield html[text_from:at], "", False, ""
                    return
                after = end + 3
            elif c == "/" and html[at + 2:at + 3] != ">" and not html[at + 2:at + 3].strip():
                at += 1  # "</ " is text
                continue
            else:
                end = -1 if ">" in missing else html.find(">", at)
                if end < 0:
                    missing.add(">")
                    break
                after = end + 1
            yield html[text_from:at], "", False, ""
            at = text_from = after
            continue
        closing = c == "/"
        m = NAME.match(html, at + 1 + closing)
        if not m:
            at += 1
            continue
        end = end_of_tag(m.end())
        if end < 0:
            break
        tag = m[0].lower()
        yield html[text_from:at], tag, closing, html[m.end():end]
        at = text_from = end + 1
        if not closing and (tag in RAW or tag in SKIPPED) and tag not in missing:
            m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if m:
                at = text_from = m.start()
            elif tag in RAW:
                return
            else:
                missing.add(tag)
    yield html[text_from:], "", False, ""


@lru_cache(maxsize=4096)
def _shape(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, int, bool, str]:
    """Of an element: whether it is in an article, marked as furniture, its rank, whether it is not shown,
    its label."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    role = found.get("role", "").lower()
    out = "hidden" in found or found.get("aria-hidden", "").lower() == "true" \
        or "display:none" in found.get("style", "").replace(" ", "").lower()
    core = tag in ("article", "main") or role == "main"
    inside = inside or core
    words, mark = set(), False
    for name in names:
        split = [w.lower() for w in PART.findall(name)]
        words.update(split)
        if any(w in FURNITURE for w in split):
            mark = mark or all(w in FURNITURE or w in PLACES or w == "header" for w in split)
        elif "header" in split and not inside:
            mark = mark or all(w in PLACES or w == "header" for w in split)
    if tag in ("html", "body", "main"):
        mark = False
    elif tag == "article":
        mark = bool(words & {"comment", "comments"})
    elif tag == "header":
        mark = mark or not inside and not words & CONTENT
    mark = mark or tag in OUTSIDE or role in ROLES
    rank = 3 if tag == "article" or found.get("itemprop", "").lower() == "articlebody" else 2 if core \
        else 1 if words & CONTENT and tag not in LEAVES and tag not in ("html", "body") else 0
    label = tag + "".join("." + DIGITS.sub("N", c).replace("/", "|") for c in sorted(set(names)))
    if role in ROLES or role == "main":
        label += "@" + role
    return inside, mark, 0 if mark else rank, out, label


class Page:
    """The containers of a page, numbered in order of their beginnings, and its blocks of text.

    Of container i: ``up`` the one around it, ``path`` the number of its path, ``rank`` how much it names an
    article, ``mark`` whether it is furniture, ``depth``. A block is (container, text, link characters, tag)."""

    def __init__(self, html: str):
        self.up, self.path, self.rank, self.mark, self.depth = [-1], [0], [0], [False], [0]
        self.numbers: dict[tuple[int, str], int] = {}
        self.labels: list[tuple[int, str]] = [(-1, "")]
        self.blocks: list[tuple[int, str, int, str]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        tags, boxes, inside = [""], [0], [False]  # the open elements, their containers
        count: dict[str, int] = {}
        runs: list[str] = []
        linked, in_link, hidden = 0, False, 0

        def flush():
            nonlocal linked
            if runs:
                text = " ".join("".join(runs).split())
                if text:
                    self.blocks.append((boxes[-1], text, linked, tags[-1]))
                runs.clear()
            linked = 0

        def pop(to: int):
            nonlocal hidden
            while len(tags) > to:
                count[tags.pop()] -= 1
                boxes.pop()
                inside.pop()
                if hidden and len(tags) < hidden:
                    hidden = 0

        for raw, tag, closing, attributes in tokens(html):
            if raw and not hidden:
                text = unescape(raw) if "&" in raw else raw
                runs.append(text)
                if in_link:
                    linked += len(text)
            if not tag:
                continue
            if tag == "br":
                runs.append(" ")
            elif tag == "a":
                in_link = not closing
            elif tag in BLOCKS:
                flush()
                if closing:
                    if count.get(tag):
                        for i in range(len(tags) - 1, 0, -1):
                            if tags[i] == tag:
                                pop(i)
                                break
                            if tag in LEAVES and tags[i] in HOLDERS:
                                break
                    continue
                in_link = False
                if tag in VOID:
                    continue
                if tags[-1] == "head" and tag != "head":
                    pop(len(tags) - 1)
                if tags[-1] in HEADINGS and tag not in ("body", "html"):
                    i = len(tags) - 1
                    while tags[i - 1] in HEADINGS:
                        i -= 1
                    pop(i)
                ended = ENDS.get(tag)
                if ended and any(count.get(t) for t in ended):
                    for i in range(len(tags) - 1, 0, -1):
                        if tags[i] in ended:
                            pop(i)
                            break
                        if tags[i] in HOLDERS:
                            break
                count[tag] = count.get(tag, 0) + 1
                tags.append(tag)
                out = self._box(tag, attributes, boxes, inside)
                if out and not hidden:
                    hidden = len(tags)
        flush()

    def _box(self, tag: str, attributes: str, boxes: list[int], inside: list[bool]) -> bool:
        """Opens an element; whether it is not shown."""
        up = boxes[-1]
        within, mark, rank, out, label = _shape(tag, attributes, inside[-1])
        inside.append(within)
        if tag in LEAVES and not mark:
            boxes.append(up)  # a paragraph is no container
            return out
        key = (self.path[up], label)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.labels)
            self.labels.append(key)
        boxes.append(len(self.up))
        self.up.append(up)
        self.path.append(number)
        self.rank.append(rank)
        self.mark.append(mark)
        self.depth.append(self.depth[up] + 1)
        return out

    def name(self, number: int) -> str:
        names = []
        while number > 0:
            number, label = self.labels[number]
            names.append(label)
        return "/" + "/".join(reversed(names)) if names else ""

    def number(self, path: str) -> int | None:
        """The number of a path, or None if it is not on the page."""
        number = 0
        for label in path.split("/")[1:]:
            number = self.numbers.get((number, label))
            if number is None:
                return None
        return number

    def best(self) -> tuple[int | None, float]:
        """The path of the container with the highest score, and the text weight it holds."""
        if not self.blocks:
            return None, 0.0
        n = len(self.up)
        weight, marks = [0.0] * n, [0] * n
        for box, text, linked, _ in self.blocks:
            weight[box] += max(0.0, len(text) - 2.0 * linked) + 1e-3
        for i in range(n - 1, 0, -1):  # what is marked adds nothing to what is around it
            if not self.mark[i]:
                weight[self.up[i]] += weight[i]
        for i in range(1, n):
            marks[i] = marks[self.up[i]] + self.mark[i]
        total: dict[int, float] = {}
        shape: dict[int, tuple[int, int, int]] = {}
        for i in range(n):
            if weight[i] > 0:
                p = self.path[i]
                total[p] = total.get(p, 0.0) + weight[i]
                shape[p] = (self.rank[i], self.depth[i], marks[i])
        if not total:
            return None, 0.0

        def score(p):
            rank, depth, marked = shape[p]
            return total[p] * RANK[rank] * 1.15 ** min(depth, 12) * PENALTY ** min(marked, 8)

        p = max(total, key=lambda p: (score(p), -p))  # of equal ones the first on the page
        return p, total[p]

    def text(self, number: int) -> str:
        """The blocks under the containers of a path, without those under furniture inside them; containers
        that hold mostly links are furniture where the path does not name an article."""
        n = len(self.up)
        if any(self.rank[i] for i in range(n) if self.path[i] == number):
            dense = [False] * n
        else:
            links, length = [0] * n, [0] * n
            for box, text, linked, _ in self.blocks:
                links[box] += linked
                length[box] += len(text)
            for i in range(n - 1, 0, -1):
                links[self.up[i]] += links[i]
                length[self.up[i]] += length[i]
            dense = [2 * a > b for a, b in zip(links, length)]
        keep = [False] * n
        for i in range(n):
            keep[i] = self.path[i] == number or i > 0 and keep[self.up[i]] and not self.mark[i]
            keep[i] = keep[i] and not dense[i]
        chosen = [k for k, b in enumerate(self.blocks) if keep[b[0]]]
        if not chosen:
            return ""
        if not any(self.blocks[k][3] == "h1" for k in chosen):
            free = [True] * n
            for i in range(1, n):
                free[i] = free[self.up[i]] and not self.mark[i]
            heads = [k for k, b in enumerate(self.blocks) if b[3] == "h1" and free[b[0]] and not keep[b[0]]]
            if len(heads) == 1 and heads[0] < chosen[0]:
                chosen.insert(0, heads[0])
        return "\n".join(self.blocks[k][1] for k in chosen)


def vote(html: str) -> tuple[str | None, float]:
    """A page's path and the text weight it holds."""
    page = Page(html)
    number, weight = page.best()
    return (None if number is None else page.name(number)), weight


def extract(html: str, winners: list[str]) -> str:
    """The text under the first of ``winners`` that the page has, else under its best container."""
    page = Page(html)
    for path in winners:
        number = page.number(path)
        text = page.text(number) if number is not None else ""
        if text:
            return text
    own, _ = page.best()
    return page.text(own) if own is not None else ""


def host(url: str) -> F.Column:
    """The host of a url in lower case; null if there is none."""
    h = F.lower(F.regexp_extract(col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", h)


def consensus(pages: DataFrame, url: str = "url", html: str = "html", winners: int = 8) -> DataFrame:
    """(host, paths): the winning paths of every host, most votes first."""
    d = pages.select(host(url).alias("host"), col(html).cast("string").alias("html")).where("host IS NOT NULL")

    def votes_of(batches):
        for b in parts(batches):
            votes = [vote(h or "") for h in b.column(1).to_pylist()]
            paths, weights = zip(*votes) if votes else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(paths, pa.string()), pa.array(weights, pa.float64())],
                ["host", "path", "weight"])

    votes = d.mapInArrow(votes_of, "host string, path string, weight double").where("path IS NOT NULL") \
        .groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("weight").alias("weight"))
    w = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc(F.round("weight", 3)), "path")
    top = votes.withColumn("place", F.row_number().over(w)).where(F.col("place") <= winners)
    top = top.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("p"))
    return top.select("host", F.col("p.path").alias("paths"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
              winners: int = 8, broadcast_paths: int = 200_000) -> DataFrame:
    """(key, url, text) of every page."""
    paths = stored(consensus(pages, url, html, winners), "host-paths")
    if paths.limit(broadcast_paths // winners + 1).count() <= broadcast_paths // winners:
        paths = F.broadcast(paths)
    d = pages.select(col(key).alias("key"), col(url).alias("url"), host(url).alias("host"),
                     col(html).cast("string").alias("html")).join(paths, "host", "left")
    d = d.select("key", "url", "html", "paths")
    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in ("key", "url"))

    def run(batches):
        for b in parts(batches):
            texts = [extract(h or "", p or []) for h, p in
                     zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             ["key", "url", "text"])

    return d.mapInArrow(run, f"{kinds}, text string")
