"""HTML main text by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read into a tree of block elements; inline markup is text. Pages of a host are aligned one after another:
where child sequences disagree, the unmatched part becomes an optional group, neighbours of one kind become a repeated
group, and texts that differ become a slot while equal ones stay constants. A host's pages are dealt into SALTS parts by
their digest and folded in the order of digests, then the parts' wrappers are folded in theirs: wrappers don't depend on
how pages are stored, a host with a third of all pages is never one task's rows, and what meets is a few small trees.
A node whose children differ and come to more than KIDS is wide. Its wrapper keeps their sizes alone, and the children
are aligned each for itself, the k-th of a label (or text) on one page with the k-th on the others, counted from the front
and once more from the end. Each such piece is a group of rows of its own, so the pieces of a host are never in one task, and
what a piece shows reaches the pages that hold its path by a join. Pieces of one shape are put together where they are cut,
as their order doesn't matter, and the shapes are folded in the order of their digests. Pieces may be wide in turn; pages
are read once more for each such step, and only those of hosts with wide nodes.

A page's main text is what its host's wrapper leaves over: texts that are constant over the host's pages and groups that
are mostly links are template, not content, wherever they stand. Names of elements and classes are hints that the wrapper
decides on, and class names count as a whole: `comment-list` is one, `no-comments` isn't. An element that holds a page's only
article, or most of a page without one, isn't left out by its name. Article and main elements are the content region if they hold at least half of the host's varying text
outside of menus and the like, else the region is the whole page. Menus, headers, footers, sidebars, notices, adverts,
forms and comments are left out, unless a host without article and main elements has most of its varying text in one.
Heads, scripts, styles and controls are never content, nor are hidden elements and adverts inside a line. A host with fewer than CONSTANT_PAGES different pages shows no
template: there the hints hold as they are.

Defined cases: null html counts as empty and gives an empty text; html without tags is all text; null or odd URLs share
the empty host. Repeated pages are extracted each for itself. Elements nested deeper than DEPTH count as children of the
one at that depth; their text is kept. A link that isn't closed ends with its block. Other columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import itertools
import json
import re
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written
from .url_rules import host_and_path

DEPTH = 60
SALTS, KIDS = 64, 200
#: Pieces of pages that a task puts together in memory before it hands them on.
PIECES = 20_000
#: Pages of a host, different in their readable text, that must agree on a text before it counts as template.
CONSTANT_PAGES = 3

# Kinds of elements, and the class names of what isn't content.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset(["p"])
CLOSED_BY_SAME = frozenset("li dt dd tr td th option thead tbody tfoot".split())
NOT_TEXT = frozenset("head script style noscript template iframe svg button select textarea dialog menu object".split())
NOT_CONTENT = frozenset("nav footer aside form".split())
MAIN = frozenset(["article", "main"])
#: Elements that are never a group of links, as they hold other groups.
REGIONS = MAIN | {"root", "html", "body"}
NOT_CONTENT_CLASSES = frozenset(
    "ad ads advert adverts advertisement aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav "
    "navbar navigation newsletter notice pager pagination popup promo related replies reply search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Articles of these classes are readers' comments and adverts; so are inline elements.
ASIDES = frozenset("ad ads advert adverts advertisement comment comments promo replies reply sponsor sponsored".split())
#: Words that may stand beside those in a class name of several parts; with any other word the name says something else.
STRUCTURE = frozenset(
    "area bar block body bottom box btn button buttons col column container content desktop fixed global group head inner item items left link links list main "
    "mobile module outer page panel right row section site slot sticky strip top unit wrap wrapper zone".split()
)
#: Begins the labels of elements that their names hint not to be content.
HINTED = "-"
#: The label of the one child that stands for all of a wide node.
WIDE = "*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rawattrs>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|\Z)(?!\s*=\s*[\"']?until-found)|style\s*=\s*(?:\"[^\"]*|'[^']*)display\s*:\s*none", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Element:
    __slots__ = ("aside", "base", "hidden", "kids", "name", "open", "skip")

    def __init__(self, name: str, attrs: str, in_main: bool) -> None:
        self.name, self.kids, self.open = name, [], 0
        names = class_names(attrs)
        self.hidden = name in NOT_TEXT or is_hidden(attrs)
        # readers' comments and adverts, which are never content
        self.aside = says(names, ASIDES)
        unwanted = self.aside if name in MAIN else name != "body" and says(names, NOT_CONTENT_CLASSES)
        self.skip = self.hidden or name in NOT_CONTENT or (name == "header" and not in_main) or unwanted
        self.base = ".".join([name, *sorted({w for n in names for w in _parts(n) if not w.isdigit()})])

    @property
    def label(self) -> str:
        return HINTED + self.base if self.skip else self.base


def class_names(attrs: str) -> list[str]:
    return [n for m in _NAMED.findall(attrs) for n in "".join(m).lower().split()] if "=" in attrs else []


def _parts(name: str) -> list[str]:
    return [w for w in re.split(r"[_-]+", name) if w]


def says(names: list[str], words: frozenset[str]) -> bool:
    """Whether a class name is one of the words, or made of them and of words of structure alone."""
    for name in names:
        parts = [w for w in _parts(name) if not w.isdigit()]
        if not words.isdisjoint(parts) and all(w in words or w in NOT_CONTENT_CLASSES or w in STRUCTURE for w in parts):
            return True
    return False


def is_hidden(attrs: str) -> bool:
    # quoted values don't count, but for styles
    return bool(attrs) and bool(_HIDDEN.search(attrs)) and bool(_HIDDEN.search(re.sub(r"(?<!style=)(\"[^\"]*\"|'[^']*')", "", attrs, flags=re.I)))


def read_page(text: str | None) -> Element:
    """The tree of block elements; a kid is an Element or (text, chars of it inside links)."""
    root = Element("root", "", False)
    # in_link: how deep the open link began; it ends with the block it stands in
    stack, run, links, in_link, at = [root], [], 0, 0, 0

    def flush() -> None:
        nonlocal links
        words = " ".join("".join(run).split())
        if words:
            stack[-1].kids.append((words, links))
        run.clear()
        links = 0

    def take(raw: str) -> None:
        nonlocal links
        if raw:
            run.append(entities.unescape(raw))
            links += len(run[-1]) * bool(in_link)

    text = text or ""
    for m in _TOKEN.finditer(text):
        take(text[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in INLINE:
            top = stack[-1]
            aside = not m["end"] and bool(m["attrs"]) and name not in VOID and (says(class_names(m["attrs"]), ASIDES) or is_hidden(m["attrs"]))
            if top.name == name:  # inside of an aside: its own end is the one that nothing inside has opened
                top.open += -1 if m["end"] else 1
            if not aside and not (top.name == name and top.open < 0):
                if name == "br":
                    run.append(" ")
                elif name == "a":
                    in_link = 0 if m["end"] else len(stack)
                continue
        flush()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    in_link *= in_link <= k
                    break
            continue
        if name in VOID:
            continue
        if name not in INLINE and (stack[-1].name in CLOSED_BY_BLOCK or (stack[-1].name == name and name in CLOSED_BY_SAME)):
            stack.pop()
            in_link *= in_link <= len(stack)
        e = Element(name, m["attrs"] or "", any(x.name in MAIN for x in stack))
        stack[-1].kids.append(e)
        if len(stack) < DEPTH:
            stack.append(e)
    take(text[at:])
    flush()
    _settle(root)
    return root


def _settle(root: Element) -> None:
    """A name alone never takes a page's content away. On a page all of whose article and main elements stand in elements
    that are skipped by name, these aren't. On a page without any, nor is one with most of the text that isn't hidden, but
    for comments and adverts."""

    def mains(e: Element, skipped: bool) -> Iterator[bool]:
        for k in e.kids:
            if isinstance(k, Element) and not k.hidden:
                below = skipped or k.skip
                if k.name in MAIN and not k.aside:
                    yield below
                yield from mains(k, below)

    def chars(e: Element) -> int:
        return sum(len(k[0]) if not isinstance(k, Element) else 0 if k.hidden else chars(k) for k in e.kids)

    def keep(e: Element, held) -> None:
        for k in e.kids:
            if isinstance(k, Element) and not k.hidden and held(k):
                k.skip = False
                keep(k, held)

    found = list(mains(root, False))
    if found and all(found):
        keep(root, lambda e: not e.aside and (e.name in MAIN or any(True for _ in mains(e, False))))
    elif not found:
        whole = chars(root)
        keep(root, lambda e: not e.aside and 2 * chars(e) > whole)


# A wrapper node is [label, repeated, optional, text, pages, chars, chars in links, kids]. text: None for an element or
# group, "" for a slot, else the digest of a constant. pages: for the root and constants the CONSTANT_PAGES smallest
# digests of the pages met, by the text that names don't hint away and by all text, so that copies of one page count
# once; merging such lists in any order gives the same.
_LABEL, _REPEATED, _OPTIONAL, _TEXT, _PAGES, _CHARS, _LINKS, _KIDS = range(8)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _texts(e: Element, part: str = "rest") -> Iterator[tuple[str, str]]:
    """Part of the page (main, rest or hinted) and text of each block."""
    for k in e.kids:
        if not isinstance(k, Element):
            yield part, k[0]
        elif not k.hidden:
            yield from _texts(k, "hinted" if k.skip else "main" if k.name in MAIN and part == "rest" else part)


def page_digests(root: Element) -> list[list[str]]:
    """What pages are told apart by: the text of their main elements, or what isn't hinted away where these have none;
    and all of their text."""
    blocks = list(_texts(root))
    shown = [t for p, t in blocks if p == "main"] or [t for p, t in blocks if p == "rest"]
    return [[_digest("\n".join(shown))], [_digest("\n".join(t for _, t in blocks))]]


def as_wrapper(root: Element, hold: bool = False) -> list:
    pages = page_digests(root)

    def of(e: Element) -> list:
        kids = []
        for k in e.kids:
            if isinstance(k, Element):
                if not k.hidden:
                    kids.append(of(k))
            else:
                kids.append(["#", False, False, _digest(k[0]), pages, len(k[0]), k[1], []])
        return [e.label, False, False, None, pages if e is root else [], 0, 0, _folded(kids, hold)]

    return of(root)


def _folded(kids: list[list], hold: bool = False) -> list[list]:
    """Neighbours of one kind, and runs of up to three kinds that repeat, as repeated groups."""
    for width in (1, 2, 3):
        out: list[list] = []
        for k in kids:
            out.append(k)
            while len(out) >= 2 * width and [x[_LABEL] for x in out[-width:]] == [x[_LABEL] for x in out[-2 * width : -width]]:
                late, early = out[-width:], out[-2 * width : -width]
                del out[-2 * width :]
                out += [_repeat(align(a, b, hold)) for a, b in zip(early, late, strict=True)]
        kids = out
    return kids


def _is_wide(kids: list[list]) -> bool:
    return bool(kids) and kids[0][_LABEL] == WIDE


def _widened(kids: list[list], hold: bool = False) -> list[list]:
    """What a wide node keeps of its children; those of a page hold on to them."""
    chars, links = _sizes(kids)
    held = [x for k in kids for x in (k[_KIDS] if k[_LABEL] == WIDE else [k])] if hold else []
    return [[WIDE, any(k[_REPEATED] for k in kids), False, "", [], chars, links, held]]


def _sizes(kids: list[list]) -> tuple[int, int]:
    chars = links = 0
    for k in kids:
        c, n = (0, 0) if k[_LABEL] == WIDE else _sizes(k[_KIDS])
        chars, links = chars + k[_CHARS] + c, links + k[_LINKS] + n
    return chars, links


def _repeat(node: list) -> list:
    node[_REPEATED] = True
    return node


def align(a: list, b: list, hold: bool = False) -> list:
    """The wrapper that fits what either fits; a and b have the same label."""
    text = a[_TEXT] if a[_TEXT] == b[_TEXT] else ""
    pages = [] if text == "" else [sorted({*x, *y})[:CONSTANT_PAGES] for x, y in zip(a[_PAGES], b[_PAGES], strict=True)]
    kids: list[list] = []
    if not a[_KIDS] and not b[_KIDS]:
        pass
    elif _is_wide(a[_KIDS]) or _is_wide(b[_KIDS]):
        kids = _widened([*a[_KIDS], *b[_KIDS]], hold)
    elif [k[_LABEL] for k in a[_KIDS]] == [k[_LABEL] for k in b[_KIDS]]:
        kids = [align(x, y, hold) for x, y in zip(a[_KIDS], b[_KIDS], strict=True)]
    else:
        matcher = SequenceMatcher(None, [k[_LABEL] for k in a[_KIDS]], [k[_LABEL] for k in b[_KIDS]], autojunk=False)
        for kind, i, j, m, n in matcher.get_opcodes():
            if kind == "equal":
                kids += [align(x, y, hold) for x, y in zip(a[_KIDS][i:j], b[_KIDS][m:n], strict=True)]
            else:
                kids += [[*k[:_OPTIONAL], True, *k[_OPTIONAL + 1 :]] for k in (*a[_KIDS][i:j], *b[_KIDS][m:n])]
        kids = _folded(kids, hold)
        kids = kids if len(kids) <= KIDS else _widened(kids, hold)
    return [a[_LABEL], a[_REPEATED] or b[_REPEATED], a[_OPTIONAL] or b[_OPTIONAL], text, pages, a[_CHARS] + b[_CHARS], a[_LINKS] + b[_LINKS], kids]


def expression(node: list) -> str:
    """The wrapper as a regular expression, for reading."""
    if node[_LABEL] == WIDE:
        return ".*"
    if node[_TEXT] is not None:
        return "#PCDATA" if node[_TEXT] == "" else f"={node[_TEXT]}"
    body = f"<{node[_LABEL]}>{''.join(map(expression, node[_KIDS]))}</>"
    mark = "*" if node[_REPEATED] and node[_OPTIONAL] else "+" if node[_REPEATED] else "?" if node[_OPTIONAL] else ""
    return f"({body}){mark}" if mark else body


# A key says where in a page's tree a node stands: the labels from the root on, each after a space, which no label
# holds. Below a wide node a tab and the number follow the label, negative if counted from the end.


def wide_keys(node: list, key: str = "") -> Iterator[str]:
    if _is_wide(node[_KIDS]):
        yield key
    for k in node[_KIDS]:
        if k[_TEXT] is None:
            yield from wide_keys(k, f"{key} {k[_LABEL]}")


def from_end(key: str) -> bool:
    """Such pieces show template only; what they hold is counted from the front, and so are pieces inside of it."""
    return "\t-" in key


def pieces(page: list, wide: frozenset[str]) -> Iterator[tuple[str, str, str, list]]:
    """The children of a page's wide nodes, also of those inside others: key of the wide node, own keys from the front and
    from the end, tree."""
    seen: dict[str, int] = {}
    found: list[tuple[str, str, int, list]] = []

    def walk(node: list, key: str) -> None:
        for k in node[_KIDS][0][_KIDS] if _is_wide(node[_KIDS]) else node[_KIDS]:
            below = f"{key} {k[_LABEL]}"
            if key in wide:
                seen[below] = seen.get(below, 0) + 1
                found.append((key, below, seen[below], k))
                below = f"{below}\t{seen[below]}"
            if k[_TEXT] is None:
                walk(k, below)

    walk(page, "")
    for above, name, n, tree in found:
        yield above, f"{name}\t{n}", f"{name}\t{n - seen[name] - 1}", _bare(tree)


def _bare(node: list) -> list:
    return [*node[:_KIDS], [] if node[_LABEL] == WIDE else [_bare(k) for k in node[_KIDS]]]


def shape(node: list) -> str:
    return node[_LABEL] if not node[_KIDS] else f"{node[_LABEL]}({' '.join(map(shape, node[_KIDS]))})"


def closed(node: list, key: str, wide: frozenset[str]) -> list:
    """The tree without what pieces() takes from it: of siblings that share a key all are wide or none."""
    kids = node[_KIDS]
    if key in wide:
        kids = _widened(kids)
    else:
        kids = [closed(k, f"{key} {k[_LABEL]}", wide) if k[_TEXT] is None else k for k in kids]
    return [*node[:_KIDS], kids]


def _labels(key: str) -> list[str]:
    return [step.split("\t")[0] for step in key.split(" ")[1:]]


def _path(labels: list[str]) -> str:
    return "".join(f"/{x}" for x in labels)


def _part(part: str, label: str) -> str:
    inside = "hinted" if label.startswith(HINTED) else "main" if label.split(".")[0] in MAIN else "rest"
    return inside if part == "rest" else "hinted" if inside == "hinted" else part


def shown_by(node: list, key: str, by: int) -> tuple[dict[str, int], dict[str, int], dict[str, list]]:
    """What a host's wrapper (key "") or a piece of it shows: varying chars by part, those inside each element that its name
    hints away, and template: path -> [whether it is mostly links, digests of constant texts]."""
    found: dict[str, list] = {}
    hinted: dict[str, int] = {}
    varying = {"main": 0, "rest": 0, "hinted": 0}

    def walk(node: list, path: str, part: str) -> tuple[int, int, int]:
        """Chars, those in links, and those of varying text outside of links."""
        chars, links, free = node[_CHARS], node[_LINKS], 0
        constants = []
        for k in node[_KIDS]:
            if k[_TEXT] is None:
                below = f"{path}/{k[_LABEL]}"
                c, n, v = walk(k, below, _part(part, k[_LABEL]))
                if k[_LABEL].startswith(HINTED):
                    hinted[below] = hinted.get(below, 0) + v
            else:
                c, n, v = k[_CHARS], k[_LINKS], 0
                if k[_TEXT] and len(k[_PAGES][by]) >= CONSTANT_PAGES:
                    constants.append(k[_TEXT])
                elif k[_LABEL] != WIDE:  # what a wide node holds its pieces show
                    v = c - n
                    varying[part] += v
            chars, links, free = chars + c, links + n, free + v
        listed = node[_REPEATED] or any(k[_REPEATED] for k in node[_KIDS])
        linked = listed and 2 * links > chars and node[_LABEL].split(".")[0] not in REGIONS
        if constants or linked:
            # siblings of one label share a path
            before = found.get(path, [False, []])
            found[path] = [before[0] or linked, sorted({*before[1], *constants})]
        return chars, links, free

    if not key:
        walk(node, "", "rest")
        return varying, hinted, found
    above = _labels(key)[:-1]
    part = "rest"
    for label in above:
        part = _part(part, label)
    # the wide node itself is judged with the tree it stands in
    *_, free = walk(["root", False, False, None, [], 0, 0, [node]], _path(above), part)
    for i, label in enumerate(above, 1):
        if label.startswith(HINTED):
            hinted[_path(above[:i])] = hinted.get(_path(above[:i]), 0) + free
    return varying, hinted, found


def kept_paths(varying: dict[str, int], hinted: dict[str, int], pages: list[int]) -> list[str]:
    """Paths of elements that are content against their names."""
    if varying["main"] or pages[1] < CONSTANT_PAGES:
        return []
    return sorted(p for p, v in hinted.items() if 2 * v > sum(varying.values()))


def removed_paths(node: list, key: str, kept: list[str], pages: list[int]) -> dict[str, list]:
    if not kept and pages[0] < CONSTANT_PAGES:
        return {}
    # if what the names hint away is content, it tells pages apart
    *_, found = shown_by(node, key, 1 if kept else 0)
    # what is left out by its name needs no template
    out = [HINTED in (k[:1] for k in p.removeprefix(max((x for x in kept if f"{p}/".startswith(f"{x}/")), key=len, default="")).split("/")) for p in found]
    return {p: v for (p, v), left_out in zip(found.items(), out, strict=True) if not left_out}


def template_of(wrapper: list, varying: dict[str, int] | None = None, kept: list[str] | None = None) -> dict:
    """What the wrapper decides: main, whether main elements are the content region; kept, the paths of elements that are
    content against their names; removed, path -> [whether it is mostly links, digests of constant texts]. Varying chars
    and kept paths are given where the host has pieces besides."""
    pages = [len(x) for x in wrapper[_PAGES]]
    if varying is None:
        varying, hinted, _ = shown_by(wrapper, "", 0)
        kept = kept_paths(varying, hinted, pages)
    if not kept and pages[0] < CONSTANT_PAGES:
        return {}
    return {"main": varying["main"] > 0 and varying["main"] >= varying["rest"], "kept": kept, "removed": removed_paths(wrapper, "", kept, pages)}


def mostly_links(e: Element) -> bool:
    """Of elements that share a path only some may be lists of links."""

    def sizes(e: Element) -> tuple[int, int]:
        parts = [sizes(k) if isinstance(k, Element) else (len(k[0]), k[1]) for k in e.kids if not (isinstance(k, Element) and k.skip)]
        return sum(c for c, _ in parts), sum(n for _, n in parts)

    chars, links = sizes(e)
    return 2 * links > chars


def main_text(text: str | None, template: dict) -> str:
    """The page's main text by its host's template; without one the hints hold."""
    removed, kept = template.get("removed", {}), frozenset(template.get("kept", ()))
    blocks: list[tuple[bool, str]] = []
    has_main = False

    def left_over(e: Element, path: str, in_main: bool) -> None:
        nonlocal has_main
        linked, constants = removed.get(path, (False, ()))
        if linked and mostly_links(e):
            return
        for k in e.kids:
            if isinstance(k, Element):
                below = f"{path}/{k.label}"
                if not k.skip or below in kept:
                    has_main |= k.name in MAIN
                    left_over(k, below, in_main or k.name in MAIN)
            elif not constants or _digest(k[0]) not in constants:
                blocks.append((in_main, k[0]))

    left_over(read_page(text), "", False)
    region = has_main and template.get("main", True)
    return " ".join(t for in_main, t in blocks if in_main or not region)


def _marked(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"x": F.xxhash64("html"), "y": F.xxhash64(F.lit(1), "html")}).withColumn("salt", F.pmod("x", F.lit(SALTS)).cast("int"))


def _tree(html: str) -> list:
    return as_wrapper(read_page(html))


def _aligned(rows: DataFrame, by: dict[str, str], order: list[str], read: Callable[[str], list]) -> DataFrame:
    """wrapper (JSON) over the trees of each group; rows of one place in the order count once, without an order all count."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, wrapper = None, None, None
        numbers = itertools.count()
        for batch in batches:
            done = []
            places = zip(*(batch[c] for c in order), strict=True) if order else [next(numbers) for _ in batch.given]
            for group, place, given in zip(zip(*(batch[c] for c in by), strict=True), places, batch.given, strict=True):
                if group != now:
                    if now:
                        done.append((*now, json.dumps(wrapper)))
                    now, last, wrapper = group, None, None
                if place != last:
                    tree = read(given)
                    wrapper = align(wrapper, tree) if wrapper else tree
                    last = place
            if done:
                yield pd.DataFrame(done, columns=[*by, "wrapper"])
        if now:
            yield pd.DataFrame([(*now, json.dumps(wrapper))], columns=[*by, "wrapper"])

    dealt = rows.select(*by, *order, "given").repartition(*by).sortWithinPartitions(*by, *order)
    return dealt.mapInPandas(fold, ", ".join(f"{c} {kind}" for c, kind in {**by, "wrapper": "string"}.items()))


def with_pieces(template: dict, more: list[dict]) -> dict:
    removed = dict(template.get("removed", {}))
    for m in more:
        linked, constants = removed.get(m["path"], (False, []))
        removed[m["path"]] = [linked or m["linked"], {*constants, *m["constants"]}]
    return {**template, "removed": removed}


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) over all pages of each host; equal pages count once."""
    dealt = _marked(pages.select("host", "html")).withColumnRenamed("html", "given")
    partial = _aligned(dealt, {"host": "string", "salt": "int"}, ["x", "y"], _tree)
    return _aligned(partial.withColumnRenamed("wrapper", "given"), {"host": "string"}, ["salt"], json.loads)


def _per_row(rows: DataFrame, of: Callable[..., Iterable[tuple]], made: str) -> DataFrame:
    """The tuples that of() makes of each row's values."""
    return _made(rows, lambda given: (t for row in given for t in of(*row)), made)


def _made(rows: DataFrame, of: Callable[[Iterator[tuple]], Iterable[tuple]], made: str) -> DataFrame:
    """The tuples that of() makes of a partition's rows."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in made.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for some in itertools.batched(of(given), 4096):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(run, made)


def infer_pieces(pages: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For hosts (host, wrapper, wide: keys of wide nodes) their pages' pieces: host, key, wrapper for the hosts' wrappers
    (key "") and all pieces; and host, wide with the keys of all wide nodes, also of those inside of pieces."""

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, met = None, {}
        for host, x, y, html, wide, new in rows:
            if (host, x, y) == last:
                continue
            last = host, x, y
            new = frozenset(new)
            for above, front, end, tree in pieces(as_wrapper(read_page(html), True), frozenset(wide)):
                if above in new:
                    group = host, front, end, shape(tree)
                    met[group] = align(met[group], tree) if group in met else tree
            if len(met) > PIECES:
                yield from handed_on(met)
                met = {}
        yield from handed_on(met)

    def handed_on(met: dict[tuple, list]) -> Iterator[tuple]:
        for (host, front, end, kind), tree in met.items():
            text, kind = json.dumps(tree), _digest(kind)
            yield host, front, kind, text
            yield host, end, kind, text

    group = {"host": "string", "key": "string"}
    found = [hosts.select("host", F.lit("").alias("key"), "wrapper")]
    keys = written(hosts.select("host", "wide", F.col("wide").alias("new")), "html-wide")
    while not keys.filter(F.size("new") > 0).isEmpty():
        read = _marked(pages.select("host", "html")).join(keys.filter(F.size("new") > 0), "host").select("host", "x", "y", "html", "wide", "new")
        # copies of a page come together
        dealt = read.repartition("host", "x").sortWithinPartitions("host", "x", "y")
        rows = _made(dealt, cut, "host string, key string, shape string, given string")
        partial = _aligned(rows, {**group, "shape": "string"}, [], json.loads).withColumnRenamed("wrapper", "given")
        made = written(_per_row(_aligned(partial, group, ["shape"], json.loads), _with_wide, "host string, key string, wrapper string, wide array<string>"), "html-pieces")
        found.append(made.select("host", "key", "wrapper"))
        met = made.filter(F.size("wide") > 0).groupBy("host").agg(F.flatten(F.collect_list("wide")).alias("met"))
        more = F.coalesce("met", F.array().cast("array<string>"))
        keys = written(keys.join(met, "host", "left").select("host", F.concat("wide", more).alias("wide"), more.alias("new")), "html-wide")
    return functools.reduce(DataFrame.unionByName, found), keys.select("host", "wide")


def _with_wide(host: str, key: str, wrapper: str) -> Iterator[tuple]:
    yield host, key, wrapper, [] if from_end(key) else list(wide_keys(json.loads(wrapper), key))


def templates_of_pieces(found: DataFrame, wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of what infer_pieces() gives: host, template; and host, path, linked, constants of the pieces."""

    def measure(host: str, key: str, wrapper: str, wide: list[str]) -> Iterator[tuple]:
        if from_end(key):
            return
        tree = json.loads(wrapper)
        varying, hinted, _ = shown_by(closed(tree, key, frozenset(wide)), key, 0)
        yield from ((host, "varying", k, v) for k, v in varying.items())
        yield from ((host, "hinted", k, v) for k, v in hinted.items())
        if not key:
            yield from ((host, "pages", str(i), len(x)) for i, x in enumerate(tree[_PAGES]))

    def judge(host: str, key: str, wrapper: str, wide: list[str], kept: list[str] | None, main: int, rest: int, shown: int, distinct: int) -> Iterator[tuple]:
        tree, kept = closed(json.loads(wrapper), key, frozenset(wide)), sorted(kept or [])
        if not key:
            template = template_of(tree, {"main": main, "rest": rest}, kept)
            yield host, json.dumps(template), None, None, None
        else:
            for path, (linked, constants) in removed_paths(tree, key, kept, [shown, distinct]).items():
                yield host, None, path, linked, constants

    def total(kind: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("name") == name), F.col("v"))), F.lit(0))

    trees = found.join(wide, "host").select("host", "key", "wrapper", "wide")
    sums = _per_row(trees, measure, "host string, kind string, name string, v long").groupBy("host", "kind", "name").agg(F.sum("v").alias("v"))
    sums = written(sums, "html-sums")
    names = {"main": total("varying", "main"), "rest": total("varying", "rest"), "hidden": total("varying", "hinted"), "shown": total("pages", "0"), "distinct": total("pages", "1")}
    totals = sums.filter("kind != 'hinted'").groupBy("host").agg(*(v.alias(k) for k, v in names.items()))
    # as in kept_paths()
    most = sums.filter("kind = 'hinted'").join(totals, "host").filter((F.col("main") == 0) & (F.col("distinct") >= CONSTANT_PAGES) & (2 * F.col("v") > F.col("main") + F.col("rest") + F.col("hidden")))
    known = totals.join(most.groupBy("host").agg(F.collect_list("name").alias("kept")), "host", "left")
    judged = trees.join(known, "host").select("host", "key", "wrapper", "wide", "kept", "main", "rest", "shown", "distinct")
    judged = written(_per_row(judged, judge, "host string, template string, path string, linked boolean, constants array<string>"), "html-removed")
    shared = judged.filter("path is not null").groupBy("host", "path").agg(F.max("linked").alias("linked"), F.array_distinct(F.flatten(F.collect_list("constants"))).alias("constants"))
    return written(judged.filter("path is null").select("host", "template"), "html-templates"), shared


def met_by_pages(pages: DataFrame, wide: DataFrame, shared: DataFrame) -> DataFrame:
    """host, x, y, more: what the pieces of a page's host show of the paths that the page holds (JSON)."""

    def paths(host: str, x: int, y: int, html: str, wide: list[str]) -> Iterator[tuple]:
        tops = {_path(_labels(key)) for key in wide}
        found = set()

        def walk(e: Element, path: str, inside: bool) -> None:
            if inside := inside or path in tops:
                found.add(path)
            for k in e.kids:
                if isinstance(k, Element) and not k.hidden:
                    walk(k, f"{path}/{k.label}", inside)

        walk(read_page(html), "", False)
        yield from ((host, x, y, p) for p in found)

    read = _marked(pages.select("host", "html")).join(wide, "host").select("host", "x", "y", "html", "wide")
    met = _per_row(read, paths, "host string, x long, y long, path string").join(shared, ["host", "path"])
    # as a set, for copies of a page
    return met.groupBy("host", "x", "y").agg(F.to_json(F.collect_set(F.struct("path", "linked", "constants"))).alias("more"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_and_path(F.col("url"))[0].alias("host"))

    def templates(host: str, wrapper: str) -> Iterator[tuple]:
        tree = json.loads(wrapper)
        wide = list(wide_keys(tree))
        # of a host with pieces the template comes from them too
        yield host, wide, wrapper if wide else None, None if wide else json.dumps(template_of(tree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = {None: {}}
            texts = []
            for text, template, more in zip(batch["html"].to_pylist(), batch["template"].to_pylist(), batch["more"].to_pylist(), strict=True):
                if template not in read:
                    read[template] = json.loads(template)
                texts.append(main_text(text, with_pieces(read[template], json.loads(more)) if more else read[template]))
            made = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    inferred = written(_per_row(infer(given), templates, "host string, wide array<string>, wrapper string, template string"), "html-templates")
    hosts = inferred.filter(F.size("wide") > 0)
    met = given.join(inferred.select("host", "template"), "host", "left").withColumn("more", F.lit(None).cast("string"))
    if not hosts.isEmpty():
        found, wide = infer_pieces(given, hosts)
        full, shared = templates_of_pieces(found, wide)
        more = written(met_by_pages(given, wide, shared), "html-met")
        theirs = _marked(given.join(full, "host")).join(more, ["host", "x", "y"], "left")
        # every host is known, and those without pieces have a template by now
        met = met.filter("template is not null").unionByName(theirs.select(*met.columns))
    return met.select("page_id", "url", "html", "template", "more").mapInArrow(run, f"page_id {kind['page_id']}, url string, text string, n_chars long")
