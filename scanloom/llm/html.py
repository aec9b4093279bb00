"""HTML main text (operator 4) by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf tag path (a number:
paths are nodes of a trie, so depth costs nothing). Per path, text length (without
links) and punctuation are aggregated to ratios per block; the ratios are smoothed
over the page's order and fused to one score, which a mark by name lowers. A path
whose score is at least a share of that of the heaviest path is content: its
blocks are the text. Blocks of weaker paths (headings, short paragraphs, list
items, cells) come along only if they stand in the same container as blocks of
content paths; containers are elements of general use with a class or an id.
An ``article`` or ``main`` around the heaviest path bounds the text: there weaker
paths are kept too, whatever their containers, but for lists of five links or more
that no heading heads. Menus, page footers, asides, dialogs, form controls, hidden
parts and what isn't text by its tag or role take no part, nor do containers with a
line of their own as readers' comments start or end with (who says, how long ago,
reply). An ``article`` that is named like one of these counts as such if another
article or main part has text. A first or second heading right before the text is its title.

Defined results: null or empty html, and pages without text, give the empty
string; text that isn't markup counts as one block; unclosed, crossed and cut-off
tags are read as browsers do in the plain cases; of paths that weigh the same the
one that comes first counts as the heaviest; the text of a button inside a line falls
away without splitting it; very long and very deep pages take
time and memory in proportion; repeated rows and null ids keep a row each; an
empty table gives no rows; other columns of the input aren't read.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"'>]|\Z)", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？،؛؟।]")

#: How HTML elements behave, and names by which pages mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes noscript template svg math canvas".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul caption".split()
)
#: An element that starts closes an open one of these, unless one of the second set stands between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
ASIDE_TAGS = frozenset("nav footer aside form dialog menu select button fieldset search head object".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
ASIDE_NAMES = frozenset(
    "ad adbox ads adslot adunit adv advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies"
    " discussion disqus dialog disclaimer footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination"
    " paywall popup promo promoted promotion rail recommended related reply replies respond responses search share sharing sidebar signup social sponsor sponsored subscribe"
    " subscription toolbar widget widgets".split()
)
#: Words that stand beside one of the names above without changing what it says.
FRAME_NAMES = frozenset(
    "area articles bar block body bottom box btn button col column container content cta form group head heading holder icon icons inner item items js left link links list main"
    " meta outer page panel post posts primary reader readers right row secondary section site slot stories text thread top unit user users wp wrap wrapper".split()
)
#: Tags that mark like a name does: whole pages may stand in one.
SOFT_TAGS = frozenset("form fieldset".split())
MAIN_NAMES = frozenset("article content entry main post story".split())
#: From one of these on, a name says what stands beside the element, not what it is.
BESIDE = frozenset("has with without no".split())
#: Elements of general use: with a class or an id they are containers of their own.
CONTAINERS = frozenset("div ul ol center address article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TITLES = frozenset("h1 h2".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Whole lines by which readers' comments can be told: who says, how long ago it was said (perhaps by whom), reply.
AGO = r"(?:\d+|an?|one) (?:second|minute|hour|day|week|month|year)s? ago"
BYLINE = re.compile(rf"(?:[^\s.,;:!?\"“”]+ ){{1,4}}(?:says|said|wrote|writes|commented|replied) ?:?|(?:[^\s.,;:!?\"“”]+ ){{1,4}}(?:says|said|wrote|writes|commented|replied)?,? ?{AGO} ?:?|(?:[^.!?:|·•]{{1,40}}[|·•,–-] ?)?{AGO}|reply(?: to [^.!?]{{1,40}})?", re.IGNORECASE)
#: Links from which on a list without a heading is a menu.
MENU = 5


class Element:
    """An open tag. ``path`` numbers its root-to-leaf path, ``box`` is its container, ``number`` counts in page order."""

    __slots__ = ("box", "hard", "hidden", "list", "main", "marks", "mute", "named", "number", "parent", "path", "place", "story", "tag", "top")

    def __init__(self, tag: str, parent: Element | None, number: int):
        self.tag, self.parent, self.number = tag, parent, number
        self.hard = self.hidden = self.named = self.main = False
        self.mute = parent is not None and parent.mute and tag not in BLOCK
        self.marks = ""  # what marks this element itself: nothing, "soft" or "hard"
        self.top: Element | None = parent.top if parent else None
        self.list: Element | None = self if tag in ("ul", "ol", "menu") else parent.list if parent else None
        self.story: Element | None = parent.story if parent else None  # the article by its tag
        if tag == "article" and self.story is None:
            self.story = self
        self.path, self.box, self.place = 0, parent.box if parent else self, parent.place if parent else self


@dataclass
class Block:
    element: Element
    text: str
    linked: int

    @property
    def path(self) -> int:
        return self.element.path

    @property
    def free(self) -> int:
        return max(0, len(self.text) - self.linked)


def _words(names: str):
    """The words of each name of a class or id, up to what stands beside the element."""
    for token in names.split():
        yield list(itertools.takewhile(lambda w: w not in BESIDE, (w.lower() for w in NAME.findall(token))))


def _marked(words: list[str]) -> bool:
    """Whether a name is one of ASIDE_NAMES, with none but framing words and short prefixes beside it."""
    return any(w in ASIDE_NAMES for w in words) and all(w in ASIDE_NAMES or w in FRAME_NAMES or len(w) == 1 for w in words)


def _element(tag: str, attributes: str, parent: Element, number: int, void: frozenset[int], paths: dict) -> Element:
    e = Element(tag, parent, number)
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    label, hard, soft, hidden, main = tag, False, False, False, tag in ("article", "main")
    if tag not in ("html", "body"):
        hard, soft = tag in ASIDE_TAGS and tag not in SOFT_TAGS, tag in SOFT_TAGS
        own_header = tag == "header" and parent.top is not None  # an article's own header holds its title
        hard = hard or (tag == "header" and not own_header)
        if found:
            names = [w for k in ("class", "id") for w in _words(found.get(k, ""))]
            role = found.get("role", "").lower()
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            main = main or role in ("main", "article") or any(w in MAIN_NAMES for words in names for w in words)
            hard = hard or hidden or role in ASIDE_ROLES
            soft = soft or (tag != "main" and not own_header and any(map(_marked, names)))
            if found.get("class", "").strip():
                label = f"{tag}.{found['class'].split()[0].lower()}"
            elif found.get("id", "").strip():
                label = f"{tag}#{re.sub('[0-9]+', '', found['id'].lower())}"
    counts = number not in void or hidden
    e.marks = "hard" if hard else "soft" if soft else ""
    e.hidden = parent.hidden or hidden
    e.hard = parent.hard or (hard and counts)
    e.named = parent.named or (soft and counts)
    e.main = main and not e.hard and not e.named
    if e.main and (e.top is None or (tag == "article" and e.top.tag != "article")):
        e.top = e  # the outermost article, else the outermost that is marked as the main part
    if tag in BLOCK:
        e.place = e
        e.path = paths.setdefault((parent.path, label), len(paths) + 1)
        if (tag in CONTAINERS and label != tag) or (tag == "article" and e.top is not e) or e.top is e:
            e.box = e
    else:
        e.path = parent.path
    return e


def blocks(page: str, void: frozenset[int] = frozenset()) -> tuple[list[Block], list[Element]]:
    """The page's blocks of text in its order, with references decoded and white space made single, and its elements.

    The marks of the elements whose numbers are in ``void`` don't count.
    """
    out: list[Block] = []
    root = Element("", None, 0)
    stack, every, parts, linked, links = [root], [root], [], 0, 0
    open_tags: Counter = Counter()
    paths: dict[tuple[int, str], int] = {}

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].mute:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if links:
                linked += len(" ".join(raw.split()))

    def flush() -> None:
        nonlocal linked
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                out.append(Block(stack[-1].place, joined, linked))
            parts.clear()
        linked = 0

    def drop(i: int) -> None:
        nonlocal links
        for e in stack[i:]:
            links -= e.tag == "a"
            open_tags[e.tag] -= 1
        del stack[i:]

    def pop_to(i: int) -> None:
        flush()
        drop(i)

    pos, size = 0, len(page)
    while pos < size:
        m = TOKEN.search(page, pos)
        if m is None:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            if not open_tags[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                e = stack[i]
                if e.tag == tag:
                    if tag in BLOCK:
                        pop_to(i)
                    else:
                        drop(i)
                    break
                if e.tag in BLOCK and tag not in BLOCK:
                    break  # an inline end tag doesn't close a block
            continue
        if tag in RAW:
            if not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, pos)
                pos = end.end() if end else size
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in BLOCK:
            flush()
            if open_tags["p"]:
                for i in range(len(stack) - 1, 0, -1):  # a block closes the paragraph that it stands in
                    if stack[i].tag == "p":
                        pop_to(i)
                        break
                    if stack[i].tag in BLOCK:
                        break
            shut, until = CLOSES.get(tag, ((), ()))
            if any(open_tags[t] for t in shut):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in until:
                        break
                    if stack[i].tag in shut:
                        pop_to(i)
                        if tag != "tr" or stack[-1].tag not in shut:
                            break
        if tag in VOID:
            continue
        e = _element(tag, m[3] or m[6] or "", stack[-1], len(every), void, paths)
        if tag not in BLOCK and e.hard and not stack[-1].hard:
            e.mute = True  # what it holds falls out of its line
        elif tag not in BLOCK and (e.hard, e.named) != (stack[-1].hard, stack[-1].named):
            flush()  # a hidden or marked inline element doesn't run into its block
            e.tag, e.place = "div", e
            e.path = paths.setdefault((e.parent.path, f"{tag}!"), len(paths) + 1)
        every.append(e)
        stack.append(e)
        open_tags[e.tag] += 1
        links += e.tag == "a"
    flush()
    return out, every


KERNEL = np.exp(-0.5 * (np.arange(-2, 3) / 1.0) ** 2)
#: Share of the heaviest path's fused score that a content path has at least.
THRESHOLD = 0.2
#: What is left of the score of a path with a mark by name.
NAMED = 1e-3
#: Share of the heaviest path's weight that content paths in other places of the page have at least.
APART = 0.2
#: Share of a path's text that isn't linked, below which it is a menu.
FREE = 0.1


def path_scores(found: list[Block], named: bool = True) -> dict[int, float]:
    """The fused score of each path of the blocks."""
    total: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0])
    for b in found:
        t = total[b.path]
        t[0] += 1
        t[1] += b.free
        t[2] += len(PUNCTUATION.findall(b.text)) if b.linked * 2 < len(b.text) else 0
    ratio = np.array([[total[b.path][1] / total[b.path][0], total[b.path][2] / total[b.path][0]] for b in found])
    weight = np.convolve(np.ones(len(found)), KERNEL)[2:-2]
    smooth = np.stack([np.convolve(ratio[:, k], KERNEL)[2:-2] / weight for k in (0, 1)], axis=1)
    fused: dict[int, list[float]] = defaultdict(list)
    for b, own, near in zip(found, ratio, smooth, strict=True):
        # punctuation counts as the text that it usually comes with
        score = np.sqrt((own[0] + 1) * (near[0] + 1)) * (1 + np.sqrt(own[1] * near[1]))
        fused[b.path].append(score * (NAMED if named and b.element.named else 1))
    return {p: float(np.mean(v)) for p, v in fused.items()}


def content_paths(found: list[Block], named: bool = True) -> tuple[set[int], dict[int, float]]:
    """The paths that pass the threshold, and each path's weight (score times text), the heaviest first."""
    scores = path_scores(found, named)
    weight: dict[int, float] = defaultdict(float)
    for b in found:
        weight[b.path] += scores[b.path] * max(1, b.free)
    order = dict(sorted(weight.items(), key=lambda x: -x[1]))
    bar = THRESHOLD * scores[next(iter(order))]
    return {p for p, s in scores.items() if s >= bar}, order


def void_marks(every: list[Block]) -> frozenset[int]:
    """Numbers of the elements whose marks don't count.

    Those are all that hold a ``main`` element; and forms and names that hold the page's
    heaviest path, if no path outside of marks passes the threshold beside it.
    """
    void: set[int] = set()
    seen: set[int] = set()

    def upwards(e: Element | None, soft: bool) -> None:
        while e is not None and e.number not in void:
            if e.marks == "soft" or (e.marks == "hard" and not soft):
                void.add(e.number)
            elif e.number in seen:
                break
            seen.add(e.number)
            e = e.parent

    looked: set[int] = set()
    for b in every:
        e = b.element
        while e is not None and e.number not in looked:
            looked.add(e.number)
            if e.tag == "main" and not e.hidden and (e.hard or e.named):
                upwards(e.parent, soft=False)
            e = e.parent
    shown = [b for b in every if not b.element.hidden]
    if not any(b.element.top is not None and b.element.top.tag in ("article", "main") and not (b.element.hard or b.element.named) for b in shown):
        for b in shown:  # no other article: a name on the one that there is says nothing
            story = b.element.story
            if story is not None and story.marks == "soft" and not b.element.hard:
                void.add(story.number)
    if void or all(not (b.element.hard or b.element.named) for b in shown):
        return frozenset(void)
    passing, weight = content_paths(shown, named=False)
    if any(b.path in passing and not (b.element.hard or b.element.named) for b in shown):
        return frozenset()
    best = next(iter(weight))
    for b in shown:
        if b.path == best:
            upwards(b.element, soft=True)
    return frozenset(void)


def _common(elements: list[Element]) -> Element:
    """The lowest element that holds all of them: that of the first and the last one in page order."""
    low, high = min(elements, key=lambda e: e.number), max(elements, key=lambda e: e.number)
    while low is not high:
        if low.number > high.number:
            low, high = high, low
        high = high.parent
    return low


def _comments(found: list[Block], own: set[int]) -> set[int]:
    """Paths of containers at least half of which hold a line of its own as readers' comments have; ``own`` are never."""
    holders: dict[int, set[int]] = defaultdict(set)
    signed: dict[int, set[int]] = defaultdict(set)
    for b in found:
        line = BYLINE.fullmatch(b.text) is not None
        box, depth = b.element.box, 0
        while depth < 3 and box is not None and box.path not in own:  # a comment's parts may be containers too
            holders[box.path].add(box.number)
            if line:
                signed[box.path].add(box.number)
            box, depth = box.parent.box if box.parent is not None else None, depth + 1
    return {p for p, n in signed.items() if 2 * len(n) >= len(holders[p])}


def _link_lists(found: list[Block]) -> set[int]:
    """Numbers of the blocks of lists that hold nothing but links, ``MENU`` or more, without a heading right before."""
    lists: dict[int, list[int]] = defaultdict(list)
    for k, b in enumerate(found):
        if b.element.list is not None:
            lists[b.element.list.number].append(k)
    out: set[int] = set()
    for own in lists.values():
        free, size = sum(found[k].free for k in own), sum(len(found[k].text) for k in own)
        headed = own[0] > 0 and found[own[0] - 1].element.tag in HEADINGS
        if len(own) >= MENU and free < FREE * size and not headed:
            out.update(own)
    return out


def main_text(page: str | None) -> str:
    every, elements = blocks(page or "")
    if void := void_marks(every):
        every, elements = blocks(page or "", void)
    found = [b for b in every if not b.element.hard]
    if not found:
        return ""
    passing, weight = content_paths(found)
    best = next(iter(weight))
    if any(b.path == best and b.element.named for b in found):
        return ""  # nothing but what is marked
    last = [e.number for e in elements]
    for e in reversed(elements[1:]):
        last[e.parent.number] = max(last[e.parent.number], last[e.number])

    heaviest = [b for b in found if b.path == best]
    regions = {b.element.top.number for b in heaviest if b.element.top is not None}
    if not regions:  # no element says that it is the article
        members = defaultdict(list)
        for b in found:
            members[b.path].append(b.element)
        for own in (members[p] for p, w in weight.items() if p in passing and w >= APART * weight[best]):
            region = _common(own)
            if len(own) == 1 and region.parent is not None and region.tag not in CONTAINERS:
                region = region.parent
            regions.add(region.number)
    inside, end = set(), -1
    for n in sorted(regions):
        inside.update(range(max(n, end + 1), last[n] + 1))
        end = max(end, last[n])

    total: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
    for b in found:
        t = total[b.path]
        t[0], t[1], t[2] = t[0] + 1, t[1] + b.free, t[2] + len(b.text)
    menus = {p for p, (n, free, size) in total.items() if n > 1 and free < FREE * size}
    strong = [b for b in found if b.path in passing and b.element.number in inside and not b.element.named]
    boxes, up = set(), [b.element.box for b in heaviest]
    exempt: set[int] = set()
    for box in up:
        while box is not None and box.path not in exempt:
            exempt.add(box.path)
            box = box.parent.box if box.parent is not None else None
    comments = _comments([b for b in found if b.element.number in inside], exempt)
    memo: dict[int, bool] = {}

    def commented(box: Element | None) -> bool:
        chain = []
        while box is not None and box.number not in memo:
            chain.append(box)
            if box.path in comments:
                break
            box = box.parent.box if box.parent is not None else None
        value = memo.get(box.number, True) if box is not None else False
        for b in chain:
            memo[b.number] = value
        return value

    boxes = {b.element.box.path for b in strong if not commented(b.element.box)}
    lists = _link_lists(found)
    kept, first = [], None
    for k, b in enumerate(found):
        e = b.element
        if e.number not in inside or e.named or commented(e.box):
            continue
        bounded = e.top is not None and e.top.tag in ("article", "main")
        if bounded:
            keep = k not in lists
        elif b.path in passing:
            keep = True
        elif e.tag in HEADINGS and k + 1 < len(found) and (found[k + 1].path in passing or found[k + 1].element.box.path in boxes):
            keep = True  # a heading goes with what it heads
        else:
            keep = e.box.path in boxes and (e.tag in HEADINGS or b.path not in menus)
        if keep:
            first = k if first is None else first
            kept.append(b)
    if first and found[first].element.tag not in TITLES and found[first - 1].element.tag in TITLES and not found[first - 1].element.named:
        kept.insert(0, found[first - 1])
    return "\n".join(b.text for b in kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
