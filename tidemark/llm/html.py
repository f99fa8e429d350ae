"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of block tags and text slots (inline markup belongs to the text), kept as a tree of groups. Inside a
page, groups that recur side by side are aligned with each other and become one repeated group. Same-host pages are aligned
one after another with the wrapper so far: what both have is one group, what one of the two lacks becomes an optional
group, texts become slots. A wrapper's slots remember how much they said, how much of it in links, and whether all pages
said the same there; pages that are copies or near copies of one another count once for that. Wrappers are put together map-side, then in
salted parts, so that no task holds a hot host.

The wrapper decides: from its root one goes down into the group that holds most of what varies from page to page and is no
link, as far as one group does; that group holds the article. Slots that say the same on several unlike pages are the
template's. Each page is then aligned with its host's wrapper, and its blocks go where their groups go. The HTML
standard's kinds of elements, and class names, only weigh in: see ``_PRIOR`` and ``dropped``.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

# Kinds of HTML elements, and names that hint at what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p ul ol li dl dt dd pre blockquote figure figcaption address".split())
OUTSIDE = frozenset("nav footer aside form button dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
HINTS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo sidebar nav navbar menu breadcrumb breadcrumbs footer cookie cookies consent notice banner popup modal newsletter subscribe signup social share sharing related recommended comment comments respond disqus pagination pager masthead topbar skip".split())
FILLERS = frozenset("posts articles links list item items box block wrapper wrap container buttons button bar icons slot area section widget site main top bottom left right side page unit inner media primary secondary to the".split())
_PRIOR = {"article": 4.0, "main": 4.0, "header": 0.25}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|</?[a-zA-Z][^>]*\Z|(?P<text>[^<]+|<)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: A group is gone down into if it holds this share of what varies at its level (the second on a host of less than UNLIKE unlike pages, and for a page unlike its host, which
#: can't tell well), and the text beside it is below the third.
BULK, BULK_OF_FEW, ASIDE = 0.5, 0.8, 0.05
#: Groups side by side recur if what they hold is so similar.
ALIKE = 0.3
#: Unlike pages on which a slot has to say the same to be the template's.
UNLIKE = 3
#: A group with a hinting name stays if it holds this share of the article; groups with this share of links are menus.
LARGE, LINKS = 0.25, 0.8
#: Groups of a wrapper beyond which its labels lose their classes (names made anew for each page would let it grow without end).
WIDEST = 20_000
#: Child lists whose lengths multiply beyond this are aligned by longest matching blocks instead of a longest common subsequence.
TABLE = 250_000
#: Parts into which a host's wrappers are dealt before they are put together, and hosts that a task remembers at a time.
SALTS, HELD = 16, 2_000
MAX_BROADCAST_BYTES = 64_000_000
VARIES = 0


class Group:
    """label, whether it may lack or recur (with its neighbours of one run, if it is in one), its groups, and what its pages say of it.
    "#" is a text slot."""

    __slots__ = ("chars", "into", "kids", "label", "links", "many", "opt", "pages", "run", "said", "seen", "times", "unlike")

    def __init__(self, label: str):
        self.label, self.opt, self.many, self.run, self.kids, self.into = label, False, False, 0, [], None
        self.pages = self.times = 1
        self.chars = self.links = 0
        self.said, self.seen, self.unlike = None, [], []  # hash of the text, or VARIES; hashes that tell unlike pages apart, by two measures

    @property
    def tag(self) -> str:
        return self.label.lstrip("!~").partition(".")[0]

    def constant(self) -> bool:
        return self.said != VARIES and len(self.seen) >= UNLIKE and len(self.unlike) >= UNLIKE


def resolve(g: Group) -> Group:
    while g.into is not None:
        if g.into.into is not None:
            g.into = g.into.into
        g = g.into
    return g


def hinting(name: str) -> bool:
    """Whether a class or id consists of names that hint at something beside the article, and fillers: ad-slot, but not ad-hoc."""
    parts = [p for p in re.split(r"[-_\d]+", name.lower()) if p]
    return any(p in HINTS for p in parts) and all(p in HINTS or p in FILLERS for p in parts)


def label_of(tag: str, attrs: str) -> str:
    """A group's label: its tag and classes, numbers of several digits as 0; after ! if the standard says that it isn't content, ~ if a name hints so."""
    if not attrs:
        return "!" + tag if tag in OUTSIDE else tag
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)}
    names = found.get("class", "").split()
    label = tag + ("." + re.sub(r"\d\d+", "0", " ".join(names)) if names else "")
    if tag in OUTSIDE or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return "!" + label
    return "~" + label if tag not in ("article", "main", "body", "html") and any(map(hinting, [*names, found.get("id", "")])) else label


# -- alignment ------------------------------------------------------------------------------------


def similarity(x: Group, y: Group) -> float:
    """Of two groups of one label: 1 for texts, else the cosine of what they hold, so that plain divs of unlike purpose are told apart."""
    if x.label == "#" or x.tag in TEXTUAL or not (x.kids or y.kids):
        return 1.0
    p, q = ({}, {})
    for g, own in ((x, p), (y, q)):
        for k in g.kids:
            own[k.label] = own.get(k.label, 0) + k.pages
    shared = sum(v * q.get(k, 0) for k, v in p.items())
    return shared / math.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values())) if shared else 0.0


def matching(xs: list[Group], ys: list[Group]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence of labels; where a label comes more than once, of the subsequence that is most similar."""
    a, b = [g.label for g in xs], [g.label for g in ys]
    once = len(set(a)) == len(a) and len(set(b)) == len(b)
    if a == b and once:
        return [(i, i) for i in range(len(a))]
    if len(a) * len(b) > TABLE:
        return [(m.a + k, m.b + k) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for k in range(m.size)]
    best = [[0.0] * (len(b) + 1)]
    for i in range(len(a) - 1, -1, -1):
        below, row, u = best[-1], [0.0], a[i]
        for j in range(len(b) - 1, -1, -1):
            skip = max(below[j], row[-1])
            row.append(max(skip, below[j + 1] + (1.0 if once else 0.01 + similarity(xs[i], ys[j]))) if u == b[j] else skip)
        best.append(row[::-1])
    best.reverse()
    i = j = 0
    found = []
    while i < len(a) and j < len(b):
        if best[i][j] == best[i + 1][j]:
            i += 1
        elif best[i][j] == best[i][j + 1]:
            j += 1
        else:
            found.append((i, j))
            i, j = i + 1, j + 1
    return found


def squares(kids: list[Group]) -> tuple[list[Group], list[tuple[Group, Group]]]:
    """Runs of up to three groups that recur side by side: the list with the first of each, and what is to be merged into what."""
    out: list[Group] = []
    merges = []
    for g in kids:
        out.append(g)
        merges += square(out)
    return out, merges


def square(out: list[Group]) -> list[tuple[Group, Group]]:
    """Whether the last groups of a list recur: then they are taken off it, to be merged into the ones before."""
    for k in (1, 2, 3):
        if len(out) >= 2 * k and all(out[-i].label == out[-i - k].label for i in range(1, k + 1)) and all(similarity(out[-i], out[-i - k]) >= ALIKE for i in range(1, k + 1)):
            again = out[-k:]
            del out[-k:]
            if k == 1:
                out[-1].many = True
            else:
                one_run(out, {g.run for g in (*out[-k:], *again)} - {0}, out[-k:])
            return list(zip(out[-k:], again, strict=True))
    return []


def one_run(kids: list[Group], runs: set[int], more: list[Group]) -> None:
    """Make one run of the groups of some runs, some more groups, and all between them."""
    at = [i for i, g in enumerate(kids) if g.run in runs or any(g is m for m in more)]
    while True:  # runs that reach into it belong to it
        inside = {g.run for g in kids[at[0] : at[-1] + 1]} - {0}
        wider = [i for i, g in enumerate(kids) if g.run in inside]
        if not wider or (wider[0] >= at[0] and wider[-1] <= at[-1]):
            break
        at = [min(at[0], wider[0]), max(at[-1], wider[-1])]
    name = 1 + max(g.run for g in kids)
    for g in kids[at[0] : at[-1] + 1]:
        g.run = name


def merge(a: Group, b: Group, same_page: bool) -> None:
    """Align b with a and put it into a: of one page, an instance of a repeated group; else the same group on other pages."""
    work = [(a, b, same_page)]
    while work:
        x, y, same = work.pop()
        y.into = x
        x.opt |= y.opt
        x.many |= y.many
        x.times += y.times
        if not same:
            x.pages += y.pages
        x.chars += y.chars
        x.links += y.links
        x.said = x.said if x.said == y.said else VARIES
        x.seen, x.unlike = (sorted({*p, *q})[:UNLIKE] for p, q in ((x.seen, y.seen), (x.unlike, y.unlike)))
        if not x.kids and not y.kids:
            continue
        pairs = matching(x.kids, y.kids)
        if len(pairs) == len(x.kids) == len(y.kids) and not any(g.run for g in y.kids):
            work += [(x.kids[p], y.kids[q], same) for p, q in pairs]
            continue
        first = max((g.run for g in x.kids), default=0)
        for g in y.kids:
            g.run += first if g.run else 0
        kids, i, j = [], 0, 0
        for p, q in [*pairs, (len(x.kids), len(y.kids))]:
            for g in [*x.kids[i:p], *y.kids[j:q]]:
                g.opt = True
                kids.append(g)
            if p < len(x.kids) and q < len(y.kids):
                kids.append(x.kids[p])
            i, j = p + 1, q + 1
        matched = [(x.kids[p], y.kids[q], same) for p, q in pairs]
        for name in {g.run for g in y.kids} - {0}:
            own = [u for u, v, _ in matched if v.run == name] + [v for v in y.kids if v.run == name and any(v is k for k in kids)]
            one_run(kids, {name, *(u.run for u in own)} - {0}, own)
        for name in {g.run for g in kids} - {0}:  # what came between the groups of a run belongs to it
            if any(g.run == name for g in kids):
                one_run(kids, {name}, [])
        x.kids, again = squares(kids)
        work += [(u, v, True) for u, v in reversed(again)]  # after what is below them
        work += matched


def parse(page: str | None) -> tuple[Group, list[tuple[Group, str, int, bool]]]:
    """The wrapper of a single page, and its blocks in page order: (slot, text, characters in links, whether the standard puts it outside)."""
    root = Group("")
    stack: list[tuple[str, Group, bool]] = [("", root, False)]  # tag, group, outside
    opened: Counter = Counter()
    said: list[str] = []
    found: list[tuple[Group, str, int, bool]] = []
    linked, link = 0, 0  # characters in links since the last block; the depth at which a link opened

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(said)).split()) if said else ""
        said.clear()
        if text:
            slot = Group("#")
            kids = stack[-1][1].kids
            if kids and kids[-1].label == "#":
                slot = kids[-1]
            else:
                kids.append(slot)
                fold(kids)
            found.append((slot, text, min(linked, len(text)), stack[-1][2]))
        linked = 0

    def fold(kids):
        for x, y in square(kids):
            merge(x, y, True)

    def close():
        nonlocal link
        opened[stack.pop()[0]] -= 1
        link = link if link <= len(stack) else 0
        fold(stack[-1][1].kids)

    at, page = 0, page or ""
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            said.append(text)
            if link:
                linked += len(text)
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        ends, attrs = (m["end"] if m["tag"] else m["end2"]), (m["attrs"] if m["tag"] else m["attrs2"]) or ""
        if tag in RAW and not ends:
            if not attrs.endswith("/"):
                shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = shut.end() if shut else len(page)
            continue
        if tag in INLINE:
            if tag == "br":
                said.append(" ")
            elif tag == "a":
                link = 0 if ends else len(stack)
            label = label_of(tag, attrs) if not ends and tag not in VOID else tag
            if not (label[0] in "!~" or opened[tag]) or tag in VOID:
                continue
        else:
            label = label_of(tag, attrs) if not ends else tag
        flush()
        if tag in VOID:
            continue
        if ends:
            if opened[tag]:
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if stack[-1][0] == "p" and tag not in INLINE:
            close()
        for other in CLOSES.get(tag, ()):
            if stack[-1][0] == other:
                close()
        group = Group(label)
        stack[-1][1].kids.append(group)
        stack.append((tag, group, stack[-1][2] or label[0] == "!"))
        opened[tag] += 1
    flush()
    while len(stack) > 1:
        close()
    return root, [(resolve(g), text, n, out) for g, text, n, out in found]


def groups(root: Group) -> list[tuple[Group, int, Group | None]]:
    """(group, depth, the group it is in), each before what it holds."""
    out, stack = [], [(root, 0, None)]
    while stack:
        g, depth, above = stack.pop()
        out.append((g, depth, above))
        stack += [(k, depth + 1, g) for k in reversed(g.kids)]
    return out


def marks_of(text: str) -> tuple[list[int], list[int]]:
    """The least and the greatest hash of all runs of 16 bytes: equal for copies, and mostly for near copies."""
    raw = text.encode().ljust(16)
    eight = np.empty(len(raw) - 7, "u8")
    for at in range(8):
        eight[at::8] = np.frombuffer(raw, "<u8", (len(raw) - at) // 8, at)
    runs = words.mix(eight[:-8] + words.mix(eight[8:]))
    return [int(runs.min()) >> 1], [int(runs.max()) >> 1]


def described(page: str | None) -> Group:
    """The wrapper of a single page, with what its slots say."""
    root, blocks = parse(page)
    marks = marks_of("\n".join(t for _, t, _, out in blocks if not out))
    for g, _, _ in groups(root):
        g.pages, g.seen, g.unlike = 1, *marks
    texts: dict[int, list[str]] = {}
    for g, text, links, _ in blocks:
        g.chars, g.links = g.chars + len(text), g.links + links
        texts.setdefault(id(g), []).append(text)
    for g in {id(g): g for g, *_ in blocks}.values():
        g.said = (xxhash.xxh64_intdigest("\n".join(texts[id(g)])) >> 1) or 1
    return root


def expression(root: Group) -> str:
    """A wrapper as a regular expression without unions: # is a text, <label> and </label> are a group's ends."""
    out: list[str] = []
    work: list = [(root.kids, 0)]
    while work:
        kids, i = work.pop()
        if isinstance(kids, str):
            out.append(kids)
        elif i < len(kids):
            g = kids[i]
            if g.run and (i == 0 or kids[i - 1].run != g.run):
                out.append("(")
            work.append((kids, i + 1))
            if g.run and (i + 1 == len(kids) or kids[i + 1].run != g.run):
                work.append((")+", 0))
            many = ("*" if g.opt else "+") if g.many else "?" if g.opt else ""
            if g.label == "#":
                out.append(f"(#){many}")
            else:
                out.append(f"(<{g.label}>")
                work += [(f"</{g.label}>){many}", 0), (g.kids, 0)]
    return "".join(out)


def packed(root: Group) -> str:
    """A wrapper of any depth as a flat list."""
    return json.dumps([[depth, g.label, int(g.opt), int(g.many), g.run, g.pages, g.times, g.chars, g.links, g.said, g.seen, g.unlike] for g, depth, _ in groups(root)], ensure_ascii=False, separators=(",", ":"))


def unpacked(text: str) -> Group:
    above: list[Group] = []
    for depth, label, opt, many, run, *rest in json.loads(text):
        g = Group(label)
        g.opt, g.many, g.run = bool(opt), bool(many), run
        g.pages, g.times, g.chars, g.links, g.said, g.seen, g.unlike = rest
        del above[depth:]
        if above:
            above[-1].kids.append(g)
        above.append(g)
    return above[0]


def bare(root: Group) -> Group:
    """A wrapper whose labels have lost their classes."""
    nodes = groups(root)
    for g, _, _ in nodes:
        g.label = g.label.partition(".")[0]
    for g, _, _ in reversed(nodes):
        if g.into is None:
            g.kids, again = squares(g.kids)
            for x, y in again:
                merge(x, y, True)
    return root


def joined(a: Group | None, b: Group) -> Group:
    """The wrapper of both."""
    if a is None:
        a = b
    else:
        for x, y in ((a, b), (b, a)):
            if x.label == "bare" != y.label:
                bare(y).label = "bare"
        merge(a, b, False)
    if a.label != "bare" and len(groups(a)) > WIDEST:
        bare(a).label = "bare"
    return a


def often(g: Group, up: Group) -> bool:
    """Whether a group mostly recurs in the one that it is in."""
    return g.times >= 1.5 * up.times


# -- what a wrapper decides -----------------------------------------------------------------------


class Wrapper:
    def __init__(self, root: Group):
        self.root, nodes = root, groups(root)
        self.above = {id(g): up for g, _, up in nodes}
        self.mass: dict[int, float] = {}  # what varies and isn't a link, weighed
        self.plain: dict[int, int] = {}  # all that is said
        self.links: dict[int, int] = {}
        for g, _, _ in reversed(nodes):
            below = [self.mass[id(k)] for k in g.kids]
            own = 0 if g.label != "#" or g.constant() else max(0, g.chars - g.links)
            weight = 0.0 if g.label[:1] == "!" else _PRIOR.get(g.tag, 0.25 if g.label[:1] == "~" else 1.0) * (2.0 if any(k.tag == "h1" for k in g.kids) else 1.0)
            self.mass[id(g)] = weight * (own + sum(below))
            self.plain[id(g)] = g.chars + sum(self.plain[id(k)] for k in g.kids)
            self.links[id(g)] = g.links + sum(self.links[id(k)] for k in g.kids)
        self.taken = self.article()

    def article(self, present: set[int] | None = None) -> dict[int, bool]:
        """Groups that are the article's (True) or left out of it (False); those below follow them, and others aren't in it.
        ``present`` leaves the other groups of the wrapper out of account, and those that only a name speaks against."""
        here, taken = self.root, {}
        bulk = BULK if present is None and len(here.seen) >= UNLIKE else BULK_OF_FEW
        mass = lambda g: 0.0 if present is not None and (id(g) not in present or g.label[:1] == "~") else self.mass[id(g)]
        while here.tag != "article":
            total = sum(map(mass, here.kids))
            text = sum(mass(k) for k in here.kids if (k.label == "#" or k.tag in TEXTUAL) and k.tag not in HEADINGS)
            inner = [k for k in here.kids if k.tag not in TEXTUAL and k.label[:1] not in ("!", "#") and k.kids and (k.tag in ("article", "main") or not often(k, here))]
            best = max(inner, key=mass, default=None)
            known = best is not None and best.tag in ("article", "main")
            if best is None or not mass(best) or mass(best) < (BULK if known else bulk) * total or (text > ASIDE * total and not known) or (here.tag == "main" and best.tag != "article"):
                break
            for k in here.kids:
                if k.tag in HEADINGS and not all(s.constant() for s in k.kids):
                    taken[id(k)] = True
            here = best
        taken[id(here)] = True
        self.dropped(here, taken)
        return taken

    def dropped(self, article: Group, taken: dict[int, bool]) -> None:
        """Leave out, below the article's group: what the standard says isn't content; groups of a hinting name that are small,
        hold links or records; the template's slots; and, in no article or main element, menus, which are lists of links."""
        inside, up = False, article
        while up is not None:
            inside, up = inside or up.tag in ("article", "main"), self.above[id(up)]
        size = self.plain[id(article)]
        stack = list(article.kids)
        while stack:
            g = stack.pop()
            plain, links = self.plain[id(g)], self.links[id(g)]
            out = g.label[:1] == "!" or (g.label == "#" and g.constant())
            out |= g.label[:1] == "~" and (plain < LARGE * size or links >= 0.3 * plain or any(often(k, g) and k.tag not in TEXTUAL and k.label != "#" for k in g.kids))
            out |= not inside and links >= LINKS * plain > 0 and g.label != "#" and g.tag not in HEADINGS | {"p", "li", "td", "th"}
            out |= not inside and g.tag == "header"
            if out:
                taken[id(g)] = False
            else:
                stack += g.kids

    def places(self, page: Group) -> dict[int, Group]:
        """The wrapper's group of each of a page's groups, as far as they are aligned."""
        out, work = {id(page): self.root}, [(page, self.root)]
        while work:
            own, there = work.pop()
            for p, q in matching(own.kids, there.kids):
                out[id(own.kids[p])] = there.kids[q]
                work.append((own.kids[p], there.kids[q]))
        return out

    def text(self, page: str | None) -> str:
        """The blocks of a page that are in the article's groups. A page without them is asked for its own largest group; one that has nothing
        but the template's slots keeps them, and what the standard puts outside is never in it."""
        root, blocks = parse(page)
        if not blocks:
            return ""
        if self.root.label == "bare":
            bare(root)
        place = self.places(root)
        nodes = groups(root)

        def said(taken):
            state: dict[int, bool] = {}
            for g, _, up in nodes:
                own = taken.get(id(place[id(g)])) if id(g) in place else None
                state[id(g)] = own if own is not None else up is not None and state[id(up)]
            return [text for g, text, _, out in blocks if not out and state[id(resolve(g))]]

        own = said(self.taken)
        if not own:
            own = said(self.article({id(g) for g in place.values()}))
        return "\n".join(own or [text for _, text, _, out in blocks if not out])


def host_of(url: Column | str) -> Column:
    """The host of a url, in lower case; of a null or malformed one, the empty string."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (packed) of every host."""

    def shapes(batches):
        for batch in batches:
            for part in common.parts(batch, 1):
                out = [packed(described(page)) for page in part.column(1).to_pylist()]
                keys = [xxhash.xxh64_intdigest(w) - 2**63 for w in out]  # what a wrapper says of texts tells pages apart
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array(keys, pa.int64())], ["host", "wrapper", "content"])

    def together(batches):
        held: dict[str, Group] = {}

        def out():
            rows = list(held.items())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([packed(w) for _, w in rows], pa.string())], ["host", "wrapper"])

        for batch in batches:
            for host, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if host not in held and len(held) >= HELD:
                    yield out()
                held[host] = joined(held.get(host), unpacked(text))
        yield out()

    kind = "host string, wrapper string"
    seen = pages.select(host_of("url").alias("host"), "html").mapInArrow(shapes, f"{kind}, content bigint").dropDuplicates(["host", "content"])
    merged = seen.mapInArrow(together, kind).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    for keys in (["host", "salt"], ["host"]):
        merged = merged.repartition(*keys).sortWithinPartitions("host", "wrapper").mapInArrow(together, kind)
        merged = merged.withColumn("salt", F.lit(0))
    return common.written(merged.groupBy("host").agg(F.first("wrapper").alias("wrapper")), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html, however long or deep.

    Null and empty pages have the empty text; a null or malformed url is a host of its own. Pages of one url or id are
    pages of their own, and equal pages have equal texts. Other columns are ignored.
    """
    found = wrappers(pages)
    keyed = pages.select("page_id", "url", "html").withColumn("at", host_of("url"))
    size = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= MAX_BROADCAST_BYTES:
        both = keyed.join(F.broadcast(found), keyed.at == found.host, "left")
    else:  # a hot host's pages are dealt to salts, each with the wrapper
        dealt = found.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)))
        both = keyed.join(dealt, (keyed.at == dealt.host) & (keyed.salt == dealt.deal), "left")
    both = both.select("page_id", "url", "html", "wrapper")
    kind = both.schema["page_id"].dataType.simpleString()

    def texts(batches):
        known: dict[str, Wrapper] = {}
        for batch in batches:
            for part in common.parts(batch, 2):
                out = []
                for page, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if text not in known:
                        if len(known) >= 64:
                            known.clear()
                        known[text] = Wrapper(unpacked(text))
                    out.append(known[text].text(page))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
