"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of tags and text slots.  Within a page, neighbouring runs of equal
structure are folded into a repeated group.  The streams of a host are then aligned one by
one: what both have stays, what only one has becomes an optional group, a run that the other
repeats becomes a repeated group, and text that differs becomes a slot.  What is left is the
host's wrapper, an expression of tags, constant texts, slots, ``(...)?`` and ``(...)+``
without alternatives.

A host's template is read off its expression.  Every different page is aligned with it, which
gives each text its place there.  A text belongs to the template if a share of the pages have it,
constant in their own expressions, at one place.  A page of another layout, or an empty one,
counts as one page that lacks it.  Pages and expressions are taken whole, however long they are.
Texts that have no place, as they stand in a long stretch that nothing tells apart, are told by
their path of elements.

Counts are sums, and wrappers are merged in each task, then in groups of bounded size, so a
host with any number of pages never meets in one task.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from textlab.llm.batches import slices
from textlab.storage import materialize

#: Wrappers that are merged in one group at most.
FAN_IN = 64
#: Two stretches are compared token by token up to this product of their lengths; longer ones are
#: first cut at the tokens, or runs of so many tokens, that occur once in either.
MAX_COMPARED = 360_000
RUNS = (1, 2, 4, 8, 16, 32)
#: Expressions of different structure, and alignments, that a worker holds, and the tokens of those.
HELD_PAGES = 2000
HELD_TOKENS = 1_000_000
#: Different pages of a host that must share a text before it counts as template, and the
#: share of its different pages.
LEAST_PAGES = 3
LEAST_SHARE = 0.5

# Fixed values of HTML: elements within a line, without content, with raw content.
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script style noscript template iframe textarea title svg canvas object select"
# Elements and words of class and id that hold no main text.
_ASIDE_TAGS = set("head nav footer aside form button dialog menu figure-ad".split())
_ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar menu "
    "nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer copyright related recommended "
    "recommendations share sharing social widget comment comments commentlist disqus respond reply replies skip".split()
)
# Words that say where or how large something is, or what kind of box: with them a name still means
# what its other words mean ("ad-slot", "related-posts"); with any other word it may be about
# anything ("share-price", "social-history").
_PLAIN_WORDS = set(
    "a and area article articles aside author avatar banner bar block body bottom box button buttons by card cards "
    "center col column container content count counter div entry first float for foot footer form global grid group "
    "head header heading holder icon icons img in inline inner input item items js large last layout left link links "
    "list local main meta mobile module of on outer page panel parent placeholder post posts primary region right row "
    "script secondary section site sticky slot small span stories story strip sub tags text the thread title to top "
    "ui teaser teasers ul unit us view wrap wrapper x xl xs sm md lg wp id c b".split()
)
# These hold titles when they stand in the article itself.
_HEADER_WORDS = {"header", "masthead"}
_MAIN_WORDS = {"article", "post", "entry", "hentry", "content", "main", "story"}
# What answers to or points away from a text, never the text of the page if it has another.
_OTHER_WORDS = set("comment comments commentlist disqus respond reply replies related recommended recommendations".split())
# A name that begins or ends so tells of the page or of a target, not what its element is ("has-sidebar", "no-comments").
_STATE_FIRST = {"has", "have", "no", "non", "not", "with", "without"}
_STATE_LAST = {"open", "closed", "enabled", "disabled", "target", "anchor"}
_ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({_RAW.replace(' ', '|')})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"},
}


class Block:
    """A stretch of text between block boundaries."""

    __slots__ = ("path", "aside", "main", "doubt", "text", "linked")

    def __init__(self, path: str, aside: bool, main: int, doubt: int):
        self.path, self.aside, self.main, self.doubt, self.text, self.linked = path, aside, main, doubt, [], 0


# Token, set aside whatever it holds, set aside by name, main content.
_Element = tuple[str, bool, int, int]
_ELEMENTS: dict[tuple[str, str, bool], _Element] = {}


def _element(name: str, attributes: str, in_main: bool) -> _Element:
    """Token of an opening tag, whether it is set aside by tag or state, by its names (2: as
    what answers to another text), whether it opens main content (2: the page's one main part)."""
    key = name, attributes, in_main
    if key not in _ELEMENTS:
        if len(_ELEMENTS) > 20_000:
            _ELEMENTS.clear()
        _ELEMENTS[key] = _read_element(*key)
    return _ELEMENTS[key]


def _named_aside(label: str, opens_main: bool) -> int:
    """Whether names set their element aside; a part that is main by another name stays."""
    level, main = 0, False
    for name in label.split():
        words = [w.lower() for w in _NAME_WORD.findall(name)]
        if not words or words[0] in _STATE_FIRST or (opens_main and words[-1] in _STATE_LAST):
            continue
        # Whole names: a word that is no plain one makes the name speak of something else.
        named = {w for w in words if not w.isdigit()} - _PLAIN_WORDS
        if not _ASIDE_WORDS.isdisjoint(words) and named <= _ASIDE_WORDS:
            level = max(level, 1 if _OTHER_WORDS.isdisjoint(words) else 2)
        elif not _MAIN_WORDS.isdisjoint(words):
            main = True
    return max(level - 1, 0) if opens_main and main else level


def _read_element(name: str, attributes: str, in_main: bool) -> _Element:
    found = {}
    for key, *values, hidden in _ATTRIBUTE.findall(attributes):
        found[(key or hidden).lower()] = next((v for v in values if v), "")
    label = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in _NAME_WORD.findall(label)}
    role = found.get("role", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    gone = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style
    main = 2 if name == "main" or role == "main" else int(name == "article" or role == "article")
    aside = name in _ASIDE_TAGS or role in _ASIDE_ROLES or gone
    named = _named_aside(label, main > 0)
    if not in_main:
        aside = aside or name == "header"
        named = named or int(bool(words & _HEADER_WORDS))
    if name in ("html", "body"):
        aside, named = gone, 0
    kind = ".".join(sorted(words - set("0123456789"))[:3])
    return f"{name}.{kind}" if kind and name not in ("html", "body") else name, aside, named, main


def _standing(stack: list[tuple[str, str, bool, int, int]]) -> tuple[bool, int]:
    """Whether a text within these elements is set aside, and if only by names at or above
    the outermost main element, the level of those.

    The page's one main part is not set aside by any name, as nothing else would be left.
    """
    if any(s[2] for s in stack):
        return True, 0
    at = next((i for i, s in enumerate(stack) if s[4]), len(stack))
    if any(s[3] for s in stack[at + 1 :]):
        return True, 0
    above = max((s[3] for s in stack[:at]), default=0)
    if at == len(stack):
        return above > 0, 0
    if stack[at][4] == 2 or not (above or stack[at][3]):
        return False, 0
    return True, 0 if above == 2 else max(above, stack[at][3])


def parse(page: str | None) -> tuple[list[str], list[Block]]:
    """Structure tokens and text blocks of a page; block ``i`` is the token ``#i``."""
    tokens: list[str] = []
    blocks: list[Block] = []
    # Open elements: name, token, aside, named aside, main.
    stack: list[tuple[str, str, bool, int, int]] = [("", "", False, 0, 0)]
    links = parts = 0
    current: Block | None = None

    def close(to: int) -> None:
        while len(stack) > to:
            name, token, *_ = stack.pop()
            if name not in _INLINE:
                tokens.append(f"</{token}>")

    for found in _TOKEN.finditer(page or ""):
        text = found[0]
        if text[0] != "<" or len(text) == 1:
            if current is None:
                if text.isspace():
                    continue
                path = ">".join(t for n, t, *_ in stack[1:] if n not in _INLINE)
                aside, doubt = _standing(stack)
                current = Block(path, aside, parts if any(s[4] for s in stack) else 0, doubt)
                tokens.append(f"#{len(blocks)}")
                blocks.append(current)
            current.text.append(text)
            if links:
                current.linked += len(text)
            continue
        name = (found[3] or "").lower()
        if not name:
            continue
        inline = name in _INLINE
        if found[2]:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if name == "a":
                links = 0
            if at:
                if inline and any(s[0] not in _INLINE for s in stack[at:]):
                    continue  # an element within a line does not close blocks
                close(at)
            if not inline:
                current, links = None, 0
            continue
        if name == "br":
            if current is not None:
                current.text.append(" ")
            continue
        if not inline:
            current, links = None, 0
            closing = _CLOSES.get(name, set()) | {"p"}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closing:
                    close(i)
                    break
                if stack[i][0] not in _INLINE and stack[i][0] not in ("p", "td", "th", "tr", "thead"):
                    break
        if name in _VOID or found[4].endswith("/"):
            if not inline:
                tokens.append(f"<{name}/>")
            continue
        if name == "a":
            links = 1
        if inline:
            # What is set aside within a line has a block of its own; links are only counted.
            plain = name == "a" or not found[4].strip()
            token, aside, named, main = (name, False, 0, 0) if plain else _element(name, found[4], True)
            if aside or named:
                current = None
        else:
            in_main = any(s[4] for s in stack)
            token, aside, named, main = _element(name, found[4], in_main)
            parts += bool(main) and not in_main
            tokens.append(f"<{token}>")
        stack.append((name, token, aside, named, main))
    return tokens, blocks


def block_text(block: Block) -> str:
    return " ".join(html_lib.unescape("".join(block.text)).split())


# ------------------------------------------------------------------ expressions
# A node is a tag ("<p>"), a text ["=", hash or None] (None: a slot), or a group
# ["+" or "?", nodes].


def _text_key(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}".encode()) >> 1


def page_nodes(tokens: list[str], blocks: list[Block]) -> list:
    """The stream of a page, neighbouring elements of one structure folded into groups."""
    out: list = []
    shapes: list[str] = []
    opened: list[int] = []
    for token in tokens:
        if token[0] == "#":
            block = blocks[int(token[1:])]
            out.append(["=", _text_key(block.path, block_text(block))])
            shapes.append("#")
            continue
        out.append(token)
        shapes.append(token)
        if token[1] != "/":
            if token[-2] != "/":
                opened.append(len(out) - 1)
        elif opened:
            _fold(out, shapes, opened.pop())
    return out


def _fold(out: list, shapes: list[str], at: int) -> None:
    """Fold the element that begins at ``at`` and ends the list with equal ones before it."""
    unit = shapes[at:]
    written = " ".join(unit)
    if at and shapes[at - 1] == f"({written})+":
        group = out[at - 1][1]
        out[at - 1 :] = [["+", [_joined(a, b) for a, b in zip(group, out[at:])]]]
        shapes[at - 1 :] = [f"({written})+"]
    elif at >= len(unit) and shapes[at - len(unit) : at] == unit:
        start = at - len(unit)
        out[start:] = [["+", [_joined(a, b) for a, b in zip(out[start:at], out[at:])]]]
        shapes[start:] = [f"({written})+"]


def _shape(node) -> str:
    """What makes two nodes alike: everything but the texts."""
    if isinstance(node, str):
        return node
    if node[0] == "=":
        return "#"
    return f"({' '.join(map(_shape, node[1]))}){node[0]}"


def _joined(a, b):
    """Two nodes of one shape as one: texts that differ become a slot."""
    if isinstance(a, str):
        return a
    if a[0] == "=":
        return a if a[1] == b[1] else ["=", None]
    return [a[0], [_joined(x, y) for x, y in zip(a[1], b[1])]]


def _absorb(nodes: list, shapes: list[str], groups: list) -> tuple[list, list[str]]:
    """Write stretches that the other side has as a group as that group."""
    known = Counter(shapes)
    for kind, inner in groups:
        wanted = [_shape(n) for n in inner]
        size = len(wanted)
        # A stretch is looked for at its rarest node.
        rare = min(range(size), key=lambda i: known[wanted[i]])
        starts: list[int] = []
        at = -1
        for _ in range(known[wanted[rare]]):
            at = shapes.index(wanted[rare], at + 1)
            start = at - rare
            if start >= (starts[-1] + size if starts else 0) and shapes[start : start + size] == wanted:
                starts.append(start)
        if starts:
            whole = f"({' '.join(wanted)}){kind}"
            for start in reversed(starts):
                nodes = [*nodes[:start], [kind, nodes[start : start + size]], *nodes[start + size :]]
                shapes = [*shapes[:start], whole, *shapes[start + size :]]
            known = Counter(shapes)
    return nodes, shapes


def _anchors(a: list[str], b: list[str], i: int, j: int, k: int, m: int, run: int = 1) -> list[tuple[int, int]]:
    """Places where runs of tokens begin that occur once in either stretch, as many as come in the same order."""
    runs_a = [tuple(a[x : x + run]) for x in range(i, j - run + 1)]
    runs_b = [tuple(b[y : y + run]) for y in range(k, m - run + 1)]
    once_a, once_b = Counter(runs_a), Counter(runs_b)
    at = {t: y for y, t in enumerate(runs_b, k) if once_b[t] == 1}
    pairs = [(x, at[t]) for x, t in enumerate(runs_a, i) if once_a[t] == 1 and t in at]
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, y) in enumerate(pairs):
        size = bisect_left(ends, y)
        before.append(last[size - 1] if size else -1)
        ends[size : size + 1], last[size : size + 1] = [y], [n]
    found = []
    n = last[-1] if last else -1
    while n >= 0:
        found.append(pairs[n])
        n = before[n]
    return found[::-1]


def matching(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Stretches that two sequences have in common, in order: ``(at in a, at in b, length)``."""
    found: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        n = 0
        while i + n < j and k + n < m and a[i + n] == b[k + n]:
            n += 1
        found.append((i, k, n))
        i, k, n = i + n, k + n, 0
        while i < j - n and k < m - n and a[j - n - 1] == b[m - n - 1]:
            n += 1
        j, m = j - n, m - n
        found.append((j, m, n))
        if i == j or k == m:
            continue
        if (j - i) * (m - k) <= MAX_COMPARED:
            blocks = SequenceMatcher(None, a[i:j], b[k:m], autojunk=False).get_matching_blocks()
            found += [(i + x, k + y, n) for x, y, n in blocks]
            continue
        # Stretches without such runs have nothing in common that can be told apart.
        anchors = next((found_at for run in RUNS if (found_at := _anchors(a, b, i, j, k, m, run))), [])
        found += [(x, y, 1) for x, y in anchors]
        if anchors:
            edges = [(i - 1, k - 1), *anchors, (j, m)]
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(f for f in found if f[2])


def align(a: list, b: list) -> list:
    """The expression that covers two expressions."""
    one, two = [_shape(n) for n in a], [_shape(n) for n in b]
    if one == two:
        return [_joined(x, y) for x, y in zip(a, b)]
    groups = lambda nodes: [n for n in nodes if isinstance(n, list) and n[0] != "="]
    in_a, in_b = groups(a), groups(b)
    (a, one), (b, two) = _absorb(a, one, in_b), _absorb(b, two, in_a)
    # Optional and mandatory groups of one shape are the same group.
    out: list = []
    i = k = 0
    for x, y, n in [*matching(one, two), (len(a), len(b), 0)]:
        for part in (a[i:x], b[k:y]):
            if len(part) == 1 and isinstance(part[0], list) and part[0][0] == "?":
                out += part
            elif part:
                out.append(["?", part])
        out += [_joined(p, q) for p, q in zip(a[x : x + n], b[y : y + n])]
        i, k = x + n, y + n
    return out


def flat(nodes: list) -> tuple[list[str], list[int | None]]:
    """Tags and texts (``#``) of an expression in order, what is in a group once, and the keys of the texts."""
    tokens: list[str] = []
    keys: list[int | None] = []
    for node in nodes:
        if isinstance(node, str):
            tokens.append(node)
            keys.append(None)
        elif node[0] == "=":
            tokens.append("#")
            keys.append(node[1])
        else:
            inner = flat(node[1])
            tokens += inner[0]
            keys += inner[1]
    return tokens, keys


def placed(nodes: list, wrapper: str, known: dict) -> list[tuple[int, int]]:
    """Place in the host's expression (-1: none) and key of each constant text of a page.

    ``wrapper`` has the tokens of the expression; ``known`` keeps alignments of pages of one structure,
    and how many tokens those have.
    """
    tokens, keys = flat(nodes)
    pair = wrapper, " ".join(tokens)
    if pair not in known:
        if len(known) >= HELD_PAGES or known.get("", 0) >= HELD_TOKENS:
            known.clear()
        places = [-1] * len(tokens)
        for x, y, n in matching(tokens, wrapper.split(" ")):
            places[x : x + n] = range(y, y + n)
        known[pair] = places
        known[""] = known.get("", 0) + len(tokens)
    return [(place, key) for place, key in zip(known[pair], keys) if key is not None]


def _listed(column: pa.Array) -> list:
    """The values of a column that repeats a few, each read once."""
    coded = column.dictionary_encode()
    values = coded.dictionary.to_pylist()
    return [None if i is None else values[i] for i in coded.indices.to_pylist()]


def _place_key(place: int, key: int) -> int:
    return xxhash.xxh64_intdigest(f"{place}\0{key}".encode()) >> 1


def expression(nodes: list) -> str:
    """A wrapper in writing."""
    parts = []
    for node in nodes:
        if isinstance(node, str):
            parts.append(node)
        elif node[0] == "=":
            parts.append("#text" if node[1] is None else "#constant")
        else:
            parts.append(f"( {expression(node[1])} ){node[0]}")
    return " ".join(parts)


class Wrapper:
    """A host's expression, and how many different pages it was inferred from."""

    def __init__(self, nodes: list, pages: int):
        self.nodes, self.pages = nodes, pages

    def merged(self, other: Wrapper) -> Wrapper:
        if self.nodes == other.nodes:
            return Wrapper(self.nodes, max(self.pages, other.pages))
        return Wrapper(align(self.nodes, other.nodes), self.pages + other.pages)

    def dump(self) -> str:
        return json.dumps([self.nodes, self.pages])

    @staticmethod
    def load(text: str) -> Wrapper:
        return Wrapper(*json.loads(text))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _inferrer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of hosts: one per host and Arrow batch, or more where structures differ much."""
    part = TaskContext.get().partitionId()
    # Pages of one structure are joined first; only different structures are aligned.
    same: dict[tuple[str, str], Wrapper] = {}
    held = 0

    def inferred() -> pa.RecordBatch:
        wrappers: dict[str, Wrapper] = {}
        for (name, _), own in same.items():
            wrappers[name] = wrappers[name].merged(own) if name in wrappers else own
        same.clear()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(wrappers), pa.string()),
                pa.array([part] * len(wrappers), pa.int64()),
                pa.array([w.dump() for w in wrappers.values()], pa.string()),
            ],
            ["host", "part", "wrapper"],
        )

    for batch in batches:
        for rows in slices([batch]):
            for name, page in zip(rows.column("_host").to_pylist(), rows.column("_html").to_pylist()):
                tokens, blocks = parse(page)
                nodes = page_nodes(tokens, blocks)
                if not nodes:
                    continue
                key, own = (name, " ".join(map(_shape, nodes))), Wrapper(nodes, 1)
                held += 0 if key in same else len(tokens)
                same[key] = same[key].merged(own) if key in same else own
                if len(same) >= HELD_PAGES or held >= HELD_TOKENS:
                    yield inferred()
                    held = 0
        yield inferred()
        held = 0


def _merge(group: pa.Table) -> pa.Table:
    wrappers = [Wrapper.load(w) for w in sorted(group.column("wrapper").to_pylist())]
    merged = wrappers[0]
    for w in wrappers[1:]:
        merged = merged.merged(w)
    return pa.table(
        {"host": group.column("host")[:1], "part": group.column("part")[:1], "wrapper": pa.array([merged.dump()])}
    )


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page with text: its host, what tells it from other pages, its constant texts at their
    places in the host's expression, and by path alone."""
    known: dict = {}
    for rows in slices(batches):
        out: list[tuple[str, bytes, list[int]]] = []
        columns = (rows.column("_host").to_pylist(), rows.column("_html").to_pylist(), _listed(rows.column("wrapper")))
        for name, page, wrapper in zip(*columns):
            tokens, blocks = parse(page)
            if blocks:
                texts = "\0".join([" ".join(tokens), *map(block_text, blocks)])
                own = xxhash.xxh3_128_digest(texts.encode())
                at = placed(page_nodes(tokens, blocks), wrapper or "", known)
                keys = {_place_key(place, key) for place, key in at} | {_place_key(-1, key) for _, key in at}
                out.append((name, own, sorted(keys)))
        kinds = (pa.string(), pa.binary(), pa.list_(pa.int64()))
        columns = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), kind) for c, kind in zip(columns, kinds)], ["host", "page", "texts"]
        )


def _aligned(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``host, wrapper``: the aligned expression of each host as :meth:`Wrapper.dump` writes it; stored.

    Each round merges the wrappers of up to ``FAN_IN`` neighbouring tasks, until there is one per host.
    """
    source = pages.select(host(F.col(url_col)).alias("_host"), F.col(html_col).cast("string").alias("_html"))
    schema = "host string, part bigint, wrapper string"
    state = materialize(source.mapInArrow(_inferrer, schema), "wrappers")
    while True:
        state = state.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("bigint"))
        state = materialize(state.groupBy("host", "part").applyInArrow(_merge, schema), "wrappers")
        if state.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] == 0:
            break
    return state.select("host", "wrapper")


def _each_wrapper(aligned: DataFrame, column: str, written: Callable[[list], str]) -> DataFrame:
    """``host`` and a text made of the nodes of its wrapper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            texts = [written(Wrapper.load(w).nodes) for w in rows.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("host"), pa.array(texts, pa.string())], ["host", column])

    return aligned.mapInArrow(run, f"host string, {column} string")


def _template_of(pages: DataFrame, aligned: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``host, wrapper, constants``: see :func:`templates`; ``wrapper`` has the tokens of the expression."""
    wrappers = materialize(_each_wrapper(aligned, "wrapper", lambda nodes: " ".join(flat(nodes)[0])), "structures")
    source = pages.select(host(F.col(url_col)).alias("_host"), F.col(html_col).cast("string").alias("_html"))
    joined = source.join(wrappers, F.col("_host") == F.col("host"), "left").select("_host", "_html", "wrapper")
    read = joined.mapInArrow(_reader, "host string, page binary, texts array<bigint>")
    different = materialize(read.groupBy("host", "page").agg(F.first("texts").alias("texts")), "page_texts")
    totals = different.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    counts = different.select("host", F.explode("texts").alias("text")).groupBy("host", "text").count()
    shared = counts.filter(F.col("count") >= LEAST_PAGES).join(totals, "host")
    shared = shared.filter(F.col("count") >= LEAST_SHARE * F.col("pages"))
    return shared.groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("constants")).join(wrappers, "host")


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper, constants``: the tokens of a host's aligned expression, and keys of places there with the
    text that at least ``LEAST_SHARE`` of its different pages, and ``LEAST_PAGES`` of them, have at
    that place.  Hosts without such texts have no row.
    """
    return _template_of(pages, _aligned(pages, url_col, html_col), url_col, html_col).select("host", "wrapper", "constants")


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper, constants``: an expression per host and the keys of its template texts.

    Pages without a host share one; pages without content count for nothing.
    """
    aligned = _aligned(pages, url_col, html_col)
    found = _template_of(pages, aligned, url_col, html_col).drop("wrapper")
    joined = _each_wrapper(aligned, "wrapper", expression).join(found, "host", "left")
    return joined.select("host", "wrapper", F.coalesce("constants", F.array().cast("array<bigint>")).alias("constants"))


def main_text(page: str | None, template: set[int]) -> str:
    """Main text of a page of a host with the given template texts.

    Blocks that are set aside (menus, notices, comments and so on) go.  If the page marks
    its article or main part, and any text is left there, all other blocks of that part
    stay.  Otherwise a block stays if it is not mostly links.  Template goes in either case.  An article
    that is set aside by a name only is taken if that leaves nothing, or if it is the only
    one, does not answer to another text, and holds more than what is left.
    """
    return _main_text(parse(page)[1], template)


def _main_text(blocks: list[Block], template: set[int]) -> str:
    texts = [(b, text) for b in blocks if (not b.aside or b.doubt) and (text := block_text(b))]
    marked = any(b.main and not b.aside for b, _ in texts)
    texts = [(b, text) for b, text in texts if _text_key(b.path, text) not in template] if template else texts
    stays = [(b, text) for b, text in texts if not b.aside]
    if marked:
        return " ".join(text for b, text in stays if b.main)
    rest = " ".join(text for b, text in stays if 2 * b.linked <= sum(map(len, b.text)))
    doubted = [(b, text) for b, text in texts if b.doubt]
    if not doubted:
        return rest
    least = min(b.doubt for b, _ in doubted)
    named = " ".join(text for b, text in doubted if b.doubt == least)
    alone = least == 1 and len({b.main for b, _ in doubted if b.doubt == 1}) == 1
    return named if not rest or (alone and len(named) > len(rest)) else rest


def extract_main_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: ``id_col, url_col, text``.

    The pages of a host are aligned first, then aligned with its expression to count template texts
    at their places there, and again to leave those out.  Null and empty pages have an empty text; a
    null url is a host of its own; rows that repeat an id are pages of their own; an empty
    table gives an empty table.  Other columns are not looked at.  A page that is cut short
    is read as far as it goes.
    """
    wrappers = materialize(templates(pages, url_col, html_col), "templates")
    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(
        F.col(id_col).alias("_id"),
        F.col(url_col).cast("string").alias("_url"),
        F.col(html_col).cast("string").alias("_html"),
        host(F.col(url_col)).alias("_host"),
    )
    # A row per host on one side: shipped to all tasks while small, else joined with the
    # pages of large hosts split.
    joined = source.join(wrappers, F.col("_host") == F.col("host"), "left").select("_id", "_url", "_html", "wrapper", "constants")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for rows in slices(batches):
            texts = []
            columns = (rows.column("_html").to_pylist(), _listed(rows.column("wrapper")), rows.column("constants").to_pylist())
            for page, wrapper, template in zip(*columns):
                tokens, blocks = parse(page)
                shared: set[int] = set()
                if template:
                    listed = set(template)
                    at = placed(page_nodes(tokens, blocks), wrapper, known)
                    shared = {key for place, key in at if _place_key(place, key) in listed}
                texts.append(_main_text(blocks, shared))
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id"), rows.column("_url"), pa.array(texts, pa.string())], ["_id", "_url", "text"]
            )

    found = joined.mapInArrow(run, f"_id {kind}, _url string, text string")
    return found.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text")
