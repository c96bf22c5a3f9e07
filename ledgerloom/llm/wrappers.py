"""Main-text extraction through wrappers: union-free regular expressions inferred from same-host pages.

A page is read as a token stream (tags with their class and id, text) and folded into nested groups by
the tags. Wrappers are inferred by aligning the streams of a host one after another: texts that differ
become text slots; parts that one side lacks become optional; neighbours with the same tags, or runs of
up to four tags that repeat, become repeated groups. Two wrappers align like a wrapper and a page, so a
host's pages are folded where they lie, and the partial wrappers are merged in two salted levels; no task
gathers a host's pages.

The wrapper names the host's content region: from the root, the child container that holds ``SHARE`` of the
variable text outside links, menus and forms, down to an article or main element or to where no child holds so
much; containers that repeat in a list count a quarter. Headings beside the last one belong to the region. A page's region is found along the wrapper's path. Its text is
the region's without headers, footers, asides, forms, scripts, styles and containers named as adverts, notices,
menus, sidebars, sharing or comments (whole class or id names), and without blocks whose texts stand, four words or
more, on at least three pages and half of the host's (counted over all of them), unless the region has no rarer text at all. A page
without the region, or of a host seen once, is read by the wrapper of its own. A wrapper has at most ``MEMBERS``
members in a list and ``NODES`` in all; rarer alternatives are merged into a slot.

Defined cases: null html gives the empty text; a null or broken url counts as the host "" ; unclosed and
stray tags are repaired as browsers do for blocks, list items and table cells; nesting beyond 100 levels
is flattened; repeated rows are extracted each; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import html as htmllib
import json
import operator
import re
from collections import Counter
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, ship

# Runs are bounded, so that broken markup costs time in proportion to its length.
_ATTRS = r"(?:[^>\"']{1,256}|\"[^\"]{0,4096}\"|'[^']{0,4096}'){0,64}+"
_LEX = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]{{0,65536}}>|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg)\b{_ATTRS}>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]{{0,64}})(?P<attrs>{_ATTRS})>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]{{0,64}})[^>]{{0,65536}}>",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROPPED = frozenset("nav footer aside form button select menu dialog script style textarea title noscript template iframe svg head object canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p li dt dd pre tr td th blockquote".split())
CONTAINERS = frozenset("article main body div section td center form html".split())
# Words of class and id that mark what is not the article, and words that may stand beside them in a name.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus share sharing social related newsletter subscribe signup login popup modal overlay search pagination pager widget toolbar copyright legal form reply replies respond".split()
)
NEUTRAL = frozenset("area bar block body bottom box button buttons container content group header heading icons inner item items left link links list main module outer panel post posts primary right row secondary section site slot title top unit wrap wrapper".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert menu menubar dialog".split())
DEPTH = 100
#: Share of a node's variable text by which its child is the content; members of a wrapper's list and nodes in all.
SHARE, MEMBERS, NODES = 0.6, 48, 3000
#: Values that are counted for a text, and words from which a block that is the same on many pages is a notice;
#: shorter ones can be equal by chance.
BAG, NOTICE = 32, 4


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


class Element:
    __slots__ = ("children", "side", "sig", "tag")

    def __init__(self, tag: str, sig: str, side: bool):
        self.tag, self.sig, self.side, self.children = tag, sig, side, []


def _side_name(name: str) -> bool:
    """Whether a class or id says that a container is not the article: one of the words, alone or with neutral ones."""
    words = _NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
    return any(w in SIDE_WORDS for w in words) and all(w in SIDE_WORDS or w in NEUTRAL for w in words)


def _open(tag: str, attrs: str) -> Element:
    side, main, classes = tag in DROPPED, False, []
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names = value.split()
            if name == "class":
                classes += [w for n in names if (w := re.sub(r"[^a-zA-Z_-]", "", n).lower())]
            side = side or tag not in INLINE and tag not in TEXTUAL and any(map(_side_name, names))
        elif name == "role":
            side, main = side or value.lower() in SIDE_ROLES, value.lower() == "main"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            side = True
    if tag in ("html", "body", "article", "main"):
        side = False
    return Element("main" if main and tag in ("div", "section") else tag, ".".join([tag, *classes]), side)


def parse(page: str | None) -> Element:
    """The page as a tree of elements and texts; unclosed tags end where browsers end them."""
    root = Element("#root", "#root", False)
    stack, at, page = [root], 0, page or ""

    def text(piece: str) -> None:
        if piece:
            kids = stack[-1].children
            if kids and isinstance(kids[-1], str):
                kids[-1] += piece
            else:
                kids.append(piece)

    for m in _LEX.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag == "br":
                stack[-1].children.append(Element("br", "br", False))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or stack[i].sig.split(".", 1)[0] == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in SIBLINGS:
            same, limits = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in limits:
                    break
                if stack[i].tag in same:
                    del stack[i:]
                    break
        node = _open(tag, m["attrs"] or "")
        stack[-1].children.append(node)
        if tag not in VOID and not (m["attrs"] or "").endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    text(page[at:])
    return root


# ---------------------------------------------------------------- wrappers
# A wrapper is a list [sig, flags, texts, chars, seen, children]: flags are 1 optional, 2 repeated, 4 not the article;
# texts has the hashes of a text's values with the pages of each, the commonest and at ties the least ``BAG`` of
# them; chars adds up the lengths and seen the merged places. A text with one value is constant, others are slots.
# A repeated group of several tags has the sig "()", a slot of rare alternatives "*".
SIG, FLAGS, TEXTS, CHARS, SEEN, KIDS = range(6)
OPT, REP, SIDE = 1, 2, 4


def _key(node: list) -> str:
    return node[SIG] if node[SIG] != "()" else "(" + " ".join(_key(k) for k in node[KIDS]) + ")"


def _hash(words: str) -> int:
    return xxhash.xxh64_intdigest(words.encode("utf-8", "surrogatepass")) >> 1 | 1


def _wrapper(node: Element) -> list:
    kids = []
    for child in node.children:
        if isinstance(child, str):
            words = _SPACE.sub(" ", child).strip()
            if words:
                kids.append(["#", 0, {_hash(words): 1}, len(words), 1, []])
        else:
            kids.append(_wrapper(child))
        _fold_tail(kids)
    return [node.sig, SIDE * node.side, {}, 0, 1, _trimmed(kids)]


def wrapper_of(node: Element) -> list:
    """The wrapper of one page."""
    return _bounded(_wrapper(node))


def _fold_tail(kids: list) -> None:
    """Turn a repetition at the end of a list into a repeated group, for runs of one to four members."""
    for n in range(1, 5):
        if n > 1 and len(kids) > n and kids[-n - 1][SIG] == "()" and len(kids[-n - 1][KIDS]) == n and [_key(k) for k in kids[-n - 1][KIDS]] == [_key(k) for k in kids[-n:]]:
            group = kids[-n - 1]
            group[KIDS] = [_merge(a, b, max) for a, b in zip(group[KIDS], kids[-n:], strict=True)]
            del kids[-n:]
            return
        if len(kids) < 2 * n or [_key(k) for k in kids[-n:]] != [_key(k) for k in kids[-2 * n : -n]]:
            continue
        merged = [_merge(a, b, max) for a, b in zip(kids[-2 * n : -n], kids[-n:], strict=True)]
        if n == 1:
            merged[0][FLAGS] |= REP
        else:
            merged = [["()", REP, {}, 0, 1, merged]]
        kids[-2 * n :] = merged
        return


def _merge(a: list, b: list, both=operator.add) -> list:
    """Both as one; ``both`` gives a value's pages, their sum for different pages and the greater for places of one."""
    return [a[SIG], a[FLAGS] | b[FLAGS], _texts(a[TEXTS], b[TEXTS], both), a[CHARS] + b[CHARS], both(a[SEEN], b[SEEN]), _align(a[KIDS], b[KIDS], both)]


def _texts(a: dict, b: dict, both) -> dict:
    if not b:
        return a
    out = dict(a)
    for k, n in b.items():
        out[k] = both(out[k], n) if k in out else n
    return out if len(out) <= BAG else dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:BAG])


def _constant(node: list) -> bool:
    return len(node[TEXTS]) == 1 and next(iter(node[TEXTS].values())) >= node[SEEN]


def _align(a: list, b: list, both=operator.add) -> list:
    """Align two lists of members by a longest common subsequence; what one side lacks becomes optional."""
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    if ka == kb:
        return [_merge(x, y, both) for x, y in zip(a, b, strict=True)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and ka[i] == kb[j]:
            out.append(_merge(a[i], b[j], both))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][SIG], a[i][FLAGS] | OPT, *a[i][TEXTS:]])
            i += 1
        else:
            out.append([b[j][SIG], b[j][FLAGS] | OPT, *b[j][TEXTS:]])
            j += 1
        _fold_tail(out)
    return _trimmed(out)


def _slot(members: list) -> list:
    return ["*", OPT | REP, {}, sum(_chars(m, False) for m in members), sum(m[SEEN] for m in members), []]


def _trimmed(kids: list) -> list:
    """At most ``MEMBERS`` members: the rarest, later ones first, become one slot at the end."""
    if len(kids) <= MEMBERS:
        return kids
    keep = set(sorted((i for i, k in enumerate(kids) if k[SIG] != "*"), key=lambda i: (-kids[i][SEEN], -kids[i][CHARS], i))[: MEMBERS - 1])
    return [k for i, k in enumerate(kids) if i in keep] + [_slot([k for i, k in enumerate(kids) if i not in keep])]


def _size(node: list) -> int:
    return 1 + sum(map(_size, node[KIDS]))


def _bounded(wrapper: list) -> list:
    """At most ``NODES`` nodes: small elements become slots, twice as large ones until the wrapper fits."""

    def cut(node: list, least: int) -> list:
        kids = [_slot([k]) if k[SIG] not in ("#", "*") and _chars(k, False) < least else cut(k, least) for k in node[KIDS]]
        joined = []
        for k in kids:
            if joined and k[SIG] == joined[-1][SIG] == "*":
                joined[-1] = ["*", OPT | REP, {}, joined[-1][CHARS] + k[CHARS], joined[-1][SEEN] + k[SEEN], []]
            else:
                joined.append(k)
        return [*node[:KIDS], joined]

    least = 16
    while _size(wrapper) > NODES and least < 1 << 40:
        wrapper, least = cut(wrapper, least), least * 2
    return wrapper


def merge_wrappers(a: list | None, b: list) -> list:
    """The wrapper of both; None is the wrapper of no page."""
    return b if a is None else _bounded(_merge(a, b))


def dumps(wrapper: list) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


def loads(text: str) -> list:
    def fixed(node: list) -> list:
        return [*node[:TEXTS], {int(k): n for k, n in node[TEXTS].items()}, *node[CHARS:KIDS], [fixed(k) for k in node[KIDS]]]

    return fixed(json.loads(text))


def expression(node: list) -> str:
    """The wrapper written as a union-free regular expression."""
    if node[SIG] == "#":
        inner = "#CONST" if _constant(node) else "#TEXT"
    elif node[SIG] == "*":
        inner = "#ANY"
    elif node[SIG] == "()":
        inner = "(" + "".join(map(expression, node[KIDS])) + ")"
    else:
        inner = f"<{node[SIG]}>" + "".join(map(expression, node[KIDS])) + f"</{node[SIG].split('.', 1)[0]}>"
    mark = ("", "?", "+", "*")[node[FLAGS] & 3]
    return f"({inner}){mark}" if mark else inner


def _tag(node: list) -> str:
    return node[SIG].split(".", 1)[0]


def _chars(node: list, variable: bool) -> int:
    """Characters of text, or of variable text outside links and what is not the article."""
    if variable and (node[FLAGS] & SIDE or _tag(node) in DROPPED or _tag(node) in ("a", "header")):
        return 0
    return (0 if variable and _constant(node) else node[CHARS]) + sum(_chars(k, variable) for k in node[KIDS])


def _told(node: list, variable: bool) -> float:
    """The text that speaks for a region: variable text, or all of it, outside links and what is not the article. Containers that repeat, such as teasers in a list, count a quarter."""
    if node[FLAGS] & SIDE or _tag(node) in DROPPED or _tag(node) in ("a", "header"):
        return 0
    own = 0 if variable and _constant(node) else node[CHARS]
    return own + sum(_told(k, variable) * (0.25 if k[FLAGS] & REP and _tag(k) in CONTAINERS else 1) for k in node[KIDS])


def content_rule(wrapper: list, shared: list[int] | None = None) -> dict:
    """What a host's pages keep: {"path": sigs below the root, "heads": whether headings beside it belong to it, "const": hashes of the texts that its pages share}.

    ``shared`` are those hashes where the host's pages have been counted; else the wrapper's own counts say.
    """
    pages = wrapper[SEEN]
    # With a page seen once all texts are constant; they count as variable then.
    some = _told(wrapper, True) > 0
    held = lambda n: _told(n, some)
    node, path, heads = wrapper, [], False
    while held(node):
        kids = [k for k in node[KIDS] if _tag(k) in CONTAINERS and not k[FLAGS] & SIDE]
        best = max(kids, key=held, default=None)
        if best is None or held(best) < SHARE * held(node):
            break
        heads = any(_tag(k) in HEADINGS for k in node[KIDS])
        node = best
        path.append(best[SIG])
        if _tag(best) in ("article", "main"):
            break
    values: list[tuple[int, int]] = []
    full = False

    def walk(n: list) -> None:
        nonlocal full
        values.extend(n[TEXTS].items())
        full = full or len(n[TEXTS]) >= BAG
        for k in n[KIDS]:
            walk(k)

    walk(node)
    least = max(3, pages / 2)
    const = {k for k, seen in values if seen >= least} if shared is None else set(shared)
    # Where the region has no rarer text, the pages are copies of each other.
    return {"path": path, "heads": heads, "const": sorted(const) if full or any(seen < least for _, seen in values) else []}


def text_values(node: Element, out: set[int]) -> set[int]:
    """Hashes of a page's texts outside what is not the article."""
    for child in node.children:
        if isinstance(child, str):
            words = _SPACE.sub(" ", child).strip()
            if words:
                out.add(_hash(words))
        elif not child.side:
            text_values(child, out)
    return out


# ---------------------------------------------------------------- extraction
def _blocks(node: Element, out: list[list[str]]) -> None:
    """Text pieces of a region, a list for each block."""
    for child in node.children:
        if isinstance(child, str):
            out[-1].append(child)
            continue
        if child.side or child.tag in DROPPED:
            out.append([])
            continue
        if child.tag == "header":
            out.append([])
            _headings(child, out)
            continue
        block = child.tag not in INLINE
        if block:
            out.append([])
        _blocks(child, out)
        if block:
            out.append([])


def _headings(node: Element, out: list[list[str]]) -> None:
    for child in node.children:
        if isinstance(child, str) or child.side:
            continue
        if child.tag in HEADINGS:
            out.append([])
            _blocks(child, out)
            out.append([])
        else:
            _headings(child, out)


def _region(root: Element, path: list[str]) -> tuple[list[Element], list[Element]]:
    """The elements at the end of the wrapper's path, and their parents."""
    here, above = [root], []
    for sig in path:
        above, here = here, [k for n in here for k in n.children if not isinstance(k, str) and k.sig == sig and not k.side]
    return here, above


def extract(page: str | None, rule: dict | None) -> str:
    """The main text of a page by its host's rule; a page without the rule's region is read by its own wrapper."""
    root = parse(page)
    found, above = _region(root, rule["path"]) if rule else ([], [])
    if not any(_letters(n) for n in found):
        rule = content_rule(wrapper_of(root))
        found, above = _region(root, rule["path"])
    const = frozenset(rule["const"])
    pieces: list[list[str]] = [[]]
    for n in above if rule["heads"] and rule["path"] else []:
        for child in n.children:
            if child in found:
                _blocks(child, pieces)
                pieces.append([])
            elif not isinstance(child, str) and child.tag in HEADINGS and not child.side:
                _blocks(child, pieces)
                pieces.append([])
    if not (rule["heads"] and rule["path"]):
        for n in found:
            _blocks(n, pieces)
            pieces.append([])
    texts = []
    for block in pieces:
        line = _SPACE.sub(" ", htmllib.unescape("".join(block))).strip()
        notice = const and line.count(" ") >= NOTICE - 1 and all(_hash(words) in const for raw in block if (words := _SPACE.sub(" ", raw).strip()))
        if line and not notice:
            texts.append(line)
    return " ".join(texts)


def _letters(node: Element) -> bool:
    return any(child.strip() if isinstance(child, str) else not child.side and child.tag not in DROPPED and _letters(child) for child in node.children)


# ---------------------------------------------------------------- operator
def infer_wrappers(pages: DataFrame, fan_in: int = 64, broadcast_hosts: int = 1_000_000) -> DataFrame:
    """(host, wrapper, shared) with the wrapper as JSON and the hashes of texts on three pages and half of the host's.

    Hot hosts are folded in place and merged in two levels. Texts are counted exactly: the pages that hold a text, added up in
    each task and then by host and text.
    """

    def make():
        held: dict[str, list] = {}
        seen: Counter = Counter()

        def flush():
            for host, wrapper in held.items():
                yield host, dumps(wrapper), None, None
            for (host, value), n in seen.items():
                yield host, None, value, n
            held.clear()
            seen.clear()

        def step(cols):
            for url, page in zip(*cols, strict=True):
                host, root = host_of(url), parse(page)
                held[host] = merge_wrappers(held.get(host), wrapper_of(root))
                seen.update((host, v) for v in text_values(root, {0}))  # 0 counts the pages
                if len(held) > 2000 or len(seen) > 200_000:
                    yield from flush()

        step.finish = flush
        return step

    def fold(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        wrapper = None
        for text in sorted(group.column("wrapper").to_pylist()):
            wrapper = merge_wrappers(wrapper, loads(text))
        return pa.table({"host": [key[0].as_py()], "wrapper": [dumps(wrapper)]})

    found = cut(map_rows(pages.select("url", "html"), "host string, wrapper string, value long, n long", make, 500))
    counts = found.filter("wrapper is null").groupBy("host", "value").agg(F.sum("n").alias("n"))
    sizes = cut(counts.filter("value = 0").select("host", F.col("n").alias("pages")))
    sizes = F.broadcast(sizes) if sizes.count() <= broadcast_hosts else sizes
    often = counts.filter("value <> 0 and n >= 3").join(sizes, "host").filter("2 * n >= pages")
    shared = often.groupBy("host").agg(F.sort_array(F.collect_list("value")).alias("shared"))
    parts = found.filter("wrapper is not null").select("host", "wrapper").distinct()
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(fan_in)))
    level = salted.groupBy("host", "salt").applyInArrow(fold, "host string, wrapper string")
    return level.distinct().groupBy("host").applyInArrow(fold, "host string, wrapper string").join(shared, "host", "left")


def extract_main_text(pages: DataFrame, broadcast_bytes: int = 1 << 26) -> DataFrame:
    """page_id, url, text, n_chars for every row. Rules of at most ``broadcast_bytes`` (counted) are broadcast, more are joined by host."""
    ship(pages.sparkSession)

    def rules_of(batches):
        for batch in batches:
            rules = [json.dumps(content_rule(loads(w), shared or [])) for w, shared in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rules, pa.string())], names=["host", "rule"])

    rules = cut(infer_wrappers(pages).mapInArrow(rules_of, "host string, rule string"))
    schema = "page_id long, url string, text string, n_chars long"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    if (rules.agg(F.sum(F.octet_length("host") + F.octet_length("rule")).alias("b")).first()["b"] or 0) <= broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["rule"] for r in rules.collect()})

        def make():
            known = {host: json.loads(rule) for host, rule in shared.value.items()}

            def step(cols):
                for page_id, url, page in zip(*cols, strict=True):
                    text = extract(page, known.get(host_of(url)))
                    yield page_id, url, text, len(text)

            return step

        return map_rows(rows, schema, make, 500)

    def make_joined():
        def step(cols):
            for page_id, url, page, rule in zip(*cols, strict=True):
                text = extract(page, json.loads(rule) if rule else None)
                yield page_id, url, text, len(text)

        return step

    hosts = map_rows(rows, "page_id long, url string, html string, host string", lambda: lambda cols: ((i, u, h, host_of(u)) for i, u, h in zip(*cols, strict=True)), 500)
    return map_rows(hosts.join(rules, "host", "left").select("page_id", "url", "html", "rule"), schema, make_joined, 500)
