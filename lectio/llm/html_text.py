"""Main text of web pages by union-free wrappers inferred per host.

A page is a token stream of block tags and texts (inline tags only join their text).  The
pages of a host are aligned one after another into one wrapper, a union-free regular
expression: tokens that match stay, neighbours with the same tag become a repeated group,
tags that only one side has become optional, and texts that differ become slots.  Wrappers
of a host from different tasks are aligned the same way, so a host of any size is
folded where its pages lie and only wrappers are shuffled.

From a host's wrapper follows where its article stands: the smallest group around all
widest ``article``, ``main`` or so named groups and main headings, or else around all text; and
which texts of its groups that stand aside are the same on every page.  Extraction reads that group
from each page and leaves out groups that are menus, headers, footers, sidebars, notices, adverts,
forms or comments by tag, class, id or role.

Rules for odd rows: null html is empty and gives ''; a null or odd url belongs to host '';
pages without the host's group are read by the same rule from their own tokens; repeated
pages and ids are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

# A tag's attributes may quote ">"; the groups are atomic, so odd quotes cost one pass.
TOKEN = re.compile(
    r"<!--(?:.*?(?:-->|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>(?:[\s/](?>[^<>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)?)>|<[!?/][^>]*>", re.S)
#: Elements whose content is no text of the page, and those that the page goes on after when they have no end.
RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style noscript template svg iframe textarea title".split()}
OPEN_ENDED = frozenset("svg title noscript template iframe".split())
ATTR = re.compile(r"\b(class|id|role|itemprop|style|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr input br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Block tags that the start of another block ends, and those that end them.
ENDED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
            "th": {"td", "th", "tr"}, "option": {"option"}}
ASIDE = frozenset("nav header footer aside form button select menu dialog noscript".split())
ASIDE_WORD = re.compile(
    r"(?:ad|ads|advert\w*|adslot|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|sidebar|side|menu|nav|navbar|"
    r"navigation|breadcrumbs?|footer|header|masthead|comments?|commentlist|respond|replies|reply|disqus|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|signup|login|search|pagination|pager|toolbar|widget|complementary|contentinfo)", re.I)
#: Words that say where or what shape a group is, not what it holds.
PLAIN_WORD = re.compile(r"(?:box|bar|block|area|section|container|wrapper?|inner|outer|list|items?|links?|buttons?|icons?|panel|group|row|col|top|bottom|left|right|"
                        r"site|page|global|main|post|user|article|secondary|primary|form|thread|slot|unit|js|the|my|is|has|l|m|s|x+)?\d*", re.I)
#: Names of asides that name subjects as well: inside an article they alone do not drop a group.
SUBJECT_NAME = frozenset("social side alert search related".split())
BODY_NAME = re.compile(r"(?:^|[-_ .])(?:article-?body|articlebody|post-?content|entry-?content|article-?content|story-?body|main)(?:$|[-_ .])", re.I)


def signature(tag: str, attrs: str) -> str:
    """Tag and names of an element; digits in names are left out, so counters do not tell elements apart."""
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return tag
    names = []
    for key, *values in ATTR.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower():
            names.append("!hidden")
        elif key != "style":
            names += re.sub(r"\d+", "", value).split()
    return ".".join([tag, *sorted(set(names))])


def _names_aside(names: str) -> bool:
    """Whether one of the names is made of words for asides (and of plain words) only: "cookie-notice", not "market-share"."""
    for name in names.split("."):
        words = re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", name)
        if any(map(ASIDE_WORD.fullmatch, words)) and all(ASIDE_WORD.fullmatch(x) or PLAIN_WORD.fullmatch(x) for x in words):
            return True
    return False


@lru_cache(100_000)
def is_aside(sig: str, inside: bool = False) -> bool:
    """Whether a group stands aside by its tag and names; ``inside``: within a named article group."""
    tag, _, names = sig.partition(".")
    if tag in ASIDE or "!hidden" in names.split("."):
        return True
    if inside and names.lower() in SUBJECT_NAME:
        return False
    return bool(names) and _names_aside(names) and not BODY_NAME.search(names.replace(".", " "))


def is_named(sig: str) -> bool:
    """Whether a group is named as the article."""
    tag, _, names = sig.partition(".")
    return tag in ("article", "main") or "main" in names.split(".") or bool(BODY_NAME.search(names.replace(".", " ")))


#: Trees are kept this deep; deeper groups are hung up at the last level.
DEPTH = 120


def _shallow(root: list) -> list:
    """A tree of at most DEPTH levels with the same texts in the same order.  Groups that hold nothing but one
    unnamed group are skipped first; then what lies deeper becomes a sibling, and stays aside
    where a group around it does."""
    def walk(tree):
        out = ["", []]
        todo = [(x, out, 1, None) for x in reversed(tree[1])]
        while todo:
            x, into, depth, aside = todo.pop()
            if isinstance(x, str):
                into[1].append(x if aside is None or into[0] == aside else [aside, [x]])
                continue
            while len(x[1]) == 1 and not isinstance(x[1][0], str) and "." not in x[0] and not is_named(x[0]) and not is_aside(x[0]):
                x = x[1][0]
            if depth < DEPTH:
                node = [x[0], []]
                into[1].append(node)
                todo += [(c, node, depth + 1, None) for c in reversed(x[1])]
            else:
                under = aside or (x[0] if is_aside(x[0]) else None)
                todo += [(c if not isinstance(c, str) else [under or x[0], [c]], into, depth, under) if not isinstance(c, str)
                         else (_Leaf((under or x[0], c)), into, depth, under) for c in reversed(x[1])]
        return out

    class _Leaf(str):
        """A text hung up with its own group's signature."""
        def __new__(cls, pair):
            self = super().__new__(cls, pair[1])
            self.sig = pair[0]
            return self
    tree = walk(root)
    todo = [tree]
    while todo:
        x = todo.pop()
        x[1] = [[c.sig, [str(c)]] if isinstance(c, _Leaf) else c for c in x[1]]
        todo += [c for c in x[1] if not isinstance(c, str)]
    return tree


def parse(page: str | None) -> list:
    """The page as ``[signature, children]``; a child is a node or a text with its white space put right."""
    root = ["", []]
    stack, text, at = [root], [], 0

    def flush():
        if text:
            clean = " ".join(html.unescape("".join(text)).split())
            if clean:
                stack[-1][1].append(clean)
            text.clear()
    deepest, endless = 0, set()
    while page and (m := TOKEN.search(page, at)):
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not m["end"]:
            if tag == "svg" and m["attrs"].endswith("/"):
                continue
            close = None if tag in endless else RAW[tag].search(page, at)
            if close:
                at = close.end()
                continue
            endless.add(tag)                              # no end tag from here on
            if tag not in OPEN_ENDED:
                break
            if tag == "title":
                after = page.find("<", at)
                at = len(page) if after < 0 else after
            continue
        if tag in RAW:
            continue
        if tag == "head":                                 # its end may be left out; what it has is void or skipped above
            continue
        if tag in INLINE:
            if tag == "br":
                text.append("\n")
            continue
        flush()
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0].partition(".")[0] == tag:
                    del stack[depth:]
                    break
            continue
        if tag in VOID:
            continue
        top = stack[-1][0].partition(".")[0]
        while top in ENDED_BY and (ENDED_BY[top] is None or tag in ENDED_BY[top]):
            stack.pop()
            top = stack[-1][0].partition(".")[0]
        node = [signature(tag, m["attrs"]), []]
        stack[-1][1].append(node)
        stack.append(node)
        deepest = max(deepest, len(stack))
    else:
        text.append((page or "")[at:])
    flush()
    return _shallow(root) if deepest > DEPTH else root


# ---- wrappers: {"s": signature, "n": pages, "o": optional, "r": repeated, "t": own text or None (a slot), "k": its characters, "c": children}

def wrapper_of(node: list) -> dict:
    texts = [x for x in node[1] if isinstance(x, str)]
    return {"s": node[0], "n": 1, "o": False, "r": False, "t": "\n".join(texts), "k": sum(map(len, texts)),
            "c": _repeats([wrapper_of(x) for x in node[1] if not isinstance(x, str)], alike=True)}


def _joined(a: dict, b: dict, same_page: bool = False) -> dict:
    return {"s": a["s"], "n": max(a["n"], b["n"]) if same_page else a["n"] + b["n"], "o": a["o"] or b["o"], "r": a["r"] or b["r"] or same_page,
            "t": a["t"] if a["t"] == b["t"] else None, "k": a["k"] + b["k"], "c": _aligned(a["c"], b["c"])}


def _repeats(children: list[dict], alike: bool = False) -> list[dict]:
    """Neighbours with the same signature become one repeated group; ``alike``: only if they also have
    groups of the same signatures inside, as a menu and the text after it have not."""
    out: list[dict] = []
    for x in children:
        if out and out[-1]["s"] == x["s"] and (not alike or {c["s"] for c in out[-1]["c"]} == {c["s"] for c in x["c"]}):
            out[-1] = _joined(out[-1], x, same_page=True)
        else:
            out.append(x)
    return out


#: Between anchors a table of up to so many cells is filled; larger stretches without anchors are taken as optional.
CELLS = 40_000


def _aligned(a: list[dict], b: list[dict]) -> list[dict]:
    """Children that agree one by one are joined in place.  Otherwise neighbours with the same signature become
    repeated groups, and what one side still lacks becomes optional."""
    if [x["s"] for x in a] != [x["s"] for x in b]:
        a, b = _repeats(a), _repeats(b)
        if [x["s"] for x in a] != [x["s"] for x in b]:
            return _repeats(_common(a, b))
    return [_joined(x, y) for x, y in zip(a, b)]


def _common(a: list[dict], b: list[dict]) -> list[dict]:
    """Alignment of two lists: equal ends, then signatures that occur once on both sides and in the same
    order as anchors, then the longest common subsequence between anchors."""
    start = 0
    while start < min(len(a), len(b)) and a[start]["s"] == b[start]["s"]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end]["s"] == b[-1 - end]["s"]:
        end += 1
    out = [_joined(x, y) for x, y in zip(a[:start], b[:start])]
    tail = [_joined(x, y) for x, y in zip(a[len(a) - end:], b[len(b) - end:])]
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    once_a, once_b = Counter(x["s"] for x in a), Counter(x["s"] for x in b)
    place = {x["s"]: j for j, x in enumerate(b) if once_b[x["s"]] == 1}
    pairs = [(i, place[x["s"]]) for i, x in enumerate(a) if once_a[x["s"]] == 1 and x["s"] in place]
    ends, back, at = [], [], []                              # longest increasing run of places
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(ends, j)
        ends[p:p + 1] = [j]
        at[p:p + 1] = [k]
        back.append(at[p - 1] if p else -1)
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    i = j = 0
    for x, y in [*reversed(chain), (len(a), len(b))]:
        out += _between(a[i:x], b[j:y])
        if x < len(a):
            out.append(_joined(a[x], b[y]))
        i, j = x + 1, y + 1
    return out + tail


def _between(a: list[dict], b: list[dict]) -> list[dict]:
    """Longest common subsequence of the signatures; what one side lacks becomes optional."""
    n, m = len(a), len(b)
    if not n or not m or n * m > CELLS:
        return [x | {"o": True} for x in a + b]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i]["s"] == b[j]["s"] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i]["s"] == b[j]["s"]:
            out.append(_joined(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(a[i] | {"o": True})
            i += 1
        else:
            out.append(b[j] | {"o": True})
            j += 1
    return out


def expression(w: dict) -> str:
    """The wrapper as a union-free regular expression."""
    text = "" if w["t"] == "" else "#TEXT" if w["t"] is None else repr(w["t"])
    inner = f"<{w['s']}>" + text + "".join(map(expression, w["c"])) + f"</{w['s'].partition('.')[0]}>"
    return f"({inner}){'+' if w['r'] else ''}{'?' if w['o'] else ''}" if w["r"] or w["o"] else inner


def _weight(w: dict) -> int:
    """Characters in the slots of a group, leaving out what stands aside."""
    own = w["k"] if w["t"] is None or w["n"] == 1 else 0
    return own + sum(_weight(x) for x in w["c"] if not is_aside(x["s"]))


def _length(w: dict) -> int:
    """Characters in a group, leaving out what stands aside."""
    return w["k"] + sum(_length(x) for x in w["c"] if not is_aside(x["s"]))


def _main_path(w: dict) -> list[str]:
    """Signatures from the root to the group that holds the article: the smallest one with all
    widest named groups and main headings, or without named groups with all text."""
    groups: list[list[dict]] = []
    headings: list[list[dict]] = []

    def visit(x: dict, path: list[dict]):
        for c in x["c"]:
            if not is_aside(c["s"]) and _length(c):
                here = [*path, c]
                if is_named(c["s"]):
                    groups.append(here)
                elif c["s"].partition(".")[0] == "h1" or c["s"] == "p" and any(is_named(y["s"]) for y in x["c"]):
                    headings.append(path)                    # a title, or a paragraph next to an article
                else:
                    visit(c, here)
    visit(w, [])
    if groups:
        both = groups + headings
        same = 0
        while all(len(x) > same and x[same] is both[0][same] for x in both):
            same += 1
        return [x["s"] for x in both[0][:same]]
    path, at = [], w
    while True:
        full = [c for c in at["c"] if not is_aside(c["s"]) and _length(c)]
        if len(full) != 1 or full[0]["r"] or at["k"]:
            return path
        at = full[0]
        path.append(at["s"])


def rule_of(w: dict) -> dict:
    """Where the article stands, and which texts there are the template's: those that a host's pages repeat while
    other texts differ, outside groups named as the article (whose headings and blocks are kept however
    many pages repeat them) or in groups that stand aside."""
    path, at = _main_path(w), w
    named = False
    for s in path:
        at = next(c for c in at["c"] if c["s"] == s)
        named = named or is_named(s)
    fixed: list[str] = []
    if w["n"] >= 3 and _weight(at):
        def visit(x: dict, inside: bool):
            for c in x["c"]:
                if c["t"] and c["n"] >= 3 and not c["r"] and 10 * c["n"] >= 8 * w["n"] and (not inside or is_aside(c["s"], True) or c["s"].lower().partition(".")[2] in SUBJECT_NAME):
                    fixed.append(c["s"] + "\t" + c["t"])
                visit(c, inside or is_named(c["s"]))
        visit(at, named)
    return {"path": path, "fixed": sorted(set(fixed))}


def article(page: str | None, rule: dict | None) -> str:
    """The page's main text: one line a block."""
    tree = parse(page)
    found = [tree]
    for step, s in enumerate(rule["path"] if rule else ()):
        found = [c for x in found for c in x[1] if not isinstance(c, str) and c[0] == s]
    if not found:
        rule = rule_of(wrapper_of(tree))
        found = [tree]
        for s in rule["path"]:
            found = [c for x in found for c in x[1] if not isinstance(c, str) and c[0] == s]
    fixed, out = set(rule["fixed"]) if rule else set(), []

    def visit(node, inside):
        own = "\n".join(x for x in node[1] if isinstance(x, str))
        keep = not fixed or node[0] + "\t" + own not in fixed
        for x in node[1]:
            if not isinstance(x, str):
                if not is_aside(x[0], inside):
                    visit(x, inside or is_named(x[0]))
            elif keep:
                out.append(x)
    inside = bool(rule) and any(map(is_named, rule["path"]))
    for x in found:
        visit(x, inside)
    return "\n".join(out)


def host_of(url_col: str) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


PARTS = 32


def infer(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper`` (JSON): the pages of each host folded in every task, then task by task."""
    small_batches(pages.sparkSession)

    def fold(batches):
        held: dict[str, dict] = {}
        for b in batches:
            for host, page in zip(b.column("host").to_pylist(), b.column("_html").to_pylist()):
                w = wrapper_of(parse(page))
                held[host] = _joined(held[host], w) if host in held else w
            if len(held) > 20_000:
                yield pa.RecordBatch.from_pydict({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]})
                held = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())],
                                         ["host", "wrapper"])

    def meet(pdf):
        import pandas as pd
        w = reduce(_joined, map(json.loads, sorted(pdf["wrapper"])))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(w)]})
    parts = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("_html")).mapInArrow(fold, "host string, wrapper string")
    some = parts.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS))).groupBy("host", "part")     # a host's wrappers meet in two levels
    return some.applyInPandas(meet, "host string, wrapper string").groupBy("host").applyInPandas(meet, "host string, wrapper string")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``."""
    def rules(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([json.dumps(rule_of(json.loads(w))) for w in b.column("wrapper").to_pylist()], pa.string())],
                                             ["host", "rule"])

    def read(batches):
        known: dict[str | None, dict | None] = {}
        for b in batches:
            out = []
            for page, rule in zip(b.column("_html").to_pylist(), b.column("rule").to_pylist()):
                if rule not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[rule] = json.loads(rule) if rule else None
                out.append(article(page, known[rule]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])
    by_host = written(infer(pages, url_col=url_col, html_col=html_col).mapInArrow(rules, "host string, rule string"), "wrappers")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"), host_of(url_col).alias("host"))
    return (src.join(by_host, "host", "left").mapInArrow(read, "page_id long, url string, text string")
            .withColumn("n_chars", F.length("text").cast("long")))
