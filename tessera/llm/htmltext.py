"""Main text of web pages, through a wrapper inferred for each host.

A wrapper is a union-free regular expression over a host's token streams: at each level an ordered list of groups, each
once, optional or repeated, and text that is either constant or a slot. It is made by aligning a bounded sample of the
host's pages one after the other: runs and tandem repeats of groups become repeated groups, what only one side has
becomes optional, differing text becomes a slot. The wrapper tells where the host keeps its article: in an element
that says so, or else in the element whose slots vary most outside of links. A page's text is what stands there, without the
groups that are boilerplate by their element, class, id or role, and without the blocks that are constant over the host.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import cut, written

#: Pages of a host that its wrapper is inferred from: those with the least hash of url and id.
SAMPLE_PAGES = 12
#: Groups that a wrapper holds at one level; an article's many paragraphs are one repeated group, so this is never reached by layout.
LEVEL_GROUPS = 64

#: Layouts of a host that wrappers are inferred for, one in each round over the pages that follow none yet.
LAYOUTS = 16
#: Levels of elements that a wrapper tells apart; what is nested deeper counts as text of the element there.
LEVELS = 60
#: Blocks are constant if all of so many different sample pages, at least, have them, beside twice as much text of their own.
CONSTANT_PAGES = 6
#: Wrappers are broadcast up to so many bytes of them.
BROADCAST_BYTES = 32 << 20

#: A quote opens a value only after the equals sign; elsewhere it is a character like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes template xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A start tag of the key closes an open element of the value, unless one of the stops is nearer.
CLOSES = {t: frozenset("p") for t in BLOCKS - {"html", "head", "body", "li", "dd", "dt", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "optgroup", "title", "caption", "legend"}}
CLOSES |= {"li": frozenset(("li", "p")), "dd": frozenset(("dd", "dt", "p")), "dt": frozenset(("dd", "dt", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",))}
CLOSES |= {t: frozenset(("tr", "td", "th", "tbody", "thead", "tfoot", "p")) for t in ("tbody", "thead", "tfoot")} | {"body": frozenset(("head",))}
STOPS = frozenset("article aside blockquote body div dl fieldset figure footer form header main nav ol section table td th ul html".split())
OUT_TAGS = frozenset("aside audio button canvas dialog embed footer form head iframe input menu nav noframes noscript object script search select style svg template textarea title video math datalist label".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
OUT_NAMES = frozenset(
    "ad ads adbox adsbox adslot adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar tooltip widget widgets".split()
)
#: Of these an element is boilerplate only while it says little, as bars and notes do; long text under such a name is the article's.
WEAK_NAMES = frozenset("alert banner discussion header login overlay respond share sharing skip social toolbar tooltip widget widgets".split())
LITTLE = 200
MAIN_NAMES = ("articlebody", "article", "story", "entry", "post", "content", "main")


class Element:
    __slots__ = ("tag", "marks", "hidden", "children")

    def __init__(self, tag: str, marks: tuple[str, ...] = (), hidden: bool = False) -> None:
        self.tag, self.marks, self.hidden = tag, marks, hidden
        self.children: list[Element | str] = []

    @property
    def signature(self) -> str:
        return ".".join((self.tag, *self.marks))


def parse(page: str) -> Element:
    """The page's balanced token stream. Comments go; unclosed elements end where their parent does, or where an element
    that can't stand inside them begins; end tags of nothing open are passed over; a tag that the page breaks off in goes."""
    root = Element("#root")
    stack, at, n = [root], 0, len(page)
    opened: Counter[str] = Counter()

    def close(k: int) -> None:
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            stack[-1].children.append(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue
        if m[1]:
            if opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        closes = CLOSES.get(tag, ())
        if any(opened[t] > 0 for t in closes):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    close(k)
                    break
                if stack[k].tag in STOPS:
                    break
        marks, hidden = [], False
        for name, a, b, c in ATTRIBUTE.findall(m[3]) if m[3].strip(" /") else ():
            name, value = name.lower(), (a or b or c)
            if name in ("class", "id"):
                marks += (x for x in re.split(r"[^a-z]+", CAMEL.sub(" ", value).lower()) if x)
            elif name == "role":
                marks.append("role=" + value.lower().strip())
            hidden |= name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()))
        element = Element(tag, tuple(dict.fromkeys(marks)), hidden)
        stack[-1].children.append(element)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            element.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif not m[3].endswith("/") or tag in BLOCKS:
            stack.append(element)
            opened[tag] += 1
    return root


def is_boilerplate(tag: str, marks: tuple[str, ...] | list[str], hidden: bool = False, says: int = 0) -> bool:
    """``says``: characters of the element's text outside of links, if they are known."""
    if hidden or tag in OUT_TAGS:
        return True
    return any((m in OUT_NAMES and (says < LITTLE or m not in WEAK_NAMES)) or m[:5] == "role=" and m[5:] in OUT_ROLES for m in marks)


def _is_out(e: Element) -> bool:
    """``is_boilerplate`` of an element; only where its name is a weak one its text is looked at."""
    if not is_boilerplate(e.tag, e.marks, e.hidden):
        return False
    return is_boilerplate(e.tag, e.marks, e.hidden, _says(e)) if any(m in WEAK_NAMES for m in e.marks) else True


def _says(e: Element) -> int:
    """Characters of text in an element, outside of links and of elements that never hold an article's text."""
    n, todo = 0, [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            n += len(" ".join(x.split()))
        elif x.tag != "a" and x.tag not in OUT_TAGS and not x.hidden:
            todo += x.children
    return n


# ---- wrappers: nested dicts, so that they travel as JSON


def _group(e: Element | str, level: int = 0) -> dict:
    """The most special wrapper of one token: every child group once, its text constant."""
    if isinstance(e, str):
        return {"sig": "#text", "const": " ".join(e.split())}
    one = {"sig": e.signature, "tag": e.tag, "marks": list(e.marks), "hidden": e.hidden, "says": _says(e) if any(m in WEAK_NAMES for m in e.marks) else 0}
    if level >= LEVELS:
        return one | {"groups": [{"sig": "#text", "const": None, "size": _says(e)}]}
    kids = [c for c in e.children if not isinstance(c, str) or c.strip()]
    return one | {"groups": _fold([_group(c, level + 1) for c in kids])}


def _merge(a: dict, b: dict) -> dict:
    """One group for two of the same signature."""
    flags = {k: True for k in ("opt", "rep") if a.get(k) or b.get(k)}
    if a["sig"] == "#text":
        return {"sig": "#text", "const": a["const"] if a["const"] == b["const"] else None, "size": max(_size(a), _size(b))} | flags
    if a["sig"] == "#seq":
        return {"sig": "#seq", "groups": _align(a["groups"], b["groups"])} | flags
    return {k: a[k] for k in ("sig", "tag", "marks", "hidden")} | {"says": max(a["says"], b["says"])} | {"groups": _align(a["groups"], b["groups"])} | flags


def _size(text: dict) -> int:
    return max(text.get("size", 0), len(text["const"] or ""))


def _fold(groups: list[dict]) -> list[dict]:
    """Runs and tandem repeats (squares) of groups become repeated groups, shortest period first."""
    for period in (1, 2, 3):
        out: list[dict] = []
        i = 0
        while i < len(groups):
            unit = [g["sig"] for g in groups[i : i + period]]
            end = i + period
            while len(unit) == period and [g["sig"] for g in groups[end : end + period]] == unit:
                end += period
            if end == i + period or "#text" in unit and period == 1:
                out.append(groups[i])
                i += 1
                continue
            whole = groups[i : i + period]
            for k in range(i + period, end, period):
                whole = [_merge(x, y) for x, y in zip(whole, groups[k : k + period])]
            out.append(whole[0] | {"rep": True} if period == 1 else {"sig": "#seq", "groups": whole, "rep": True})
            i = end
        groups = out
    return groups


def _align(a: list[dict], b: list[dict]) -> list[dict]:
    """Mismatches are resolved: what the other side lacks is optional; repeats that only then show are folded again."""
    out: list[dict] = []
    for kind, i, j, k, m in SequenceMatcher(None, [_key(g) for g in a], [_key(g) for g in b], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [_merge(x, y) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [g | {"opt": True} for g in (*a[i:j], *b[k:m])]
    out = _fold(out)
    # neighbours beyond the bound join the first of their signature, as a repeated optional group
    if len(out) > LEVEL_GROUPS:
        kept: dict[str, dict] = {}
        for g in out:
            kept[_key(g)] = (_merge(kept[_key(g)], g) if _key(g) in kept else g) | {"opt": True, "rep": True}
        out = list(kept.values())
    return out


def _key(g: dict) -> str:
    return g["sig"] if g["sig"] != "#seq" else "#seq " + " ".join(_key(x) for x in g["groups"])


def infer(pages: list[str]) -> dict:
    """The wrapper of a host's sample pages: ``main``, the path of signatures to where it keeps its article, ``beside``, its
    siblings that belong to it, and ``const``, the blocks there that all pages have."""
    wrapper: dict | None = None
    roots = [parse(page) for page in pages]
    for root in roots:
        one = _group(root)
        wrapper = one if wrapper is None else _merge(wrapper, one)
    if wrapper is None:
        return {"main": None}
    main = _main_path(wrapper)
    found = {"main": main, "beside": _beside(wrapper, main)}
    return found | {"const": _constant([_blocks(_along(root, found)) for root in roots])} if main else found


def _constant(pages: list[list[str]]) -> list[str]:
    """Blocks that all pages have, unless these are too few or too alike, as copies of one article are."""
    different = {tuple(blocks) for blocks in pages if blocks}
    if len(different) < CONSTANT_PAGES:
        return []
    common = set.intersection(*map(set, different))
    size = sum(map(len, common))
    return sorted(common) if all(sum(map(len, p)) >= 3 * size for p in different) else []


def _varying(g: dict) -> int:
    """The size of the varying text in a group, outside of links and boilerplate."""
    if g["sig"] == "#text":
        return _size(g) if g["const"] is None else 0
    if g["sig"] != "#seq" and (g["tag"] == "a" or is_boilerplate(g["tag"], g["marks"], g["hidden"], g["says"])):
        return 0
    return sum(map(_varying, g["groups"]))


def _beside(wrapper: dict, main: list[str] | None) -> list[str]:
    """Signatures of containers next to the main one whose text varies, too: an article may lie in several."""
    if not main or len(main) < 2 or main[-1].split(".")[0] in ("article", "main"):
        return []
    level = [wrapper]
    for sig in main[1:-1]:
        level = [x for g in level for x in _inside(g) if x["sig"] == sig]
    near = [x for g in level for x in _inside(g) if x.get("tag") in CONTAINERS]
    least = 0.25 * max((_varying(x) for x in near if x["sig"] == main[-1]), default=0)
    return sorted({x["sig"] for x in near if x["sig"] != main[-1] and _varying(x) > least})


def _inside(g: dict) -> list[dict]:
    """The groups of a level, those of repeated sequences included."""
    return [y for x in g.get("groups", []) for y in (_inside(x) if x["sig"] == "#seq" else [x])]


def _main_path(wrapper: dict) -> list[str] | None:
    """The path to the element with most varying text outside of links and boilerplate; None where none has any.

    An element is credited with the slots of its own paragraphs, not with those of nested containers. Elements that say
    they are the article, or else the main part, come before any other.
    """
    best: tuple[int, float, list[str]] | None = None

    def walk(g: dict, path: list[str], linked: bool) -> float:
        """What ``g`` gives to the element around it."""
        nonlocal best
        if g["sig"] == "#text":
            return 0.0 if linked else float(_size(g)) * (1 if g["const"] is None else 0.25) * (3 if g.get("rep") else 1)
        if g["sig"] == "#seq":
            return 3 * sum(walk(x, path, linked) for x in g["groups"])
        if is_boilerplate(g["tag"], g["marks"], g["hidden"], g["says"]):
            return 0.0
        here = [*path, g["sig"]]
        own = sum(walk(x, here, linked or g["tag"] == "a") for x in g["groups"]) * (3 if g.get("rep") else 1)
        if g["tag"] in CONTAINERS:
            named = any(m.startswith(n) for n in MAIN_NAMES for m in g["marks"])
            said = 2 if g["tag"] == "article" else 1 if g["tag"] == "main" or "role=main" in g["marks"] else 0
            credit = (said, own * (2 if named else 1))
            if (own or said) and (best is None or credit > best[:2]):
                best = (*credit, here)
            return 0.25 * own
        return own

    walk(wrapper, [], False)
    return best and best[2]


CONTAINERS = frozenset("article body div main section td center #root".split())


# ---- extraction


def _find(e: Element, wanted: Callable[[Element], bool]) -> list[Element]:
    """The topmost elements that are wanted, in page order, none of them inside boilerplate."""
    out: list[Element] = []
    todo = list(reversed(e.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str) or c.tag not in ("article", "main") and _is_out(c):
            continue
        if wanted(c):
            out.append(c)
        else:
            todo.extend(reversed(c.children))
    return out


def _along(e: Element, wrapper: dict) -> list[Element]:
    """What the page has at a wrapper's path; hidden elements and boilerplate on the way are passed over."""
    path, level = wrapper["main"], [e]
    for k, sig in enumerate(path[1:], 2):
        wanted = {sig, *wrapper.get("beside", ())} if k == len(path) else {sig}
        level = [c for x in level for c in x.children if not isinstance(c, str) and c.signature in wanted and not _is_out(c)]
    return level if len(path) < 2 or any(x.signature == path[-1] for x in level) else []


def _article(root: Element, wrapper: dict | None) -> tuple[list[Element], set[str]]:
    """Where a page has its article, along its host's wrapper, or that of another layout, or by its own elements; and the
    blocks there that are constant."""
    while wrapper:
        if wrapper.get("main") and (found := _along(root, wrapper)):
            return found, set(wrapper.get("const", ()))
        wrapper = wrapper.get("next")
    # an article of comments is marked as such or stands inside of boilerplate
    own = _find(root, lambda e: e.tag == "article" and not is_boilerplate("", e.marks, e.hidden)) or _find(root, lambda e: (e.tag == "main" or "role=main" in e.marks) and not e.hidden)
    return own, set()


def follows(page: str | None, wrapper: dict | None) -> bool:
    """False for a page that would be taken whole."""
    return not page or not page.strip() or bool(_article(parse(page), wrapper)[0])


def extract(page: str | None, wrapper: dict | None) -> str:
    """Main text: blocks in page order, one on each line, white space inside of them as one space.

    The page is read along the host's wrapper, and its constant blocks go, unless nothing else is there. Where it doesn't
    follow the wrapper, as a page of another layout or one that is cut off, its own ``article`` or ``main`` element counts,
    and the whole body where it has neither.
    """
    if not page or not page.strip():
        return ""
    root = parse(page)
    found, constant = _article(root, wrapper)
    blocks = _blocks(found or [root])
    return "\n".join([b for b in blocks if b not in constant] or blocks)


def _blocks(found: list[Element]) -> list[str]:
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    # an explicit stack: pages nest as deeply as they like
    todo: list[tuple[Element | str | None, bool]] = [(e, True) for e in reversed(found)]
    while todo:
        e, top = todo.pop()
        if e is None:
            flush()
        elif isinstance(e, str):
            line.append(html.unescape(e))
        elif e.tag == "br" or e.tag in VOID:
            if e.tag in BLOCKS:
                flush()
            line.append(" ")
        elif e.tag == "header" and not top:
            for h in reversed(_find(e, lambda x: x.tag in HEADINGS)):
                todo.append((h, False))
        elif top or not _is_out(e):
            block = top or e.tag in BLOCKS
            if block:
                flush()
                todo.append((None, False))
            todo.extend((c, False) for c in reversed(e.children))
    flush()
    return blocks


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; an empty string where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer_wrappers(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(host, wrapper): for each host the wrapper of a sample, as JSON.

    The sample has at most ``sample_pages`` pages of a host, which bounds what one task gets however many pages the
    host has: Spark keeps that many of each host in every task before anything is shuffled.
    """
    return _inferred(_hosted(pages, page_id, url, markup), sample_pages)


def _hosted(pages: DataFrame, page_id: str, url: str, markup: str) -> DataFrame:
    return pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(url, page_id).alias("order"), F.col(markup).alias("html")).filter(F.col("html").isNotNull())


def _inferred(rows: DataFrame, sample_pages: int) -> DataFrame:
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("host").orderBy("order"))).filter(F.col("n") <= sample_pages)

    def run(key, table):
        texts = table.sort_by("order").column("html").to_pylist()
        return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(infer(texts))]})

    return first.select("host", "order", "html").groupBy("host").applyInArrow(run, "host string, wrapper string")


def _broadcast(wrappers: DataFrame) -> DataFrame:
    """Wrappers are short paths; where there are too many hosts to send them all, pages are shuffled by host."""
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("_host") + F.octet_length("_wrapper")), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers


def all_wrappers(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(host, wrapper): like ``infer_wrappers``, with further layouts of a host as ``next``.

    Every page is tried. Those that follow no wrapper of their host and have no article by themselves give samples of their
    own, so that a layout is learnt however few pages have it, until all are followed or no layout is found any more.
    """
    rest = _hosted(pages, page_id, url, markup)
    wrappers = cut(_inferred(rest, sample_pages))
    for _ in range(LAYOUTS - 1):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                known = {w: json.loads(w) for w in set(b.column("wrapper").to_pylist()) if w}
                lost = [not follows(page.as_py(), known.get(w.as_py())) for page, w in zip(b.column("html"), b.column("wrapper"))]
                yield b.select(["host", "order", "html"]).filter(pa.array(lost, pa.bool_()))

        own = _broadcast(wrappers.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper")))
        joined = rest.join(own, F.col("host") == F.col("_host"), "left").select("host", "order", "html", F.col("_wrapper").alias("wrapper"))
        rest = written(joined.mapInArrow(run, "host string, order bigint, html string"))
        more = cut(_inferred(rest, sample_pages).filter(F.get_json_object("wrapper", "$.main").isNotNull()).withColumnRenamed("wrapper", "more"))
        if more.isEmpty():
            return wrappers
        # an earlier layout goes before a later one
        chained = F.udf(_chain, "string")
        wrappers = cut(wrappers.join(more, "host", "left").select("host", F.when(F.col("more").isNull(), F.col("wrapper")).otherwise(chained("wrapper", "more")).alias("wrapper")))
    return wrappers


def _chain(wrapper: str, more: str) -> str:
    first = last = json.loads(wrapper)
    while last.get("next"):
        last = last["next"]
    last["next"] = json.loads(more)
    return json.dumps(first)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html", out: str = "text", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """``pages`` with the main text of each in ``out``; a null or empty page has an empty text, so has one without any.

    Every row gives a row. A column named like ``out`` is replaced. Broken and deeply nested markup is read as far as
    it goes, and whole pages are, whatever their length.
    """
    wrappers = _broadcast(all_wrappers(pages, sample_pages, page_id, url, markup).select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper")))
    kept = [c for c in pages.columns if c != out]
    joined = pages.select(*kept, F.col(markup).alias("_html"), host_of(F.col(url)).alias("_of")).join(wrappers, F.col("_of") == F.col("_host"), "left").select(*kept, "_html", "_wrapper")
    schema = pages.select(*kept, F.lit("").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = []
                for page, w in zip(b.column(len(kept)), b.column(len(kept) + 1)):
                    if (w := w.as_py()) not in known:
                        if len(known) > 10_000:
                            known = {None: None}
                        known[w] = json.loads(w)
                    texts.append(extract(page.as_py(), known[w]))
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(texts, pa.string())], [*kept, out])

    return joined.mapInArrow(run, schema)
