"""Main text of web pages by wrappers inferred per host.

A page is a stream of tags and text slots.  Runs of equal neighbours become
repeated groups; the streams of a host are aligned one after another, and what
only some have becomes optional.  The result is a union-free regular expression
for the host, its wrapper.  Each page is matched to it, and a text that stands
in the same slot of most pages of a host is template.  A page's text comes from
the blocks that are not, of the regions in which the host's pages vary.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Elements without content, elements that begin a new block, and elements that are no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
OUT_TAGS = frozenset("head title nav aside footer form button select option textarea dialog menu noscript iframe object svg canvas template audio video".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
OUT_NAMES = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|nav|navbar|navigation|menu|sidebar|side|header|footer|masthead"
    r"|cookies?|consent|gdpr|notice|notification|popup|overlay|modal|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended"
    r"|comments?|commentlist|disqus|replies|reply|breadcrumbs?|pagination|pager|widget|toolbar|skip|legal|copyright)(?:$|[\s_-])"
)
MAIN_NAMES = re.compile(r"(?i)(?:^|[\s_-])(?:article|main|post|entry|story)(?:$|[\s_-])")
IMPLIED_END = {"p": BLOCK, "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
RAW = "script|style|noscript|template|textarea|title|iframe|svg|xmp"

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s>/])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*(?:>|\Z)|<(?=[a-zA-Z])[^>]*\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"(?i)(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s")
LONGEST_REPEAT = 12
REGIONS = ("article", "main", "body", "out")
#: A slot's text is template if it is in half of the host's pages that have the slot, in so many different surroundings at least.
LEAST_PAGES = 3


@dataclass
class Stream:
    """items: tags and slots ('#' and the region); texts: of each slot its words; breaks: whether a new block begins before it."""

    items: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    breaks: list[bool] = field(default_factory=list)


def _kind(tag: str, attrs: str, region: str) -> str:
    """The region inside an element that stands in `region`."""
    if region == "out":
        return "out"
    names, role = [], ""
    for name, a, b, c in _NAMES.findall(attrs) if "=" in attrs else ():
        if name.lower() == "role":
            role = (a or b or c).lower()
        else:
            names.append(a or b or c)
    named = " ".join(names)
    if tag in OUT_TAGS or role in OUT_ROLES or (tag == "header" and region == "body"):
        return "out"
    if tag not in ("html", "body", "article", "main") or (tag == "article" and region == "article"):
        if named and OUT_NAMES.search(named) and not (tag == "header" and region != "body"):
            return "out"
    if tag == "article":
        return "article"
    if region != "article" and (tag == "main" or role == "main" or (named and MAIN_NAMES.search(named))):
        return "main"
    return region


def tokenize(page: str) -> Stream:
    out, stack, region = Stream(), [("", "body")], "body"
    at, fresh_block = 0, True

    def text(raw: str) -> None:
        nonlocal fresh_block
        t = html_lib.unescape(raw) if "&" in raw else raw
        if not t or (t.isspace() and not out.texts):
            return
        slot = f"#{region}"
        if not fresh_block and out.items and out.items[-1] == slot:
            out.texts[-1] += t
        elif not t.isspace():
            out.items.append(slot)
            out.texts.append(t)
            out.breaks.append(fresh_block)
            fresh_block = False
        elif not fresh_block:
            out.texts[-1] += " "

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            else:
                if tag != "p":
                    continue
            region = stack[-1][1]
            out.items.append(f"/{tag}")
            fresh_block |= tag in BLOCK
            continue
        if tag in BLOCK:
            fresh_block = True
            while len(stack) > 1 and tag in IMPLIED_END.get(stack[-1][0], ()):
                stack.pop()
                region = stack[-1][1]
            if stack[-1][0] not in IMPLIED_END:  # an open inline element of a paragraph that never ended
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in BLOCK:
                        if tag in IMPLIED_END.get(stack[k][0], ()):
                            del stack[k:]
                            region = stack[-1][1]
                        break
        elif tag == "br" and not fresh_block:
            out.texts[-1] += " "
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag not in VOID and not attrs.rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            region = _kind(tag, attrs, region)
            stack.append((tag, region))
        out.items.append(tag if region == "body" or tag in VOID else f"{tag}:{region}")
    if at < len(page):
        text(page[at:])
    return out


# --- wrappers ---------------------------------------------------------------------------------
# An item is a tag, a slot, or ("+", items) for a group that repeats.


def _numbered(items: list) -> list[list[list[int]]]:
    """Of each item its leaves (the slots inside it), each with its own number only."""
    out, n = [], 0
    for x in items:
        k = _leaves(x)
        out.append([[n + j] for j in range(k)])
        n += k
    return out


def _leaves(x) -> int:
    return sum(map(_leaves, x[1])) if isinstance(x, tuple) else int(x[0] == "#")


def _joined(parts: list[list[list[int]]]) -> list[list[int]]:
    """The leaves of repetitions of one item, as those of the item."""
    return [sum(same, []) for same in zip(*parts, strict=True)]


def fold_slots(items: list) -> tuple[list, list[list[int]]]:
    """Neighbouring repeats of up to LONGEST_REPEAT items become groups, again and again, inner ones first.

    Also, of each leaf of the result, in order, the numbers of the slots it stands for.
    """
    src, again = _numbered(items), True
    while again:
        again = False
        for w in range(1, LONGEST_REPEAT + 1):
            out, own, k, n = [], [], 0, len(items)
            while k < n:
                r = 1
                if k + w < n and items[k] == items[k + w] and items[k : k + w] == items[k + w : k + 2 * w]:
                    block = items[k : k + w]
                    while items[k + r * w : k + (r + 1) * w] == block:
                        r += 1
                if r > 1:
                    one = block[0] if w == 1 and isinstance(block[0], tuple) else ("+", tuple(block))
                    out.append(one)
                    own.append(_joined([sum(src[k + j * w : k + (j + 1) * w], []) for j in range(r)]))
                    k, again = k + r * w, True
                else:
                    out.append(items[k])
                    own.append(src[k])
                    k += 1
            items, src = out, own
    return items, sum(src, [])


def fold(items: list) -> list:
    return fold_slots(items)[0]


def _groups(items: list) -> set:
    return {x for x in items if isinstance(x, tuple)}


def _regroup_slots(items: list, src: list, groups: set) -> tuple[list, list]:
    """Single occurrences of known groups become these groups, so that one row meets many; src follows."""
    for g in sorted(groups, key=lambda g: (-len(g[1]), repr(g))):
        body, out, own, k = list(g[1]), [], [], 0
        while k < len(items):
            if items[k] == body[0] and items[k : k + len(body)] == body:
                leaves, one, k = sum(src[k : k + len(body)], []), g, k + len(body)
            else:
                leaves, one, k = src[k], items[k], k + 1
            if one == g and out and out[-1] == g:
                own[-1] = _joined([own[-1], leaves])
            else:
                out.append(one)
                own.append(leaves)
        items, src = out, own
    return items, src


def _regroup(items: list, groups: set) -> list:
    return _regroup_slots(items, _numbered(items), groups)[0]


def match(items: list, wrapper: list) -> list[int]:
    """Of each leaf of a folded page the number of the wrapper's leaf it is aligned with; -1 if none."""
    found, (items, src) = [-1] * sum(map(_leaves, items)), _regroup_slots(items, _numbered(items), _groups(wrapper))
    own = _numbered(wrapper)
    for a, b, n in SequenceMatcher(None, wrapper, items, autojunk=False).get_matching_blocks():
        for k in range(n):
            for slot, leaves in zip(own[a + k], src[b + k], strict=True):
                for x in leaves:
                    found[x] = slot[0]
    return found


def align(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """One wrapper for both: (item, optional) pairs; what only one side has is optional."""
    ga, gb = _groups([x for x, _ in a]), _groups([x for x, _ in b])
    a, b = _regroup_pairs(a, gb | ga), _regroup_pairs(b, ga | gb)
    out: list[tuple] = []
    for op, i, j, k, m in SequenceMatcher(None, [x for x, _ in a], [x for x, _ in b], autojunk=False).get_opcodes():
        if op == "equal":
            out += [(x, p or q) for (x, p), (_, q) in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [(x, True) for x, _ in a[i:j]] + [(x, True) for x, _ in b[k:m]]
    return out


def _regroup_pairs(w: list[tuple], groups: set) -> list[tuple]:
    if not groups:
        return w
    flat, optional = _regroup([x for x, _ in w], groups), {}
    for x, o in w:
        optional[x] = optional.get(x, True) and o
    return [(x, optional.get(x, all(optional.get(y, True) for y in x[1]) if isinstance(x, tuple) else True)) for x in flat]


def infer(skeletons: list[tuple], start: list[tuple] | None = None) -> list[tuple]:
    w = start
    for s in skeletons:
        one = [(x, False) for x in s]
        w = one if w is None else align(w, one)
    return w or []


def expression(wrapper: list[tuple]) -> str:
    """The wrapper as a regular expression over tags and slots."""

    def show(x) -> str:
        if isinstance(x, tuple):
            return "(" + "".join(map(show, x[1])) + ")+"
        return "(.*)" if x[0] == "#" else f"<{x}>"

    return "".join(f"({show(x)})?" if o else show(x) for x, o in wrapper)


def regions(items: list) -> set[str]:
    out: set[str] = set()
    for x in items:
        out |= regions(list(x[1])) if isinstance(x, tuple) else {x[1:]} if x[0] == "#" else set()
    return out


def content_regions(wrapper: list[tuple]) -> tuple[str, ...]:
    """The regions whose slots hold the article in pages of this wrapper, best first."""
    found = regions([x for x, _ in wrapper])
    return tuple(r for r in REGIONS[:3] if r in found)


def extract(stream: Stream, order: tuple, template: list[bool] | None = None) -> str:
    """The blocks of the first step of `order` (a region, or several) in which the page has any text that is not template.

    A block goes only if all of its slots are template.
    """
    own = [x[1:] for x in stream.items if x[0] == "#"]
    template = template or [False] * len(own)
    for step in order:
        regions_ = (step,) if isinstance(step, str) else step
        blocks: list[list[str]] = []
        varies: list[bool] = []
        for r, t, new, same in zip(own, stream.texts, stream.breaks, template, strict=True):
            if new or (not blocks and r in regions_):
                blocks.append([])
                varies.append(False)
            if r in regions_:
                blocks[-1].append(t)
                varies[-1] |= not same
        texts = [" ".join("".join(b).split()) for b, v in zip(blocks, varies, strict=True) if v]
        if any(texts):
            return "\n\n".join(t for t in texts if t)
    return ""


def choose(mass: dict[str, int], n_pages: int, found: tuple[str, ...]) -> tuple:
    """The order for extract(), from the characters of each region that are not template.

    A region that varies as much as all better ones together is read with them;
    'out' counts only on hosts whose other regions never vary.
    """
    varying = [r for r in REGIONS[:3] if mass.get(r)]
    if n_pages < LEAST_PAGES:
        return found
    if not varying:
        return (*found, "out") if mass.get("out") else found
    first = varying[:1]
    for r in varying[1:]:
        if mass[r] >= sum(mass[x] for x in first):
            first.append(r)
    return (tuple(first), *found)


class Host:
    """What is known of one host: its wrapper, and once they are counted its template texts and regions."""

    def __init__(self, known: str | None):
        x = json.loads(known or "{}")
        wrapper = _load(x.get("wrapper", "[]"))
        self.items = [i for i, _ in wrapper]
        self.template = {(t["slot"], t["h"]) for t in x.get("template") or ()}
        self.order = choose({m["region"]: m["mass"] for m in x.get("mass") or ()}, x.get("n_pages") or 0, content_regions(wrapper))
        self.matched: dict[tuple, list[int]] = {}

    def slots(self, stream: Stream) -> list[int]:
        """The wrapper's slot of each slot of the page; below zero (one number a region) what it does not have."""
        own = [x[1:] for x in stream.items if x[0] == "#"]
        out = [-2 - REGIONS.index(r) for r in own]
        items, leaves = fold_slots(stream.items)
        key = tuple(items)
        if key not in self.matched:
            if len(self.matched) >= 2_000:
                self.matched.clear()
            self.matched[key] = match(items, self.items)
        for slot, numbers in zip(self.matched[key], leaves, strict=True):
            if slot >= 0:
                for n in numbers:
                    out[n] = slot
        return out

    def text(self, page: str) -> str:
        stream = tokenize(page)
        if not self.template:
            return extract(stream, self.order)
        return extract(stream, self.order, [(s, h) in self.template or not n for s, (h, n) in zip(self.slots(stream), map(_digest, stream.texts), strict=True)])


def _digest(text: str) -> tuple[int, int]:
    """Digest (signed) and length of a slot's text, white space made one space."""
    t = " ".join(text.split())
    h = xxhash.xxh64_intdigest(t)
    return h - (1 << 64) if h >> 63 else h, len(t)


def slot_rows(host: Host, page: str) -> set[tuple[int, str | None, int | None, int, int]]:
    """(slot, region, digest, length, surroundings) of a page's texts; without digest of its slots, and at -1 of the page.

    A text's surroundings are the longest and the least of the other texts, so
    that copies and near copies of one article are mostly counted as one page.
    """
    stream = tokenize(page)
    regions_ = [x[1:] for x in stream.items if x[0] == "#"]
    rows = [(s, r, *d) for s, r, d in zip(host.slots(stream), regions_, map(_digest, stream.texts), strict=True) if d[1]]
    pool = {(n, h) for _, r, h, n in rows if r != "out"} or {(n, h) for _, r, h, n in rows}
    longest = sorted(pool, reverse=True)[:2]
    least = sorted(pool, key=lambda x: x[1])[:2]

    def around(text: tuple[int, int] | None) -> int:
        a = next((x[1] for x in longest if x != text), 0)
        b = next((x[1] for x in least if x != text), 0)
        return ((3 * a + b + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)

    out: set = {(-1, None, None, 0, around(None))}
    for s, r, h, n in rows:
        out |= {(s, r, h, n, around((n, h))), (s, r, None, 0, around(None))}
    return out


# --- on Spark ---------------------------------------------------------------------------------


def _dump(wrapper: list[tuple]) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


def _load(text: str) -> list[tuple]:
    def item(x):
        return (x[0], tuple(map(item, x[1]))) if isinstance(x, list) else x

    return [(item(x), o) for x, o in json.loads(text)]


def _skeleton_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of each host's pages of one task."""
    known: dict[str | None, list[tuple]] = {}
    seen: set[tuple] = set()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([_dump(w) for w in known.values()], pa.string())], names=["host", "wrapper"])
        known.clear()
        seen.clear()
        return out

    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            skeleton = tuple(fold(tokenize(page.as_py() or "").items))
            if (host, skeleton) not in seen:
                seen.add((host, skeleton))
                known[host] = infer([skeleton], known.get(host))
        if len(seen) > 20_000:
            yield flush()
    yield flush()


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by host: one wrapper is held at a time."""
    now, wrapper, started = None, None, False
    for b in batches:
        for host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if started and host != now:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([_dump(wrapper)], pa.string())], names=["host", "wrapper"])
                wrapper = None
            wrapper = _load(text) if wrapper is None else align(wrapper, _load(text))
            now, started = host, True
    if started:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([_dump(wrapper)], pa.string())], names=["host", "wrapper"])


def host_of(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host and wrapper (JSON) of every host, from all of its pages.

    Each task sends one wrapper per host on, equal ones are merged before the
    shuffle, and a host's wrappers are then aligned in a stream.
    """
    own = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    parts = own.mapInArrow(_skeleton_batches, "host string, wrapper string").distinct()
    return parts.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_merge_batches, "host string, wrapper string")


def _known(wrappers: dict[str, str] | None):
    """From a row's first column to its Host."""
    hosts: dict[str, Host] = {}

    def get(key: str | None) -> Host:
        text = wrappers.get(key) if wrappers is not None else key
        if (text or "") not in hosts:
            if len(hosts) > 1_000:
                hosts.clear()
            hosts[text or ""] = Host(text)
        return hosts[text or ""]

    return get


def _slot_batches(wrappers: dict[str, str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _known(wrappers)
        for b in batches:
            rows = []
            for key, host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows += [(host, *x) for x in slot_rows(get(key), page.as_py() or "")]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["host", "slot", "region", "h", "size", "around"])

    return run


def learn(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host and known (JSON: wrapper, template, mass, n_pages) of every host, from all of its pages.

    Texts are counted by (host, slot, digest) with partial sums, so neither a
    hot host nor a hot text gathers rows in one task.
    """
    wrappers = materialize(infer_wrappers(pages, url_col, html_col).select("host", F.to_json(F.struct("wrapper")).alias("known"), "wrapper"), "wrappers")
    rows, known = _with_known(pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")), wrappers)
    rows = rows.mapInArrow(_slot_batches(known), "host string, slot int, region string, h long, size long, around long")
    once = rows.groupBy("host", "slot", "region", "h", "size", "around").agg(F.count(F.lit(1)).alias("rows"))
    texts = materialize(once.groupBy("host", "slot", "region", "h", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")), "slots")
    totals = texts.filter("h IS NULL").select("host", "slot", F.col("n").alias("total"))
    template = materialize(
        texts.filter(F.col("h").isNotNull() & (F.col("n") >= LEAST_PAGES)).join(totals, ["host", "slot"]).filter("2 * n >= total"), "template"
    )
    chars = F.sum(F.col("size") * F.col("rows"))
    mass = texts.filter("h IS NOT NULL").groupBy("host", "region").agg(chars.alias("mass"))
    constant = template.groupBy("host", "region").agg(chars.alias("constant"))
    mass = mass.join(constant, ["host", "region"], "left").withColumn("mass", F.col("mass") - F.coalesce("constant", F.lit(0)))
    return (
        wrappers.select("host", "wrapper")
        .join(mass.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("region", "mass"))).alias("mass")), "host", "left")
        .join(template.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "h"))).alias("template")), "host", "left")
        .join(totals.filter("slot = -1").select("host", F.col("total").alias("n_pages")), "host", "left")
        .select("host", F.to_json(F.struct("wrapper", "template", "mass", "n_pages")).alias("known"))
    )


#: Wrappers of so many hosts at most, and of so many characters in all, are sent to all executors.
BROADCAST_HOSTS, BROADCAST_CHARS = 5_000, 16_000_000


def _with_known(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, dict[str, str] | None]:
    """rows (host and others) behind the key for _known(), and what that takes."""
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("known")), F.lit(0)).alias("c")).first()
    if size["n"] <= BROADCAST_HOSTS and size["c"] <= BROADCAST_CHARS:
        return rows.select(F.col("host").alias("key"), "*"), {r["host"]: r["known"] for r in known.collect()}
    return rows.join(known.select("host", "known"), "host", "left").select(F.col("known").alias("key"), *rows.columns), None


def _extract_batches(wrappers: dict[str, str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _known(wrappers)
        for b in batches:
            texts = [get(key).text(page.as_py() or "") for key, page in zip(b.column(0).to_pylist(), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(4), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return run


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url and text (empty if none) per input row.

    Null html is empty; a null or odd url belongs to the host ''; null and
    repeated ids stay rows of their own; pages of any length are read whole;
    other input columns are ignored; an empty table gives none.  On hosts with
    too few different pages (LEAST_PAGES) nothing is template.
    """
    kind = dict(pages.dtypes)
    known = materialize(learn(pages, url_col, html_col), "hosts")
    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html"), F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows, sent = _with_known(rows, known)
    return rows.mapInArrow(_extract_batches(sent), f"id {kind[id_col]}, url {kind[url_col]}, text string").select(F.col("id").alias(id_col), "url", "text")
