"""Main text of web pages: site templates are found by counting element subtrees per host and are then deleted.

First pass: each page is parsed and every element subtree gets a hash of its tags and text, and a key of the main text
around it. A subtree with ``min_pages`` different keys on its host, and with as many as ``least_share`` of the host's
different texts, is a template part: copies of a page have one key, however many they are. Distinct (host, hash, key)
are counted before and after the shuffle. Second pass: the template hashes of a page come back to it by page_id, those
subtrees are deleted, and the text of what is left is joined.

What is main text. Where a page marks its article (``article`` or ``main``), only text inside counts; paragraphs and
headings there are never template parts, since copied articles recur as well. Other containers inside (lists, tables,
sections, ...) are deleted when they hold less than ``most_share`` of the article's text and when also the first and the
longest block of the article outside of them have enough different keys, so that neither copies nor near copies lose a
part. Only labels (a ``div`` of up to ``_LABEL`` characters without a sentence, such as "Read on") go with copies, too,
where they stand on half of the host's pages. Without such a mark main text is the body. Elements that are no
text by their tag, role, class or id (menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts,
styles, reader comments) go everywhere; but a class or id alone never drops what holds the article or most of the text.

Blocks: tags in ``INLINE`` do not end a block, ``br`` is white space, every other tag ends one. Character references are
decoded, then white space inside a block becomes one blank.

Defined results: null or empty html has an empty text, never null; broken markup is read as far as it goes (unclosed
elements end with their parent, a tag cut off at the end is dropped); pages without a host are no site, so counting finds
nothing on them; rows that share a
page_id are pages of their own and know each other's template parts; a null page_id keeps parts that only counting finds.
"""

from __future__ import annotations

import html as markup
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.reputation import host_of
from isoreach.session import materialise

#: Fixed names of the markup language.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = "script|style|noscript|template|iframe|textarea|title|svg|math|object|canvas|select|audio|video"
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(("article", "main"))
NO_TEXT = frozenset("head nav footer aside form button fieldset menu dialog noscript".split())
KEPT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figcaption".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
#: Parts of class names and ids that mark what is no text.
_MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies footer "
    "masthead menu modal nav navbar navigation newsletter notice popup promo related reply share sharing sidebar social "
    "sponsor sponsored subscribe toolbar widget".split()
)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?P<cut>(?:\"[^\">]*|'[^'>]*)?\Z))|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: Words that may follow a mark in a name ("ad-slot", not "social-science"), and words that turn it into a layout's name.
_HOLDERS = frozenset(
    "area articles bar block body box button buttons container content count form header icon icons inner info item items "
    "law link links list message outer panel policy posts section signup slot text thread title toggle top unit wrap wrapper".split()
)
_LAYOUT = frozenset("has hide no non not with without".split())
#: Marks of parts that often consist of articles of their own.
_ARTICLES = frozenset("comment comments related reply".split())
#: All attributes one after the other, so that a name is never found inside a value.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
#: Most characters of a label, and what ends a sentence.
_LABEL = 20
_SENTENCE = re.compile(r"[.!?;:。！？]")
_WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    drop: bool
    main: bool
    start: int
    end: int = -1
    hash: int = 0
    marked: frozenset[str] = frozenset()


@dataclass
class Page:
    """Elements in order, the text pieces (element, block number, text), and the place of each piece among all tokens."""

    nodes: list[Node] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)
    places: list[int] = field(default_factory=list)


def _marks(value: str) -> set[str]:
    """The marks that the names of a class or an id hold."""
    found = set()
    for name in value.split():
        words = _WORD.findall(name)
        last = max((k for k, w in enumerate(words) if w in _MARKS), default=-1)
        if last >= 0 and _HOLDERS.issuperset(words[last + 1 :]) and _LAYOUT.isdisjoint(words[:last]):
            found |= _MARKS.intersection(words)
    return found


def _no_text(tag: str, attrs: str, inside_main: bool) -> tuple[bool, frozenset[str]]:
    """Whether the element is no text by its tag, role or a hidden attribute, and the marks of its class and id."""
    if tag in NO_TEXT or tag == "header" and not inside_main:
        return True, frozenset()
    if tag in ("html", "body", *MAIN) or not attrs.strip():
        return False, frozenset()
    marks = set()
    for m in _ATTR.finditer(attrs):
        name, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
            return True, frozenset()
        if name in ("class", "id"):
            marks |= _marks(value)
    return False, frozenset(marks)


def _drop_marked(page: Page) -> None:
    """Drops the elements whose class or id marks them, except those that hold the article or most of the text."""
    nodes = page.nodes
    if not any(n.marked for n in nodes):
        return
    size, holds, under = [0] * len(nodes), [n.main and n.tag in MAIN for n in nodes], [False] * len(nodes)
    total = 0
    for k, _, text in page.texts:
        if k < 0 or not nodes[k].drop:
            total += len(text)
            if k >= 0:
                size[k] += len(text)
    for k in range(len(nodes) - 1, -1, -1):
        if nodes[k].parent >= 0:
            size[nodes[k].parent] += size[k]
            holds[nodes[k].parent] |= holds[k]
    for k, node in enumerate(nodes):
        under[k] = bool(node.marked) or node.parent >= 0 and under[node.parent]
    elsewhere = any(n.main and n.tag in MAIN and not under[k] for k, n in enumerate(nodes))
    within = [total] * len(nodes)  # text of the article around, else of the page
    for k, node in enumerate(nodes):
        if node.parent >= 0:
            above = nodes[node.parent]
            within[k] = size[node.parent] if above.tag in MAIN and above.main else within[node.parent]
            node.drop |= above.drop
        if node.marked and not node.drop:
            most = 2 * size[k] >= within[k] > 0
            if node.main:
                node.drop = not most
            else:
                node.drop = not (holds[k] and not node.marked & _ARTICLES or most and not elsewhere)
        node.main &= not node.drop or node.parent >= 0 and nodes[node.parent].main


def parse(source: str) -> Page:
    page = Page()
    nodes = page.nodes
    stack: list[int] = []
    said: list[str] = []  # tags and texts in order, from which subtree hashes are made
    block = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = nodes[stack.pop()]
            node.end = len(said)

    for m in _TOKEN.finditer(source):
        if m["text"] is not None:
            text = markup.unescape(m["text"])
            if stack:
                page.texts.append((stack[-1], block, text))
            else:
                page.texts.append((-1, block, text))
            page.places.append(len(said))
            said.append(" ".join(text.split()))
            continue
        if m["tag"] is None or m["cut"] is not None:
            continue
        tag = m["tag"].lower()
        if tag not in INLINE:
            block += 1
        if m["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if nodes[stack[depth]].tag == tag:
                    close(depth)
                    break
            continue
        if tag == "br":
            page.texts.append((stack[-1] if stack else -1, block, " "))
            page.places.append(len(said))
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, -1, -1):
                if nodes[stack[depth]].tag == "p":
                    close(depth)
                    break
                if nodes[stack[depth]].tag not in INLINE:
                    break
        elif tag == "li":
            for depth in range(len(stack) - 1, -1, -1):
                if nodes[stack[depth]].tag == "li":
                    close(depth)
                    break
                if nodes[stack[depth]].tag in ("ul", "ol"):
                    break
        above = nodes[stack[-1]] if stack else None
        inside = above is not None and above.main
        drop, marked = _no_text(tag, m["attrs"], inside)
        drop |= above is not None and above.drop
        nodes.append(Node(tag, stack[-1] if stack else -1, drop, inside or tag in MAIN and not drop, len(said), marked=marked))
        stack.append(len(nodes) - 1)
        said.append(f"<{tag}>")
    close(0)
    _drop_marked(page)
    holds_main = set()
    for k, node in enumerate(nodes):
        if node.tag in MAIN and node.main:
            while k >= 0 and k not in holds_main:
                holds_main.add(k)
                k = nodes[k].parent
    for k, node in enumerate(nodes):
        # The frame of the page, the article itself and its paragraphs are never template parts.
        if node.tag in ("html", "body") or k in holds_main or node.main and node.tag in KEPT_BLOCKS | INLINE:
            continue
        # Inside an article a subtree is counted for itself, since more is asked of it.
        node.hash = xxhash.xxh64_intdigest("\0".join(said[node.start : node.end]), seed=int(node.main)) - (1 << 63)
    return page


def evidence(page: Page, most_share: float = 0.3) -> list[tuple[int, int, int]]:
    """(hash, kind, key) of each different subtree; hash 0 is the page itself.

    The key is of the main text outside the subtree (kind 0), in an article also of the first (1) and the longest (2)
    block outside; kind 3 marks labels of an article, where they hold less than ``most_share`` of its text together.
    """
    nodes = page.nodes
    has_main = any(n.main for n in nodes)
    spots, sums, blocks = [], [0], {}
    for place, (k, block, text) in zip(page.places, page.texts, strict=True):
        if has_main if k < 0 else nodes[k].drop or has_main and not nodes[k].main:
            continue
        said = " ".join(text.split())
        if said:
            spots.append(place)
            sums.append(sums[-1] + xxhash.xxh64_intdigest(said))
            blocks.setdefault(block, (place, []))[1].append(said)
    key = lambda x: (x & 0xFFFFFFFF) - (1 << 31)
    out = {(0, 0): key(sums[-1])}
    starts, ranked, before, after, labels = [], [], [], [], []
    if any(n.hash and n.main for n in nodes):
        starts = [place for place, _ in blocks.values()]
        ranked = [(len(t), xxhash.xxh64_intdigest(t)) for t in (" ".join(parts) for _, parts in blocks.values())]
        before, after = [(0, 0)], [(0, 0)]  # the longest block of the first k, and of the last k
        for r in ranked:
            before.append(max(before[-1], r))
        for r in reversed(ranked):
            after.append(max(after[-1], r))
    parents = {n.parent for n in nodes}
    for k, node in enumerate(nodes):
        if not node.hash or (node.hash, 0) in out:
            continue
        a, b = bisect_left(spots, node.start), bisect_left(spots, node.end)
        out[node.hash, 0] = key(sums[-1] - sums[b] + sums[a])
        if node.main:
            i, j = bisect_left(starts, node.start), bisect_left(starts, node.end)
            first = ranked[0] if i > 0 else ranked[j] if j < len(ranked) else (0, 0)
            out[node.hash, 1] = key(first[1])
            out[node.hash, 2] = key(max(before[i], after[len(ranked) - j])[1])
            text = " ".join(t for _, parts in list(blocks.values())[i:j] for t in parts) if node.tag == "div" and k not in parents else ""
            if 0 < len(text) <= _LABEL and not _SENTENCE.search(text):
                labels.append((node.hash, len(text)))
    # Short divs that make up the article are its text.
    if sum(n for _, n in labels) < most_share * sum(n for n, _ in ranked):
        out |= {(h, 3): 0 for h, _ in labels}
    return [(h, kind, x) for (h, kind), x in out.items()]


def main_text(page: Page, template: frozenset[int] | set[int], most_share: float = 0.3) -> str:
    """The text without template parts; blocks joined by a blank."""
    nodes = page.nodes
    has_main = any(n.main for n in nodes)
    size = [0] * len(nodes)
    total = 0
    for k, _, text in page.texts:
        if k >= 0 and nodes[k].main and not nodes[k].drop:
            total += len(text)
        while k >= 0:
            size[k] += len(text)
            k = nodes[k].parent
    gone = [False] * len(nodes)
    for k, node in enumerate(nodes):
        recurs = node.hash in template and node.hash != 0
        part = recurs and (not node.main or size[k] < most_share * total)
        gone[k] = node.drop or part or node.parent >= 0 and gone[node.parent]
    blocks: dict[int, list[str]] = {}
    for k, block, text in page.texts:
        if k < 0:
            if has_main:
                continue
        elif gone[k] or has_main and not nodes[k].main:
            continue
        blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return " ".join(line for line in lines if line)


def extract(pages: DataFrame, min_pages: int = 3, most_share: float = 0.3, least_share: float = 0.02) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_template (deleted subtrees that counting found)."""
    own = pages.select("page_id", "url", "html")

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hosts, hashes, kinds, keys = [], [], [], [], []
            for row in batch.to_pylist():
                for h, kind, key in evidence(parse(row["html"] or ""), most_share):
                    ids.append(row["page_id"])
                    hosts.append(row["host"])
                    hashes.append(h)
                    kinds.append(kind)
                    keys.append(key)
            arrays = [pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(kinds, pa.int8()), pa.array(keys, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "host", "hash", "kind", "key"])

    hosted = own.select("page_id", host_of(F.col("url")).alias("host"), "html").filter("host <> ''")
    found = hosted.mapInArrow(subtrees, "page_id long, host string, hash long, kind byte, key int")
    counted = found.groupBy("host", "hash", "kind", "key").agg(F.count("*").alias("n"))
    counted = counted.groupBy("host", "hash", "kind").agg(F.count("*").alias("keys"), F.sum("n").alias("pages"))
    counted = counted.groupBy("host", "hash").agg(
        F.min(F.when(F.col("kind") < 3, F.col("keys"))).alias("keys"), F.max("pages").alias("pages"), F.max("kind").alias("kind")
    )
    counted = materialise(counted.filter((F.col("pages") >= min_pages) | (F.col("hash") == 0)), "subtree-counts")
    hosts = counted.filter("hash = 0").select("host", F.col("keys").alias("host_keys"), F.col("pages").alias("host_pages"))
    recurs = F.col("keys") >= F.greatest(F.lit(min_pages), F.col("host_keys") * least_share)
    label = (F.col("kind") == 3) & (2 * F.col("pages") >= F.col("host_pages"))
    counted = counted.filter("hash <> 0").join(hosts, "host").filter(recurs | label)
    mine = found.filter("page_id IS NOT NULL AND hash <> 0 AND kind = 0").join(counted.select("host", "hash"), ["host", "hash"])
    mine = mine.groupBy("page_id").agg(F.collect_set("hash").alias("hashes"))
    known = "page_id long, url string, text string, n_chars long, n_template int"

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                page = parse(row["html"] or "")
                template = set(row["hashes"] or ())
                text = main_text(page, template, most_share)
                out.append((row["page_id"], row["url"], text, len(text), sum(n.hash in template for n in page.nodes)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32())
            values = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["page_id", "url", "text", "n_chars", "n_template"])

    return own.join(mine, "page_id", "left").select("page_id", "url", "html", "hashes").mapInArrow(texts, known)
