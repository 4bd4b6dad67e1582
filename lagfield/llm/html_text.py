"""Main text of web pages by templates deduced for each host.

Elements are tokens, told apart by their place in the page (their labels from the root); the text that stands directly
in an element found once on a page is a token too, told apart by place and text.  Tokens with the same occurrence vector
over all pages of a host form an equivalence class; vectors are compared by a hash that is built up page by page, so no
page meets another.  A class counts if pages of several different texts hold it, and is valid if its tokens come once
a page, in the same order on every page, and all inside one slot of the class around them.  Valid classes nest into the
host's template: a text in the class of its own element belongs to it.  Between the template's tokens are slots; a
page's text is what remains in them, but for the parts that tags and names mark as menus, adverts, comments and the like.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfield.llm.common import materialize

#: Pages of different texts that have to hold a token; copies and near copies of a page mostly count as one.
SUPPORT = 3

#: HTML elements by role, and words in class and id that name boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr input".split()
)
RAW = set("script style noscript template textarea title iframe noembed noframes xmp".split())
SKIP = set("head nav footer aside form button select menu dialog svg canvas object audio video map".split()) | RAW
CLOSED_BY_BLOCK = set(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
    "body": {"head"},
}
WALLS = set("ul ol dl table select article section div main aside nav footer header form body html".split())
#: Names that condemn all inside, and names that condemn all inside but for an article or main part.
ALWAYS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored comment comments commentlist respond reply replies "
    "discussion disqus cookie cookies consent gdpr popup modal login signup".split()
)
AROUND = set(
    "banner promo promotion sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs notice notices alert footer "
    "foot masthead share sharing social related recommended overlay newsletter subscribe subscription search pagination "
    "pager toolbar widget widgets skip-link site-header page-header topbar top-bar".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S,
)
_NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ENDS = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url) -> str:
    """Host of a URL in lower case; empty where there is none."""
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


FREE, WRAPPED, OUT = 0, 1, 2


def verdict(attributes) -> int:
    """What class, id and role say: ``OUT``, ``WRAPPED`` (but for articles inside) or ``FREE``.

    Names are whole: ``sidebar`` or ``main-sidebar``, but not ``content-sidebar-wrap``.
    """
    found = FREE
    for _, a, b, c in _NAME.findall(attributes or ""):
        for name in (a or b or c).lower().split():
            for part in (name, name.replace("_", "-").rpartition("-")[2]):
                if part in ALWAYS:
                    return OUT
                if part in AROUND:
                    found = WRAPPED
    return found


class Walk:
    """One page as a sequence of elements and texts.

    ``elements``: [key, parent index, tag, verdict]; ``texts``: (element index, text, block number).  Inline elements
    are not kept.  A key names an element's place: its labels from the root, hashed.
    """

    keys: dict = {}

    def __init__(self, page: str):
        self.elements, self.texts, self.block = [[0, -1, "", FREE]], [], 0
        self.stack = [0]
        place = 0
        while True:
            m = _TOKEN.search(page, place)
            stop = m.start() if m else len(page)
            if stop > place:
                self.texts.append((self.stack[-1], page[place:stop], self.block))
            if not m:
                return
            place = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.close(tag)
                continue
            attributes = m[3] if m[2] else m[6]
            if tag in RAW:
                end = _ENDS[tag].search(page, place)
                place = end.end() if end else len(page)
                continue
            self.open(tag, attributes)

    def open(self, tag, attributes):
        said = verdict(attributes)
        if tag in INLINE and not said:
            if tag == "br":
                self.texts.append((self.stack[-1], " ", self.block))
            return
        self.block += 1
        if tag in CLOSED_BY_BLOCK:
            self.shut({"p"})
        if tag in SIBLINGS:
            self.shut(SIBLINGS[tag])
        if tag in VOID:
            return
        names = {k.lower(): (a or b or c) for k, a, b, c in _NAME.findall(attributes)} if attributes else {}
        label = re.sub(r"\d+", "0", " ".join([tag, *sorted(names.get("class", "").split()), "#" + names.get("id", "")]))
        parent = self.stack[-1]
        up = self.elements[parent]
        if tag in ("html", "body"):
            said = FREE
        elif tag in SKIP or (tag == "header" and not any(self.elements[i][2] in ("article", "main") for i in self.stack)):
            said = OUT
        elif tag in ("article", "main"):
            # its own name only counts if it says that nothing inside is an article
            said = OUT if said == OUT else FREE
        inherited = FREE if up[3] == WRAPPED and tag in ("article", "main") else up[3]
        self.elements.append([self.key(up[0], label), parent, tag, max(said, inherited)])
        self.stack.append(len(self.elements) - 1)

    @classmethod
    def key(cls, up, label):
        known = cls.keys.get((up, label))
        if known is None:
            if len(cls.keys) > 100_000:
                cls.keys.clear()
            digest = hashlib.blake2b(f"{up}/{label}".encode("utf-8", "replace"), digest_size=8).digest()
            known = cls.keys[(up, label)] = int.from_bytes(digest, "little", signed=True) & ~1
        return known

    def tag(self, index):
        return self.elements[index][2]

    def own_texts(self) -> dict:
        """Text that stands directly in each element that is not condemned, blanks taken together."""
        held: dict = {}
        for index, piece, _ in self.texts:
            if not self.elements[index][3] and not piece.isspace():
                held.setdefault(index, []).append(piece)
        return {index: " ".join("\0".join(pieces).split()) for index, pieces in held.items()}

    def tokens(self):
        """Key, parent's key and place in the page of each element and of the text of each once-found element."""
        counts = Counter(e[0] for e in self.elements)
        own = self.own_texts()
        for index, (key, parent, *_) in enumerate(self.elements):
            yield key, self.elements[parent][0] if parent >= 0 else None, index, counts[key]
            if index in own and counts[key] == 1:
                yield text_key(key, own[index]), key, index, 1

    def shut(self, tags):
        """Close open elements of these tags up to the nearest wall."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.tag(self.stack[i])
            if tag in tags:
                del self.stack[i:]
                self.block += 1
                tags = tags if tag != "p" else set()
            elif tag in WALLS:
                return

    def close(self, tag):
        if tag in VOID:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.tag(self.stack[i]) == tag:
                del self.stack[i:]
                break
        if tag not in INLINE:
            self.block += 1


def _mix(a: int, b: int) -> int:
    digest = hashlib.blake2b(b"%d:%d" % (a, b), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def text_key(element: int, text: str) -> int:
    """Key of a text token: odd, where keys of elements are even."""
    digest = hashlib.blake2b(f"{element}\0{text}".encode("utf-8", "replace"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True) | 1


def _tokens(batches):
    """For each host and token of a batch: occurrence vector (hashed), pages, occurrences and kinds of pages.

    ``kinds`` has a bit for each page, chosen by the least hash of its texts, which near copies mostly share.
    """
    for batch in batches:
        held: dict = {}
        for page, url, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            walk, host = Walk(text or ""), host_of(url)
            texts = walk.own_texts().values()
            kind = min((zlib.crc32(t.encode("utf-8", "replace")) for t in texts), default=0)
            bit = 1 << (kind * 0x9E3779B1 >> 7) % 63
            met = set()
            for key, parent, _, n in walk.tokens():
                if key in met:
                    continue
                met.add(key)
                got = held.setdefault((host, key), [parent, 0, 0, 0, 0])
                got[1] ^= _mix(page or 0, n)
                got[2] += 1
                got[3] += n
                got[4] |= bit
        columns = list(zip(*((h, k, *v) for (h, k), v in held.items()), strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)],
            names="host key parent vector pages total kinds".split(),
        )


def _checked(batches):
    """For each class of the hosts of a batch: the order of its tokens on a page (hashed), and whether all are in one slot.

    The slot of a token is the nearest element of another class around it, and how many of that class come before.
    """
    for batch in batches:
        rows = []
        for url, text, members in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            of = {m["key"]: m["class"] for m in members or ()}
            if not of:
                continue
            walk = Walk(text or "")
            orders: dict = {}
            slots: dict = {}
            before: Counter = Counter()
            around = [None] * len(walk.elements)  # the class of each element or else of what is around it
            for key, _, index, n in walk.tokens():
                parent = walk.elements[index][1]
                own = of.get(key) if n == 1 else None
                is_text = key & 1
                outer = around[index] if is_text else (around[parent] if parent >= 0 else None)
                if own is not None:
                    orders[own] = _mix(orders.get(own, 0), key)
                    if outer is not None and outer != own:
                        slots.setdefault(own, set()).add((outer, before[outer]))
                    before[own] += 1
                if not is_text:
                    around[index] = own if own is not None else outer
            host = host_of(url)
            rows += [(host, c, order, len(slots.get(c, ())) <= 1) for c, order in orders.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["host", "class", "order", "nested"]
        )


def templates(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``host, fixed``: the text tokens of the template of every host that has any, from all of its pages.

    Tokens are counted in the tasks that read the pages, then by host and key; classes are met by their vector.  Only
    those that hold a text in the class of its own element are checked on the pages.
    """
    rows = pages.select(F.col(page_id).cast("long"), F.col(url), F.col(html)).mapInArrow(
        _tokens, "host string, key bigint, parent bigint, vector bigint, pages bigint, total bigint, kinds bigint"
    )
    counted = rows.groupBy("host", "key").agg(
        F.min("parent").alias("parent"),
        F.bit_xor("vector").alias("vector"),
        F.sum("pages").alias("pages"),
        F.sum("total").alias("total"),
        F.bit_or("kinds").alias("kinds"),
    )
    once = materialize(
        counted.where((F.col("pages") == F.col("total")) & (F.bit_count("kinds") >= SUPPORT)).select(
            "host", "key", "parent", F.xxhash64("vector", "pages").alias("class")
        ),
        "html-tokens",
    )
    # a text whose element is in the same class: wherever the element stands, it says the same
    element = once.select("host", F.col("key").alias("parent"), F.col("class").alias("of"))
    texts = once.where(F.col("key").bitwiseAND(F.lit(1)) == 1).join(element, ["host", "parent"]).where("class = of")
    texts = materialize(texts.select("host", "key", "class"), "html-texts")
    members = once.join(texts.select("host", "class").distinct(), ["host", "class"])
    by_host = materialize(
        members.groupBy(F.col("host").alias("__host__")).agg(F.collect_list(F.struct("key", "class")).alias("members")),
        "html-members",
    )
    found = _with_host(pages, url).join(by_host, "__host__").select(F.col(url), F.col(html), "members")
    checked = found.mapInArrow(_checked, "host string, class bigint, order bigint, nested boolean")
    valid = (
        checked.groupBy("host", "class")
        .agg((F.min("order") == F.max("order")).alias("ordered"), F.bool_and("nested").alias("nested"))
        .where("ordered AND nested")
    )
    return texts.join(valid, ["host", "class"]).groupBy("host").agg(F.collect_set("key").alias("fixed"))


def _with_host(pages: DataFrame, url: str) -> DataFrame:
    name = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    return pages.withColumn("__host__", name)


def main_text(page: str, fixed=()) -> str:
    """Text blocks in the slots of the template, those of articles and main parts if the page has any."""
    walk = Walk(page)
    elements = walk.elements
    fixed = set(fixed)
    skipped = set()
    if fixed:
        skipped = {index for key, _, index, _ in walk.tokens() if key in fixed}
    marked = any(e[2] in ("article", "main") and not e[3] for e in elements)
    inside = [not marked] * len(elements)
    for i, (_, parent, tag, _) in enumerate(elements):
        if tag in ("article", "main") or (parent >= 0 and inside[parent]):
            inside[i] = True
    blocks, last = [], None
    for index, piece, block in walk.texts:
        if inside[index] and not elements[index][3] and index not in skipped:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(piece)
    out = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(b for b in out if b)


def _extract(batches):
    for batch in batches:
        page, fixed = (batch.column(i).to_pylist() for i in (2, 3))
        texts = [main_text(p or "", f or ()) for p, f in zip(page, fixed, strict=True)]
        n = np.array([len(t) for t in texts], np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(n)],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    A null or empty page has the empty text; a page without a URL belongs to the host without a name; repeated rows have a row each;
    an empty table gives no rows; further columns are not looked at.
    """
    pages = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    # written first, so that Spark knows its size: a small one goes to the pages, not the pages to it
    deduced = materialize(templates(pages), "html-templates").withColumnRenamed("host", "__host__")
    return (
        _with_host(pages, "url")
        .join(deduced, "__host__", "left")
        .select("page_id", "url", "html", "fixed")
        .mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
    )
