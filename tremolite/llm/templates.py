"""Main text of web pages: equivalence classes of tokens that share occurrence vectors over a host's pages make its template."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged

#: Fixed values of HTML: elements without content, with raw content, that stand within a line, and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: What an element ends if it opens inside, and within what.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
#: What holds no article text: elements, roles, and words of a class or id.
APART = frozenset("head nav header footer aside form script style noscript template button select textarea title iframe svg math canvas object audio video dialog menu".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
APART_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion menu nav navbar navigation breadcrumb breadcrumbs header footer masthead sidebar notice notices cookie cookies consent gdpr popup modal newsletter subscribe signup login pagination pager share sharing social".split()
)
#: Elements whose class says nothing of what they hold.
ALWAYS = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
MAIN = ("article", "main")

TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">]++)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[a-z]+")

#: A class is in the template if its tokens stand on so many of the host's pages, and the host has so many pages.
LEAST_SHARE, LEAST_PAGES = 0.5, 3
#: Text is a template's own if all of at least so many pages have it, each as often.
SAME_PAGES = 10
#: Elements further down share the path of the one there; longer names of an element are hashed.
DEEPEST, LONGEST_LABEL = 100, 80


@lru_cache(1 << 12)
def _tag(whole: str) -> tuple[str, str, bool, str] | None:
    """(kind, name, apart, label) of a tag: kind is ``open`` or ``close``; None for what is no tag."""
    m = TAG.match(whole)
    name = (m[2] or m[5] or "").lower()
    if not name:
        return None
    if m[1] or m[4]:
        return "close", name, False, ""
    given = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m[3] or m[6] or "")}
    named = sorted(set(given.get("class", "").split())) + ([f"#{given['id']}"] if given.get("id") else [])
    said = set(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(named)).lower()))
    words = COMMENT_WORDS if name == "article" else APART_WORDS
    apart = name in APART or given.get("role", "").lower() in APART_ROLES or (name not in ALWAYS and bool(said & words))
    label = ".".join([name, *named])
    return "open", name, apart, label if len(label) <= LONGEST_LABEL else f"{name[:LONGEST_LABEL]}.{hashlib.blake2b(label.encode(), digest_size=8).hexdigest()}"


@lru_cache(1 << 13)
def _token(mark: str, path: str) -> int:
    """A token's number: odd if it is text, even if it is a tag."""
    number = int.from_bytes(hashlib.blake2b(f"{mark}{path}".encode(), digest_size=8).digest(), "little", signed=True)
    return number | 1 if mark == "=" else number & ~1


class Page:
    """A page's tokens in order, its blocks of text, and the paths of its elements.

    Tags within a line are no tokens and don't end a block. Tokens are told apart by the path of elements around them, as
    equal tags play different parts in different places. ``blocks`` has (text, path, main, token): main if an article or
    main element is around it. Blocks apart, such as menus, are tokens too, but have no text.
    """

    def __init__(self, source: str) -> None:
        self.tokens: list[int] = []
        self.blocks: list[tuple[str, str, bool, int]] = []
        self.chars: dict[str, int] = {}  # of the text inside each path
        self._stack: list[tuple[str, str, bool, bool]] = []  # name, path, apart, main
        self._text: list[str] = []
        self._names: Counter[str] = Counter()  # of the open elements
        at = 0
        end = len(source)
        while at < end:
            m = TAG.search(source, at)
            if m is None:
                self._text.append(source[at:])
                break
            if m.start() > at:
                self._text.append(source[at : m.start()])
            at = m.end()
            tag = _tag(m[0]) if len(m[0]) < 400 else _tag.__wrapped__(m[0])
            if tag is None:
                continue
            kind, name, apart, label = tag
            if kind == "close":
                self._close(name)
            elif name in RAW:  # all up to its end tag
                close = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(source, at)
                self._open(name, True, label)
                at = close.end() if close else end
                self._close(name)
            else:
                self._open(name, apart, label)
        self._flush()
        while self._stack:
            self._pop()

    def _flush(self) -> None:
        if not self._text:
            return
        text = "".join(self._text)
        self._text = []
        if not text or text.isspace():
            return
        text = " ".join(html.unescape(text).split())
        if not text:
            return
        _, path, apart, main = self._stack[-1] if self._stack else ("", "", False, False)
        token = _token.__wrapped__("=", f"{path}\n{text}")
        self.tokens.append(token)
        if not apart:
            self.blocks.append((text, path, main, token))
            self.chars[path] = self.chars.get(path, 0) + len(text)

    def _pop(self) -> None:
        name, path, _, _ = self._stack.pop()
        self._names[name] -= 1
        if name not in INLINE:
            self.tokens.append(_token(">", path))

    def _close(self, name: str) -> None:
        if name == "br":
            self._text.append(" ")
            return
        for n in range(len(self._stack) - 1, -1, -1) if self._names[name] else ():
            if self._stack[n][0] == name:
                if name not in INLINE or self._stack[n][2]:
                    self._flush()
                if name in INLINE:  # blocks opened inside stay open
                    del self._stack[n]
                    self._names[name] -= 1
                while len(self._stack) > n and name not in INLINE:
                    self._pop()
                return

    def _open(self, name: str, apart: bool, label: str) -> None:
        if name in INLINE and name in VOID:
            self._text.append(" " if name == "br" else "")
            return
        if name not in INLINE or apart:
            self._flush()
        if name in ENDS_P and self._names["p"]:
            self._close("p")
        elif name in SIBLINGS:
            ends, within = SIBLINGS[name]
            for e in reversed(self._stack):
                if e[0] in ends:
                    self._close(e[0])
                    break
                if e[0] in within:
                    break
        _, path, was_apart, main = self._stack[-1] if self._stack else ("", "", False, False)
        if name not in INLINE:
            if len(self._stack) < DEEPEST:
                path = f"{path}/{label}"
            self.tokens.append(_token("<", path))
        if name not in VOID:
            self._names[name] += 1
            self._stack.append((name, path, apart or was_apart, main or name in MAIN))


def _host(url: str | None) -> str:
    return re.sub(r"^(?:[^/?#:]*:)?//", "", url or "").split("/")[0].split("?")[0].split("#")[0].lower()


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, tokens, paths = [], [], []
        for url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page = Page(source or "")
            hosts.append(_host(url))
            tokens.append(np.array([_token("", ""), *page.tokens], "<i8").tobytes())
            held: dict[str, int] = {}  # a path's text is its own and that of the elements inside
            for path, n in page.chars.items():
                for end in (m.start() for m in re.finditer("/|$", path) if m.start()):
                    held[path[:end]] = held.get(path[:end], 0) + n
            paths.append([{"path": p, "token": _token("<", p), "chars": n} for p, n in held.items()])
        yield pa.record_batch([pa.array(hosts), pa.array(tokens, pa.binary()), pa.array(paths, pa.list_(pa.struct([("path", pa.string()), ("token", pa.int64()), ("chars", pa.int64())])))], names=["host", "tokens", "paths"])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each of 64 bits spread over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page and token: a vector's place as two numbers of 31 bits, to be summed."""
    for batch in batches:
        hosts, found, marks, counts = [], [], [], []
        for host, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            token, n = np.unique(np.frombuffer(tokens, "<i8"), return_counts=True)
            page = np.uint64(int.from_bytes(hashlib.blake2b(tokens, digest_size=8).digest(), "little"))
            hosts += [host] * len(token)
            found.append(token)
            marks.append(_mixed(_mixed(n.astype(np.uint64)) ^ page))
            counts.append(n)
        if found:
            mark = np.concatenate(marks)
            low, high = (mark & np.uint64(0x7FFFFFFF)).astype(np.int64), (mark >> np.uint64(33)).astype(np.int64)
            yield pa.record_batch([pa.array(hosts), pa.array(np.concatenate(found)), pa.array(low), pa.array(high), pa.array(np.concatenate(counts))], names=["host", "token", "low", "high", "n"])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and class of its host's: the order of the class's tokens, in which slot of which class it first stands,
    and whether it is in order throughout and its occurrences nest."""
    names = ["host", "class", "parent", "slot", "order", "nested"]
    for batch in batches:
        out: dict[str, list] = {n: [] for n in names}
        for r in batch.to_pylist():
            of = {t["token"]: t["class"] for t in r["template"] or []}
            order: dict[int, list[int]] = {}
            seen = [(of[t], t) for t in np.frombuffer(r["tokens"], "<i8").tolist() if t in of]
            for c, t in seen:
                if t not in (o := order.setdefault(c, [])):
                    o.append(t)
            bad: set[int] = set()
            within: dict[int, tuple[int, int]] = {}
            stack: list[list[int]] = []  # class, tokens read
            for c, t in seen:
                while stack and stack[-1][1] == len(order[stack[-1][0]]):
                    stack.pop()
                if t == order[c][0]:
                    within.setdefault(c, (stack[-1][0], stack[-1][1]) if stack else (-1, 0))
                    if any(s[0] == c for s in stack):  # the one before isn't complete
                        bad.add(c)
                    stack.append([c, 1])
                elif any(s[0] == c for s in stack):
                    while stack[-1][0] != c:  # these reach across the class around them
                        bad.add(stack.pop()[0])
                    if order[c][stack[-1][1]] == t:
                        stack[-1][1] += 1
                    else:
                        bad.add(c)
                else:
                    bad.add(c)
            for c, o in order.items():
                for n, v in zip(names, (r["host"], c, *within.get(c, (-1, 0)), hashlib.blake2b(np.array(o, "<i8").tobytes(), digest_size=8).hexdigest(), c not in bad), strict=True):
                    out[n].append(v)
        kinds = {"host": pa.string(), "class": pa.int64(), "parent": pa.int64(), "slot": pa.int64(), "order": pa.string(), "nested": pa.bool_()}
        yield pa.record_batch([pa.array(v, kinds[n]) for n, v in out.items()], names=names)


def deduce_templates(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, pages, main, own, classes): the template of each host; staged.

    A token's occurrence vector (how often it stands on each page) is known by a sum of hashes, so that tasks add up parts
    of it and no task holds a host. Tags of one vector are a class, and each text is one. Classes on at least half of a host's pages are
    compared with each page's order: valid ones keep one order on all pages, and nest in each other's slots. A host's
    template has as many tokens as two pages on average at most.

    ``classes`` are the valid ones with their parent and slot, ``own`` the text tokens that are the template's on all pages,
    ``main`` the path of the template's element that holds the article: the first article or main element, else the deepest
    one that stands once on a page and holds half of the text.
    """
    t = staged(pages.select(F.col(url).cast("string"), F.col(source).cast("string")).mapInArrow(_tokenised, "host string, tokens binary, paths array<struct<path:string,token:long,chars:long>>"), "tokens")
    v = t.select("host", "tokens").mapInArrow(_vectors, "host string, token long, low long, high long, n long")
    v = v.groupBy("host", "token").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.count("*").alias("on"), F.max("n").alias("most"))
    n_pages = t.groupBy("host").agg(F.count("*").alias("pages"))
    often = v.join(n_pages, "host").filter((F.col("on") >= LEAST_SHARE * F.col("pages")) & (F.col("pages") >= LEAST_PAGES))
    # a text stands in a slot and spans nothing, so it is a class of its own
    vector = F.struct("on", "low", "high", F.when(F.col("token") % 2 != 0, F.col("token")).alias("text"))
    often = often.withColumn("class", F.dense_rank().over(Window.partitionBy("host").orderBy(F.desc("on"), vector)).cast("long"))
    tokens = staged(often.select("host", "pages", "token", "on", "most", "class"), "classes")
    per_host = tokens.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("template"))
    orders = t.select("host", "tokens").join(per_host, "host").mapInArrow(_orders, "host string, class long, parent long, slot long, order string, nested boolean")
    orders = orders.groupBy("host", "class").agg(
        (F.bool_and("nested") & (F.min("order") == F.max("order"))).alias("valid"), F.when(F.min("parent") == F.max("parent"), F.min("parent")).alias("parent"), F.when(F.min("slot") == F.max("slot"), F.min("slot")).alias("slot"),
    )
    valid = tokens.join(orders.filter("valid").drop("valid"), ["host", "class"])
    one = valid.groupBy("host", "class").agg(F.first("parent").alias("parent"), F.first("slot").alias("slot"), F.sort_array(F.collect_list("token")).alias("tokens"), F.min("on").alias("on"))
    one = one.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("class", "parent", "slot", "on", "tokens"))).alias("classes"))
    one = tokens.groupBy("host").agg(F.first("pages").alias("pages")).join(one, "host", "left").withColumn("classes", F.coalesce("classes", F.array()))
    own = valid.filter((F.col("token") % 2 != 0) & (F.col("on") == F.col("pages")) & (F.col("pages") >= SAME_PAGES)).groupBy("host").agg(F.collect_list("token").alias("own"))
    # only elements of the template can be the main one
    held = t.select("host", F.inline("paths")).groupBy("host", "path", "token").agg(F.sum("chars").alias("chars")).join(valid.select("host", "token", "most"), ["host", "token"])
    last = F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), 1)
    held = held.withColumns({"named": last.isin(*MAIN), "depth": F.size(F.split("path", "/")), "all": F.max("chars").over(Window.partitionBy("host"))}).filter("named OR most = 1 AND 2 * chars >= all")
    main = held.groupBy("host").agg(F.max_by("path", F.struct("named", F.when(F.col("named"), -F.col("depth")).otherwise(F.col("depth")), "chars", "path")).alias("main"))
    out = staged(one.join(main, "host", "left").join(own, "host", "left").select("host", "pages", "main", "own", "classes"), "templates")
    discard(t, tokens)
    return out


def main_blocks(page: Page, main: str | None, own: frozenset[int]) -> list[str]:
    """The blocks of a page's article: those inside the template's main element if that is an article or main element; if
    not, or if the page has none, those inside such elements of its own. Of pages without any, those inside the template's
    main element, or all that aren't apart; there, text that is the template's own goes."""
    inside = [b for b in page.blocks if main and (b[1] == main or b[1].startswith(f"{main}/"))]
    named = inside if main and main.rpartition("/")[2].partition(".")[0] in MAIN else []
    if named := named or [b for b in page.blocks if b[2]]:
        return [b[0] for b in named]
    return [b[0] for b in inside or page.blocks if b[3] not in own]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.select(["page_id", "url", "html"])
        texts = []
        for source, main, own in zip(*(batch.column(c).to_pylist() for c in ("html", "main", "own")), strict=True):
            texts.append("\n\n".join(main_blocks(Page(source or ""), main, frozenset(own or ()))))
        yield pa.record_batch([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page, whose blocks are apart by an empty line.

    Null html: empty text. Null url: the host without a name. Repeated rows have a row each and count as often in their host's
    template. A host of one page or two has no template: its pages' own elements decide. No page, no row. Other columns aren't read.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    templates = deduce_templates(p).select("host", "main", "own")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:(?:[^/?#:]*:)?//)?([^/?#]*)", 1))
    return p.withColumn("host", host).join(templates, "host", "left").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
