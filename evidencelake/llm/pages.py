"""Main text of web pages by template deduction from equivalence classes of tokens.

Method: a page is a sequence of tokens, each with its role (the containers it
stands in): tags, the words of short blocks (told apart by the word before), and
long blocks as a whole. Within a host, tokens of one container role with the same
occurrence vector (how often they occur on each page) form an equivalence class,
so classes nest into the host's template as their containers do. A class must be
frequent (on ``SUPPORT`` of the host's pages, and of its distinct pages) and is
valid as far as it is ordered and nested: a second reading of the pages checks
that a token has the same place in every repetition of its class, and that it
stands in the same gaps of the class around it (the largest of the nearest
container around that is on as many pages), on every page. Tokens that move are
not template. A third reading finds the slots of every page: what stands in the
gaps of the template's classes.

The main text is made of slots. Where some stand in ``article`` or ``main``
elements, it is all of these elements, recurring lines too; such an element
without a slot is template, and is read only if the page's others have none
either (a page whose article is copied all over its host). Without such elements
it is the slots of every container, with the recurring lines inside the article:
in a container that holds slots those from the first slot or heading to the last
slot, lists and tables counting as what is around them. Containers whose element
or class says menu, footer, advert and so on are left out.

A vector is not stored but summarised by a sum of hashes of (page, count), in two
halves that can't overflow, the number of pages and a 64-bit mask of page
contents. These merge in any order, and copies of a page can't cancel, so
statistics over all pages are one aggregation with partial sums, and a host with
a third of all pages needs no task of its own. Copies of one page set one bit of
the mask, so a copied article does not pass for a template. Pages are never
shuffled while templates take at most ``MAX_TEMPLATES`` bytes; beyond that they
are joined by host.

Defined results: null html is empty, a null url a host of its own; pages
without text give an empty string; a host of fewer than ``MIN_PAGES`` pages
has an empty template, so each of its pages is one slot; repeated rows each get a row; pages of any length are
read whole; an empty table gives no rows; columns other than those named are not
read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import materialise, pick, slices

SUPPORT, MIN_PAGES, MIN_CLASS, LONG_BLOCK = 0.8, 8, 2, 30
MAX_TEMPLATES, MAX_HOSTS = 32 << 20, 100_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Block elements that close themselves where the next begins; their content belongs to the container around.
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption blockquote pre figcaption figure hr address option".split())
_DROP = frozenset("head script style noscript template nav header footer aside form button select option textarea input iframe object svg canvas menu dialog title noembed noframes xmp".split())
_NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adslot|banner|sponsor\w*|promo\w*|side-?bar|menu|nav\w*|breadcrumbs?|cookies?|notices?|consent|gdpr|comments?|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|sign-up|login|popup|modal|overlay|footer|foot|header|masthead|widget|toolbar|pagination|pager|skip-link|disclaimer|alert)(?:$|[\s_-])", re.I)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
_HOST = re.compile(r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")

#: Lists and tables belong to the text of the container around.
_PARTS = frozenset("ul ol dl table".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

STATS = "host string, token long, place long, host_row boolean, pages long, low long, high long, mask long"
RANKS = "host string, token long, class int, around int, least long, most long, fewest long, widest long"


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _dropped(name: str, attrs: str, inside_article: bool) -> bool:
    if name in _DROP and not (name == "header" and inside_article):
        return True
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and _NAMED.search(value):
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return name not in ("html", "body")
    return False


def _label(name: str, attrs: str) -> str:
    for m in _ATTR.finditer(attrs):
        if m[1].lower() == "class":
            return f"{name}.{m[2] or m[3] or m[4] or ''}"
    return name


class Block:
    __slots__ = ("path", "leaf", "dropped", "main", "text", "at")

    def __init__(self, path, leaf, dropped, main, text, at):
        self.path, self.leaf, self.dropped, self.main, self.text, self.at = path, leaf, dropped, main, text, at  # main: which article, or 0; at: tags before it


def blocks(page: str | None) -> tuple[list[Block], list[tuple[str, str]]]:
    """Blocks of text with their role, in page order; and (role, tag) of every block-level tag."""
    out: list[Block] = []
    tags: list[tuple[str, str]] = []
    if not page:
        return out, tags
    # name, path, dropped, the outermost article around or 0; of elements that close themselves only those to be dropped
    stack: list[tuple[str, str, bool, int]] = []
    leaf, buf, at, n = "", [], 0, len(page)

    def flush() -> None:
        text = html_lib.unescape("".join(buf)) if buf else ""
        buf.clear()
        text = " ".join(text.split())
        if text:
            _, path, dropped, main = stack[-1] if stack else ("", "", False, 0)
            out.append(Block(path, leaf, dropped, main, text, len(tags)))

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            buf.append(page[at:])
            break
        if m.start() > at:
            buf.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                buf.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        closing, name, attrs = m[1], m[2].lower(), m[3] or ""
        if name in _INLINE:
            continue
        if name == "br":
            buf.append(" ")
            continue
        if not closing and name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.start() if end else n
            close = page.find(">", at) if end else -1
            at = close + 1 if close >= 0 else n
            if name in ("title", "textarea", "noscript", "iframe"):
                flush()
            continue
        flush()
        path = stack[-1][1] if stack else ""
        tags.append((path, closing + name))
        if name in _VOID:
            continue
        if not closing and stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in _LEAF)):
            stack.pop()  # its end tag may be left out
            path = stack[-1][1] if stack else ""
        inside, dropped = (stack[-1][3], stack[-1][2]) if stack else (0, False)
        leaf = "" if closing or name not in _LEAF else name
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if name in _LEAF and stack[i][0] not in _LEAF:
                    break
            continue
        if name in _LEAF and not _dropped(name, attrs, inside):
            continue
        stack.append((name, f"{path}/{_label(name, attrs)}", dropped or _dropped(name, attrs, inside), inside or (len(tags) if name in ("article", "main") else 0)))
    flush()
    return out, tags


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


def _text_tokens(b: Block) -> list[int]:
    words = b.text.split(" ")
    if len(words) > LONG_BLOCK:
        return [_hash("b", b.path, b.leaf, b.text)]
    role = f"w\x1f{b.path}\x1f{b.leaf}\x1f"
    return [xxhash.xxh64_intdigest(f"{role}{w}\x1f{before}") - (1 << 63) for before, w in zip(["", *words], words)]


def _in_order(found: list[Block], tags: list[tuple[str, str]]):
    """(token, path, block or -1) of a page, as they stand."""
    at, known = 0, {}
    for i, b in enumerate([*found, None]):
        for t in tags[at : b.at if b else None]:
            if (token := known.get(t)) is None:
                token = known[t] = _hash("t", *t)
            yield token, t[0], -1
        if b:
            at = b.at
            for token in _text_tokens(b):
                yield token, b.path, i


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _stats(batches):
    for b in slices(batches, "html"):
        held: dict[str, dict[tuple[int, int, bool], list[int]]] = {}
        for key, url, page in zip(b.column("page_key").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            of = held.setdefault(host_of(url), {})
            seen: Counter = Counter()
            paths = {}
            for t, p, _ in _in_order(*blocks(page)):
                seen[t] += 1
                paths[t] = p
            bit = 1 << (key % 64)
            places = {p: _hash("p", p) for p in set(paths.values())}
            vectors: dict[int, int] = {}
            for t, c in [(None, 1), *seen.items()]:
                if (v := vectors.get(c)) is None:
                    v = vectors[c] = xxhash.xxh64_intdigest(f"{key}/{c}")
                k = (0, 0, True) if t is None else (t, places[paths[t]], False)
                old = of.get(k)
                if old is None:
                    of[k] = [1, v & 0xFFFFFFFF, v >> 32, bit]
                else:
                    old[0] += 1
                    old[1] += v & 0xFFFFFFFF
                    old[2] += v >> 32
                    old[3] |= bit
        keys = [k for of in held.values() for k in of]
        vals = [v for of in held.values() for v in of.values()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([h for h, of in held.items() for _ in of], pa.string()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                pa.array([k[2] for k in keys], pa.bool_()), *(pa.array([v[i] for v in vals], pa.int64()) for i in range(3)), pa.array([_signed(v[3]) for v in vals], pa.int64()),
            ],
            names=["host", "token", "place", "host_row", "pages", "low", "high", "mask"],
        )


class _Classes:
    """The classes of a host, as (place, pages, tokens), and which of them stands around which."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.of = {t: c for c, r in enumerate(rows) for t in r["tokens"]}
        self.size = [len(r["tokens"]) for r in rows]
        self.at: dict[int, list[int]] = {}
        for c in sorted(range(len(rows)), key=lambda c: (-rows[c]["pages"], -self.size[c], min(rows[c]["tokens"]))):
            self.at.setdefault(rows[c]["place"], []).append(c)
        self.known: dict[int, int] = {}

    def around(self, c: int, path: str) -> int:
        """The class around class ``c``, whose place is ``path``; -1: none."""
        if c not in self.known:
            above = (q for p in _above(path)[1:] for q in self.at.get(_hash("p", p), ()) if self.rows[q]["pages"] >= self.rows[c]["pages"])
            self.known[c] = next(above, -1)
        return self.known[c]


def _ranks(batches):
    """Of each token the least and greatest place in the repetitions of its class, and the least and greatest set of gaps of the class around, over the pages that have it."""
    for b in slices(batches, "html"):
        sets: dict[str, _Classes] = {}
        held: dict[tuple[str, int], list[int]] = {}
        lists = b.column("classes")
        for i, (host, page) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)):
            if host not in sets:
                sets[host] = _Classes(lists[i].as_py())
            own = sets[host]
            met = [0] * len(own.size)
            gaps: dict[int, int] = {}
            for t, path, _ in _in_order(*blocks(page)):
                c = own.of.get(t)
                if c is None:
                    continue
                rank = met[c] % own.size[c]
                met[c] += 1
                q = own.around(c, path)
                old = held.get((host, t))
                if old is None:
                    held[host, t] = [c, q, rank, rank, 1 << 62, -1]
                elif rank < old[2]:
                    old[2] = rank
                elif rank > old[3]:
                    old[3] = rank
                if q >= 0:
                    gaps[t] = gaps.get(t, 0) | 1 << met[q] % own.size[q] % 62
            for t, g in gaps.items():
                old = held[host, t]
                if met[old[1]]:
                    old[4], old[5] = min(old[4], g), max(old[5], g)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()), *(pa.array([v[i] for v in held.values()], pa.int32()) for i in (0, 1)),
                *(pa.array([v[i] for v in held.values()], pa.int64()) for i in (2, 3, 4, 5)),
            ],
            names=["host", "token", "class", "around", "least", "most", "fewest", "widest"],
        )


def valid(rows: list[dict]) -> list[list[int]]:
    """The classes of a host as far as they are ordered and nested, tokens in order."""
    moving = {r["class"] for r in rows if r["least"] < r["most"]}
    out: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        astray = r["fewest"] < r["widest"] and r["around"] not in moving  # the gaps of a class that moves say nothing
        if r["least"] == r["most"] and not astray:
            out.setdefault(r["class"], []).append((r["least"], r["token"]))
    return [[t for _, t in sorted(out[c])] for c in sorted(out)]


def _valid(batches):
    for b in batches:
        found = [valid(rows) for rows in b.column("rows").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(found, pa.list_(pa.list_(pa.int64())))], names=["host", "template"])


def _by_host(pages: DataFrame, found: DataFrame, lists: str, how: str) -> DataFrame:
    """``pages`` with the lists of tokens of their host, broadcast while they are small."""
    held = F.flatten(F.col("classes.tokens") if lists == "classes" else F.col(lists))
    size = found.agg(F.coalesce(F.sum(F.size(held) * 8 + F.size(lists) * 32 + 64), F.lit(0))).first()[0]
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
    return pages.withColumn("host", host).join(F.broadcast(found) if size <= MAX_TEMPLATES else found, "host", how)


def templates(pages: DataFrame) -> DataFrame:
    """host, template: its valid classes as lists of tokens in order. ``pages``: page_key, url, html."""
    sums = [F.sum(c).alias(c) for c in ("pages", "low", "high")]
    s = pages.mapInArrow(_stats, STATS).groupBy("host", "token", "place", "host_row").agg(*sums, F.bit_or("mask").alias("mask"))
    s = materialise(s.filter((F.col("pages") > 1) | F.col("host_row")), "tokens")
    hosts = s.filter("host_row").select("host", F.col("pages").alias("n"), F.bit_count("mask").alias("bits"))
    rare = (F.col("pages") < SUPPORT * F.col("n")) | (F.bit_count("mask") < F.greatest(F.lit(2), SUPPORT * F.col("bits")))
    # tokens of a large host stay where they are until the rare ones, nearly all, are gone
    few = F.broadcast(hosts) if hosts.count() <= MAX_HOSTS else hosts
    tokens = s.filter(~F.col("host_row")).join(few, "host").filter((F.col("n") >= MIN_PAGES) & ~rare)
    classes = tokens.groupBy("host", "place", "low", "high", "pages").agg(F.sort_array(F.collect_list("token")).alias("tokens")).filter(F.size("tokens") >= MIN_CLASS)
    classes = materialise(classes.groupBy("host").agg(F.collect_list(F.struct("place", "pages", "tokens")).alias("classes")), "classes")
    ranks = _by_host(pages, classes, "classes", "inner").select("host", "html", "classes").mapInArrow(_ranks, RANKS)
    ends = [F.min("least").alias("least"), F.max("most").alias("most"), F.min("fewest").alias("fewest"), F.max("widest").alias("widest")]
    ranks = ranks.groupBy("host", "token", "class", "around").agg(*ends)
    rows = F.collect_list(F.struct("token", "class", "around", "least", "most", "fewest", "widest")).alias("rows")
    return ranks.groupBy("host").agg(rows).mapInArrow(_valid, "host string, template array<array<bigint>>")


def places(template: list[list[int]]) -> dict[int, tuple[int, int, int]]:
    """Of each token of a template its class, its place there and the size of the class."""
    return {t: (c, i, len(ts)) for c, ts in enumerate(template) for i, t in enumerate(ts)}


def slots(found: list[Block], tags: list[tuple[str, str]], template: dict) -> list[tuple[int, int] | None]:
    """Of each block the slot it fills: the innermost open class and the place there before its first own token; (-1, 0) outside all; None: it is template."""
    out: list[tuple[int, int] | None] = [None] * len(found)
    if not template:
        return [(-1, 0)] * len(found)
    inside: list[tuple[int, int]] = []
    for t, _, i in _in_order(found, tags):
        at = template.get(t)
        if at is None:
            if i >= 0 and out[i] is None:
                out[i] = inside[-1] if inside else (-1, 0)
            continue
        c, place, size = at
        for k in range(len(inside) - 1, -1, -1):
            if inside[k][0] == c:
                del inside[k:]
                break
        if place < size - 1:
            inside.append((c, place))
    return out


def main_text(page: str | None, template: dict | frozenset, main: int | None = None) -> str:
    """``template``: the ``places`` of the host's. ``main``: the hash of the only container to read where there is no article, if the caller knows it."""
    every, tags = blocks(page)
    filled = [(b, s is not None) for b, s in zip(every, slots(every, tags, template), strict=True) if not b.dropped]
    articles = {b.main for b, own in filled if b.main and own} or {b.main for b, _ in filled if b.main}
    if articles:
        return "\n".join(b.text for b, _ in filled if b.main in articles)
    if main is not None:
        filled = [(b, own) for b, own in filled if any(_hash("p", p) == main for p in _above(b.path))]
    found = [b for b, _ in filled]
    slot = [own or b.leaf == "h1" for b, own in filled]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    for i, b in enumerate(found):
        if slot[i] or b.leaf in _HEADINGS:
            for p in _above(b.path):
                first.setdefault(p, i)
                if slot[i]:
                    last[p] = i
    return "\n".join(b.text for i, b in enumerate(found) if slot[i] or first.get(p := _around(b.path), i + 1) <= i < last.get(p, -1))


def _around(path: str) -> str:
    """The container without the lists and tables in it that hold the text."""
    while path.rpartition("/")[2].partition(".")[0] in _PARTS:
        path = path.rpartition("/")[0]
    return path


def _above(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(len(parts), 0, -1)]


def _extract(batches):
    for b in slices(batches, "html"):
        sets: dict[str, dict] = {}
        out = []
        hosts, lists = b.column("host").to_pylist(), b.column("template")
        for i, page in enumerate(b.column("html").to_pylist()):
            h = hosts[i]
            if h not in sets:
                sets[h] = places(lists[i].as_py() or [])
            out.append(main_text(page, sets[h]))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, url, text."""
    p = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("page_id", F.col("page_id").cast("long"))
    found = materialise(templates(p.select(F.xxhash64("html").alias("page_key"), "url", "html")), "templates")
    joined = _by_host(p, found, "template", "left").select("page_id", "url", "html", "host", "template")
    return joined.mapInArrow(_extract, "page_id long, url string, text string")
