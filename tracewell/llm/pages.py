"""HTML extraction by equivalence-class template deduction.

1. Each page is parsed once into tokens (the start and end of each element, told apart by its path, and each block of
   text with its path) and its blocks of text; what follows works on these.
2. Over the pages of a host every token has an occurrence vector (how often it stands in each page), which is gathered
   as a sum of keyed hashes, so that no task ever holds a host's pages. Tokens with equal vectors that stand in at least
   half of the pages form an equivalence class.
3. A class of two or more tokens is valid if it is ordered (in every page its tokens come in one order, over and over)
   and nested (its instances lie within one gap of any other class's instances, never across). The valid classes are
   the host's template.
4. What stands between two tokens of an instance is a slot. Blocks of text that are no token of the template fill slots;
   a field is a slot and an element's path in it, and its role is what the host's pages have there in sum: furniture,
   main text or links.
5. The text of the main fields is what is returned. Text that the template says (the element always holds it) is none,
   nor is what the roles or an element's own marks tell to be furniture; where a page has a main element or an article,
   only what stands in it is main. A page whose main text would be nothing but template text is a copy of its host's
   others and keeps it.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import PIECE_BYTES, U64, arrow_map, cut, mix

#: A class or field needs this share of a host's pages and so many pages; templates are broadcast up to so many hosts and tokens.
SHARE, LEAST_PAGES, BROADCAST_HOSTS, BROADCAST_TOKENS = 0.5, 3, 20_000, 1_000_000
#: What is known of a block of text, and of a field.
FURNISHED, IN_MAIN, IN_ARTICLE, LISTED, HEADED = 1, 2, 4, 8, 16
IS_FURNITURE, IS_MAIN, IS_LINKS = 1, 2, 4

# Fixed values of HTML: elements without content, with raw content, inside a line, and those whose start ends an open one.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE = set("head nav footer aside form script style noscript template button select svg iframe dialog menu object canvas textarea title".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|alert|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|widget\w*|related|recommend\w*|shar(?:e|ing)|social|comment\w*|respond|disqus\w*|repl(?:y|ies)|footer|header|masthead|newsletter|subscri\w*|signup|login|popup|modal|overlay|toolbar|pagination|pager|skip\w*|copyright|disclaimer)(?:$|[\s_-])", re.I)
# In an article only whole names tell furniture; parts of names need a template text or links to confirm them.
_AD, _NEWS = r"ads?|advert(?:s|isements?|ising)?|adsense", r"newsletter|subscribe|signup"
WHOLE = re.compile(rf"(?:^|\s)(?:(?:{_AD})(?:[_-](?:slot|container|wrapper|unit|banner|box|block))?|sponsored|promo|nav|navbar|navigation|breadcrumbs?|sidebar|widget|(?:post|entry)[_-](?:nav|navigation|share|comments)|related(?:[_-](?:posts?|articles?|stories|links|content))?|(?:share|sharing|social)(?:[_-](?:buttons?|links?|icons?|bar|share))?|comments?(?:[_-](?:area|list|section|body|content|wrapper|thread|form|respond))?|disqus(?:_thread)?|(?:{_NEWS})(?:[_-](?:signup|form|box))?|toolbar|pagination|pager)(?:$|\s)", re.I)
PARTS = re.compile(rf"(?:^|[\s_-])(?:{_AD}|sponsor(?:s|ed)?|promo(?:s|ted|tions?)?|banners?|cookies?|consent|gdpr|notices?|alert|nav|navbar|navigation|menus?|breadcrumbs?|sidebar|widgets?|related|recommend(?:ed|ations?)|shar(?:e|ing)|social|comments?|respond|disqus|repl(?:y|ies)|footer|{_NEWS}|subscription|login|popup|modal|overlay|toolbar|pagination|pager|skip|copyright|disclaimer)(?:$|[\s_-])", re.I)
# Inside a line only an advert's own names tell it.
INLINE_AD = re.compile(rf"(?:^|\s)(?:(?:{_AD})(?:[_-](?:slot|container|wrapper|unit|banner|box|block|label|text|link))?|sponsored|promo)(?:$|\s)", re.I)
LISTS, HEADINGS = set("ul ol li td dl".split()), set("h1 h2 h3 h4 h5 h6".split())
SLUGGED = set("section h1 h2 h3 h4 h5 h6".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<[a-zA-Z/!?][^>]*+\Z", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![^\s])hidden(?![^\s/>])")


def _h(*parts: object) -> int:
    """62 bits."""
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 2


@lru_cache(maxsize=1 << 15)
def _path(parent: int, mark: str) -> int:
    """The name of a path: that of its parent's and its own mark, so a path of any depth costs the same."""
    return _h("path", parent, mark)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


class _Open:
    __slots__ = ("flags", "main", "name", "path", "suspect")

    def __init__(self, name: str, path: int, flags: int, suspect: int = 0) -> None:
        self.name, self.path, self.flags, self.suspect = name, path, flags, suspect
        self.main = bool(flags & (IN_MAIN | IN_ARTICLE))


def _attributes(text: str) -> dict[str, str]:
    out = {}
    for m in ATTRIBUTE.finditer(text):
        key = (m[1] or "hidden").lower()
        out.setdefault(key, m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "")
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I))


def _is_furniture(name: str, attributes: dict[str, str], parent: _Open) -> bool:
    if name in FURNITURE or (name == "header" and not parent.main):
        return True
    if name in ("html", "body", "article", "main"):
        return False
    if attributes.get("role", "").lower() in ROLES or _hidden(attributes):
        return True
    return _named(WHOLE if parent.main else NAMES, name, attributes, parent)


def _named(names: re.Pattern, name: str, attributes: dict[str, str], parent: _Open) -> bool:
    """Whether the class or id says so; in an article the ids of sections and headings are slugs of their titles."""
    return bool(names.search(attributes.get("class", "")) or (not (parent.main and name in SLUGGED) and names.search(attributes.get("id", ""))))


def parse(html: str) -> tuple[list[int], list[tuple[int, str, int, int, int, int]]]:
    """Tokens in page order, and the blocks of text: number of its token, text, flags, characters in links, number of the
    element of an article that may be furniture, and token of its element's start."""
    root = _Open("", 0, 0)
    stack, tokens, out = [root], [], []
    opened: dict[str, int] = {}
    text: list[str] = []
    linked, in_link, suspects = 0, False, 0
    hidden: list[str] = []  # open elements of a line that are hidden or adverts

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                top = stack[-1]
                out.append((len(tokens), joined, top.flags, linked, top.suspect, top.path << 1))
                tokens.append(_h("text", top.path, joined) << 1)
            text.clear()
        linked = 0

    def close(k: int) -> None:
        for x in reversed(stack[k:]):
            opened[x.name] -= 1
            tokens.append(x.path << 1 | 1)
        del stack[k:]

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            raw = html_lib.unescape(raw) if "&" in raw else raw
            text.append(raw)
            linked += len(raw.strip()) if in_link else 0

    at, n = 0, len(html)
    while at < n:
        i = html.find("<", at)
        if i < 0:
            add(html[at:])
            break
        if i > at:
            add(html[at:i])
        m = TAG.match(html, i)
        if m is None or (m[2] is None and m[0][1:2].isalpha()):
            loose = LOOSE.match(html, i)
            if loose is None:
                if m is not None:
                    break
                add("<")
                at = i + 1
                continue
            m = loose
        at = m.end()
        if m.lastindex is None or m[2] is None:
            continue
        closing, name = m[1] == "/", m[2].lower()
        if name in INLINE:
            attributes = _attributes(m[3]) if m[3] and not closing else {}
            if name == "a":
                in_link = not closing
            if closing:
                if name in hidden:
                    del hidden[len(hidden) - 1 - hidden[::-1].index(name) :]
            elif name != "wbr" and (hidden or (attributes and (_hidden(attributes) or INLINE_AD.search(attributes.get("class", ""))))):
                hidden.append(name)
            continue
        if name in VOID:
            text.append(" ")
            continue
        flush()
        hidden.clear()
        if closing:
            if opened.get(name, 0) > 0:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                close(k)
            continue
        attributes = _attributes(m[3]) if m[3] else {}
        if stack[-1].name == "p":
            close(-1)
        ends = ENDS.get(name)
        if ends and stack[-1].name in ends:
            close(-1)
            if name == "tr" and stack[-1].name == "tr":
                close(-1)
        parent = stack[-1]
        path = _path(parent.path, name + "".join("." + c for c in sorted(attributes.get("class", "").split())[:3]))
        tokens.append(path << 1)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if m[3].endswith("/") and name not in ("div", "p", "section", "article"):
            continue
        suspect = parent.suspect
        if parent.main and not suspect and name not in ("article", "main") and _named(PARTS, name, attributes, parent):
            suspects += 1
            suspect = suspects
        role = attributes.get("role")
        flags = parent.flags | (FURNISHED if parent.flags & FURNISHED or _is_furniture(name, attributes, parent) else 0)
        flags |= (IN_MAIN if name == "main" or role == "main" else 0) | (IN_ARTICLE if name == "article" or role == "article" else 0) | (LISTED if name in LISTS else 0) | (HEADED if name in HEADINGS else 0)
        stack.append(_Open(name, path, flags, suspect))
        opened[name] = opened.get(name, 0) + 1
    flush()
    close(1)
    return tokens, out


PARSED = "page_id long, url string, host string, key long, tokens array<long>, at array<int>, text array<string>, size array<int>, flags array<int>, linked array<int>, suspect array<int>, element array<long>"


def parsed(pages: DataFrame) -> DataFrame:
    """One row for each page: its tokens and blocks of text. About PIECE_BYTES of html go out together."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for i in range(len(batch)):
            page, url, html = (batch.column(c)[i].as_py() for c in range(3))
            html = html or ""
            tokens, found = parse(html)
            columns = [*zip(*found, strict=True)] if found else [()] * 6
            at, text, flags, linked, suspect, element = map(list, columns)
            rows.append((page, url, host_of(url), _h(page, url, html), tokens, at, text, [len(t) for t in text], flags, linked, suspect, element))
            held += len(html)
            if held > PIECE_BYTES or i == len(batch) - 1:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)
                rows, held = [], 0

    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), longs, ints, pa.list_(pa.string()), ints, ints, ints, ints, longs]
    names = [x.split()[0] for x in PARSED.split(", ")]
    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), fn, PARSED)


def classes(pages: DataFrame) -> DataFrame:
    """host, tokens, labels: the tokens in equivalence classes of two or more and the number of each one's class; pages: `parsed`."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code = batch.column(0).dictionary_encode()
        lens = np.diff(np.asarray(batch.column(2).offsets))
        flat = batch.column(2).flatten().to_numpy()
        row = np.repeat(np.arange(len(batch)), lens)
        if not len(flat):
            return
        order = np.lexsort((flat, row))
        r, t = row[order], flat[order]
        first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (t[1:] != t[:-1])))
        count = np.diff(np.append(first, len(r)))
        r, t = r[first], t[first]
        with np.errstate(over="ignore"):
            h = mix(batch.column(1).to_numpy().astype(U64)[r] + mix(count.astype(U64)))
        hosts = code.indices.to_numpy()[r]
        order = np.lexsort((t, hosts))
        hosts, t, h = hosts[order], t[order], h[order]
        first = np.flatnonzero(np.append(True, (hosts[1:] != hosts[:-1]) | (t[1:] != t[:-1])))
        sums = [np.add.reduceat(x.astype(np.int64), first) for x in (np.ones(len(h)), h >> U64(32), h & U64(0xFFFFFFFF))]
        yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(hosts[first])), pa.array(t[first]), *map(pa.array, sums)], ["host", "token", "n", "v1", "v2"])

    rows = arrow_map(pages.select("host", "key", "tokens"), fn, "host string, token long, n long, v1 long, v2 long")
    tokens = rows.groupBy("host", "token").agg(F.sum("n").alias("n"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2")).filter(F.col("n") >= LEAST_PAGES)
    frequent = tokens.join(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "host").filter(F.col("n") >= SHARE * F.col("pages"))
    # A class has at most the tokens that stand in half of a host's pages: twice the tokens of an average page.
    found = frequent.groupBy("host", "n", "v1", "v2").agg(F.collect_list("token").alias("class")).filter(F.size("class") >= 2)
    return _by_host(found.groupBy("host").agg(F.collect_list("class").alias("classes")))


def _by_host(held: DataFrame) -> DataFrame:
    labels = F.transform("classes", lambda c, i: F.array_repeat(i, F.size(c)))
    return cut(held.select("host", F.flatten("classes").alias("known"), F.flatten(labels).alias("labels")))


def _with(pages: DataFrame, hosts: DataFrame, size: str) -> DataFrame:
    """pages with what is known of their hosts (one row each); broadcast if it is small, in rows and in entries."""
    n, entries = hosts.agg(F.count(F.lit(1)), F.sum(F.size(size))).first()
    few = n <= BROADCAST_HOSTS and (entries or 0) <= BROADCAST_TOKENS
    return pages.join(F.broadcast(hosts) if few else hosts, "host", "left")


class _Template:
    """What is known of a host: the class of each token, how many tokens each class has, and the roles of fields."""

    def __init__(self, tokens: list[int] | None, labels: list[int] | None, fields: list[int] | None = None, roles: list[int] | None = None) -> None:
        self.label = dict(zip(tokens or (), labels or (), strict=True))
        self.size: dict[int, int] = {}
        for c in labels or ():
            self.size[c] = self.size.get(c, 0) + 1
        self.role = dict(zip(fields or (), roles or (), strict=True))

    def walk(self, tokens: list[int], at: list[int]) -> tuple[list[int], dict[int, list[int]], set[int]]:
        """Slot of each block, the tokens of each class in order, and the classes that lie across another's gaps.

        A slot is named by the token before it in the innermost open instance of a class; 0 where none is open.
        """
        label, size = self.label, self.size
        stack: list[int] = []
        seen: dict[int, int] = {}
        last: dict[int, int] = {}
        order: dict[int, list[int]] = {}
        crossing: set[int] = set()
        slots, places, k = [], len(at), 0
        for i, t in enumerate(tokens):
            if k < places and at[k] == i:
                slots.append(last[stack[-1]] if stack else 0)
                k += 1
            c = label.get(t)
            if c is None:
                continue
            if c not in seen:
                stack.append(c)
                seen[c] = 0
            while stack[-1] != c:  # begun inside an instance of c and not yet ended
                crossing.add(stack[-1])
                seen.pop(stack.pop())
            seen[c] += 1
            last[c] = t
            order.setdefault(c, []).append(t)
            if seen[c] == size[c]:
                stack.pop()
                seen.pop(c)
        return slots, order, crossing


def _hosts(batch: pa.RecordBatch, columns: list[int]) -> Iterator[tuple[int, str, _Template]]:
    """Row, host and its template; the templates of a few hosts at a time are kept."""
    known: dict[str, _Template] = {}
    for i, host in enumerate(batch.column(0).to_pylist()):
        if host not in known:
            if len(known) > 64:
                known.clear()
            known[host] = _Template(*(batch.column(c)[i].as_py() for c in columns))
        yield i, host, known[host]


def templates(pages: DataFrame, found: DataFrame) -> DataFrame:
    """host, known, labels of the valid ones among the classes: ordered and nested in every page of the host."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[int]] = {}
        for i, host, template in _hosts(batch, [2, 3]):
            if not template.label:
                continue
            _, order, crossing = template.walk(batch.column(1)[i].as_py(), [])
            for c, tokens in order.items():
                m = template.size[c]
                good = c not in crossing and tokens == tokens[:m] * (len(tokens) // m) and len(set(tokens[:m])) == m
                h = _h(*tokens[:m]) if good else -1
                s = seen.setdefault((host, c), [h, h])
                s[0], s[1] = min(s[0], h), max(s[1], h)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), *[pa.array([s[j] for s in seen.values()], pa.int64()) for j in (0, 1)]], ["host", "c", "low", "high"])

    rows = arrow_map(_with(pages.select("host", "tokens"), found, "known").select("host", "tokens", "known", "labels"), fn, "host string, c int, low long, high long")
    valid = rows.groupBy("host", "c").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low = high and low >= 0").select("host", "c")
    tokens = found.select("host", F.explode(F.arrays_zip("known", "labels")).alias("x")).select("host", F.col("x.known").alias("token"), F.col("x.labels").alias("c"))
    kept = tokens.join(valid, ["host", "c"]).groupBy("host", "c").agg(F.collect_list("token").alias("class"))
    return _by_host(kept.groupBy("host").agg(F.collect_list("class").alias("classes")))


def _field(slot: int, element: int) -> int:
    return (slot * 0x9E3779B97F4A7C15 + element * 0xBF58476D1CE4E5B9 & 0x7FFFFFFFFFFFFFFF) if slot else 0


def fields(pages: DataFrame, template: DataFrame) -> DataFrame:
    """host, fields, roles: what the slots of at least half of a host's pages hold in sum."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[int]] = {}
        for i, host, known in _hosts(batch, [7, 8]):
            if not known.label:
                continue
            tokens, at, size, flags, linked, element = (batch.column(c)[i].as_py() for c in range(1, 7))
            slots, _, _ = known.walk(tokens, at)
            once = set()
            for j, slot in enumerate(slots):
                key = (host, _field(slot, element[j]))
                if not key[1] or tokens[at[j]] in known.label:
                    continue
                s = sums.setdefault(key, [0, 0, 0, 0, 0])
                s[0] += key not in once
                once.add(key)
                s[1] += size[j]
                s[2] += size[j] if flags[j] & FURNISHED else 0
                s[3] += size[j] if flags[j] & (IN_MAIN | IN_ARTICLE) else 0
                s[4] += linked[j]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), *[pa.array([s[j] for s in sums.values()], pa.int64()) for j in range(5)]], ["host", "field", "n", "size", "furniture", "main", "links"])

    names = ["host", "tokens", "at", "size", "flags", "linked", "element"]
    rows = arrow_map(_with(pages.select(*names), template, "known").select(*names, "known", "labels"), fn, "host string, field long, n long, size long, furniture long, main long, links long")
    total = rows.groupBy("host", "field").agg(*[F.sum(c).alias(c) for c in ("n", "size", "furniture", "main", "links")]).filter(F.col("n") >= LEAST_PAGES)
    total = total.join(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "host").filter(F.col("n") >= SHARE * F.col("pages"))
    role = sum((F.when(F.col(c) * 2 > F.col("size"), F.lit(bit)).otherwise(F.lit(0)) for c, bit in (("furniture", IS_FURNITURE), ("main", IS_MAIN), ("links", IS_LINKS))), F.lit(0))
    return cut(total.groupBy("host").agg(F.collect_list(F.struct("field", role.alias("role"))).alias("x")).select("host", F.col("x.field").alias("fields"), F.col("x.role").alias("roles")))


def chosen(tokens: list[int], at: list[int], text: list[str], flags: list[int], linked: list[int], suspect: list[int], element: list[int], known: _Template) -> str:
    """Text of the main fields of a page: blocks in page order, joined by one space."""
    label, every = known.label, range(len(text))
    slots = known.walk(tokens, at)[0] if label else [0] * len(text)
    role = [known.role.get(_field(s, e)) for s, e in zip(slots, element, strict=True)] if known.role else [None] * len(text)
    said = [label.get(tokens[at[j]]) for j in every]
    # Text and element are of one class: wherever the element stands on the host's pages, it holds this text.
    fixed = [said[j] is not None and said[j] == label.get(element[j]) for j in every]
    free = [j for j in every if not flags[j] & FURNISHED and not (role[j] or 0) & IS_FURNITURE]
    inside = next((bit for bit in (IN_MAIN, IN_ARTICLE) if any(f & bit for f in flags)), 0)
    if inside:
        kept = [j for j in free if flags[j] & inside]
        parts: dict[int, list[int]] = {}
        for j in kept:
            if suspect[j]:
                s = parts.setdefault(suspect[j], [0, 0, 0])
                s[0], s[1], s[2] = s[0] + len(text[j]), s[1] + linked[j], s[2] or int(fixed[j])
        confirmed = {k for k, (size, links, told) in parts.items() if told or links * 2 > size}
        kept = [j for j in kept if suspect[j] not in confirmed]
        if any(said[j] is None for j in kept):
            # Headings that all articles of a host share (Method, Results) are the article's, as nothing but the template speaks against them.
            kept = [j for j in kept if not fixed[j] or flags[j] & HEADED]
        return " ".join(text[j] for j in kept)
    # Neither a main element nor an article: the template decides, by its fields and its own text.
    links: dict[int, list[int]] = {}
    for j in free:
        s = links.setdefault(element[j], [0, 0])
        s[0], s[1] = s[0] + len(text[j]), s[1] + linked[j]
    listed = lambda j: flags[j] & LISTED and (role[j] & IS_LINKS if role[j] is not None else links[element[j]][1] * 2 > links[element[j]][0])
    kept = [j for j in free if said[j] is None and not listed(j)] or [j for j in free if not listed(j)]
    if any(r is not None and r & IS_MAIN for r in known.role.values()):
        kept = [j for j in kept if role[j] is None or role[j] & IS_MAIN]
    return " ".join(text[j] for j in kept)


def main_text(html: str) -> str:
    """The main text of a page by itself, of a host without a template."""
    tokens, found = parse(html)
    at, text, flags, linked, suspect, element = map(list, zip(*found, strict=True)) if found else ([],) * 6
    return chosen(tokens, at, text, flags, linked, suspect, element, _Template([], []))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html).

    Null or empty html gives an empty text; a page without a host shares the host "" with its like. Nothing else is
    dropped and no text is cut, however long or deep the page. Repeated pages count each in their host's vectors and
    each give a row; an empty table gives an empty result, and other columns are left out.
    """
    page = cut(parsed(pages))
    template = templates(page, classes(page))
    known = cut(template.join(fields(page, template), "host", "left"))
    names = ["host", "tokens", "at", "text", "flags", "linked", "suspect", "element", "page_id", "url"]

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first, out, held = 0, [], 0
        for i, _, host in _hosts(batch, [10, 11, 12, 13]):
            out.append(chosen(*(batch.column(c)[i].as_py() for c in range(1, 8)), host))
            held += len(out[-1])
            if held > PIECE_BYTES or i == len(batch) - 1:
                yield pa.RecordBatch.from_arrays([batch.column(8).slice(first, len(out)), batch.column(9).slice(first, len(out)), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])
                first, out, held = i + 1, [], 0

    joined = _with(page.select(*names), known, "known").select(*names, "known", "labels", "fields", "roles")
    return arrow_map(joined, fn, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Every page; hosts and their templates come from the table itself."""
    from .shared import table

    return extract(table(spark, sf_dir, "pages"))
