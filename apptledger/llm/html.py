"""Main text of web pages by equivalence-class template deduction.

Pages of a host come from one template. A page is a sequence of tokens: tags, told apart by their path
of enclosing elements and their class and id, and pieces of text, told apart by path and wording. Over
the distinct pages of a host every token has an occurrence vector, how often it stands on which page; tokens with the
same vector are an equivalence class. A class is the template's if it has at least two tokens and stands on
``SUPPORT`` of the host's distinct pages, of which there must be ``LEAST_PAGES``. On a page a class is valid
if its tokens come in one order, repeated as a whole, and if classes nest: none begins inside another's
gap and ends outside it. Valid classes form the template; the runs between their tokens are the slots.

Text inside ``article`` elements is the text, be it empty; without one inside ``main``; without either, of the whole body.
In a body without a marked region, text of the template is left out; what a page marks as its article stays whole, also where
all articles of a host share a sentence. Anything inside menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or comments of readers is left out everywhere, known by element, role, or words of class and id. Some words
name furniture wherever they stand (``STRONG``), some only if nothing else is said (``share-bar``, not
``share-price-report``), and some only outside an article and its paragraphs (``search``, ``discussion``). A header inside
an article belongs to the article.

Where a host has pages without a marked region, those of its pages whose visible texts are near copies of each other
(five-word shingles, see ``neardup``) count once for its template, so one story under many addresses is no template.

Vectors are never gathered: a token's vector is a 64-bit exclusive or over hashes of (page, count), combined
before the shuffle, so a host with a third of all pages costs a task no more than any other. Templates
hold tokens that stand on most pages of a host, so their size is bounded by a page's.

Character references are decoded; white space inside a block becomes one space, ``br`` included; blocks are
trimmed and joined by an empty line. Null, empty and wholly marked-up pages give an empty text. Cut pages are read as far
as they go. Pages without a host share no template and go by their elements. Pages are read whole; repeated rows
count once for the template and get a text each; an empty table gives an empty one. Raw elements such as ``svg`` may close
themselves.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apptledger.llm.arrow import with_columns
from apptledger.llm.neardup import near_duplicates
from apptledger.llm.urlrules import host_of
from apptledger.operators.joins import BROADCAST_LIMIT_CONF, spread_join
from apptledger.session import materialized

LEAST_PAGES, SUPPORT = 5, 0.8
LEAST_TOKENS = 2

RAW = "script|style|title|textarea|noscript|iframe|noembed|noframes|xmp|template|svg|math"
TOKEN = re.compile(
    rf"(?is)<!--.*?(?:-->|\Z)"
    rf"|<({RAW})\b(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</\1\b[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?[a-z!?/][^>]*(?:>|\Z)"
    r"|([^<]+|<)")
ATTRIBUTE = re.compile(r"(?is)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var").split())
#: Elements that an opening tag of the same kind closes, up to the container that holds them.
CLOSED_BY_NEXT = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"})}
FURNITURE = frozenset("nav footer aside form menu button select dialog object canvas audio video".split())
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id that name furniture wherever they stand.
STRONG = frozenset((
    "ad ads adbox advert adverts advertisement advertising sponsored promo gdpr newsletter subscribe signup login sidebar "
    "sidebars navbar breadcrumb breadcrumbs masthead toolbar topbar disqus pagination pager popup modal").split())
#: Words that do so inside an article, or on a paragraph, if the rest of the name says no more than ``NEUTRAL`` words.
MEDIUM = frozenset((
    "banner cookie cookies consent overlay subscription rail widget widgets menu menus nav navigation footer share sharing "
    "social related recommended recommendations comment comments sponsor promoted promotion").split())
#: Words that do so outside an article only, on elements that hold others.
WEAK = frozenset("notice notices alert search reply replies respond discussion".split())
FURNITURE_WORDS = STRONG | MEDIUM | WEAK
NEUTRAL = frozenset((
    "area bar block box button buttons container content form icon icons inner item items left link links list main module outer "
    "panel posts right row section slot stories top bottom unit wrap wrapper").split())
#: Blocks that hold text rather than elements.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("html body main article".split())
MEMO = 200_000

PAGE = T.StructType([
    T.StructField("content", T.BinaryType()), T.StructField("marked", T.BooleanType()), T.StructField("tokens", T.ArrayType(T.LongType())),
    T.StructField("counts", T.ArrayType(T.IntegerType()))])


def number(*parts: str | int) -> int:
    """A signed 64-bit number for a token."""
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) - 2**63


def is_furniture(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element is no part of the article."""
    if name in FURNITURE or name == "header" and not in_article:
        return True
    if name in WHOLE and "comment" not in attributes.get("class", "").lower():
        return False
    if attributes.get("role", "").lower() in FURNITURE_ROLES:
        return True
    names = [{w.lower() for w in WORD.findall(n)} for key in ("class", "id") for n in attributes.get(key, "").split()]
    holds_text = name in PARAGRAPHS or name in INLINE
    if in_article or holds_text:
        return any(words & STRONG or words & MEDIUM and words <= FURNITURE_WORDS | NEUTRAL for words in names)
    return any(words & FURNITURE_WORDS or "header" in words for words in names)


class Reader:
    """Pages to tokens: (number, text or None, whether a block ends, furniture, in article, in main)."""

    def __init__(self):
        self.memo: dict[tuple, tuple[int, int, dict[str, str]]] = {}

    def element(self, path: int, name: str, raw: str) -> tuple[int, int, dict[str, str]]:
        """Path below this element, number of its tag, and its class, id and role."""
        key = (path, name, raw)
        found = self.memo.get(key)
        if found is None:
            attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(raw)}
            marks = (attributes.get("class", ""), attributes.get("id", ""))
            found = number(path, name), number(path, "<", name, *marks), attributes
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(raw) < 200:
                self.memo[key] = found
        return found

    def tokens(self, page: str) -> list[tuple]:
        out: list[tuple] = []
        #: Open elements: name, path below, furniture, in article, in main.
        stack: list[tuple] = [("", 0, False, False, False)]
        for match in TOKEN.finditer(page):
            name, text = match[3], match[5]
            top = stack[-1]
            if text is not None:
                if text.isspace():
                    out.append((0, " ", False, True, False, False))
                else:
                    out.append((number(top[1], "", text.strip()), text, False, *top[2:]))
                continue
            if name is None:
                continue  # comments, declarations, and elements whose content is no text of the page
            name = name.lower()
            if name == "br" or name in INLINE and not match[2]:
                _, own, attributes = self.element(top[1], name, match[4])
                if attributes and name not in VOID and not top[2] and is_furniture(name, attributes, top[3]):
                    stack.append((name, top[1], True, *top[3:]))
                out.append((own, " " if name == "br" else None, False, *top[2:]))
                continue
            if name in INLINE:
                # Only those that are furniture are on the stack, above the block they stand in.
                if top[0] == name:
                    stack.pop()
                out.append((number(top[1], "</", name), None, False, *stack[-1][2:]))
                continue
            while stack[-1][0] in INLINE or not match[2] and stack[-1][0] in PARAGRAPHS:
                stack.pop()
            if match[2]:
                for at in range(len(stack) - 1, 0, -1):
                    if stack[at][0] == name:
                        del stack[at:]
                        break
                out.append((number(stack[-1][1], "</", name), None, True, *stack[-1][2:]))
                continue
            closes, holders = CLOSED_BY_NEXT.get(name, ((), ()))
            for at in range(len(stack) - 1, 0, -1) if closes else ():
                if stack[at][0] in holders:
                    break
                if stack[at][0] in closes:
                    del stack[at:]
                    break
            top = stack[-1]
            below, own, attributes = self.element(top[1], name, match[4])
            furniture = top[2] or is_furniture(name, attributes, top[3])
            inside = (furniture, top[3] or name == "article" and not furniture,
                      top[4] or (name == "main" or attributes.get("role") == "main") and not furniture)
            out.append((own, None, True, *inside))
            # Paragraphs and headings hold no elements that matter, and are often left open: one that is furniture
            # ends where the next block begins.
            if name in PARAGRAPHS:
                if furniture and not top[2]:
                    stack.append((name, top[1], True, *top[3:]))
                continue
            if name in VOID:
                continue
            stack.append((name, below, *inside))
        return out


def valid_places(numbers: list[int], classes: list[list[int]]) -> set[int]:
    """Places of a page's tokens that belong to valid classes: ordered, and nested in each other."""
    of = {token: k for k, tokens in enumerate(classes) for token in tokens}
    places: dict[int, list[int]] = {}
    for at, token in enumerate(numbers):
        if token in of:
            places.setdefault(of[token], []).append(at)
    sound = {}
    for k, found in places.items():
        order = [numbers[at] for at in found[:len(classes[k])]]
        if len(set(order)) == len(order) and all(numbers[at] == order[i % len(order)] for i, at in enumerate(found)) \
                and len(found) % len(order) == 0:
            sound[k] = order
    while True:
        # Every begun class must go on before those around it do.
        open_classes: list[list[int]] = []
        broken = None
        for at in sorted(at for k in sound for at in places[k]):
            k = of[numbers[at]]
            if open_classes and open_classes[-1][0] == k:
                open_classes[-1][1] += 1
            elif numbers[at] == sound[k][0]:
                open_classes.append([k, 1])
            else:
                # It goes on inside another's gap: the class that began later does not nest.
                broken = open_classes[-1][0]
                break
            if open_classes[-1][1] == len(sound[k]):
                open_classes.pop()
        if broken is None:
            return {at for k in sound for at in places[k]}
        del sound[broken]


def main_text(tokens: list[tuple], template: set[int]) -> str:
    """The slots of the article's region, block by block."""
    has_article = any(t[4] and not t[3] for t in tokens)
    has_main = any(t[5] and not t[3] for t in tokens)
    blocks, parts = [], []
    for at, (_, text, ends, furniture, in_article, in_main) in enumerate(tokens):
        if ends:
            blocks.append("".join(parts))
            parts = []
        elif text is not None:
            if text == " ":
                parts.append(text)
            elif not furniture and (in_article or not has_article and (in_main or not has_main and at not in template)):
                parts.append(text)
    blocks.append("".join(parts))
    cleaned = (" ".join(references.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in cleaned if b)


def page_digest(page: str) -> bytes:
    return xxhash.xxh3_128_digest(page.encode("utf-8", "surrogatepass"))


def visible_texts(pages: DataFrame, html: str) -> DataFrame:
    """(content, visible): digest and visible text, furniture and all, of each page."""

    def make():
        reader = Reader()

        def compute(pages: pa.Array) -> list[list]:
            texts = [page.as_py() or "" for page in pages]
            return [[page_digest(t) for t in texts], [" ".join(k[1] for k in reader.tokens(t) if k[1]) for t in texts]]

        return compute

    added = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("visible", T.StringType())])
    return with_columns(pages.select(html), html, added, make).select("content", "visible")


def one_of_each_story(distinct: DataFrame, pages: DataFrame, host: str, html: str) -> DataFrame:
    """``distinct`` pages without the near copies on hosts where a template may take text from an article."""
    open_hosts = materialized(distinct.where("not marked").select(host).distinct(), "open-hosts")
    if open_hosts.isEmpty():
        return distinct
    texts = visible_texts(pages.join(open_hosts, host, "left_semi"), html)
    stories = near_duplicates(texts, "content", "visible").select(
        F.col("content").alias("of"), F.col("component_id").alias("story")).distinct()
    # Of the near copies on a host the one with the least digest stands for all.
    mine = distinct.select(host, "content").join(open_hosts, host, "left_semi")
    told = mine.join(stories, F.col("content") == F.col("of")).groupBy(host, "story").agg(F.min("content").alias("content"))
    others = distinct.join(open_hosts, host, "left_anti")
    return distinct.join(told.select(host, "content"), [host, "content"], "left_semi").unionByName(others)


def page_tokens(df: DataFrame, html: str) -> DataFrame:
    """``df`` with a digest of each page, whether it marks its article, and its distinct tokens with their counts."""

    def make():
        reader = Reader()

        def compute(pages: pa.Array) -> list[list]:
            contents, marked, tokens, counts = [], [], [], []
            for page in pages:
                text = page.as_py() or ""
                read = reader.tokens(text)
                found = Counter(t[0] for t in read if t[0])
                marked.append(any((t[4] or t[5]) and not t[3] for t in read))
                contents.append(page_digest(text))
                tokens.append(list(found))
                counts.append(list(found.values()))
            return [contents, marked, tokens, counts]

        return compute

    return with_columns(df, html, PAGE, make)


def templates(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(host, classes): the equivalence classes of each host's template, as arrays of token numbers."""
    read = page_tokens(pages.where(f"`{host}` <> '' and `{html}` is not null").select(host, html), html).drop(html)
    distinct = read.groupBy(host, "content").agg(
        F.any_value("marked").alias("marked"), F.any_value(F.arrays_zip("tokens", "counts")).alias("found"))
    distinct = one_of_each_story(materialized(distinct, "pages"), pages, host, html)
    hosts = distinct.groupBy(host).agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    vectors = (
        distinct.select(host, "content", F.explode("found").alias("t"))
        .groupBy(host, F.col("t.tokens").alias("token"))
        .agg(F.count(F.lit(1)).alias("on"), F.bit_xor(F.xxhash64("content", "t.counts")).alias("vector"))
        .where(F.col("on") >= SUPPORT * LEAST_PAGES))
    frequent = vectors.join(hosts, host).where(F.col("on") >= SUPPORT * F.col("pages"))
    classes = frequent.groupBy(host, "vector").agg(F.sort_array(F.collect_list("token")).alias("class"))
    return classes.where(F.size("class") >= LEAST_TOKENS).groupBy(host).agg(F.collect_list("class").alias("classes"))


def with_templates(located: DataFrame, deduced: DataFrame) -> DataFrame:
    """Each page with its host's classes. Templates are broadcast if all their tokens fit, else hot hosts are spread."""
    limit = int(deduced.sparkSession.conf.get(BROADCAST_LIMIT_CONF, str(32 << 20)))
    size = F.aggregate("classes", F.lit(200).cast("long"), lambda total, one: total + 16 + 8 * F.size(one))
    if (deduced.agg(F.sum(size)).first()[0] or 0) <= limit:
        return located.join(F.broadcast(deduced), "__host__", "left")
    return spread_join(located, deduced, ["__host__"], "left", spread_by=[f"`{c}`" for c in located.columns if c != "__host__"])


def extract(df: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """``df`` with the main text of each page."""
    kept = [c for c in df.columns if c != text]
    located = df.select(*[df[f"`{c}`"] for c in kept], host_of(df[url]).alias("__host__"))
    deduced = materialized(templates(located, "__host__", html), "templates")
    joined = with_templates(located, deduced).withColumn(
        "__page__", F.struct(F.col(f"`{html}`").alias("html"), "classes"))

    def make():
        reader = Reader()

        def main(page: str | None, classes: list[list[int]] | None) -> str:
            tokens = reader.tokens(page) if page else []
            return main_text(tokens, valid_places([t[0] for t in tokens], classes) if classes else set())

        def compute(pages: pa.Array) -> list[list]:
            return [[main(p["html"].as_py(), p["classes"].as_py()) for p in pages]]

        return compute

    added = T.StructType([T.StructField(text, T.StringType())])
    return with_columns(joined.select(*[f"`{c}`" for c in kept], "__page__"), "__page__", added, make).drop("__page__")
