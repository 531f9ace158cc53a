"""Main text of web pages by equivalence-class template deduction.

The pages of a host come from few templates.  A token is a container tag at its path from the root, or a run of text
at such a path.  Tokens that occur equally often on every page of a host have equal occurrence vectors and form an
equivalence class; classes found on most pages, with their tags nested in each other, are the host's template.  What
stands between template tokens are slots.  A page gives the text of all slots but parts that by name are not the
article, or all that lies in elements marked as the article; the template's own words go.

Occurrence vectors are never held: a token's vector is the exclusive-or, over pages, of a hash of page and count, which
combines map-side in any order; equal vectors have equal marks.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.llm.common import settled, text_of

#: Share of a host's pages that a template token is on, and pages that a host needs to have its words taken for a template's.
OFTEN, PAGES = 0.6, 8
#: Templates that are broadcast at most: a few dozen marks each.
HOSTS = 50_000
#: Repeated htmls that are broadcast at most: a host's name and a mark each.
COPIES = 500_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)(?:>|\Z)
    |<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)""", re.S | re.X)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

# Names of the language's elements by use.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_AWAY = frozenset("nav header footer aside form script style template svg math head menu dialog noscript button select option textarea input iframe object canvas audio video fieldset".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_AWAY_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation menu
    breadcrumb breadcrumbs sidebar aside header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay
    newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments
    respond reply replies disqus widget toolbar pagination pager skip toc tags taglist hidden""".split())
_AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
_MAIN_WORDS = frozenset("article content main post entry story body text".split())
_BREAKS_PATH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption figure hr address caption summary details li dt dd tr td th thead tbody tfoot".split())


@dataclass
class Element:
    """A container in a page: its label in paths, and whether its name or that of what holds it takes it out of the article."""

    name: str
    label: str
    path: str
    away: bool
    article: bool


@dataclass
class Block:
    path: str
    away: bool
    article: bool
    parts: list[str] = field(default_factory=list)

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


def _element(name: str, rest: str, parent: Element) -> Element:
    words, role, hidden = [], "", False
    if rest.strip(" /"):
        for key, value in _ATTR.findall(rest):
            key, value = key.lower(), entities.unescape(value.strip("\"'"))
            if key in ("class", "id"):
                words += value.split()
            elif key == "role":
                role = value.lower()
            hidden = hidden or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", ""))
    marks = {part for w in words for part in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", w).lower())}
    away = parent.away or hidden or name in _AWAY or role in _AWAY_ROLES
    article = name in ("article", "main") or role in ("main", "article")
    if marks & _AWAY_WORDS and name not in ("html", "body", "article", "main"):
        away = True
    label = name + "".join(f".{w}" for w in sorted(m for m in marks if m)[:4])
    return Element(name, label, f"{parent.path}/{label}", away, parent.article or article)


def read(page: str) -> tuple[list[Block], Counter]:
    """Blocks of text in page order, and how often each container path occurs."""
    stack = [Element("", "", "", False, False)]
    paths: Counter = Counter()
    blocks: list[Block] = []
    now: Block | None = None
    at, n = 0, len(page)

    def add(s: str) -> None:
        nonlocal now
        if now is None:
            top = stack[-1]
            now = Block(top.path, top.away, top.article)
            blocks.append(now)
        now.parts.append(s)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            add(page[at:lt])
        if lt >= n:
            break
        m = _TAG.match(page, lt)
        if not m:   # a bare sign in the text
            add("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        ends = m["end"] or m["end2"]
        rest = m["rest"] if m["name"] else m["rest2"]
        if name in _RAW and not ends:
            if not rest.rstrip().endswith("/"):
                shut = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                at = n if shut is None else shut.start()
            now = None if name not in _INLINE else now
            continue
        if name in _INLINE:
            if name == "br":
                add(" ")
            continue
        now = None
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            continue
        if name in _VOID:
            continue
        shuts = _CLOSES.get(name)
        if shuts:
            while stack[-1].name in shuts:
                stack.pop()
        elif stack[-1].name == "p":   # any block ends a paragraph
            stack.pop()
        e = _element(name, rest, stack[-1])
        if name in _BREAKS_PATH:   # text blocks are no containers of their own: their path is what holds them
            e.path = stack[-1].path if not e.away or stack[-1].away else e.path
        else:
            paths[e.path] += 1
        stack.append(e)
    return blocks, paths


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _run(block: Block) -> str:
    """Token of a run of text: a mark, as the text may be long."""
    return "#" + xxhash.xxh64_hexdigest(f"{block.path}\0{block.text()}")


def token_counts(pages: DataFrame) -> DataFrame:
    """(host, token, support, vector) over the distinct pages of each host: a container's token is its path.

    ``copies`` marks pages whose html is on the host more than once; their tokens are put together by html first.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
            for mark, host, page, copies in zip(pdf["_h"], pdf["host"], pdf["html"], pdf["copies"]):
                blocks, paths = read(page)
                for token, c in [*paths.items(), *Counter(_run(b) for b in blocks if b.text()).items()]:
                    s = seen[host, token, mark if copies else None]
                    vector = xxhash.xxh64_intdigest(f"{mark}:{c}") >> 1
                    s[:] = (1, vector) if copies else (s[0] + 1, s[1] ^ vector)
            rows = [(*k, *v) for k, v in seen.items()]
            yield pd.DataFrame(rows, columns=["host", "token", "_h", "support", "vector"]).astype({"_h": "Int64"})

    counted = pages.select("_h", "host", "html", "copies").mapInPandas(count, "host string, token string, _h long, support long, vector long")
    alone = F.col("_h").isNull()
    once = counted.groupBy("host", "token", "_h").agg(F.when(alone, F.sum("support")).otherwise(F.max("support")).alias("support"),
                                                      F.when(alone, F.bit_xor("vector")).otherwise(F.max("vector")).alias("vector"))
    return once.groupBy("host", "token").agg(F.sum("support").alias("support"), F.bit_xor("vector").alias("vector"))


def deduce(tokens: pd.DataFrame, pages: int) -> list[str]:
    """The template's own runs of text, from a host's frequent tokens."""
    classes: dict[tuple, list] = defaultdict(list)
    for r in tokens.itertuples(index=False):
        classes[r.support, r.vector].append(r)
    valid, kept = {""}, []
    for _, members in sorted(classes.items(), key=lambda c: -c[0][0]):
        tags = {m.token for m in members if m.token[0] == "/"}
        # a class whose tags do not nest in each other and the template so far is none of its classes
        if all(p.rpartition("/")[0] in valid | tags for p in tags):
            valid |= tags
            kept += members
    return sorted(m.token for m in kept if m.token[0] == "#") if pages >= PAGES else []


def templates(pages: DataFrame) -> DataFrame:
    """(host, own): a host's template from the tokens on at least OFTEN of its pages.

    Tokens of a single page go before anything is dealt by host, and those on too few pages before a host's tokens are
    put together, so a host brings at most 1 / OFTEN times the tokens of an average page, however many pages it has.
    Pages of one host with equal html count as one.  A host of one such page has no template; its page speaks for itself.
    """
    htmls = settled(pages.groupBy("host", "_h").agg(F.count(F.lit(1)).alias("n")))
    size = htmls.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    again = htmls.filter("n > 1").select("host", "_h", F.lit(True).alias("copies"))
    told = pages.join(F.broadcast(again) if again.count() <= COPIES else again, ["host", "_h"], "left")
    frequent = token_counts(told.withColumn("copies", F.coalesce("copies", F.lit(False)))).filter("support > 1").join(size, "host").filter(F.col("support") >= OFTEN * F.col("pages"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "own": [deduce(pdf, int(pdf["pages"].iloc[0]))]})

    return frequent.groupBy("host").applyInPandas(one, "host string, own array<string>")


def extract(page: str, own: set[str]) -> str:
    """Blocks of a page that are not away by name, one a line.

    Where blocks lie in an element marked as the article, all of those and no others are taken, and no words count as
    the template's; elsewhere the template's own runs go, unless nothing would be left.
    """
    blocks, _ = read(page)
    shown = [(b, t) for b in blocks if not b.away and (t := b.text())]
    marked = [t for b, t in shown if b.article]
    return "\n".join(marked or [t for b, t in shown if _run(b) not in own] or [t for _, t in shown])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null html counts as empty and gives an empty text; pages without a host in their url share one template.  Repeated
    rows come out once each; rows of a host with equal html count as one page for the template.  Other columns are not read.  Templates
    are counted and sent to all tasks while they are few; beyond that pages meet them in a join by host, which Spark
    splits where one host has most pages.
    """
    read_pages = pages.select("page_id", "url", text_of("html").alias("html"), _host(F.col("url")).alias("host"),
                              F.xxhash64(text_of("html")).alias("_h"))
    known = settled(templates(read_pages))
    joined = read_pages.join(F.broadcast(known) if known.count() <= HOSTS else known, "host", "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [extract(h, set(o if o is not None else ())) for h, o in zip(pdf["html"], pdf["own"])]
            out = pdf[["page_id", "url"]].copy()
            out["page_id"] = out["page_id"].astype("Int64")
            yield out.assign(text=texts, n_chars=[len(t) for t in texts])

    return joined.select("page_id", "url", "html", "own").mapInPandas(cut, "page_id long, url string, text string, n_chars long")
