"""Main text of web pages, with boilerplate found by a suffix array per host.

A page is a row of blocks.  The token streams of a host's pages are
concatenated and sorted by suffix; a long substring that stands on pages with
distinct contents is boilerplate, and the blocks it covers are removed, so
unique runs stay.  That decides on every block that markup leaves open, beside
an article or without one.  Markup has the last word where repetition cannot
decide: text in the page's article is kept although copies of the article
repeat it, and menus, headers, footers, forms and the like go although they
stand on one page only.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import append_columns, stored
from ledgerline.llm.substring import mix, word_hashes

#: Tokens that a repeated substring has at least.
LONG = 6
#: Share of a block's tokens that repeats have to cover.
COVERED = 0.5
#: Tokens of a host that one suffix array holds; a host with more is dealt to several by page.
PIECE_TOKENS = 50_000

# Elements by role.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_HIDDEN = {"head", "template", "noscript", "svg", "math", "object", "audio", "video", "canvas", "select", "datalist"} | _RAW
_CHROME = {"nav", "header", "footer", "aside", "form", "button", "fieldset", "dialog", "menu", "label"}
_MAIN = {"article", "main"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# An element one of whose class or id names is, begins or ends with one of these is no article text.
_CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disclaimer", "footer", "header", "login", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "related", "replies", "share", "sharing",
    "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: First parts of names that tell of something else's presence.
_ABOUT = {"has", "have", "with", "without", "no", "is", "not"}
#: Start tags that end an open element of the listed names.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert"}
# A start tag ends at the first > outside quotes.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
_GAP = re.compile(r"\s+")

#: Where a block stands: in the article, in chrome, or undecided.
ARTICLE, CHROME, OPEN = 0, 1, 2


def _named_chrome(names: str, place: int) -> bool:
    for name in names.lower().split():
        parts = re.split(r"[-_]+", name)
        if parts[0] not in _ABOUT and any(x in _CHROME_WORDS for x in (parts[0], parts[-1])):
            # An article's own header is its head, not the site's.
            if place != ARTICLE or "header" not in (parts[0], parts[-1]):
                return True
    return False


def _is_chrome(name: str, rest: str, place: int) -> bool:
    if name in _CHROME:
        return place != ARTICLE or name != "header"
    if name in ("html", "body") or "=" not in rest and "hidden" not in rest.lower():
        return False
    found = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTRIBUTE.finditer(rest)}
    return (
        found.get("role", "").lower() in _CHROME_ROLES
        or bool(re.search(r"(?i)(?:^|\s)hidden(?=$|[\s=/])", rest))
        or found.get("aria-hidden", "").lower() == "true"
        or bool(re.search(r"(?i)display\s*:\s*none", found.get("style", "")))
        or _named_chrome(f"{found.get('class', '')} {found.get('id', '')}", place)
    )


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(place, text) of every non-empty block in page order; scripts, styles and the like are left out.

    Elements may be left open or be closed out of order: an end tag closes back
    to its start, one without a start is passed over.  Unfinished markup at the
    end of a page is dropped, as is the rest of an unclosed script.
    """
    page = page or ""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, place, hidden
    place, hidden = OPEN, False

    def flush() -> None:
        text = _GAP.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((place, text))

    at = 0
    while at < len(page):
        tag = _TAG.search(page, at)
        if not hidden:
            held.append(page[at : tag.start() if tag else len(page)])
        if not tag:
            break
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if name in _BLOCKS:
            flush()
        elif name == "br":
            held.append(" ")
        if tag["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                if any(n in _BLOCKS for n, _, _ in stack[depth:]) or stack[depth][1] != (stack[depth - 1][1] if depth else OPEN):
                    flush()
                del stack[depth:]
                place, hidden = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
            continue
        if name in _VOID or (tag["rest"].endswith("/") and name not in _BLOCKS and name not in _RAW):
            continue
        if name in _BLOCKS:  # it ends an open paragraph, and an item the item before
            ends = _ENDS.get(name, set()) | {"p"}
            last = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _BLOCKS), None)
            while last is not None and stack[last][0] in ends:
                del stack[last:]
                last = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _BLOCKS), None)
            place, hidden = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
        chrome = place == CHROME or _is_chrome(name, tag["rest"], place)
        if chrome != (place == CHROME) or name in _MAIN:
            flush()
        place = CHROME if chrome else ARTICLE if name in _MAIN else place
        hidden = hidden or name in _HIDDEN
        stack.append((name, place, hidden))
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else len(page)
    flush()
    return out


def _whole(parts: np.ndarray, long: int) -> np.ndarray:
    """Starts of the windows of ``long`` tokens that lie in one part."""
    n = len(parts) - long + 1
    return np.flatnonzero(parts[:n] == parts[long - 1 :]) if n > 0 else np.empty(0, dtype=np.int64)


def repeated_starts(tokens: np.ndarray, pages: np.ndarray, long: int = LONG, parts: np.ndarray | None = None) -> np.ndarray:
    """Starts of the substrings of ``long`` tokens that also stand on another page, in suffix order.

    ``tokens`` are the concatenated streams, ``pages`` the page of each, and
    ``parts`` the stretch of it that no substring leaves, the page if not given.
    The suffix array is built by prefix doubling up to ``long`` tokens: suffixes
    whose first ``long`` tokens are equal are neighbours in it.
    """
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    span = 1
    while span < long:
        step = min(span, long - span)
        after = np.full(n, -1, dtype=np.int64)
        after[: n - step] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.concatenate(([0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0))))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        span += step
    starts = _whole(pages if parts is None else parts, long)
    if not len(starts):
        return starts
    suffixes = starts[np.argsort(rank[starts], kind="stable")]
    classes = np.concatenate(([0], np.cumsum(np.diff(rank[suffixes]) != 0)))
    firsts = np.flatnonzero(np.concatenate(([True], np.diff(classes) != 0)))
    least = np.minimum.reduceat(pages[suffixes], firsts)
    most = np.maximum.reduceat(pages[suffixes], firsts)
    return suffixes[(least < most)[classes]]


def _covered(n: int, starts: np.ndarray, long: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a window from one of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + long, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_tokens(tokens: np.ndarray, pages: np.ndarray, long: int = LONG) -> np.ndarray:
    """Which tokens lie in a substring of ``long`` or more tokens that also stands on another page."""
    return _covered(len(tokens), repeated_starts(tokens, pages, long), long)


_BLOCK = T.ArrayType(
    T.StructType([T.StructField("place", T.IntegerType()), T.StructField("text", T.StringType())])
)


def _parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with blocks and n_tokens (of the blocks outside the article)."""

    def make():
        def compute(htmls):
            out: list[list] = [[], []]
            for page in htmls:
                found = blocks(page)
                out[0].append([{"place": p, "text": t} for p, t in found])
                out[1].append(sum(t.count(" ") + 1 for p, t in found if p != ARTICLE))
            return out

        return compute

    return append_columns(pages, ["html"], [("blocks", _BLOCK), ("n_tokens", T.LongType())], make)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _stretches(found: list[dict]) -> list[int]:
    """A number per block; adjacent ones of one place share it, so that no window joins text to a menu or over an article."""
    out: list[int] = []
    for b, last in zip(found, [None, *found[:-1]], strict=True):
        joined = last is not None and (last["place"], last["number"] + 1) == (b["place"], b["number"])
        out.append(out[-1] + (not joined) if out else 0)
    return out


def _judged(long: int):
    """Group function: per content, its open blocks, the windows that repeat in the group, and of dealt hosts all windows' codes."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        tokens, pages, parts, rows, n, part = [], [], [], [], 0, 0
        for page, found in enumerate(group["blocks"]):
            stream = [word_hashes(b["text"]) for b in found]
            sizes = [len(t) for t in stream]
            numbers = np.array(_stretches(found), dtype=np.int64) + part
            rows.append((n, sum(sizes), found, sizes))
            tokens += stream
            pages.append(np.full(sum(sizes), page))
            parts.append(np.repeat(numbers, sizes))
            n, part = n + sum(sizes), int(numbers[-1]) + 1
        tokens, pages, parts = np.concatenate(tokens), np.concatenate(pages), np.concatenate(parts)
        hits = np.sort(repeated_starts(tokens, pages, long, parts))
        codes = np.empty(0, dtype=np.uint64)
        starts = _whole(parts, long) if group["pieces"].iloc[0] > 1 else codes.astype(np.int64)
        if len(starts):
            codes = np.zeros(len(starts), dtype=np.uint64)
            for k in range(long):
                codes = mix(codes * np.uint64(0xD1342543DE82EF95) + tokens[starts + k])
        out = []
        for (at, size, found, sizes), host, content in zip(rows, group["host"], group["content"], strict=True):
            begins = np.cumsum([0, *sizes[:-1]])
            mine = [i for i, b in enumerate(found) if b["place"] == OPEN and sizes[i]]
            own = slice(*np.searchsorted(starts, (at, at + size)))
            if mine or own.start < own.stop:
                hit = hits[slice(*np.searchsorted(hits, (at, at + size)))] - at if mine else hits[:0]
                open_blocks = [(found[i]["number"], int(begins[i]), sizes[i]) for i in mine]
                columns = [list(c) for c in zip(*open_blocks, strict=True)] if mine else [[], [], []]
                out.append((host, content, *columns, hit.tolist(), (starts[own] - at).tolist(), codes[own].view(np.int64).tolist()))
        return pd.DataFrame(out, columns=["host", "content", "number", "begin", "size", "hits", "at", "code"])

    return run


def _dropped(verdict: DataFrame, long: int, share: float) -> DataFrame:
    """``verdict`` with drop: the open blocks of which repeats, those of the array and ``more``, cover ``share`` of the tokens."""

    def make():
        def compute(*columns):
            out = []
            for number, begin, size, hits, more in zip(*columns, strict=True):
                starts = np.array([*hits, *(more or [])], dtype=np.int64)
                n = max([b + s for b, s in zip(begin, size, strict=True)] + [int(starts.max()) + long if len(starts) else 0])
                covered = _covered(n, starts, long)
                out.append([k for k, b, s in zip(number, begin, size, strict=True) if covered[b : b + s].mean() >= share])
            return [out]

        return compute

    inputs = ["number", "begin", "size", "hits", "more"]
    return append_columns(verdict, inputs, [("drop", T.ArrayType(T.IntegerType()))], make)


def extract_text(
    pages: DataFrame, long: int = LONG, share: float = COVERED, piece_tokens: int = PIECE_TOKENS
) -> DataFrame:
    """page_id, url, text and n_chars per row of ``pages`` (page_id, url, html).

    ``text`` joins the kept blocks by one newline; white space inside a block,
    line breaks included, is one space.  Kept are the blocks of the article
    (``article`` or ``main``) less what is marked as chrome inside, and of those
    outside article and chrome the ones that repeats do not cover, whether the
    page has an article or not.  A repeat has at least ``long`` tokens and
    stands on pages of the host with different html; repeated rows are one
    content and do not erase each other.  Null, empty and textless pages give an
    empty text.  Pages without a host form a host of their own.  An empty table
    gives an empty result.  Other columns are ignored.

    Only token streams outside articles go to the suffix arrays, so a host's
    group is small; a host with more than ``piece_tokens`` is dealt to several
    arrays, and all windows of its pages meet once more by their hashes, so that
    the result does not depend on how pages are dealt.
    """
    content = F.unhex(F.md5(F.coalesce("html", F.lit("")).cast("binary")))
    parsed = _parsed(pages.select("page_id", "url", "html"))
    parsed = stored(parsed.withColumns({"host": _host(F.col("url")), "content": content}).drop("html"), "pages")
    sizes = parsed.groupBy("host", "content").agg(F.max("n_tokens").alias("n")).groupBy("host").agg(F.sum("n").alias("n"))
    sizes = sizes.select("host", ((F.col("n") / piece_tokens).cast("int") + 1).alias("pieces"))
    numbered = F.transform(
        "blocks", lambda b, i: F.struct(b["place"].alias("place"), b["text"].alias("text"), i.alias("number"))
    )
    streams = parsed.where("n_tokens > 0").select(
        "host", "content", F.filter(numbered, lambda b: b["place"] != ARTICLE).alias("blocks")
    )
    dealt = streams.dropDuplicates(["host", "content"]).join(sizes, "host")
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("content"), "pieces"))
    # Dealt by both keys, or the join's partitions by host would be taken as they are.
    verdict = dealt.repartition("host", "piece").groupBy("host", "piece").applyInPandas(
        _judged(long),
        "host string, content binary, number array<int>, begin array<int>, size array<int>, hits array<int>, at array<int>, code array<long>",
    )
    verdict = stored(verdict, "blocks")
    asks = F.size("number") > 0
    codes = verdict.select("host", "content", asks.alias("asks"), F.explode(F.arrays_zip("at", "code")).alias("x"))
    codes = codes.select("host", "content", "asks", "x.at", "x.code")
    met = codes.groupBy("host", "code").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a < b")
    more = codes.where("asks").join(met, ["host", "code"], "left_semi").groupBy("host", "content").agg(F.collect_list("at").alias("more"))
    drop = _dropped(verdict.where(asks).drop("at", "code").join(more, ["host", "content"], "left"), long, share)
    undecided = F.exists("blocks", lambda b: b["place"] == OPEN)
    plain = parsed.where(~undecided).select("page_id", "url", F.expr(f"filter(blocks, b -> b.place = {ARTICLE})").alias("kept"))
    others = parsed.where(undecided).join(drop.select("host", "content", "drop"), ["host", "content"], "left").select(
        "page_id",
        "url",
        F.expr(
            f"filter(blocks, (b, i) -> b.place = {ARTICLE} OR b.place = {OPEN} AND NOT array_contains(coalesce(drop, array()), i))"
        ).alias("kept"),
    )
    text = F.array_join(F.transform("kept", lambda b: b["text"]), "\n")
    found = plain.unionByName(others).select("page_id", "url", text.alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
