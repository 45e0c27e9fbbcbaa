"""Main text of web pages by deducing each host's template from its pages.

1. Every page is cut into tokens: tags and text blocks, told apart by their path of open elements. Per (host, token),
   Spark sums an order-free fingerprint of the token's occurrence vector, that is, of its count on each page.
2. Tokens of a host with equal vectors that occur on enough pages form an equivalence class. A second pass checks every
   class on every page: its tokens must come in one order, repeated as a whole, and within one gap of the host's root
   class (the one that occurs once on every page). Classes that hold everywhere are nested into the template.
3. What is left between template tokens are slots; the slots of the article are the main text. Slots below elements
   that never hold it (menus, page headers and footers, sidebars, notices, adverts, forms, scripts, comments) are left
   out. Text that belongs to the template is left out only on pages without an article or main element, and there only
   where the page's own text outweighs it, so copies of one page on a host, however many, keep their text.

Templates are joined to the pages by host. They are small, written to the shared folder first, so Spark broadcasts
them when their size allows it and else shuffles, splitting hot hosts. Whole pages are read; nothing is gathered per
host but its template, whose tokens each occur on at least ``SHARE`` of the host's pages.

Defined cases: null or empty html gives an empty text; a null URL or one without a host belongs to the host ``""``;
a host of one page has no template; broken or unclosed markup is read as far as it goes. Repeated rows
give repeated rows, empty tables empty tables. Columns named like the result's are replaced, all others stay.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.tables import lean, stored
from geoloom.llm.urls import host_of

#: Share of a host's pages that a class must occur on, and that text must occur on to be template text.
SHARE, TEXT_SHARE = 0.5, 0.9
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
NEVER = frozenset("head title nav header footer aside form script style noscript template iframe object svg button "
                  "select textarea dialog menu".split())
NEVER_CLASS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent "
                        "cookie cookies dialog disqus footer header masthead menu modal nav navbar navigation "
                        "newsletter notice notices popup promo related share sidebar social sponsor sponsored "
                        "subscribe toolbar widget".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>?|<\?[^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile("[a-z]+")


def _mark(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little",
                          signed=True)


def _boilerplate(name: str, names: str) -> bool:
    if name in NEVER:
        return True
    if not names or name in ("html", "body"):
        return False
    if name in ("article", "main"):
        return bool({"comment", "ad", "advert"} & set(names.lower().split()))
    return any(w in NEVER_CLASS for w in _WORD.findall(names.lower()))


def page_tokens(html: str) -> list[tuple[int, str | None, int, bool]]:
    """Tokens of a page in order: (token, text of a block or null, 1 below an article, 2 below a main element, whether
    an element around it never holds main text)."""
    out: list[tuple[int, str | None, int, bool]] = []
    # Open elements: name, path, depth of articles and mains around it, whether it is boilerplate.
    stack: list[tuple[str, str, int, bool]] = [("", "", 0, False)]
    pieces: list[str] = []
    block = stack[0]

    def close_block() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((_mark("text", block[1], text), text, block[2], block[3]))
            pieces.clear()

    def pop(name: str) -> None:
        while stack[-1][0] != name:
            stack.pop()
        stack.pop()

    for found in _TOKEN.finditer(html):
        name = found[3]
        if name is None:
            part = found[0]
            if part[0] != "<" or part == "<":
                if not pieces:
                    block = stack[-1]
                elif stack[-1][3] != block[3]:  # an inline element that is boilerplate, or its end
                    close_block()
                    block = stack[-1]
                pieces.append(entities.unescape(part) if "&" in part else part)
            continue
        name = name.lower()
        if name == "br":
            pieces.append(" ") if pieces else None
            continue
        inline = name in INLINE
        if not inline:
            close_block()
        if found[2]:
            if any(x[0] == name for x in stack):
                out.append((_mark("close", stack[-1][1] if stack[-1][0] == name else name), None, 0, False))
                pop(name)
            continue
        if not inline:
            for x in reversed(stack):  # an open paragraph or item ends where the next block (or item) begins
                if x[0] == "p" and name not in VOID or x[0] == name and name in ("li", "dt", "dd", "tr", "td", "option"):
                    pop(x[0])
                    break
                if x[0] not in INLINE and x[0] != "p":
                    break
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(found[4])) if "=" in found[4] else ""
        above = stack[-1]
        path = f"{above[1]}/{name}" if inline or not names else f"{above[1]}/{name}.{names}"
        dropped = above[3] or _boilerplate(name, names)
        out.append((_mark("open", path), None, 0, dropped))
        if name not in VOID and not found[4].endswith("/"):
            stack.append((name, path, above[2] | (1 if name == "article" else 2 if name == "main" else 0), dropped))
    close_block()
    return out


def main_text(tokens: list[tuple[int, str | None, int, bool]], template: frozenset[int] = frozenset()) -> str:
    """The blocks of the article's slots, without boilerplate, all of them where the page adds any to the template; else
    those of the main element's slots; else, on pages without either, all blocks of the page, without template text
    where the page's own text outweighs it, in blocks or characters."""
    blocks = [(text, where, token in template) for token, text, where, dropped in tokens
              if text is not None and not dropped]
    whole: list[str] = []
    for level in (1, 2):
        held = [(text, shared) for text, where, shared in blocks if where & level]
        if not all(shared for _, shared in held):
            return " ".join(t for t, _ in held)
        whole = whole or [t for t, _ in held]
    if whole:
        return " ".join(whole)
    own, taken = ([t for t, _, shared in blocks if shared == side] for side in (False, True))
    if own and (len(own) >= len(taken) or sum(map(len, own)) >= sum(map(len, taken))):
        return " ".join(own)
    return " ".join(t for t, _, _ in blocks)


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """Per (host, token) of columns host, page and html: pages it occurs on, its occurrences, whether it is text, and
    the fingerprint of its occurrence vector. Token 0 stands for the page itself."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list] = {}
            for host, page, html in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), _texts(batch.column(2))):
                counts: dict[int, list] = {0: [1, False]}
                for token, text, _, _ in page_tokens(html):
                    counts.setdefault(token, [0, text is not None])[0] += 1
                for token, (n, is_text) in counts.items():
                    entry = sums.setdefault((host, token), [0, 0, is_text, 0])
                    entry[0] += 1
                    entry[1] += n
                    entry[3] ^= _mark(str(page), str(n))
            rows = [(h, t, *v) for (h, t), v in sums.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), _VECTOR)] if rows else [pa.array([], k) for k in _VECTOR],
                ["host", "token", "pages", "n", "is_text", "vector"])

    parts = pages.mapInArrow(count, "host string, token bigint, pages bigint, n bigint, is_text boolean, vector bigint")
    return parts.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.max("is_text").alias("is_text"),
        F.bit_xor("vector").alias("vector"))


_VECTOR = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]


def candidate_classes(vectors: DataFrame) -> DataFrame:
    """Per host, its tokens that occur on enough pages, with their class (vector) and whether it is the root's."""
    hosts = vectors.where("token = 0").select("host", F.col("pages").alias("all_pages"),
                                              F.col("vector").alias("root"))
    # Most tokens occur on one page only; they go before the join deals rows by host.
    frequent = vectors.where("token <> 0 AND pages >= 2").join(hosts, "host").where(
        F.col("pages") >= F.col("all_pages") * F.when(F.col("is_text"), TEXT_SHARE).otherwise(SHARE))
    return frequent.groupBy("host").agg(F.collect_list(F.struct(
        "token", F.col("vector").alias("class"), (F.col("vector") == F.col("root")).alias("is_root"))).alias("tokens"))


def valid_classes(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Classes (host, class) whose order, and place between the root class's tokens, is the same on every page."""

    @lean
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int], tuple[int, int]] = {}
            for host, html, listed in zip(_texts(batch.column(0)), _texts(batch.column(1)), batch.column(2)):
                of = {x["token"]: (x["class"], x["is_root"]) for x in listed.as_py()}
                size: dict[int, int] = {}
                for of_class, _ in of.values():
                    size[of_class] = size.get(of_class, 0) + 1
                runs: dict[int, list] = {}
                gap = 0
                for token, _, _, _ in page_tokens(html):
                    if token in of:
                        of_class, is_root = of[token]
                        gap += is_root
                        runs.setdefault(of_class, []).append((token, 0 if is_root else gap))
                for of_class, run in runs.items():
                    n = size[of_class]
                    first = [t for t, _ in run[:n]]
                    ok = len(run) % n == 0 and all(t == first[i % n] for i, (t, _) in enumerate(run)) and all(
                        len({g for _, g in run[i: i + n]}) == 1 for i in range(0, len(run), n))
                    order = _mark(*map(str, first)) if ok else 0
                    low, high = seen.get((host, of_class), (order, order))
                    seen[host, of_class] = min(low, order), max(high, order)
            rows = [(h, c, *v) for (h, c), v in seen.items()]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds],
                ["host", "class", "low", "high"])

    joined = pages.join(candidates, "host").select("host", "html", "tokens")
    return joined.mapInArrow(check, "host string, class bigint, low bigint, high bigint").groupBy("host", "class").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).where("low = high AND low <> 0").select("host", "class")


def templates(pages: DataFrame) -> DataFrame:
    """Per host, the tokens of its template, from columns host, page and html."""
    # Stored, as it is read twice, and the pages would be cut into tokens for each.
    vectors = stored(occurrence_vectors(pages), "vectors")
    candidates = stored(candidate_classes(vectors), "classes")
    valid = valid_classes(pages, candidates)
    tokens = candidates.select("host", F.explode("tokens").alias("t")).select("host", "t.token", "t.class")
    return stored(tokens.join(valid, ["host", "class"]).groupBy("host").agg(
        F.collect_list("token").alias("template")), "templates")


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text",
                 chars: str = "n_chars") -> DataFrame:
    """Adds the main text of every page and its number of code points."""
    host = host_of(F.col(f"`{url}`"))
    page = F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns if c != html] or [F.lit(0)])
    read = pages.select(host.alias("host"), page.alias("page"), F.col(f"`{html}`").alias("html"))

    @lean
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[int, frozenset[int]] = {}
        for bodies, listed in batches:
            found = []
            for body, tokens in zip(bodies.to_pylist(), listed.to_pylist()):
                key = hash(tuple(tokens)) if tokens else 0
                if key not in known:
                    known.clear()
                    known[key] = frozenset(tokens or ())
                found.append(main_text(page_tokens(body or ""), known[key]))
            yield pa.array(found, pa.string())

    apply = F.arrow_udf(run, "string")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (text, chars)]
    given = pages.select(F.struct(*kept).alias("kept"), host.alias("host"), F.col(f"`{html}`").alias("html"))
    joined = given.join(templates(read), "host", "left")
    done = joined.select("kept", apply("html", "template").alias("text"))
    return done.select("kept.*", F.col("text").alias(text), F.length("text").cast("long").alias(chars))
