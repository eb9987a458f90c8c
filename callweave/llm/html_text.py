"""HTML extraction: the article's text, without what its host repeats, by a suffix array over the pages of a host.

A page is read as a stream of blocks.  Text inside elements that hold no article text (menus, forms, scripts, adverts,
notices, comments; see the fixed lists) is out.  What the page itself marks as its article (``article``, or ``main`` and
``role=main`` where articles hold the lesser part of it) are its candidates, on other pages all blocks that are not out.

Pages are then judged by their host, all on one path.  The streams of a host's pages are one text of tokens; its suffixes
are taken at the starts of blocks, and compared down to the end of the block that completes ``RUN`` tokens, so what repeats is whole blocks
and never a part of a sentence.  A run is boilerplate where pages of different bodies share it: copies of an article, also with
some words changed, count as one body, told by two MinHash values of the candidates.  A page of which more than
``COPY`` would go is most likely a copy that those values missed, and loses only what recurs more widely than its main part.
Blocks of a marked article are no part of the streams: lines that many articles share are article text all the same.

Runs are brought together by host and a 64-bit name and counted with map-side combine, so a host with a third of all pages is
no heavier in any task.  Pages are parsed once; candidates and names are stored, and html crosses no exchange.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, sliced, stored

#: Tokens of a run at least; bodies that share boilerplate: so many, this share of those of the host, and of the pages that hold it.
RUN, BODIES, OF_HOST, OF_PAGES = 6, 2, 1 / 200, 1 / 8
#: Share of the candidates' tokens beyond which a page counts as a copy; words of the runs that tell bodies apart.
COPY, SHINGLE = 3 / 4, 5
#: Elements whose text is never article text; blocks; elements that stay open until closed by name.
OUT = frozenset("head script style noscript template nav footer aside form button select textarea option iframe object svg math canvas audio video dialog menu".split())
RAW = frozenset("script style textarea title template iframe noscript xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NESTED = (BLOCKS | OUT | frozenset(["span"])) - frozenset("p li dd dt td th tr tbody thead tfoot hr html body h1 h2 h3 h4 h5 h6".split())
#: Class and id names of notices, adverts, menus and comments, alone or with one another and words of layout.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar comment comments disqus respond reply "
    "replies share sharing social related recommended newsletter subscribe signup cookie cookies consent gdpr notice notices popup modal overlay "
    "breadcrumb breadcrumbs menu nav navbar navigation footer masthead widget pagination pager skip toolbar".split()
)
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
LAYOUT = frozenset(
    "area bar block body bottom box button buttons center col column container content first footer form group header holder icon icons inner item "
    "items last layer left line link links list main module outer page panel primary right row secondary section site slot small social text title top "
    "unit wide wrap wrapper".split()
)
REGIONS = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _hints(names: str) -> frozenset[str]:
    """Hints among class and id names; a name counts where all its parts are hints, words of layout or numbers."""
    found = set()
    for name in names.lower().split():
        parts = [x for x in re.split(r"[_:-]+", name) if x and not x.isdigit()]
        if all(x in HINTS or x in LAYOUT for x in parts):
            found.update(x for x in parts if x in HINTS)
    return frozenset(found)


def _is_out(name: str, attributes: str) -> int:
    """2 for elements that hold no article text or comments, 1 for those that only their class or id tells, else 0."""
    if name in OUT:
        return 2
    if not attributes or not attributes.strip(" /\n\t\r"):
        return 0
    found = _attributes(attributes)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return 2
    hints = _hints(found.get("class", "") + " " + found.get("id", ""))
    if name in ("article", "main", "body", "html") or found.get("role", "").lower() == "main":
        return 2 if name == "article" and hints & COMMENTS else 0
    return 2 if hints & COMMENTS else 1 if hints else 0


def blocks(page: str) -> Iterator[tuple[int, int, str]]:
    """Blocks of text in page order: regions around it (1 main, plus 2 article with 4 times its number), whether it is out, the text.

    Out is 0 for text, 2 for what is out in any case, and the number of the outermost element, negative, for what only its class tells.
    """
    stack: list[tuple[str, int, int, int]] = []  # of open elements: name, out, region, text parts before it
    out, region, parts, at, articles, classed = 0, 0, [], 0, 0, 0

    def flush() -> list[tuple[int, int, str]]:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        return [(region, out, text)] if text else []

    while True:
        m = TOKEN.search(page, at)
        parts.append(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if name == "br":
            parts.append(" ")
        if not name or name in VOID - {"hr"}:
            continue
        if name in BLOCKS or name in OUT:
            yield from flush()
        if m["close"]:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), None)
            # A stray end tag does not end the article around it.
            if depth is None or name not in REGIONS and any(x[0] in REGIONS for x in stack[depth + 1:]):
                continue
            if name == "span" and out:
                del parts[stack[depth][3]:]
            del stack[depth:]
            out, region = stack[-1][1:3] if stack else (0, 0)
            continue
        attributes = m["attributes"]
        hidden = _is_out(name, attributes) or 2 * (name == "header" and region == 0)
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}[\\s/>]|\\Z", re.I).search(page, at)
            if name == "title":
                text = " ".join(html.unescape(page[at:end.start()]).split())
                yield from [(0, 2, text)] if text else []
            at = end.start()
        if name in NESTED:
            is_main = name == "main" or "main" in attributes and _attributes(attributes).get("role", "").lower() == "main"
            if name == "article" and not region & 2:
                articles += 1
                region |= 2 + 4 * articles
            region |= is_main
            classed += hidden == 1
            out = 2 if 2 in (out, hidden) else out or -classed * (hidden == 1)
            stack.append((name, out, region, len(parts)))
    yield from flush()


def read_page(page: str) -> tuple[list[tuple[bool, str]], bool]:
    """Blocks as (whether it is a candidate, text), and whether the page marks its article."""
    found = list(blocks(page))
    main, articles = 0, {}
    for region, out, text in found:
        if region and out < 2:
            main += len(text) * (region & 1)
            articles[region] = articles.get(region, 0) + len(text) * (region >> 1 & 1)
    # An article comes before main if most of what stands in main stands in it, or if it stands outside and holds more.
    # Else articles are teasers, in the text of main or beside it.
    best = 0 if not articles else 2 if any(size * (1 + (region & 1)) > main for region, size in articles.items()) else 1
    held = [region & best if best else 1 for region, _, _ in found]
    size: dict[int, int] = {}
    for within, (_, out, text) in zip(held, found):
        if within and out < 2:
            size[out] = size.get(out, 0) + len(text)
    # What only a class name puts out is no side matter where one element holds most of the text.
    kept = {0} | {out for out, n in size.items() if 2 * n > sum(size.values())}
    return [(bool(within) and out in kept, text) for within, (_, out, text) in zip(held, found)], bool(articles)


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def runs_of(host: str, found: list[tuple[bool, str]], marked: bool, run: int) -> list[tuple[int, int, int]]:
    """Runs of whole blocks that hold ``run`` tokens: name on the host, first candidate, end of the candidates.

    Of a page with a marked article only what stands around it; such runs hold no candidate.
    """
    salt = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))
    sizes = [text.count(" ") + 1 for _, text in found]
    place = np.concatenate(([0], np.cumsum([inside for inside, _ in found]))).tolist()
    out, end, tokens = [], 0, 0
    for start in range(len(found)):
        while end < len(found) and tokens < run:
            tokens += sizes[end]
            end += 1
        if tokens < run:
            break
        if not marked or place[end] == place[start]:
            text = "\n".join(text for _, text in found[start:end])
            out.append((xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), salt) - (1 << 63), place[start], place[end]))
        tokens -= sizes[start]
    return out


def body_of(texts: list[str]) -> list[int]:
    """Two MinHash values of the runs of ``SHINGLE`` words of the candidates, and a hash of all of them."""
    words = " ".join(texts).encode("utf-8", "surrogatepass").split(b" ")
    shingles = {b" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
    least = [min(map(h, shingles)) for h in (xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest)]
    return [x - (1 << 63) for x in (xxhash.xxh3_64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass")), *least)]


def _parsed(batches, run: int):
    kinds = [("host", pa.int64()), ("content", pa.int64()), ("body1", pa.int64()), ("body2", pa.int64()), ("blocks", pa.list_(pa.string())),
             ("runs", pa.list_(pa.struct([("name", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])))]
    for batch in sliced(batches, 256):
        out = {name: [] for name, _ in kinds}
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            (found, marked), host = read_page(page), host_of(url)
            texts = [text for inside, text in found if inside]
            content, body1, body2 = body_of(texts)
            values = (xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass")) - (1 << 63), content, body1, body2, texts,
                      [dict(zip(("name", "first", "end"), r)) for r in runs_of(host, found, marked, run)])
            for (name, _), value in zip(kinds, values):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(out[n], t) for n, t in kinds)],
                                         ["page_id", "url", *(n for n, _ in kinds)])


def unique_blocks(texts: list[str], runs: list[tuple[int, int, int]], spread: dict[int, int]) -> list[str]:
    """Candidates without those that boilerplate runs cover; ``spread`` tells how many bodies share a run."""
    cover = np.zeros(len(texts), np.int64)
    for name, first, end in runs:
        if name in spread:
            cover[first:end] = np.maximum(cover[first:end], spread[name])
    tokens = np.array([text.count(" ") + 1 for text in texts], np.int64)
    beyond = 0
    if tokens[cover > 0].sum() > COPY * tokens.sum():
        order = np.argsort(cover[cover > 0], kind="stable")
        weights = np.cumsum(tokens[cover > 0][order])
        beyond = cover[cover > 0][order][np.searchsorted(weights, weights[-1] / 2)]  # the spread of the middle token
    return [text for text, c in zip(texts, cover.tolist()) if c <= beyond]


def _judged(batches):
    for batch in sliced(batches):
        texts = []
        for blocks_, runs, shared in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            spread = {x["name"]: x["bodies"] for x in shared or ()}
            if spread:
                blocks_ = unique_blocks(blocks_, [(r["name"], r["first"], r["end"]) for r in runs], spread)
            texts.append("\n".join(blocks_))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN) -> DataFrame:
    """``page_id``, ``url``, ``text`` for every row: blocks in page order joined by line feeds, empty if none.

    A page with a marked article keeps all of it; pages without lose the blocks that their host repeats.  Null html is empty; a null or
    odd url is the host "".  Pages of a host with equal candidates count as one for repeats, and near copies mostly as one body.  Rows go through one by one, so null ids and repeated rows are rows like others.
    """
    page = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), page.alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    schema = (f"page_id {kind}, url string, host long, content long, body1 long, body2 long, blocks array<string>, "
              "runs array<struct<name:long,first:int,end:int>>")
    parsed = stored(rows.mapInArrow(lambda b: _parsed(b, run), schema), "parsed")
    # A run of a page, once per host and content.
    held = parsed.select("host", "content", "body1", "body2", F.explode("runs.name").alias("name")).distinct()
    held = stored(held, "runs")
    hosts = parsed.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("of_host"))
    shared = held.groupBy("host", "name").agg(
        F.count_distinct("content").alias("n"), F.count_distinct("body1").alias("bodies1"), F.count_distinct("body2").alias("bodies2"))
    shared = shared.select("host", "name", "n", F.least("bodies1", "bodies2").alias("bodies")).filter(F.col("bodies") >= BODIES)
    shared = shared.filter(F.col("bodies") >= F.col("n") * OF_PAGES).join(hosts, "host").filter(F.col("bodies") >= F.col("of_host") * OF_HOST)
    shared = stored(shared.select("host", "name", "bodies"), "shared")
    mine = held.join(shared, ["host", "name"]).groupBy("host", "content").agg(F.collect_set(F.struct("name", "bodies")).alias("shared"))
    mine = stored(mine, "covered").withColumnsRenamed({"host": "h", "content": "c"})
    # A page none of whose runs holds a candidate cannot lose one: its text crosses no exchange.
    touched = F.exists("runs", lambda r: r["end"] > r["first"])
    columns = ["page_id", "url", "blocks", "runs"]
    judged = parsed.filter(touched).join(mine, (F.col("host") == F.col("h")) & (F.col("content") == F.col("c")), "left").select(*columns, "shared")
    whole = parsed.filter(~touched).select(*columns, F.lit(None).cast(judged.schema["shared"].dataType).alias("shared"))
    release(held, shared)
    return whole.union(judged).mapInArrow(_judged, f"page_id {kind}, url string, text string")
