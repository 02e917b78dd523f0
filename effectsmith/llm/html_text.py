"""Main text of pages by a suffix array per host.

Each page is read into blocks with the place they stand in: inside an article (or main), inside a part
that HTML itself names as furniture (nav, header, footer, aside, form, adverts, notices, comments ...),
or neither. The token streams of a host's pages, all blocks of them, are concatenated and a suffix array
over them, built by prefix doubling, shows on how many different pages each substring of MIN_RUN tokens
stands. Tokens covered by runs that stand on enough pages are boilerplate and are removed; the unique
runs stay. How many pages are enough depends on the place: for a loose block MIN_PAGES and the share
LOOSE_SHARE of the host's pages, inside an article MIN_PAGES and ARTICLE_SHARE (a passage that a few
articles share is a copied article, one on half of all pages is a template), for furniture none: it is
boilerplate wherever it stands. Loose unique runs of a page with an article are main text only if they
have more words than what is left of the article (a teaser).

A host of at most SLICE pages is one array. A larger one, such as a host with a third of all pages, is
dealt by a hash of the page to slices of about SLICE pages. A run on a share of the host's pages stands
on that share of the pages of at least one slice, so the slices' arrays give all candidates; the
candidates' pages are counted over the whole host by a partial-aggregated grouped sum, and what is
decided goes back to all slices. So neither slices nor partitions change a result, and no array grows
with the data.

Defined results: null or empty html gives empty text; a page whose url has no host (null url) is
a host of its own; repeated rows are extracted each, and rows of equal id and html count as one page; an empty table gives an empty result.
Only page_id, url and html are read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectsmith.functions.lineage import written

MIN_RUN = 6
MIN_PAGES = 3
LOOSE_SHARE, ARTICLE_SHARE = 0.01, 0.5
SLICE = 1000
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WINDOW = 1 << 16
# Elements of HTML by what they do to text.
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table"
    " tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav header footer aside form menu dialog button select option input label fieldset head".split())
CORE = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo banner cookie cookies consent gdpr notice notices"
    " newsletter subscribe subscription popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget"
    " footer header masthead comment comments disqus replies reply respond share sharing social related recommended login signup"
    " toolbar pagination pager skip".split()
)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
NAME_PARTS = re.compile(r"[a-z]+")
CLOSED_BY = {"p": BLOCK - {"body", "html"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option", "optgroup"])}
LOOSE, ARTICLE, BOILER = 0, 1, 2


def is_furniture(tag: str, attributes: str) -> bool:
    if tag in FURNITURE:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            if value in ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif any(part in MARKS for part in NAME_PARTS.findall(value)):
            return True
    return False


known_furniture = lru_cache(1 << 14)(is_furniture)


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(place, text) of every block with text, in page order."""
    out: list[tuple[int, str]] = []
    if not page:
        return out
    stack: list[tuple[str, int]] = []
    place = LOOSE
    parts: list[str] = []
    at = 0
    raw_until = ""

    def flush() -> None:
        text = parts[0] if len(parts) == 1 else "".join(parts)
        parts.clear()
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text:
            out.append((place, text))

    for m in TAG.finditer(page):
        data, closing, name, attributes = m.groups()
        tag = name.lower() if name else ""
        if raw_until:
            if closing and tag == raw_until:
                raw_until, at = "", m.end()
            continue
        start, end = m.span()
        if start > at:
            parts.append(page[at:start])
        at = end
        if not tag:
            if data:
                parts.append(html.escape(data))
            continue
        block = tag in BLOCK
        if block:
            if parts:
                flush()
        elif tag == "br":
            parts.append(" ")
        if closing:
            if stack and stack[-1][0] == tag:
                stack.pop()
                place = stack[-1][1] if stack else LOOSE
                continue
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if not block and any(t in BLOCK for t, _ in stack[depth + 1 :]):
                        break
                    del stack[depth:]
                    place = stack[-1][1] if stack else LOOSE
                    break
            continue
        if tag in RAW:
            if attributes.endswith("/") and tag in ("svg", "math"):
                continue
            found = RAW_END[tag].search(page, at)
            if found is None:
                at = len(page)
                break
            raw_until = tag
            at = found.start()
            continue
        if block:
            for depth in range(len(stack) - 1, -1, -1):
                top = stack[depth][0]
                if top in CLOSED_BY:
                    if tag in CLOSED_BY[top]:
                        del stack[depth:]
                        place = stack[-1][1] if stack else LOOSE
                    break
                if top in BLOCK:
                    break
        if tag in VOID or attributes.endswith("/"):
            continue
        if place == BOILER or tag in FURNITURE or (attributes and (known_furniture if len(attributes) < 200 else is_furniture)(tag, attributes)):
            inner = BOILER
        elif tag in CORE:
            inner = ARTICLE
        else:
            inner = place
        if inner != place and not block:
            inner = place if inner != BOILER else BOILER
            if parts:
                flush()
        stack.append((tag, inner))
        place = inner
    if not raw_until and at < len(page):
        parts.append(page[at:])
    if parts:
        flush()
    return out


def stable_order(key: np.ndarray) -> np.ndarray:
    """As a stable argsort; where 63 bits hold key and place, they are sorted together, which is several times faster."""
    n = len(key)
    low, bits = (key.min(), n.bit_length()) if n else (0, 0)
    if n and int(key.max() - low).bit_length() + bits < 63:
        both = (key - low << bits) | np.arange(n)
        both.sort()
        return both & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


def suffix_array(stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` tokens, and the rank of each; equal rank, equal prefix.

    Prefix doubling: ranks by one token, then by 2, 4 ... tokens, each round from pairs of earlier ranks. A rank
    is the place where its group of equal prefixes begins, so only groups of several suffixes are sorted again.
    """
    n = len(stream)
    order = stable_order(stream)
    rank = np.empty(n, dtype=np.int64)
    slots, suffixes, key = np.arange(n), order, stream[order]
    have = 1
    while True:
        first = np.ones(len(slots), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        rank[suffixes] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        if have >= depth:
            return order, rank
        shared = ~first
        shared[:-1] |= shared[1:]
        slots, suffixes = slots[shared], suffixes[shared]
        step = min(have, depth - have)
        after = suffixes + step
        key = rank[suffixes] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = stable_order(key)
        suffixes, key = suffixes[by], key[by]
        order[slots] = suffixes
        have += step


def run_pages(stream: np.ndarray, page: np.ndarray, min_run: int = MIN_RUN) -> np.ndarray:
    """For every token, the number of different pages on which the ``min_run`` tokens from it stand.

    Block ends are tokens that occur once, so no run crosses a block.
    """
    n = len(stream)
    if n < min_run:
        return np.ones(n, dtype=np.int64)
    order, rank = suffix_array(stream, min_run)
    sorted_rank, sorted_page = rank[order], page[order]
    start = np.ones(n, dtype=bool)
    start[1:] = sorted_rank[1:] != sorted_rank[:-1]
    group = np.cumsum(start) - 1
    # pages of one group: positions stand in stream order inside it, so a page's positions are together
    new_page = start.copy()
    new_page[1:] |= sorted_page[1:] != sorted_page[:-1]
    pages = np.empty(n, dtype=np.int64)
    pages[order] = np.bincount(group, weights=new_page).astype(np.int64)[group]
    return pages


def covered(starts: np.ndarray, min_run: int = MIN_RUN) -> np.ndarray:
    """Mask of the tokens in a run of ``min_run`` tokens that starts where ``starts`` is true."""
    n = len(starts)
    chosen = np.flatnonzero(starts)
    edge = np.bincount(chosen, minlength=n + min_run) - np.bincount(chosen + min_run, minlength=n + min_run)[: n + min_run]
    return np.cumsum(edge[:n]) > 0


Block = tuple[int, str]


def window_codes(lines: str) -> np.ndarray:
    """32-bit hash of every word of the lines, never 0, and a 0 behind each line; all lines end with a line end.

    A multilinear hash: the sum of the word's bytes, each times a 64-bit number of its place in the word.
    """
    raw = np.frombuffer(lines.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10))
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    weight = np.arange(1, int(place.max()) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        weight = (weight ^ (weight >> np.uint64(shift))) * np.uint64(factor)
    value = (weight ^ (weight >> np.uint64(31)))[place]
    value *= raw.astype(np.uint16) + np.uint16(1)
    value[ends] = 0
    line_end = raw[ends] == 10
    out = np.zeros(len(ends) + int(line_end.sum()), dtype=np.uint32)
    out[np.arange(len(ends)) + np.cumsum(line_end) - line_end] = np.maximum(np.add.reduceat(value, starts) >> np.uint64(32), 1)
    return out


def codes_of(texts: list[str]) -> np.ndarray:
    """Word hashes of the texts (of blocks), a 0 behind each text; WINDOW characters or one text at a time."""
    windows: list[list[str]] = []
    size = WINDOW
    for text in texts:
        if size >= WINDOW:
            windows.append([])
            size = 0
        windows[-1].append(text)
        size += len(text)
    return np.concatenate([np.zeros(0, dtype=np.uint32), *(window_codes("\n".join([*w, ""])) for w in windows)])


def with_ends(tokens: np.ndarray) -> np.ndarray:
    """Tokens with block ends (0) made negative and unique."""
    stream = tokens.astype(np.int64)
    ends = np.flatnonzero(stream == 0)
    stream[ends] = -1 - np.arange(len(ends))
    return stream


def run_hashes(stream: np.ndarray, min_run: int = MIN_RUN) -> np.ndarray:
    """64-bit hash of the ``min_run`` tokens from every token (as far as the stream goes)."""
    n = max(len(stream) - min_run + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min_run):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + stream[k : k + n].astype(np.uint64)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def whole_runs(stream: np.ndarray, min_run: int = MIN_RUN) -> np.ndarray:
    """Mask of the tokens from which ``min_run`` tokens stand inside one block."""
    ends = np.concatenate([[0], np.cumsum(stream < 0)])
    n = max(len(stream) - min_run + 1, 0)
    return ends[min_run : min_run + n] == ends[:n]


def needed(share: float, n_pages: int, min_pages: int = MIN_PAGES) -> int:
    return max(min_pages, math.ceil(share * n_pages - 1e-9))


def texts_of(pages: list[tuple[object, list[Block]]], n_pages: int | None = None, known: tuple[np.ndarray, np.ndarray] | None = None, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> list[str]:
    """Main text of the pages (page, blocks) of one host, or of a slice of it.

    Of a slice ``n_pages`` is the number of the whole host's pages and ``known`` has ascending hashes of its
    runs on enough pages and the number of their pages; else both come from the pages given.
    """
    number: dict[object, int] = {}
    who = [number.setdefault(page, len(number)) for page, _ in pages]
    stream = with_ends(codes_of([text for _, blocks in pages for _, text in blocks]))
    ends = np.flatnonzero(stream < 0)
    firsts = np.concatenate([[0], ends + 1])[:-1]
    lengths = ends - firsts + 1
    of_place = np.repeat(np.array([place for _, blocks in pages for place, _ in blocks], dtype=np.int64), lengths)
    if known is None:
        n_pages = len(number)
        owner = np.repeat(np.array(who, dtype=np.int64), [len(blocks) for _, blocks in pages])
        count = run_pages(stream, np.repeat(owner, lengths), min_run)
    else:
        runs, held = known
        count = np.ones(len(stream), dtype=np.int64)
        if len(runs):
            own = run_hashes(stream, min_run)
            at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
            count[: len(own)] = np.where((runs[at] == own) & whole_runs(stream, min_run), held[at], 1)
    enough = np.where(of_place == ARTICLE, needed(ARTICLE_SHARE, n_pages, min_pages), needed(LOOSE_SHARE, n_pages, min_pages))
    boilerplate = covered(count >= enough, min_run) | (of_place == BOILER)
    upto = np.concatenate([[0], np.cumsum(boilerplate)])
    sizes = zip(firsts.tolist(), ends.tolist(), (upto[ends] - upto[firsts]).tolist(), strict=True)
    out = []
    for _, blocks in pages:
        kept: list[tuple[int, str]] = []
        words_in = [0, 0, 0]
        for (place, text), (first, end, gone) in zip(blocks, sizes, strict=False):
            if gone == end - first:
                continue
            if gone:
                text = " ".join(w for w, c in zip(text.split(" "), boilerplate[first:end].tolist(), strict=True) if not c)
            kept.append((place, text))
            words_in[place] += end - first - gone
        whole = words_in[ARTICLE] < words_in[LOOSE]
        out.append(" ".join(text for place, text in kept if whole or place == ARTICLE))
    return out


def main_texts(pages: list[tuple[object, str | None]], min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> list[str]:
    """Main text of the pages (id, html) of one host."""
    return texts_of([((page_id, source), blocks_of(source)) for page_id, source in pages], min_run=min_run, min_pages=min_pages)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            found = [blocks_of(source) for source in part.column("html").to_pylist()]
            codes = codes_of([text for blocks in found for _, text in blocks])
            block_ends = np.concatenate([[0], np.flatnonzero(codes == 0) + 1])
            offsets = block_ends[np.cumsum([0, *map(len, found)])]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes.view(np.int32)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("host", "slice", "page")), lists], ["host", "slice", "page", "codes"])


def _tokens(codes: pa.ListArray) -> list[np.ndarray]:
    """The codes of every page, block ends 0."""
    offsets = codes.offsets.to_numpy()
    values = codes.values.to_numpy().view(np.uint32)
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _slices(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Consecutive rows of equal host and slice: about SLICE pages."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(_tokens(batch.column(c)) if c == "codes" else batch.column(c).to_pylist() for c in columns), strict=True):
            if group and group[0][:2] != row[:2]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _slices(batches, ["host", "slice", "page", "codes"]):
        pages = {row[2]: row[3] for row in group}
        stream = with_ends(np.concatenate(list(pages.values())))
        count = run_pages(stream, np.repeat(np.arange(len(pages)), [len(c) for c in pages.values()]))
        own = run_hashes(stream)
        chosen = np.unique(own[(count[: len(own)] >= math.ceil(LOOSE_SHARE * len(pages) - 1e-9)) & whole_runs(stream)])
        yield pa.RecordBatch.from_arrays([pa.array([group[0][0]] * len(chosen), pa.string()), pa.array(chosen, pa.int64())], ["host", "run"])


def _page_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            pages = _tokens(part.column("codes"))
            stream = with_ends(np.concatenate(pages))
            inside = np.flatnonzero(whole_runs(stream))  # pages end with a block's end, so no run crosses them
            owner = pa.array(np.repeat(np.arange(len(pages)), [len(p) for p in pages])[inside])
            runs = pa.array(run_hashes(stream)[inside], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("host").take(owner), part.column("page").take(owner), runs], ["host", "page", "run"])


def decided(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(host, n, slices, runs, counts): the runs on enough pages of each host of many slices.

    ``rows``: (host, slice, page, html) of these hosts. A run needs LOOSE_SHARE of the pages, so a host's
    runs are at most 1 / LOOSE_SHARE times the tokens of a mean page.
    """
    coded = rows.mapInArrow(_coded, "host string, slice long, page long, codes array<int>")
    sliced = coded.repartition("host", "slice").sortWithinPartitions("host", "slice", "page")
    candidates = written(sliced.mapInArrow(_candidates, "host string, run long").distinct(), "html-candidates")
    met = coded.select("host", "page", "codes").mapInArrow(_page_runs, "host string, page long, run long").join(candidates, ["host", "run"], "left_semi")
    counted = met.groupBy("host", "run").agg(F.count_distinct("page").alias("pages")).join(hot, "host")
    enough = counted.filter(F.col("pages") >= F.greatest(F.lit(MIN_PAGES), F.ceil(F.lit(LOOSE_SHARE) * F.col("n") - 1e-9)))
    lists = enough.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("run", "pages"))).alias("r")).select("host", F.col("r.run").alias("runs"), F.col("r.pages").alias("counts"))
    return hot.join(lists, "host", "left")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [blocks_of(source) for source in batch.column("html").to_pylist()]
        # furniture of hosts of many slices has been counted and is never main text
        found = [[b for b in blocks if b[0] != BOILER] if hot else blocks for blocks, hot in zip(found, batch.column("hot").to_pylist(), strict=True)]
        columns = [pa.array([[p for p, _ in b] for b in found], pa.list_(pa.int32())), pa.array([[t for _, t in b] for b in found], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "slice", "page", "page_id", "url")), *columns], ["host", "slice", "page", "page_id", "url", "places", "texts"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _slices(batches, ["host", "slice", "page", "page_id", "url", "places", "texts", "n", "runs", "counts"]):
        n_pages = known = None
        if group[0][7] is not None:  # what is decided about the host comes first
            n_pages, known = group[0][7], tuple(np.array(x or [], dtype=np.int64) for x in group[0][8:10])
            group = group[1:]
        texts = texts_of([(row[2], list(zip(row[5], row[6], strict=True))) for row in group], n_pages, known)
        for start in range(0, len(group), 1000):
            part, text = group[start : start + 1000], texts[start : start + 1000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.string()),
                    pa.array(text, pa.string()),
                    pa.array([len(t) for t in text], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )


def extracted(pages: DataFrame, slice_pages: int = SLICE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    host, page = F.lower(F.regexp_extract("url", r"^[\s\S]*?://([^/?#]*)", 1)), F.xxhash64("page_id", "html")
    own = F.concat(F.lit("/"), page.cast("string"))  # no host has a slash
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.when(host != "", host).otherwise(own).alias("host"), page.alias("page"), "html")
    sizes = rows.groupBy("host").agg(F.count_distinct("page").alias("n"))
    hot = written(sizes.filter(F.col("n") > slice_pages).withColumn("slices", F.ceil(F.col("n") / slice_pages)), "html-hosts")
    dealt = rows.join(hot, "host", "left").withColumn("slice", F.when(F.col("slices").isNull(), F.lit(0)).otherwise(F.pmod("page", F.col("slices"))).cast("long"))
    known = decided(dealt.filter("slices is not null").select("host", "slice", "page", "html"), hot)
    first = known.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "n", "runs", "counts")
    texts = dealt.select("host", "slice", "page", "page_id", "url", "html", F.col("slices").isNotNull().alias("hot")).mapInArrow(
        _parsed, "host string, slice long, page long, page_id long, url string, places array<int>, texts array<string>"
    )
    every = texts.unionByName(first, allowMissingColumns=True).repartition("host", "slice")
    return every.sortWithinPartitions("host", "slice", F.col("n").isNull(), "page").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
