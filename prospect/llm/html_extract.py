"""Main text of web pages: structure first, then each host's repeated strings.

A page is cut into blocks at block-level tags. A block is *main* inside
``article`` or ``main``; *chrome* inside menus, headers, footers, sidebars,
notices, adverts, forms and comments (by tag, role, class or id, each name taken
as a whole, which may be made of several such words); else *open*. Chrome is
dropped everywhere. An ``article`` whose first block, or a heading, is a link and
nothing else is a teaser for another page, and as open as what is around it; so is
one of bare words, without a paragraph, heading or other block of its own. A page
with a main block marks its article and has its text by that, whatever the lengths:
what it says there is never taken for boilerplate, however many pages repeat it. On
a page without one all blocks but chrome are its text, less what the host's suffix
array finds.

Every page with a host is in its host's suffix array: a marked one by all that
stands outside of its article, one without by all blocks but chrome, and where a
host has a page without, the articles of its other pages are in it too. The
suffixes of the token streams are sorted; substrings of ``LEAST_TOKENS`` or
more that occur on ``LEAST_PAGES`` or more distinct pages are found from the common
prefixes of neighbours. The tokens they cover are boilerplate: unique runs
are kept on pages without an article, and ``n_repeated`` says of any page how many
of the tokens that its text leaves out are covered. Blocks that repeat as a whole are
boilerplate too.

No group is unbounded: the array of a host with up to ``HOST_TOKENS`` tokens is made
by one task. Those of larger hosts are one sorted table, host by host, that Spark
deals out by ranges, so a string that most pages have is many tasks; what neighbours
have in common across two ranges is settled by their first and last runs. It is sorted
``LEAST_TOKENS`` tokens deep, as longer common prefixes decide nothing.

Edge cases: a null or empty page has the empty text; a page cut off anywhere, or
very long, is read as far as it goes; a null or odd address names no host, so no other
page bears witness against its page;
repeated rows are extracted as often as they come and count as one page if they
have one id; an empty table gives no rows. Columns besides ``page_id``, ``url``
and ``html`` are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, encode

LEAST_TOKENS, LEAST_PAGES = 6, 3
#: Tokens of a host up to which one task makes its array, in less than 135 MB; both ways find the same.
HOST_TOKENS = 1 << 18
#: Words of more characters stand in the dealt array by their hash.
LONG_WORD = 32

#: Fixed values of HTML: elements whose content is no text, elements without content, elements that begin and end a block.
RAW = "script|style|noscript|template|iframe|object|svg|select|textarea|title|canvas|audio|video"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CHROME = frozenset("nav aside footer form menu dialog button head search".split())
_CHROME_WORDS = r"ads?|adverts?|advert(?:isement|ising)s?|banner|sponsor(?:ed|s)?|promo(?:tion)?s?|cookies?|consent|gdpr|notices?|notifications?|alerts?|popup|modal|newsletter|subscribe|signup|sidebar|menu|nav|navbar|navigation|breadcrumbs?|comments?|commentlist|replies|disqus|share|sharing|social|footer|header|masthead|toolbar|pagination|pager|contentinfo|complementary|search|login|skip"
#: Classes, ids and roles that name something other than the article: whole names, which may be made of several such words.
NAMED = re.compile(
    r"^(?:(?:page|site|main|global|top|bottom|left|right|user|reader|post|blog)[-_])?"
    rf"(?:{_CHROME_WORDS})"
    rf"(?:[-_](?:{_CHROME_WORDS}|box|bar|notices?|list|links?|menu|nav|container|wrapper|section|area|form|content|inner|signup|popup|modal|buttons?|thread|reply|body|item|\d+))*$"
)
SELF_NAMED = frozenset("html body".split())
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^<>]*(?:>|\Z)""", re.I | re.S
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def _is_chrome(name: str, attributes: str, inside: bool) -> bool:
    if name in CHROME or (name == "header" and not inside):
        return True
    if not attributes or name in SELF_NAMED:
        return False
    # an article's own header stays, whatever its class
    return any(NAMED.match(w) and not (inside and w == "header") for value in _NAMES.findall(attributes) for w in value.lower().strip("\"'").split())


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of the blocks with text, in page order; kind is main, open or chrome."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, begins chrome, begins main
    chrome = main = links = 0
    run: list[str] = []
    plain = False  # whether the run has text outside links
    # the outermost article: how many blocks came before it, whether it is a teaser, and whether it has blocks of its own
    before, teaser, solid = -1, False, False
    heading = 0

    def opened() -> None:
        out[before:] = [("open" if k == "main" else k, t) for k, t in out[before:]]

    def flush() -> None:
        nonlocal plain, teaser, solid
        if run:
            text = "".join(run)
            run.clear()
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append(("chrome" if chrome else "main" if main and not teaser else "open", text))
                if before >= 0 and not chrome and not teaser and not plain and (heading or all(k == "chrome" for k, _ in out[before:-1])):
                    teaser = True
                    opened()
                solid = solid or (before >= 0 and not chrome and next(n for n, _, _ in reversed(stack) if n in BLOCK) != "article")
        plain = False

    def close(down_to: int) -> None:
        nonlocal chrome, main, links, heading, before, teaser, solid
        while len(stack) > down_to:
            n, c, m = stack.pop()
            chrome -= c
            main -= m
            links -= n == "a"
            heading -= n in HEADINGS
            if m and not main:
                if before >= 0 and not solid:
                    opened()
                before, teaser, solid = -1, False, False

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run.append(page[at : m.start()])
            plain = plain or (not links and not page[at : m.start()].isspace())
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in BLOCK:
            flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(n in BLOCK or c or a for n, c, a in stack[i:]):  # the end of an inline element ends no block
                        flush()
                    close(i)
                    break
            continue
        if name in BLOCK and name != "body":
            # an open paragraph ends where a block begins; so does a list item at the next one
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or (stack[i][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if name == "body":
            for i, (open_, _, _) in enumerate(stack):
                if open_ == "head":
                    close(i)
                    break
        attributes = m[4] or ""
        if name in VOID or attributes.endswith("/"):
            continue
        c = _is_chrome(name, attributes, main > 0)
        a = name in ("article", "main") and not c and not chrome
        if c:
            flush()
        stack.append((name, c, a))
        chrome += c
        links += name == "a"
        heading += name in HEADINGS
        if a and not main and name == "article":
            before = len(out)
        elif a and name == "main":
            # all of it counts, whatever stands around or in it
            before, teaser, solid = -1, False, False
        main += a
    if at < len(page):
        run.append(page[at:])
        plain = plain or (not links and not page[at:].isspace())
    flush()
    close(0)
    return out


def marks_article(found: list[tuple[str, str]]) -> bool:
    return any(k == "main" for k, _ in found)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pages in chunks(batches, "html"):
        found = [blocks(p) for p in pages]
        marked = [marks_article(b) for b in found]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("row", "page_id", "url")), pa.array(["\n\n".join(t for k, t in b if k == "main") if m else None for b, m in zip(found, marked)], pa.string()), pa.array([None if m else [t for k, t in b if k != "chrome"] for b, m in zip(found, marked)], pa.list_(pa.string()))],
            ["row", "page_id", "url", "text", "blocks"],
        )


def _streams(batches: Iterator[pa.RecordBatch], articles: bool) -> Iterator[pa.RecordBatch]:
    """The blocks that are in the array: all of a page that marks an article, else all but chrome. An article's are null unless asked for."""
    for batch, pages in chunks(batches, "html"):
        found = [blocks(p) for p in pages]
        plain = [not marks_article(b) for b in found]
        own = [[k == "main" for k, _ in b if k != "chrome" or not p] for b, p in zip(found, plain)]
        texts = [[t if articles or k != "main" else None for k, t in b if k != "chrome" or not p] for b, p in zip(found, plain)]
        tokens = [sum(len(t.split()) for t in x if t) for x in texts]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "page", "host")), pa.array(plain), pa.array(texts, pa.list_(pa.string())), pa.array(own, pa.list_(pa.bool_())), pa.array(tokens, pa.int64())], ["row", "page", "host", "plain", "blocks", "article", "tokens"])


def runs(blocks: list[str | None], article: list[bool]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Runs of tokens between articles that were left out: tokens, and the place of each among those outside of articles, -1 inside."""
    words: list[str] = []
    at: list[int] = []
    n = 0
    for t, inside in zip(chain(blocks, [None]), chain(article, [True])):
        if t is None:
            if words:
                yield words, np.array(at)
                words, at = [], []
            continue
        more = t.split()
        words += more
        at += [-1] * len(more) if inside else range(n, n + len(more))
        n += 0 if inside else len(more)


def places(at: np.ndarray, least: int = LEAST_TOKENS) -> np.ndarray:
    """The place where each window of ``least`` tokens begins; -1 if it reaches into an article."""
    first, last = at[: max(0, len(at) - least + 1)], at[least - 1 :]
    return np.where((first >= 0) & (last - first == least - 1), first, -1)


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order (prefix doubling) and the common prefix of each with the one before."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:] if k < n else second[:0]
        order = np.lexsort((second, rank))
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)]))
        rank, k = new, 2 * k
        if rank.max() == n - 1 or k >= n:
            break
    order = np.argsort(rank, kind="stable")
    common, h = np.zeros(n, np.int64), 0  # Kasai et al.
    values, places, of = s.tolist(), order.tolist(), rank.tolist()
    for i in range(n):
        r = of[i]
        if r:
            j = places[r - 1]
            while i + h < n and j + h < n and values[i + h] == values[j + h]:
                h += 1
            common[r] = h
            h = max(0, h - 1)
        else:
            h = 0
    return order, common


def repeats(streams: list[list[str]], pages: list, least: int = LEAST_TOKENS, least_pages: int = LEAST_PAGES) -> list[np.ndarray]:
    """Where in each stream a substring of ``least`` tokens begins that ``least_pages`` distinct pages have."""
    ids: dict[str, int] = {}
    parts, owner = [], []
    for i, words in enumerate(streams):
        parts.append(np.array([ids.setdefault(w, len(ids)) for w in words] + [-1 - i], np.int64))  # an end that nothing equals
        owner.append(np.full(len(words) + 1, i))
    if not parts:
        return []
    s, own = np.concatenate(parts), np.concatenate(owner)
    found = np.zeros(len(s), bool)
    order, common = suffix_array(s)
    edges = np.diff(np.concatenate([[0], (common >= least).astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
        group = order[a - 1 : b]  # suffixes that share at least ``least`` tokens
        if len({pages[i] for i in own[group].tolist()}) >= least_pages:
            found[group] = True
    return [x[:-1] for x in np.split(found, np.cumsum([len(p) for p in parts])[:-1])]


def _cover(n: int, starts: np.ndarray, least: int = LEAST_TOKENS) -> np.ndarray:
    """Which of ``n`` tokens the substrings of ``least`` tokens that begin at ``starts`` cover."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.subtract.at(marks, starts + least, 1)
    return np.cumsum(marks[:-1]) > 0


def covered(streams: list[list[str]], pages: list, least: int = LEAST_TOKENS, least_pages: int = LEAST_PAGES) -> list[np.ndarray]:
    """Which tokens of each stream stand in a substring of ``least`` tokens or more that ``least_pages`` distinct pages have."""
    return [_cover(len(x), np.flatnonzero(x), least) for x in repeats(streams, pages, least, least_pages)]


def _kept(blocks: list[str], repeated: list[bool], marks: np.ndarray) -> str:
    """The blocks without the repeated ones and without the tokens that are marked."""
    at, kept = 0, []
    for t, r in zip(blocks, repeated):
        words = t.split()
        left = [] if r else [w for w, c in zip(words, marks[at : at + len(words)]) if not c]
        at += len(words)
        if left:
            kept.append(" ".join(left))
    return "\n\n".join(kept)


def _host_array(table: pa.Table) -> pa.Table:
    """(row, pos) of the repeated substrings outside of articles, from the suffix array of one host."""
    streams, at, rows, pages = [], [], [], []
    for row, page, texts, article in zip(*(table.column(c).to_pylist() for c in ("row", "page", "blocks", "article"))):
        for words, where in runs(texts, article):
            streams.append(words)
            at.append(places(where))
            rows.append(row)
            pages.append(page)
    found = [p[x[: len(p)] & (p >= 0)] for p, x in zip(at, repeats(streams, pages))]
    return pa.table({"row": pa.array(np.repeat(np.array(rows, np.int64), [len(x) for x in found]), pa.int64()), "pos": pa.array(np.concatenate([np.empty(0, np.int64), *found]).astype(np.int32))})


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each suffix of ``LEAST_TOKENS`` or more: the tokens that it is sorted by, and its place."""
    for batch in batches:
        keys: list[str] = []
        at, sizes = [np.empty(0, np.int64)], []
        for texts, article in zip(*(batch.column(c).to_pylist() for c in ("blocks", "article"))):
            before = len(keys)
            for words, where in runs(texts, article):
                words = [w if len(w) <= LONG_WORD else f"{w[:8]}\x1f{xxhash.xxh3_128_hexdigest(encode(w))}" for w in words]
                keys.extend(" ".join(words[i : i + LEAST_TOKENS]) for i in range(len(words) - LEAST_TOKENS + 1))
                at.append(places(where))
            sizes.append(len(keys) - before)
        again = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        yield pa.RecordBatch.from_arrays([batch.column("host").take(again), pa.array(keys, pa.string()), batch.column("page").take(again), batch.column("row").take(again), pa.array(np.concatenate(at).astype(np.int32))], ["host", "key", "page", "row", "pos"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated suffixes of a range of the sorted array, one run of equal prefixes after the other.

    A run that begins or ends the range may go on beyond it: where it has too few pages
    here its rows are handed on with their keys, else one row of each of enough pages.
    """
    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        host, key, page = (t.column(c) for c in ("host", "key", "page"))
        n = t.num_rows
        same = pc.and_(pc.equal(host.slice(1), host.slice(0, n - 1)), pc.equal(key.slice(1), key.slice(0, n - 1))).to_numpy(zero_copy_only=False)
        begins = np.concatenate([[True], ~same])
        ids = page.to_numpy()
        other = begins | np.concatenate([[True], ids[1:] != ids[:-1]])
        run = np.cumsum(begins) - 1
        many = np.bincount(run, other) >= LEAST_PAGES
        sure = many[run] & (t.column("pos").to_numpy() >= 0)
        if sure.any():
            yield _bare(t.filter(pa.array(sure)))

        def told(r: int) -> pa.RecordBatch:
            of = np.flatnonzero(run == r)
            return t.take(pa.array(of[other[of]][:LEAST_PAGES] if many[r] else of))

        last = int(run[-1])
        if first and last:
            yield told(0)
            first = False
        held = told(last)
    if held is not None:
        yield held


def _bare(t: pa.RecordBatch) -> pa.RecordBatch:
    """The rows without what only runs across ranges need."""
    return pa.RecordBatch.from_arrays([pa.nulls(t.num_rows, pa.string())] * 2 + [pa.nulls(t.num_rows, pa.int64()), t.column("row"), t.column("pos")], ["host", "key", "page", "row", "pos"])


def _dealt_array(streams: DataFrame) -> DataFrame:
    """(row, pos) as of ``_host_array``, from the arrays of hosts of any size as one sorted table."""
    kinds = "host string, key string, page long, row long, pos int"
    array = streams.select("host", "page", "row", "blocks", "article").mapInArrow(_suffixes, kinds).orderBy("host", "key", "page", "row", "pos")
    # written once, as the ranges are sampled
    found = cut(array.mapInArrow(_neighbours, kinds), "repeats")
    across = found.where("key is not null")
    often = across.groupBy("host", "key").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= LEAST_PAGES).select("host", "key")
    return found.where("key is null").select("row", "pos").unionByName(across.where("pos >= 0").join(often, ["host", "key"], "left_semi").select("row", "pos"))


def _unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts: the marked article, or the blocks without the tokens that repeated strings cover and without repeated blocks."""
    for batch in batches:
        out, sizes = [], []
        for text, texts, starts, gone in zip(*(batch.column(c).to_pylist() for c in ("text", "blocks", "starts", "gone"))):
            starts, out_of = np.array(starts or [], np.int64), set(gone or [])
            marks = _cover(sum(len(t.split()) for t in texts) if text is None else int(starts.max(initial=0)) + LEAST_TOKENS, starts)
            sizes.append(int(marks.sum()))
            out.append(_kept(texts, [i in out_of for i in range(len(texts))], marks) if text is None else text)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(sizes, pa.int64())], ["page_id", "url", "text", "n_repeated"])


def extract(pages: DataFrame, host_tokens: int = HOST_TOKENS) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated) of every row."""
    pages = pages.select("page_id", "url", "html")
    kinds = dict(pages.dtypes)
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), "^[a-zA-Z]+://([^/?#:]+)", 1)), F.lit(""))
    # rows are told apart by a hash of what is in them; equal ones get equal texts
    row = F.xxhash64("page_id", F.col("page_id").isNull(), "url", F.col("url").isNull(), "html")
    rows = pages.withColumn("row", row)
    told = rows.where(host != "").select("row", F.xxhash64("page_id").alias("page"), host.alias("host"), "html")
    shape = "row long, page long, host string, plain boolean, blocks array<string>, article array<boolean>, tokens long"
    streams = cut(told.mapInArrow(lambda b: _streams(b, False), shape), "streams")
    # hosts with pages that mark no article: what their other pages' articles say bears witness too
    hosts = cut(streams.where("plain and tokens > 0").select("host").distinct(), "hosts")
    mixed = not hosts.isEmpty()
    if mixed:
        whole = told.join(hosts, "host", "left_semi").select("row", "page", "host", "html").mapInArrow(lambda b: _streams(b, True), shape)
        streams = cut(streams.join(hosts, "host", "left_anti").select(*whole.columns).unionByName(whole), "streams")
    large = streams.groupBy("host").agg(F.sum("tokens").alias("n")).where(F.col("n") > host_tokens).select("host")
    large = cut(large, "large")
    small = streams.join(large, "host", "left_anti").select("host", "row", "page", "blocks", "article")
    marks = small.groupBy("host").applyInArrow(lambda t: _host_array(t), "row long, pos int")
    if not large.isEmpty():
        marks = marks.unionByName(_dealt_array(streams.join(large, "host", "left_semi")))
    marks = marks.withColumn("block", F.lit(None).cast("int"))
    if mixed:
        # whole blocks that several pages of the host have, by counting
        each = streams.join(hosts, "host", "left_semi").select("row", "page", "host", "plain", F.posexplode("blocks").alias("block", "t")).withColumn("h", F.xxhash64("t"))
        many = each.select("host", "h", "page").distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES).select("host", "h")
        marks = marks.unionByName(each.where("plain").join(many, ["host", "h"], "left_semi").select("row", F.lit(None).cast("int").alias("pos"), "block"))
    marks = marks.groupBy("row").agg(F.collect_list("pos").alias("starts"), F.collect_list("block").alias("gone"))
    parsed = rows.mapInArrow(_parse, f"row long, page_id {kinds['page_id']}, url {kinds['url']}, text string, blocks array<string>")
    found = parsed.join(marks, "row", "left").mapInArrow(_unique_runs, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_repeated long")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
