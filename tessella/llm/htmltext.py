"""Main text of web pages by suffix arrays over the pages of a host.

A page is parsed to blocks of visible text, each with the marks of its containers. The token streams of a host's pages are
concatenated, their suffixes are sorted by their first WIDTH tokens, and equal neighbours from distinct pages
show the long substrings that the pages share. Shared runs cover boilerplate: blocks that are mostly covered go, and unique runs stay.

Marks settle what runs alone cannot: menus and adverts can be unique, and a page's article can be copied. What stands in menus,
footers, sidebars, forms or comments goes. On a page with an article, what stands outside it goes; inside it a block goes
if it is covered and its own class names it boilerplate, or if most pages of the host share it, unless the whole article is so.
On a page without one the runs decide.

A host's pages are dealt to shards of about SHARD characters, so one host never meets in one task. The windows of hosts of several shards that
decide on a text are counted over the whole host by 64-bit keys, so the texts do not depend on the shards.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.frames import BROADCAST_ROWS, bounded, cut, stored

WIDTH = 8
PLACE = np.random.default_rng(20240608).integers(1, 1 << 63, size=WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHARD = 2_000_000
COVERED = 0.5
#: Share of an article's words, in blocks that most pages share, from which on the article itself is the copy, not a notice in it.
COPIED = 0.75
#: Pages that share a block of an article, at least, and more than half of all seen together, for it to be no part of it, unless they share most of the article too.
COMMON = 5
#: Fixed values of HTML: elements whose content is not text, elements that break a block, elements that are not main text, void ones.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title", "select", "button", "textarea", "datalist", "audio", "video", "map"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
BREAKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Closed by the start of another of the same kind or by their parent's end.
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot"}
ALIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("thead", "tbody"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("tbody", "tfoot")}
#: Elements that hold running text: their class is a hint, not a verdict.
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "tr", "caption", "figcaption", "hr", "br"}
#: A class or id names boilerplate when all of its parts are of these words, one of them of the first kind. Headers count outside articles only.
KINDS = set(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription "
    "signup login nav navbar navigation menu menus menubar breadcrumb breadcrumbs sidebar footer share sharing social related recommended recommendations widget widgets comment comments disqus "
    "replies reply respond pagination pager skip toolbar search copyright disclaimer".split()
)
HEADERS = {"header", "masthead"}
PLACES = set("site page main top bottom left right global primary secondary box bar block list wrap wrapper container section area unit slot link links item items post posts story stories article articles form panel overlay buttons icons thread side bottom text inner outer row col".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar", "alertdialog"}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
HIDDEN = re.compile(r"(^|\s)hidden(\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


@dataclass
class Block:
    """A block's text, and whether it stands in the page's article, in a container of boilerplate, and in a text element whose class names boilerplate."""

    text: str
    main: bool
    aside: bool
    hinted: bool = False


def named(marks: str, main: bool) -> bool:
    """Whether a class or id among marks names boilerplate."""
    kinds = KINDS if main else KINDS | HEADERS
    for token in marks.lower().split():
        parts = [x for x in re.split(r"[-_]+", token) if x and not x.isdigit()]
        if parts and any(x in kinds for x in parts) and all(x in kinds or x in PLACES for x in parts):
            return True
    return False


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each piece of markup; comments and declarations have no name. Linear time.

    A tag ends at the first '>' outside of quotes. Once a tag runs into the end of the page that way, an open quote is to blame, and
    from there on tags end at the first '>'.
    """
    at, n, quoted = 0, len(source), True
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if source.startswith(("<!", "<?"), start):
            end = source.find(">", start)
            at = n if end < 0 else end + 1
            yield start, at, "", False, ""
            continue
        closing = source.startswith("/", start + 1)
        name = NAME.match(source, start + 1 + closing)
        if name is None:
            at = start + 1
            continue
        end, seek = -1, name.end()
        while quoted:
            stop = STOP.search(source, seek)
            if stop is None:
                quoted = False
            elif stop[0] == ">":
                end = stop.start()
                break
            else:
                close = source.find(stop[0], stop.end())
                if close < 0:
                    quoted = False
                seek = close + 1
        if end < 0:
            end = source.find(">", name.end())
            if end < 0:
                return
        sent = yield start, end + 1, name[0].lower(), closing, source[name.end() : end]
        at = end + 1 if sent is None else sent


def blocks(source: str) -> list[Block]:
    """Visible blocks in page order with their marks. Only block elements and marked ones are kept open, so time is linear."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool, int]] = []
    places: dict[str, list[int]] = {}
    parts: list[str] = []

    def state() -> tuple[bool, bool, bool, bool, int]:
        return stack[-1][1:] if stack else (False, False, False, False, 0)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                main, aside, hinted, _, _ = state()
                out.append(Block(text, main, aside, hinted))
            parts.clear()

    def close(i: int) -> None:
        for entry in reversed(stack[i:]):
            places[entry[0]].pop()
        del stack[i:]

    def hard_above(i: int) -> bool:
        return stack[-1][5] > stack[i][5]

    def say(lo: int, hi: int) -> None:
        if hi > lo and not state()[3]:
            parts.append(html.unescape(source[lo:hi]))

    at, found, sent = 0, tags(source), None
    while True:
        try:
            start, end, name, closing, attributes = found.send(sent)
        except StopIteration:
            break
        sent = None
        say(at, start)
        at = end
        if not name:
            continue
        if closing:
            if name in BREAKS:
                flush()
            if places.get(name):
                i = places[name][-1]
                if name in BREAKS or not hard_above(i):
                    close(i)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BREAKS:
            flush()
            for kind in ALIKE.get(name, (name,)) if name in LOOSE else ("p",):
                if places.get(kind) and not hard_above(places[kind][-1]):
                    close(places[kind][-1])
        if name in VOID:
            continue
        main, aside, hinted, silent, hard = before = state()
        if attributes.strip():
            values = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
            role = values.get("role", "").lower()
            if name not in ("html", "body", "main"):
                if role in ROLES:
                    aside = True
                if named(f"{values.get('class', '')} {values.get('id', '')}", main):
                    hinted, aside = (True, aside) if name in TEXT or name not in BREAKS else (hinted, True)
                silent = silent or bool(HIDDEN.search(attributes)) and name not in ("html", "body")
            if role in ("main", "article") or values.get("itemprop") == "articleBody":
                main = True
        if name in ASIDE or (name == "header" and not main):
            aside = True
        if name in ("article", "main"):
            main = True
        silent = silent or name in SILENT
        if name in RAW and (name == "textarea" or silent):
            raw = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = sent = raw.end() if raw else len(source)
            continue
        if name in BREAKS or (before != (main, aside, hinted, silent, hard) and not attributes.rstrip().endswith("/")):
            places.setdefault(name, []).append(len(stack))
            stack.append((name, main, aside, hinted, silent, hard + (name in BREAKS and name not in LOOSE)))
    say(at, len(source))
    flush()
    return out


def shared_runs(streams: list[list[str]]) -> list[np.ndarray]:
    """Of each token of each stream, in how many streams the most common substring of WIDTH tokens over it stands; 0 if in its own only.

    The tokens of streams shorter than WIDTH count with the end mark, so that a short stream is shared as a whole only.
    """
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    total = int(lengths.sum())
    if total == 0:
        return [np.zeros(0, dtype=np.int64) for _ in streams]
    codes: dict[str, int] = {}
    flat = np.fromiter((codes.setdefault(t, len(codes) + 1) for s in streams for t in s), dtype=np.int64, count=total)
    owner = np.repeat(np.arange(len(streams)), lengths)
    last = np.repeat(np.cumsum(lengths), lengths)
    rank, span = flat, 1
    while span < WIDTH:
        follow = np.zeros(total, dtype=np.int64)
        inside = np.arange(total) + span < last
        follow[inside] = rank[np.arange(total)[inside] + span]
        _, rank = np.unique(rank * (rank.max() + follow.max() + 2) + follow, return_inverse=True)
        rank = rank + 1
        span *= 2
    order = np.argsort(rank, kind="stable")
    sorted_rank, sorted_owner = rank[order], owner[order]
    first = np.concatenate(([True], sorted_rank[1:] != sorted_rank[:-1]))
    other = first | np.concatenate(([True], sorted_owner[1:] != sorted_owner[:-1]))
    edge = np.flatnonzero(first)
    held = np.add.reduceat(other.astype(np.int64), edge)
    spread = np.zeros(total, dtype=np.int64)
    spread[order] = np.repeat(np.where(held > 1, held, 0), np.diff(np.append(edge, total)))
    whole = np.arange(total) + WIDTH <= last
    starts = np.where(whole, spread, 0)
    covered = starts.copy()
    for step in range(1, WIDTH):
        covered[step:] = np.maximum(covered[step:], starts[:-step])
    short = (lengths < WIDTH)[owner]
    covered[short] = spread[short]
    ends = np.cumsum(lengths)
    return [covered[e - n : e] for e, n in zip(ends, lengths, strict=True)]


def window_keys(column: pa.Array, salt: np.ndarray) -> tuple[np.ndarray, K.Words]:
    """The 64-bit key of the window of WIDTH tokens at each token of each text, its row's salt included; a text's end is part of a shorter window."""
    words = K.split(column)
    at, end, out = np.arange(len(words.hash)), words.first[words.row + 1], np.zeros(len(words.hash), dtype=np.uint64)
    for j in range(WIDTH):
        inside = at + j < end
        out[inside] += words.hash[at[inside] + j] * PLACE[j]
    return K.mix(K.mix(out) ^ salt[words.row]), words


def once(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a key and a row by key, then row; the rows given ascend."""
    order = np.argsort(keys, kind="stable")
    key, row = keys[order], row[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], row[new]


def told_runs(keys: np.ndarray, words: K.Words, known: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """shared_runs() of texts by their window keys, where the pages of whole hosts are known: sorted keys, and counts of at least 2."""
    spread = np.zeros(len(keys), dtype=np.int64)
    if len(known[0]) and len(keys):
        at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
        spread = np.where(known[0][at] == keys, known[1][at], 0)
    row = words.row
    starts = np.where(np.arange(len(keys)) + WIDTH <= words.first[row + 1], spread, 0)
    covered = starts.copy()
    for step in range(1, WIDTH):
        covered[step:] = np.maximum(covered[step:], np.where(row[step:] == row[:-step], starts[:-step], 0))
    covered = np.where(np.diff(words.first)[row] < WIDTH, spread, covered)
    return np.split(covered, words.first[1:-1])


def mostly(hit: np.ndarray, sizes: list[int]) -> list[bool]:
    """Of each block of so many tokens, whether COVERED of them are hit."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total, n = np.append(0, np.cumsum(hit)), np.diff(ends, prepend=0)
    return ((n > 0) & (total[ends] - total[ends - n] >= COVERED * n)).tolist()


def main_text(parsed: list[list[Block]], pages: int | None = None, runs: list[np.ndarray] | None = None) -> list[str]:
    """Main texts of pages of one host. Without its number of pages, and runs over all of them, the pages are the host's only ones."""
    runs = shared_runs([[t for b in page for t in b.text.split()] for page in parsed]) if runs is None else runs
    most = max(COMMON, (len(parsed) if pages is None else pages) // 2 + 1)
    out = []
    for page, spread in zip(parsed, runs, strict=True):
        article = any(b.main and not b.aside for b in page)
        sizes = [len(b.text.split()) for b in page]
        common, shared = (mostly(spread >= least, sizes) for least in (most, 2))
        main = [n if b.main and not b.aside else 0 for n, b in zip(sizes, page, strict=True)]
        copied = article and sum(n for n, c in zip(main, common, strict=True) if c) >= COPIED * sum(main)
        kept, rare = [], []
        for block, often, covered in zip(page, common, shared, strict=True):
            if block.aside or (article and not block.main):
                continue
            if covered and (block.hinted or not article):
                continue
            kept.append(block.text)
            if copied or not (covered and often):
                rare.append(block.text)
        out.append("\n\n".join(rare if rare or not article else kept))
    return out


def page_blocks(texts: list[str], marks: list[int]) -> list[Block]:
    return [Block(t, bool(m & 1), bool(m & 2), bool(m & 4)) for t, m in zip(texts, marks, strict=True)]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, K.Words]]:
    """Slices of parsed pages with their windows' keys."""
    for batch in batches:
        texts = pa.array([" ".join(t) for t in batch.column("texts").to_pylist()], pa.large_string())
        for lo, hi in K.slices(texts, 4 * K.SLICE_BYTES):
            own = batch.slice(lo, hi - lo)
            yield own, *window_keys(texts[lo:hi], np.asarray(own.column("salt")).view(np.uint64))


def windows_apart(parsed: DataFrame) -> DataFrame:
    """(host, shard, key, n): of the windows that decide on a text, in how many pages they stand, by shard and task.

    Windows decide if they lie over blocks that other pages' runs may remove, or stand in most pages of a host, so in most of its pages in some slice of
    a task. If such ones are few, only they are counted, else all.
    """

    def deciding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, keys, words in sliced(batches):
            found = []
            for r, (texts, marks) in enumerate(zip(own.column("texts").to_pylist(), own.column("marks").to_pylist(), strict=True)):
                article, at = any(m & 1 and not m & 2 for m in marks), words.first[r]
                for text, m in zip(texts, marks, strict=True):
                    n = len(text.split())
                    if not m & 2 and (m & 5 == 5 if article else True):
                        found.append(keys[max(words.first[r], at - WIDTH + 1) : at + n])
                    at += n
            _, host = np.unique(np.asarray(own.column("salt")), return_inverse=True)
            each, row = once(keys, words.row)
            key, first, n = np.unique(each, return_index=True, return_counts=True)
            found.append(key[2 * n > np.bincount(host)[host[row[first]]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], ["key"])

    wanted = stored(parsed.select("salt", "texts", "marks").mapInArrow(deciding, "key long").distinct())
    few = wanted.count() <= BROADCAST_ROWS
    shared = parsed.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in wanted.collect()], dtype=np.int64).view(np.uint64)) if few else None)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, keys, words in sliced(batches):
            held = np.isin(keys, shared.value) if shared.value is not None else np.ones(len(keys), dtype=bool)
            each, row = once(keys[held], words.row[held])
            shard = np.asarray(own.column("shard")).astype(np.int64)[row]
            order = np.lexsort((shard, each))
            key, shard, row = each[order], shard[order], row[order]
            start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])))) if len(key) else np.zeros(0, np.int64)
            columns = [own.column("host").take(pa.array(row[start])), pa.array(shard[start].astype(np.int32)), pa.array(key[start].view(np.int64)), pa.array(np.diff(np.append(start, len(key))))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "shard", "key", "n"])

    return stored(parsed.select("host", "salt", "shard", "texts", "marks").mapInArrow(counted, "host string, shard int, key long, n long"))


def settled(parsed: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of the parsed pages of hosts of several shards. Few known windows come along; else they meet the pages by shard."""
    each = windows_apart(parsed)
    totals = stored(each.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"))
    schema = "page_id long, url string, text string, n_chars long"

    def texts_of(own: pa.RecordBatch, keys: np.ndarray, words: K.Words, known: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        pages = zip(*(own.column(c).to_pylist() for c in ("texts", "marks", "pages")), told_runs(keys, words, known), strict=True)
        texts = [main_text([page_blocks(t, m)], n, [runs])[0] for t, m, n, runs in pages]
        return pa.RecordBatch.from_arrays([own.column("page_id"), own.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    def ordered(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = key.astype(np.int64).view(np.uint64)
        order = np.argsort(key)
        return key[order], n[order].astype(np.int64)

    if totals.count() <= BROADCAST_ROWS:
        rows = np.array(totals.collect(), dtype=np.int64).reshape(-1, 2)
        shared = parsed.sparkSession.sparkContext.broadcast(ordered(rows[:, 0].copy(), rows[:, 1]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own, keys, words in sliced(batches):
                yield texts_of(own, keys, words, shared.value)

        return parsed.mapInArrow(run, schema)

    def meet(pages: pa.Table, known: pa.Table) -> pa.Table:
        held = ordered(known.column("key").to_numpy(), known.column("n").to_numpy())
        found = [texts_of(own, keys, words, held) for own, keys, words in sliced(iter(pages.combine_chunks().to_batches()))]
        return pa.Table.from_batches(found, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]))

    known = each.select("host", "shard", "key").distinct().join(totals, "key").select("host", "shard", "key", "n")
    return parsed.groupBy("host", "shard").cogroup(known.groupBy("host", "shard")).applyInArrow(meet, schema)


def extract(pages: DataFrame, shard: int = SHARD) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the article's blocks, joined by two newlines.

    A null or empty page gives an empty text; pages with a null or odd url form a host of their own; a page alone on its host
    has no shared runs, so its marks decide. Rows repeated stay repeated: they share runs with each other, which the
    article's marks outweigh. A page of any length is one task's row. Pages are parsed once; shards of a host are dealt by the hash of the page
    id and text, by the host's total length, and change no text: windows of hosts of several shards are counted over the whole host.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("host", host)
    sizes = cut(rows.groupBy("host").agg(F.ceil(F.sum(F.length("html")) / F.lit(shard)).cast("int").alias("shards"), F.count(F.lit(1)).alias("pages")).where("shards > 1"))
    split = F.when(F.col("shards") > 1, F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.col("shards"))).otherwise(0).cast("int")
    dealt = rows.join(bounded(sizes, 100_000), "host", "left").select("page_id", "url", "host", "pages", split.alias("shard"), F.xxhash64("host").alias("salt"), "html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.slices(batch.column("html"), 4 * K.SLICE_BYTES):
                parsed = [blocks(h) for h in batch.column("html")[lo:hi].to_pylist()]
                lists = [pa.array([[b.text for b in page] for page in parsed], pa.list_(pa.string())), pa.array([[b.main + 2 * b.aside + 4 * b.hinted for b in page] for page in parsed], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[lo:hi] for i in range(6)), *lists], [*batch.schema.names[:6], "texts", "marks"])

    parsed = lambda rows: rows.mapInArrow(parse, "page_id long, url string, host string, pages long, shard int, salt long, texts array<string>, marks array<int>")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        texts = main_text([page_blocks(*page) for page in zip(group["texts"], group["marks"], strict=True)])
        return pd.DataFrame({"page_id": group["page_id"], "url": group["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    small = parsed(dealt.where("pages IS NULL")).groupBy("host").applyInPandas(run, "page_id long, url string, text string, n_chars long")
    return small if sizes.isEmpty() else small.unionByName(settled(stored(parsed(dealt.where("pages IS NOT NULL")), "zstd")))
