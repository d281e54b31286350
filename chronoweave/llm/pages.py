"""Main text of web pages: a suffix array over each host's token streams, page structure as the second signal.

A scanner cuts a page into blocks and notes what its markup says of each: chrome (menu, header, footer, sidebar, notice,
advert, form, comment), main text (a text element of a main container) or nothing. The pages of a host are dealt to one task (a
large host to several), their token streams are concatenated, all suffixes are sorted, and intervals of the suffix array whose
common prefix has ``RUN`` tokens or more are the repeats; the distinct page bodies in an interval say how much of the host has
it. What the markup says goes first:

* chrome goes, whether it repeats or not;
* a block of main text stays, unless it is a line of the host: runs on ``OFTEN`` of its bodies, ``MANY`` at least, cover ``WHOLE`` of it;
* blocks of which the markup says nothing lose words of runs on ``OFTEN`` of the host's bodies (two at least), or of runs on
  ``SOME`` of them (``FEW`` at least) where these fill more than half of the block. What structure has dropped never counts
  as cut by the repeats.

A page is more than its frame: if less than ``REST`` of its words were left, its longest cut blocks are main text that the host
shows at several places (copies, variants) and come back, until enough is left.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, gram_hashes, make_room, word_bounds, word_hashes, write_table

RUN, DEPTH, OFTEN, SOME, FEW, MANY, WHOLE, REST = 6, 32, 0.5, 0.1, 3, 12, 0.9, 0.25
#: Tokens of a large host that are sorted together, bytes of a host that one task gets whole, hosts larger than that which are broadcast.
TOKENS, HOST_BYTES, BIG_HOSTS = 1 << 20, 8 << 20, 100_000
#: Bytes of text of one part that a task packs together, and of all parts that it holds for that; runs that a broadcast may bring.
PACK, HELD, FETCH = 1 << 18, 32 << 20, 1_000_000
# Element and attribute names of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "svg", "canvas", "object", "audio", "video", "dialog", "menu", "math", "map", "datalist"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
CELLS = {"td", "th", "br"}
TEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "dd", "dt", "figcaption", "td", "th", "caption"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
OUT_NAMES = re.compile(r"(?!has-|with-|no-|is-|js-)(?:[\w-]*[-_])?(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|related|recommended|recommendations|comment|comments|commentlist|disqus|reply|replies|respond|sidebar|widget|widgets|breadcrumb|breadcrumbs|menu|nav|navbar|navigation|footer|header|masthead|toolbar|pagination|pager|login|signup|search|skip)(?:[-_]?\d+)?(?:[-_](?:box|bar|list|area|block|wrap|wrapper|container|section|inner|top|bottom|left|right|main|form|links|item|items|text|message|unit|slot|widget|content))*", re.IGNORECASE)
MAIN_NAMES = re.compile(r"(?:main|article|post|entry|story|page)[-_]?(?:content|body|text|main)|articlebody|article|content|main|post|entry|story", re.IGNORECASE)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?", re.DOTALL)
ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _marks(tag: str, raw: str) -> tuple[bool, bool]:
    """(dropped, main) by an element's attributes."""
    if not raw.strip():
        return False, False
    a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}
    role = a.get("role", "").lower()
    names = f"{a.get('class', '')} {a.get('id', '')}".split()
    main = role == "main" or a.get("itemprop", "").lower() == "articlebody"
    out = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or role in ROLES or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")))
    if tag not in ("html", "body", "main"):
        out = out or any(OUT_NAMES.fullmatch(n) for n in names) and not (tag == "article" and any(MAIN_NAMES.fullmatch(n) for n in names))
    return out, main or (tag in ("div", "section", "td") and any(MAIN_NAMES.fullmatch(n) for n in names))


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(kind, text) of the page's blocks in order. kind: 'keep', 'weak' or 'drop'.

    A dropped box that is never closed, or closed too late, would swallow the article after it: if no main container stands
    outside dropped boxes, those inside count, unless they or what they stand in are comments or teasers by their own names."""
    page = page or ""
    stack: list[tuple[str, bool, int]] = []  # element, dropped, rank of its main container (0: none)
    found: list[list] = []  # dropped, dropped from its container inwards, ranks of the containers around it, in a text element, pieces
    open_ = True

    def text(piece: str) -> None:
        nonlocal open_
        if open_ or not found:
            main = next((i for i, s in enumerate(stack) if s[2] > 1), 0)
            found.append([any(s[1] for s in stack), any(s[1] for s in stack[main:]), {s[2] for s in stack if s[2]}, any(s[0] in TEXTS for s in stack), []])
            open_ = False
        found[-1][4].append(html.unescape(piece))

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in BLOCKS:
            open_ = True
        elif tag in CELLS and found and not open_:
            found[-1][4].append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag not in BLOCKS and any(s[0] in BLOCKS for s in stack[k + 1 :]):
                        del stack[k]
                    else:
                        open_ = open_ or any(s[1] for s in stack[k:])
                        del stack[k:]
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag == "body":
            stack.clear()
        if tag == "p" or tag == "li" or tag in ("dt", "dd"):  # these end one another
            ends = {"dt", "dd"} if tag in ("dt", "dd") else {tag}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        out, main = _marks(tag, m[3])
        rank = 3 if tag == "article" else 2 if tag == "main" or main and "itemprop" in m[3] else 1 if main else 0
        inside = any(s[2] for s in stack)
        out = out or (tag in DROPPED and not (tag == "header" and inside))
        if out:
            open_ = True
        stack.append((tag, out, rank))
    cut = [[out, inner, ranks, in_text, " ".join("".join(pieces).split())] for out, inner, ranks, in_text, pieces in found]
    if not any(ranks and not out and words for out, _, ranks, _, words in cut):
        for b in cut:
            if max(b[2], default=0) > 1:
                b[0] = b[1]
    best, most = 0, 0
    for rank in (3, 2, 1):  # a lower rank wins only by more text of its own in text elements than the higher one has
        own = [(in_text, len(words)) for out, _, ranks, in_text, words in cut if not out and words and max(ranks, default=0) == rank]
        if own and (not best or sum(n for in_text, n in own if in_text) > most):
            best, most = rank, sum(n for _, n in own)
    rows = []
    for out, _, ranks, in_text, words in cut:
        if words:
            rows.append(("drop" if out or best and best not in ranks else "keep" if ranks and in_text else "weak", words))
    return rows


def suffix_array(tokens: np.ndarray, left: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of token streams in order, and how many tokens each shares with the one before it (up to ``depth``; the first:
    0), by prefix doubling. left: tokens from each place to the end of its stream, itself included."""
    n = len(tokens)
    ranks, step = [np.unique(tokens, return_inverse=True)[1] + 1], 1
    while step < depth:
        r, after = ranks[-1].astype(np.int64), np.zeros(n, np.int64)
        on = np.flatnonzero(left > step)
        after[on] = r[on + step]
        ranks.append(np.unique(r * (n + 1) + after, return_inverse=True)[1] + 1)
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b, shared = order[:-1], order[1:], np.zeros(n, np.int64)
    got = np.zeros(max(0, n - 1), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        on = np.flatnonzero((got + (1 << k) <= left[a]) & (got + (1 << k) <= left[b]))
        same = on[ranks[k][a[on] + got[on]] == ranks[k][b[on] + got[on]]]
        got[same] += 1 << k
    shared[1:] = got
    return order, shared


def repeats(tokens: np.ndarray, left: np.ndarray, body: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each place the number of distinct bodies that have the run of ``run`` tokens from there; 0 where none begins."""
    out = np.zeros(len(tokens), np.int64)
    if not len(tokens):
        return out
    order, shared = suffix_array(tokens, left)
    interval = np.cumsum(shared < run)  # suffixes with a common prefix of run tokens stand side by side
    both = np.unique(interval * (body.max() + 1) + body[order])
    count = np.bincount(both // (body.max() + 1), minlength=interval[-1] + 1)
    out[order] = count[interval]
    out[left < run] = 0
    return out


def _covered(starts: np.ndarray, left: np.ndarray, run: int) -> np.ndarray:
    """Which tokens a run from one of ``starts`` covers."""
    edge = np.zeros(len(left) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return np.cumsum(edge)[:-1] > 0


def _words(pages: list[list[tuple[str, str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all blocks: their hashes, the words from each to the end of its block, the page of each; words before each block."""
    data, offsets = buffers(pa.array([t for page in pages for _, t in page], pa.large_string()))
    starts, ends, before = word_bounds(data, offsets)
    block_of = np.repeat(np.arange(len(before) - 1), np.diff(before))
    left = before[1:][block_of] - np.arange(len(starts))
    page_of = np.repeat(np.arange(len(pages)), [len(page) for page in pages])
    return word_hashes(data, starts, ends), left, page_of[block_of], before


def _body(page: list[tuple[str, str]]) -> str:
    return "\n".join(t for k, t in page if k != "drop")


def _runs(h: np.ndarray, left: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a run begins, and the runs' names."""
    at = np.flatnonzero(left >= run)
    return at, gram_hashes(h, run)[at].view(np.int64)


def _look_up(names: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which names are among the known (sorted), and where."""
    if not len(known):
        return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    return known[at] == names, at


def judge(pages: list[list[tuple[str, str]]], run: int = RUN, host: tuple[np.ndarray, np.ndarray, int] | None = None) -> list[tuple[str, int, int]]:
    """Blocks of the pages of one host -> for each page its text, the words that the repeats cut, and those of structure alone.
    host: its common runs (sorted names), the bodies that have each, and the number of its bodies; none: pages are the whole host."""
    if not any(pages):
        return [("", 0, 0) for _ in pages]
    h, left, page_of, before = _words(pages)
    size = np.diff(before)
    if host is None:
        names: dict[str, int] = {}
        body = np.array([names.setdefault(_body(page), len(names)) for page in pages])
        count, bodies = repeats(h.view(np.int64), left, body[page_of], run), len(names)
    else:
        count, bodies = np.zeros(len(h), np.int64), host[2]
        at, grams = _runs(h, left, run)
        among, where = _look_up(grams, host[0])
        count[at[among]] = host[1][where[among]]
    often, some = max(2, OFTEN * bodies), max(FEW, SOME * bodies)
    covered = {k: _covered(np.flatnonzero(count >= n), left, run) for k, n in (("often", often), ("some", min(often, some)), ("main", max(often, MANY)))}
    total = {k: np.diff(np.append(0, np.cumsum(c))[before]) for k, c in covered.items()}
    out, at = [], 0
    for page in pages:
        kept: dict[int, str] = {}
        back, structure, cut, words = [], 0, 0, 0
        for i, (kind, text) in enumerate(page, at):
            n = int(size[i])
            words += n if kind != "drop" else 0
            if kind == "drop":
                structure += n
                continue
            if kind == "keep":
                gone = n if total["main"][i] >= WHOLE * n and n >= run else 0
                kept[i] = "" if gone else text
            else:
                by = "some" if total["some"][i] * 2 > n else "often"
                gone = int(total[by][i])
                stays = ~covered[by][before[i] : before[i + 1]]
                kept[i] = " ".join(w for w, s in zip(text.split(" "), stays, strict=True) if s) if gone else text
            if gone:
                back.append((-gone, i))
            cut += gone
        lost = -sum(g for g, _ in back)
        for g, i in sorted(back):
            if words - lost >= REST * words:
                break
            kept[i], lost, cut = page[i - at][1], lost + g, cut + g
        at += len(page)
        out.append(("\n".join(t for t in kept.values() if t), cut, structure))
    return out


OUT = "page_id long, url string, text string, by_repeats long, by_structure long"


def _judged(held: list[tuple], run: int, host: tuple[np.ndarray, np.ndarray, int] | None = None) -> pa.RecordBatch:
    """held: (page_id, url, blocks) of each page."""
    found = judge([b for _, _, b in held], run, host)
    return pa.RecordBatch.from_arrays(
        [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.string()), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64())))],
        ["page_id", "url", "text", "by_repeats", "by_structure"],
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(s, 256).columns), strict=True)


def _whole_hosts(rows: DataFrame, run: int) -> DataFrame:
    """rows(page_id, url, html, host), a host in one task."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        held: list[tuple] = []
        key = None
        for page_id, url, page, host in _rows(batches):
            if held and host != key:
                yield _judged(held, run)
                held = []
            key = host
            held.append((page_id, url, blocks(page)))
        if held:
            yield _judged(held, run)

    return rows.repartition("host").sortWithinPartitions("host").mapInArrow(run_, OUT)


KINDS = {"k": "keep", "w": "weak", "d": "drop"}
PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("kinds", pa.string()), ("texts", pa.string()), ("body", pa.int64())])
ZSTD = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))


PACKS = "host string, parts int, part int, again boolean, data binary"


def _pack(rows: list[tuple]) -> bytes:
    """Pages of one part, compressed together."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PAGE, options=ZSTD) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(PAGE)], schema=PAGE))
    return sink.getvalue().to_pybytes()


def _parsed(rows: DataFrame) -> DataFrame:
    """rows(page_id, url, html, host, parts) -> packs of pages of one part: blocks as one letter and one line each, and the body's
    name, which decides the part. A page whose blocks the task has met before on its host counts no more (``again``) and may lie in any part."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        seen: set[tuple] = set()
        held: dict[tuple, list] = {}
        size: dict[tuple, int] = {}

        def packed(keys: list[tuple]) -> pa.RecordBatch:
            data = [_pack(held.pop(k)) for k in keys]
            for k in keys:
                del size[k]
            types = (pa.string(), pa.int32(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], t) for i, t in enumerate(types)), pa.array(data, pa.binary())], ["host", "parts", "part", "again", "data"])

        total = 0
        for page_id, url, page, host, parts in _rows(batches):
            found = blocks(page)
            texts = "\n".join(t for _, t in found)
            body = xxhash.xxh3_64_intdigest(_body(found))
            name = (host, body, xxhash.xxh3_64_intdigest(texts))
            again = name in seen
            if len(seen) < TOKENS:
                seen.add(name)
            key = (host, parts, (xxhash.xxh3_64_intdigest(f"{page_id} {url}") if again else body) % parts, again)
            held.setdefault(key, []).append((page_id, url, "".join(k[0] for k, _ in found), texts, int(np.uint64(body).view(np.int64))))
            size[key] = size.get(key, 0) + len(texts)
            total += len(texts)
            if size[key] > PACK:
                total -= size[key]
                yield packed([key])
            elif total > HELD:
                total = 0
                yield packed(list(held))
        if held:
            yield packed(list(held))

    return rows.mapInArrow(run_, PACKS)


def _unpack(data: bytes) -> list[tuple]:
    """(body, page_id, url, blocks, row of the pack) of each page."""
    rows = _rows(pa.ipc.open_stream(data))
    return [(r[4], r[0], r[1], list(zip((KINDS[x] for x in r[2]), r[3].split("\n"), strict=True)) if r[2] else [], r) for r in rows]


SORTED = "host string, whole boolean, again boolean, data binary, run long, k long, slack long"


def _sorted(packs: DataFrame, run: int, tokens: int) -> DataFrame:
    """Pages of large hosts by (host, part), and what their suffixes say. A row with data is a chunk of a part, about ``tokens``
    words of it; whole: the part has no other. Without data: a run on SOME of a chunk's bodies or more, k being how many more than
    the slack that any run may have unreported; or, without a run, a chunk's bodies and its slack."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        met: set[int] = set()  # bodies of the part

        def row_batch(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.string(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = ["host", "whole", "again", "data", "run", "k", "slack"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        def chunk(host: str, whole: bool, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            known = len(met)
            met.update(r[0] for r in held)
            fresh = len(met) - known
            slack = max(0, math.ceil(round(SOME * fresh, 9)) - 1)
            yield row_batch([(host, whole, False, _pack([r[4] for r in held]), None, None, None), (host, None, None, None, None, fresh, slack)])
            h, left, page_of, _ = _words([r[3] for r in held])
            body = np.unique(np.array([r[0] for r in held], np.int64), return_inverse=True)[1]
            count = repeats(h.view(np.int64), left, body[page_of], run)
            at, grams = _runs(h, left, run)
            often = count[at] > slack
            names, first = np.unique(grams[often], return_index=True)
            k = (count[at][often][first] - slack).tolist()
            yield row_batch([(host, None, None, None, name, n, None) for name, n in zip(names.tolist(), k, strict=True)])

        key, held, size, on = None, [], 0, False
        for host, part, again, data in _rows(batches):
            if (host, part) != key:
                if held:
                    yield from chunk(key[0], not on, held)
                met.clear()
                key, held, size, on = (host, part), [], 0, False
            if again:
                yield row_batch([(host, None, True, data, None, None, None)])
                continue
            for r in _unpack(data):
                if size > tokens:
                    yield from chunk(host, False, held)
                    held, size, on = [], 0, True
                held.append(r)
                size += r[4][3].count(" ") + len(r[3])
        if held:
            yield from chunk(key[0], not on, held)

    return packs.repartition("host", "part").sortWithinPartitions("host", "part", "again").select("host", "part", "again", "data").mapInArrow(run_, SORTED)


def _counted(chunks: DataFrame, run: int) -> DataFrame:
    """chunks(data, whole, facts) with facts an array of (run, k) -> rows (host, run, body, k): of a whole part the number of bodies that have each run, else one
    row for each body, as it may go on in another chunk."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for host, whole, data, facts in _rows(batches):
            held, runs = _unpack(data), np.array(sorted(f["run"] for f in facts), np.int64)
            if not len(runs):
                continue
            bodies, body = np.unique(np.array([r[0] for r in held], np.int64), return_inverse=True)
            h, left, page_of, _ = _words([r[3] for r in held])
            at, grams = _runs(h, left, run)
            among, where = _look_up(grams, runs)
            both = np.unique(body[page_of[at[among]]] * len(runs) + where[among])
            if whole:
                k = np.bincount(both % len(runs), minlength=len(runs))
                names, of, k = runs[k > 0], [None] * int((k > 0).sum()), k[k > 0]
            else:
                names, of, k = runs[both % len(runs)], bodies[both // len(runs)], np.ones(len(both), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(names), pa.string()), pa.array(names), pa.array(of, pa.int64()), pa.array(k, pa.int64())], ["host", "run", "body", "k"])

    return chunks.select("host", "whole", "data", "facts").mapInArrow(run_, "host string, run long, body long, k long")


def _large_hosts(rows: DataFrame, hint: str, run: int, tokens: int) -> DataFrame:
    """rows(page_id, url, html, host, parts). Texts are shuffled once. Equal bodies meet in one part, so bodies of parts add up."""
    sorted_ = write_table(_sorted(_parsed(rows), run, tokens), "sorted", **{"parquet.block.size": str(16 << 20)})
    chunks, reported = sorted_.where("data is not null"), sorted_.where("data is null")
    hosts = reported.where("run is null").groupBy("host").agg(F.sum("k").alias("bodies"), F.sum("slack").alias("slack"))
    hosts = write_table(hosts.withColumn("least", F.least(F.greatest(F.lit(2), OFTEN * F.col("bodies")), F.greatest(F.lit(FEW), SOME * F.col("bodies")))), "shares")

    def with_facts(chunks: DataFrame, facts: DataFrame) -> DataFrame:
        """facts(host, run, k) of a host as an array beside each of its chunks."""
        facts = write_table(facts, "facts")
        lists = facts.groupBy("host").agg(F.collect_list(F.struct("run", "k")).alias("facts"))
        both = chunks.join(lists.hint("broadcast" if facts.count() <= FETCH else "merge"), "host", "left").join(hosts.hint(hint), "host")
        return both.withColumn("facts", F.coalesce("facts", F.array().cast("array<struct<run:bigint,k:bigint>>")))

    maybe = reported.where("run is not null").groupBy("host", "run").agg(F.sum("k").alias("k")).hint("merge").join(hosts, "host").where("k + slack >= least")
    counted = _counted(with_facts(chunks.where("not again"), maybe.select("host", "run", "k")), run)
    counted = counted.groupBy("host", "run", "body").agg(F.sum("k").alias("k")).withColumn("k", F.when(F.col("body").isNull(), F.col("k")).otherwise(1))
    common = counted.groupBy("host", "run").agg(F.sum("k").alias("k")).hint("merge").join(hosts, "host").where("k >= least")

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for data, facts, bodies in _rows(batches):
            facts = sorted((f["run"], f["k"]) for f in facts)
            host = (np.array([r for r, _ in facts], np.int64), np.array([k for _, k in facts], np.int64), bodies)
            yield _judged([r[1:4] for r in _unpack(data)], run, host)

    return with_facts(chunks, common.select("host", "run", "k")).select("data", "facts", "bodies").mapInArrow(run_, OUT)


def extract(pages: DataFrame, run: int = RUN, host_bytes: int = HOST_BYTES, tokens: int = TOKENS, big_hosts: int = BIG_HOSTS) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, by_repeats, by_structure): kept blocks in page order, joined by one
    line feed; the numbers of words that the suffix array cut (which would else stay) and that structure cut.

    Null and empty pages have an empty text; unclosed elements end with the page; texts of any length are whole. A page's host
    is the part of its url between // and the next /, ? or #; pages without one form a host of their own. Repeated rows are
    extracted each, and pages of equal text never count as two; null page_ids stay. A host of over ``host_bytes`` is dealt to several
    tasks and ``tokens`` of it at a time are sorted together, so no group is ever held whole; shares are always those of the whole
    host, so neither number changes a result. Pages of one host with one body and many frames
    stream through one task. An empty table gives none."""
    url_host = F.coalesce(F.nullif(F.regexp_extract("url", r"//([^/?#]*)", 1), F.lit("")), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"), url_host.alias("host"))
    total = rows.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes")).where(F.col("bytes") > host_bytes)
    big = write_table(total.select("host", F.ceil(F.col("bytes") / host_bytes).cast("int").alias("parts")), "hosts")
    if not (large := big.count()):
        return _whole_hosts(rows, run)
    hint = "broadcast" if large <= big_hosts else "merge"
    big = big.hint(hint)
    return _whole_hosts(rows.join(big, "host", "left_anti").select("page_id", "url", "html", "host"), run).unionByName(_large_hosts(rows.join(big, "host").select("page_id", "url", "html", "host", "parts"), hint, run, tokens))


def query(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_repeats", "by_structure")
