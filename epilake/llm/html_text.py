"""Main text of web pages: markup roles and nearest-URL page differencing.

A page becomes lines, one for each block, with the role that its markup gives it:

- `out`: inside menus, headers, footers, sidebars, forms and the like, by element
  name, ARIA role or hidden;
- `prose`: a paragraph, heading, quote, table or list text inside article or main;
- `open`: anything else, also inside elements that a word of class or id names a menu,
  header, advert, notice, comment or the like. Such a word says nothing if the element
  holds an article or main, or, within one, more than half of its text (comments aside),
  or beside a modifier as in `has-sidebar`.

Pages are sorted by host, then URL path without scheme, query and fragment; a
page is paired with the next one of its host that has other lines, the last with the
last one before that has; copies of a page are never its pair. The
line hashes of a pair are aligned by longest common subsequence. `out` lines go.
`open` lines that the pair shares go too: they belong to the site, not the page. If a
page has `prose`, its open lines outside article and main go as well; else those
that are left are its text. Prose that two pages share (a copied article) stays.

Hosts of any size: rows are cut into ranges of (host, path, page_id, digest of html)
at split points that a hash-chosen sample of the keys gives, so reruns cut alike. A
first pass keeps a digest of each page's lines, from which follow the pages before and
behind a range that its first and last run of equal pages is compared with; these are
copied into the range. So the pairs don't depend on the ranges.

Lines: character references are decoded, white space inside a block becomes one
space, blocks are joined by a line end.

Edge cases: null or empty html has no text. Rows with equal URLs are ordered by
page_id (null first). A null url has an empty host. Unclosed, unknown or wrongly
nested elements end with the element around them. An empty table gives no row.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilake.llm import text as T
from epilake.llm.tables import partitions, range_bucket, read_table, written

OUT, OPEN, PROSE, INNER = "out", "open", "prose", "inner"
#: Roles of elements that a word of class or id marks; the second for comments, whatever their size.
NAMED, REPLIES = "named", "replies"
#: Keys that split points are chosen from, for each range.
SAMPLE = 64
#: Bits of alignment that a pair may take at once; beyond, it is split where the lengths of both halves add up best.
ALIGN_BITS = 1 << 28

RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video"}
OUT_ELEMENTS = {"head", "nav", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu", "fieldset", "label", "option"}
MAIN_ELEMENTS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE_BLOCKS = HEADINGS | {"p", "blockquote", "pre", "li", "dd", "dt", "td", "th", "caption", "figcaption"}
BLOCKS = PROSE_BLOCKS | OUT_ELEMENTS | MAIN_ELEMENTS | {
    "html", "body", "header", "section", "div", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "hr", "address",
    "details", "summary", "center", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
OUT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "promo", "promotion", "sponsor", "sponsored", "sidebar",
             "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "topbar", "cookie", "cookies",
             "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
             "login", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "respond", "replies",
             "disqus", "pagination", "pager", "widget", "widgets", "toolbar", "search", "skip", "disclaimer"}
REPLY_WORDS = {"comment", "comments", "respond", "replies", "disqus"}
#: A class or id with one of these tells what the element has or lacks, not what it is.
MODIFIERS = {"has", "no", "not", "with", "without", "is", "enable", "enabled", "disable", "disabled"}
#: With one of these beside it, "header" names the head of the article itself.
ARTICLE_WORDS = {"article", "post", "entry", "story"}

# quotes hold a ">" only where they open a value and are closed; a tag with other quotes ends at its first ">"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>" + "|".join(sorted(RAW)) + r")\b[^>]*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>"
    r"|<[!?][^>]*>", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: An unquoted value that ends in a slash, which closes nothing.
_SLASH_VALUE = re.compile(r"=\s*[^\s\"'>]*/\Z")
_WORDS = re.compile(r"[a-z]+")


def _role(name: str, attrs: str) -> str | None:
    """Role that an element gives to what it holds."""
    if name in OUT_ELEMENTS:
        return OUT
    if attrs and not attrs.isspace():
        got = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
        if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower():
            return OUT
        if got.get("role", "").lower() in OUT_ROLES:
            return OUT
        words = set()
        for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", got.get("class", "") + " " + got.get("id", "")).lower().split():
            parts = set(_WORDS.findall(token))
            if not parts & MODIFIERS:
                words |= parts
        if name in ("html", "body"):
            words = set()
        if name in MAIN_ELEMENTS:
            words &= {"comment", "comments"}
        if words & ARTICLE_WORDS:
            words -= {"header"}
        if words & OUT_WORDS:
            return REPLIES if words & REPLY_WORDS else NAMED
        if got.get("role", "").lower() in MAIN_ELEMENTS or got.get("itemprop", "").lower() == "articlebody":
            return INNER
    if name in MAIN_ELEMENTS:
        return INNER
    return OUT if name == "header" else None


def lines(page: str) -> list[tuple[str, str]]:
    """(text, role) of each block in page order."""
    out: list[tuple[str, str]] = []
    buffer: list[str] = []
    stack: list[tuple[str, str | None]] = []  # open elements that matter
    depth_out = depth_main = 0
    block = ""
    # elements marked by a word: those open, and for each the one around it, whether it is no mark, and its text inside article or main
    named: list[int] = []
    around: list[int] = []
    cleared: list[bool] = []
    held: list[int] = []
    replies: list[bool] = []
    within: list[bool] = []
    owner: list[int] = []  # for each line the innermost of them, or -1
    inner_chars = 0

    def flush():
        if buffer:
            text = " ".join(html_lib.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                role = OUT if depth_out else INNER if depth_main else OPEN
                out.append((text, PROSE if role == INNER and block in PROSE_BLOCKS else role))
                owner.append(named[-1] if named else -1)
                if role == INNER:
                    nonlocal inner_chars
                    inner_chars += len(text)
                    if named:
                        held[named[-1]] += len(text)

    def leave(i):
        nonlocal depth_out, depth_main
        for _, role in stack[i:]:
            depth_out -= role == OUT
            depth_main -= role == INNER
            if role in (NAMED, REPLIES):
                named.pop()
        del stack[i:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            buffer.append(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m[0].startswith("<![CDATA["):
                continue
            if m["raw"]:
                buffer.append(" ")
            continue
        name = name.lower()
        if name == "br":
            buffer.append(" ")
            continue
        is_block = name in BLOCKS
        if is_block:
            flush()
            block = name if not m["close"] else ""
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    leave(i)
                    break
        elif name not in VOID and (not m["attrs"].endswith("/") or _SLASH_VALUE.search(m["attrs"])):
            if name == "body":  # a head that was not closed
                leave(0)
            role = _role(name, m["attrs"])
            if name == "header" and depth_main and role in (OUT, NAMED, REPLIES):
                role = None
            elif name == "header" and not depth_main and role in (NAMED, REPLIES):
                role = OUT  # by its name
            if role is None and name not in BLOCKS:
                continue
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                leave(len(stack) - 1)  # the next one ends it
            if not is_block:
                flush_role = depth_out == 0 and role in (OUT, NAMED, REPLIES)
                if flush_role:
                    flush()
            stack.append((name, role))
            depth_out += role == OUT
            depth_main += role == INNER
            if role in (NAMED, REPLIES):
                around.append(named[-1] if named else -1)
                named.append(len(cleared))
                cleared.append(False)
                held.append(0)
                replies.append(role == REPLIES)
                within.append(depth_main > 0)
            elif role == INNER and depth_out == 0:
                for k in reversed(named):
                    if cleared[k]:
                        break
                    cleared[k] = True
    buffer.append(page[at:])
    flush()
    marked = [False] * len(cleared)
    for k in range(len(cleared) - 1, -1, -1):  # inner ones before those around them
        if around[k] >= 0:
            held[around[k]] += held[k]
    for k in range(len(cleared)):
        big = within[k] and not replies[k] and 2 * held[k] > inner_chars
        marked[k] = not (cleared[k] or big) or (around[k] >= 0 and marked[around[k]] and not cleared[k])
    return [(text, OPEN if k >= 0 and marked[k] and role != OUT else role) for (text, role), k in zip(out, owner)]


def common(x: list[int], y: list[int]) -> set[int]:
    """Positions in x of a longest common subsequence of x and y."""
    begin = 0
    while begin < min(len(x), len(y)) and x[begin] == y[begin]:
        begin += 1
    end = 0
    while end < min(len(x), len(y)) - begin and x[-1 - end] == y[-1 - end]:
        end += 1
    out = set(range(begin)) | set(range(len(x) - end, len(x)))
    both = set(x[begin:len(x) - end]) & set(y[begin:len(y) - end])
    px = [i for i in range(begin, len(x) - end) if x[i] in both]
    py = [j for j in range(begin, len(y) - end) if y[j] in both]
    if not px:
        return out
    out.update(px[k] for k in _align([x[i] for i in px], [y[j] for j in py]))
    return out


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """Bit rows of the alignment: a 0 in row i at j tells that the length grows at j (Allison and Dix)."""
    masks: dict[int, int] = {}
    for j, v in enumerate(y):
        masks[v] = masks.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        u = row & masks.get(v, 0)
        row = ((row + u) | (row - u)) & full
        yield row


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of x and y[:j], for j from 0."""
    row = (1 << len(y)) - 1
    for row in _rows(x, y):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(y)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def _align(x: list[int], y: list[int]) -> list[int]:
    """Positions in x of a longest common subsequence, by halves of x (Hirschberg) while the bit rows are too many."""
    out: list[int] = []
    work = [(0, len(x), 0, len(y))]
    while work:
        a, b, c, d = work.pop()
        if a == b or c == d:
            continue
        if b - a > 1 and (b - a) * (d - c) > ALIGN_BITS:
            mid = (a + b) // 2
            cut = c + int(np.argmax(_lengths(x[a:mid], y[c:d]) + _lengths(x[mid:b][::-1], y[c:d][::-1])[::-1]))
            work += [(a, mid, c, cut), (mid, b, cut, d)]
            continue
        own, other = x[a:b], y[c:d]
        places: dict[int, int] = {}
        for j, v in enumerate(other):
            places[v] = places.get(v, 0) | 1 << j
        rows = list(_rows(own, other))
        full = (1 << len(other)) - 1
        j = len(other)
        for k in range(len(own) - 1, -1, -1):
            above = rows[k - 1] if k else full
            # length up to j with and without line k
            cut = (1 << j) - 1
            grown = j - (rows[k] & cut).bit_count()
            if grown == j - (above & cut).bit_count():
                continue
            match = places[own[k]] & cut
            while match:  # the last place where line k lengthens it
                at = match.bit_length() - 1
                if 1 + at - (above & (1 << at) - 1).bit_count() == grown:
                    out.append(a + k)
                    j = at
                    break
                match ^= 1 << at
    return out


def main_text(own: list[tuple[str, str]], shared: set[int]) -> str:
    """Text of a page whose lines at `shared` are those of its pair too."""
    article = any(r == PROSE for _, r in own)
    kept = []
    for i, (text, role) in enumerate(own):
        if role == PROSE or (role != OUT and i not in shared and not (article and role == OPEN)):
            kept.append(text)
    return "\n".join(kept)


def with_key(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host, key: keys sort by host, path, page_id and digest of html."""
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    page = F.col("page_id").cast("long")
    number = F.when(page.isNull(), "").when(page < 0, F.concat(F.lit("-"), F.lpad((page + F.lit(1 << 62)).cast("string"), 20, "0"))).otherwise(
        F.lpad(page.cast("string"), 20, "0"))
    html = F.coalesce("html", F.lit(""))
    return pages.select(page.alias("page_id"), "url", html.alias("html"), host.alias("host"),
                        F.concat_ws("\u0001", host, path, number, F.md5(html.cast("binary"))).alias("key"))


def _points(keyed: DataFrame, parts: int, sample: int = SAMPLE) -> list[str]:
    """At most parts - 1 keys that cut the rows about evenly; `sample` keys for each range, chosen by their hash."""
    if parts < 2:
        return []
    keys = keyed.select("key")
    n = keys.count()
    m = max(1, n // (sample * parts))
    got = sorted({r.key for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(m)) == 0).collect()})
    return sorted({got[len(got) * k // parts] for k in range(1, parts)}) if got else []


def _bucket(key: Column, points: list[str]) -> Column:
    return range_bucket(key, points)


def _hashes(own: list[tuple[str, str]]) -> list[int]:
    return [int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for t, _ in own]


def _digest_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [blake2b(repr(_hashes(lines(page))).encode(), digest_size=16).digest() for page in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["key"], batch["host"], pa.array(got, pa.binary())], ["key", "host", "digest"])


def _edge_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First keys of the first two runs of equal pages and last keys of the last two, of the ranges in order."""
    runs: list[list] = []  # bucket, host, digest, first key, last key; the first two and last two of a range

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*runs), (pa.int32(), pa.string(), pa.binary(), pa.string(), pa.string()))],
                                          ["bucket", "host", "digest", "first", "last"])

    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("bucket", "host", "digest", "key"))):
            if runs and runs[-1][0] != row[0]:
                yield batch_of()
                runs.clear()
            if runs and runs[-1][1:3] == list(row[1:3]):
                runs[-1][4] = row[3]
            else:
                if len(runs) == 4:
                    del runs[2]
                runs.append([*row, row[3]])
    if runs:
        yield batch_of()


def _neighbours(light: DataFrame, points: list[str]) -> dict[str, list[int]]:
    """Buckets that the page of a key is copied to, as the nearest one with other lines before or behind the range."""
    rows = light.withColumn("bucket", _bucket(F.col("key"), points)).repartitionById(len(points) + 1, "bucket").sortWithinPartitions("key")
    got = rows.select("bucket", "host", "digest", "key").mapInArrow(_edge_partition, "bucket int, host string, digest binary, first string, last string")
    runs: dict[int, list] = {}
    for r in sorted(got.collect(), key=lambda r: (r.bucket, r.first)):
        runs.setdefault(r.bucket, []).append(r)
    out: dict[str, list[int]] = {}
    order = sorted(runs)
    for place, b in enumerate(order):
        for edge, others, side in ((runs[b][-1], order[place + 1:], 0), (runs[b][0], order[:place][::-1], -1)):
            for o in others:
                near = runs[o] if side == 0 else runs[o][::-1]
                other = next((r for r in near if (r.host, r.digest) != (edge.host, edge.digest)), None)
                if other is not None:
                    if other.host == edge.host:
                        out.setdefault(other.first if side == 0 else other.last, []).append(b)
                    break
    return out


def _pair_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in order; a run of equal pages is written when a page with other lines follows."""
    host = before = mine = None  # line hashes of the run before and of this one
    run: list[tuple] = []        # page_id, url, number of the lines in kinds
    kinds: list[list] = []       # equal lines can have different roles

    def batch_of(rows):
        types = [pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], ["page_id", "url", "text", "n_chars"])

    def done(other):
        shared = common(mine, other) if other is not None and run else set()
        texts = [main_text(own, shared) for own in kinds]
        for page_id, url, k in run:
            yield page_id, url, texts[k], len(texts[k])

    rows, size = [], 0
    for batch in batches:
        for page_id, url, page, now_host, real in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "host", "real"))):
            own = lines(page)
            now = _hashes(own)
            if now_host != host or now != mine:
                for row in done(now if now_host == host else before):
                    rows.append(row)
                    size += len(row[2])
                    if size > T.GROUP:
                        yield batch_of(rows)
                        rows, size = [], 0
                before = mine if now_host == host else None
                host, mine = now_host, now
                run.clear()
                kinds.clear()
            if real:
                if own not in kinds:
                    kinds.append(own)
                run.append((page_id, url, kinds.index(own)))
        if rows:
            yield batch_of(rows)
            rows, size = [], 0
    for row in done(before):
        rows.append(row)
        size += len(row[2])
        if size > T.GROUP:
            yield batch_of(rows)
            rows, size = [], 0
    if rows:
        yield batch_of(rows)


def extract(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    parts = parts or partitions(pages.sparkSession)
    keyed = with_key(pages)
    light = written(keyed.select("key", "host", "html").mapInArrow(_digest_partition, "key string, host string, digest binary"), "html-lines")
    points = _points(light, parts)
    rows = keyed.withColumn("bucket", _bucket(F.col("key"), points))
    copied = _neighbours(light, points) if points else {}
    if copied:
        to = F.create_map(*[x for k, v in sorted(copied.items()) for x in (F.lit(k), F.array(*[F.lit(b) for b in v]))])
        extra = F.when(F.col("key").isin(list(copied)), F.transform(F.element_at(to, F.col("key")), lambda b: F.struct(b.alias("bucket"), F.lit(False).alias("real"))))
        ranges = F.array(F.struct("bucket", F.lit(True).alias("real")))
        rows = rows.select("page_id", "url", "html", "host", "key", F.explode(F.when(extra.isNotNull(), F.concat(ranges, extra)).otherwise(ranges)).alias("_r"))
        rows = rows.select("page_id", "url", "html", "host", "key", "_r.*")
    else:
        rows = rows.withColumn("real", F.lit(True))
    rows = rows.repartitionById(len(points) + 1, "bucket").sortWithinPartitions("key")
    return rows.mapInArrow(_pair_partition, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
