"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of text chunks and tags. Words score positive and tags negative; the weights are log odds of
standing inside the main element (`article` or `main`), counted on Spark over pages that have one, from at most
SAMPLE pages (by hash of page_id). Words are told apart by the block they stand in, the chunk's length, whether they are a link and
whether they begin with a copyright sign, never by names: so menus, teasers and imprints that nothing marks have weights of their own,
below 0 where they stand outside. A run of marked boilerplate (navigation, page header and footer, asides, forms, adverts,
notices, comments ...: elements or names) costs RUN at most, so text on both sides of it stays together. One linear
scan finds the contiguous region with the highest sum (the first on ties). Boilerplate in it is left out; the rest is
decoded, spaces joined, blocks put together by line feeds. Where the region holds under TRUST of the page's words that are
neither links nor marked (a page unlike those learned from), all words score above 0 and the scan is done again.

A page's own main element counts if it holds TRUST or more of the words of the best region found without it; then
words outside of it have the learned weight of such words, and tags and boilerplate inside it score 0. A teaser in
an `article` so does not hide the text beside it.

A name marks boilerplate if its last word does (`post-share`), words of place and layout at its end aside (`comment-body`): in `ad-hoc` or
`sharing-economy` the last word says something else.

Defined results: null, empty and tag-only pages give the empty text; broken markup is read leniently (unclosed
comments and scripts run to the end, a `<` that no `>` follows is text, and after a quotation that swallows the rest of
the page quotes no longer count), in time linear in the page's length; very long pages are read whole; repeated rows
give repeated rows; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 2_000
LEAST, MOST = 0.05, 2.0
#: What a run of boilerplate costs at most, and the share of words that makes a main element count.
RUN, TRUST = 8.0, 0.3

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title select object canvas math".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li td dd dt figcaption".split())
MAIN = frozenset(("article", "main"))
BOILERPLATE = frozenset("nav footer aside form button menu dialog head".split())
KNOWN = BLOCKS | VOID | RAW | frozenset("a b i em strong span u small sub sup code img q cite mark abbr time label".split())
# Words in class, id and role. STRONG ones mark boilerplate anywhere, TALK ones even around a main element, NOTICES
# containers, WEAK ones only containers outside of the main element; LAYOUT words before one say that a page has it, not that this is it.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promoted promotion nav navbar navigation menubar breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent newsletter subscribe subscription signup login share sharing social popup modal overlay gdpr toolbar pagination pager widget widgets contentinfo".split()
)
TALK = frozenset(
    "comment comments commentlist disqus reply replies respond response responses reaction reactions discussion discussions feedback opinions related recommended recommendations".split()
)
WEAK = frozenset("banner menu side aside rail bottom header register search more hidden privacy legal copyright complementary skip".split())
NOTICES = frozenset("notice notices notification notifications alert alerts disclaimer".split())
# Words of place and layout that may stand at the end of a name.
PLACE = frozenset(
    "area bar block body bottom box button buttons card column container content count entry footer form frame group header heading holder icon icons image inner item items label left link links list main module number outer page pane panel primary region right row secondary section slot space text thread title toggle top unit wrap wrapper zone posts post articles stories".split()
)
LAYOUT = frozenset("has with no is without".split())
_MARKS = STRONG | TALK | WEAK | NOTICES

_OPEN = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?=[\s/]|$))", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_IMPRINT = re.compile(r"\s*(?:©|\(c\)\s*\d|copyright\s*(?:©|\(c\)|\d))", re.I)
_CLOSE = {name: re.compile(f"</{name}(?![a-zA-Z0-9:-])", re.I) for name in RAW}


def marks(page: str):
    """(kind, value, attributes) in page order; kind is "text", "open", "close" or "void". One pass, linear."""
    at, n, quoted = 0, len(page), True
    text_from, last = 0, page.rfind(">")
    while True:
        i = page.find("<", at)
        if i < 0 or i > last:
            break
        m = _OPEN.match(page, i + 2 if page.startswith("</", i) else i + 1)
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = n if end < 0 else end + 3
            found = None
        elif m is None:
            if not page.startswith(("<!", "<?", "</"), i):
                at = i + 1  # a plain "<"
                continue
            end, found = page.find(">", i) + 1, None
        else:
            end, found = m.end(), m
            while quoted:
                stop = _STOP.search(page, end)
                if stop is None:
                    quoted = False
                elif page[stop.start()] == ">":
                    end = stop.start() + 1
                    break
                else:
                    end = page.find(stop[0], stop.end()) + 1
                    quoted = end > 0
            if not quoted:
                end = page.find(">", m.end()) + 1
        if i > text_from:
            yield "text", page[text_from:i], ""
        at = text_from = end
        if found is None:
            continue
        name = found[0].lower()
        if page[i + 1] == "/":
            yield "close", name, ""
            continue
        attributes = page[found.end() : end - 1]
        if name in RAW:
            if not attributes.endswith("/"):
                close = _CLOSE[name].search(page, at)
                end = page.find(">", close.end()) + 1 if close else 0
                at = text_from = end or n
            continue
        yield "void" if name in VOID or attributes.endswith("/") and name not in BLOCKS else "open", name, attributes
    if n > text_from:
        yield "text", page[text_from:], ""


def _mark(name: str, attributes: str) -> int:
    """How an element is marked: 0 not, 1 WEAK, 2 STRONG, 3 TALK or by its element name, 4 hidden."""
    found = 3 if name in BOILERPLATE and name != "form" else 2 if name == "form" else 1 if name == "header" else 0
    if not attributes or name in ("html", "body", "main"):
        return found
    for key, value in _NAMES.findall(attributes):
        key = key.lower()
        if key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return 4
        if key == "style":
            continue
        for one in value.strip("\"'").split():
            words = [w.lower() for w in _SPLIT.split(one) if w]
            last = len(words)
            while last and words[last - 1] not in _MARKS and words[last - 1] in PLACE:
                last -= 1
            if not last or words[last - 1] not in _MARKS:
                continue
            for i, w in enumerate(words[:last]):
                if i and words[i - 1] in LAYOUT:
                    continue
                if w in TALK:
                    found = max(found, 3)
                elif w in STRONG or w in NOTICES and name not in PROSE:
                    found = max(found, 2)
                elif w in WEAK and name not in PROSE:
                    found = max(found, 1)
    return found


def items(page: str | None):
    """(kind, value, boilerplate, main, link, block): kind "text", or "tag" with the element's name."""
    parent, names, level, holds, depth_block = [-1], [""], [0], [False], [0]
    tokens: list[tuple[str, str, int]] = []  # kind, value, element
    stack, open_names = [0], {}

    def close_to(k: int) -> None:
        for e in stack[k:]:
            open_names[names[e]] -= 1
        del stack[k:]

    for kind, value, attributes in marks(page or ""):
        if kind == "text":
            tokens.append((kind, value, stack[-1]))
            continue
        if kind == "close":
            if open_names.get(value):
                low = 0 if value in BLOCKS else depth_block[stack[-1]]
                k = len(stack) - 1
                while k > low and names[stack[k]] != value:
                    k -= 1
                if k > 0 and names[stack[k]] == value:
                    close_to(k)
            tokens.append(("tag", value, stack[-1]))
            continue
        if value in BLOCKS and value != "br":  # a block ends an open paragraph
            k = depth_block[stack[-1]]
            if k and (names[stack[k]] == "p" or value == "li" and names[stack[k]] == "li"):
                close_to(k)
        if kind == "void":
            tokens.append(("tag", value, stack[-1]))
            continue
        e = len(names)
        parent.append(stack[-1])
        names.append(value)
        level.append(_mark(value, attributes))
        holds.append(False)
        depth_block.append(len(stack) if value in BLOCKS else depth_block[stack[-1]])
        stack.append(e)
        open_names[value] = open_names.get(value, 0) + 1
        tokens.append(("tag", value, e))
    for e, name in enumerate(names):  # which elements hold a main element or a top heading
        if name == "h1" or name in MAIN and level[e] < 2:
            up = parent[e]
            while up > 0 and not holds[up]:
                holds[up] = True
                up = parent[up]
    boiler, main, link = [False] * len(names), [False] * len(names), [False] * len(names)
    block = [""] * len(names)
    for e in range(1, len(names)):
        p, mark = parent[e], level[e]
        boiler[e] = boiler[p] or mark >= 3 or mark == 2 and not holds[e] or mark == 1 and not main[p] and not (holds[e] and names[e] != "header")
        main[e] = main[p] or names[e] in MAIN and not boiler[e]
        link[e] = link[p] or names[e] == "a"
        block[e] = names[e] if names[e] in BLOCKS else block[p]
    return [(kind, value, boiler[e], main[e], link[e], block[e]) for kind, value, e in tokens]


def _kind(kind: str, value: str, link: bool, block: str, n: int) -> str:
    """The token kind that has a weight of its own."""
    if kind != "text":
        return f"<{value}>" if value in KNOWN else "<other>"
    if link:
        return "link"
    if _IMPRINT.match(entities.unescape(value[:80])):
        return "imprint"
    place = "heading" if block in HEADINGS else block if block in PROSE else "other"
    return f"{place} {'short' if n < 4 else 'middle' if n < 15 else 'long'}"


def counts(page: str | None) -> dict[tuple[str, bool], int]:
    """(token kind, inside main) -> tokens, of a page that marks its main element; else empty."""
    out: dict[tuple[str, bool], int] = {}
    for kind, value, boiler, main, link, block in items(page):
        n = len(value.split()) if kind == "text" else 1
        inside = main and not boiler
        for key in (_kind(kind, value, link, block, n), *(() if main else ("outside" if kind == "text" else "<outside>",))):
            out[key, inside] = out.get((key, inside), 0) + n
    return out if any(inside for _, inside in out) else {}


def learn(pages: DataFrame) -> dict[str, float]:
    """Log odds of each token kind standing inside the main element."""
    import pyarrow as pa

    ids = pages.select("page_id").where(F.col("page_id").isNotNull()).orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    chosen = pages.join(F.broadcast(ids.distinct()), "page_id", "left_semi").select("html")

    def run(batches):
        for batch in batches:
            total: dict = {}
            for page in batch.column(0).to_pylist():
                for k, n in counts(page).items():
                    total[k] = total.get(k, 0) + n
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())],
                names=["kind", "inside", "n"],
            )

    seen: dict[str, list[int]] = {}
    for r in chosen.mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect():
        seen.setdefault(r["kind"], [0, 0])[r["inside"]] += r["n"]
    return log_odds(seen)


def log_odds(seen: dict[str, list[int]]) -> dict[str, float]:
    """kind -> log odds of the inside, from kind -> [outside, inside] counts."""
    out, into = (sum(v[i] for v in seen.values()) + 1 for i in (0, 1))
    return {k: math.log((v[1] + 0.5) / into) - math.log((v[0] + 0.5) / out) for k, v in seen.items()}


def gains(tokens: list, weights: dict[str, float], trusted: bool, plain: bool = False) -> list[float]:
    """The score of every token; `trusted`: the page's main element counts; `plain`: words score above 0."""
    out, run = [], 0.0
    link = min(-LEAST, max(-MOST, weights.get("link", -1.0)))
    outside = min(-LEAST, max(-MOST, weights.get("outside", -1.0)))
    for kind, value, boiler, main, linked, block in tokens:
        n = len(value.split()) if kind == "text" else 1
        inside = trusted and main
        if not boiler:
            run = 0.0
        if boiler:
            gain = 0.0 if inside else -min(n * (1.0 if kind == "text" else 0.5), RUN - run)
            run -= gain
        elif trusted and not main:
            gain = outside * n
        elif kind == "tag":
            gain = 0.0 if inside else min(-LEAST, max(-MOST, weights.get(_kind(kind, value, linked, block, n), -0.3)))
        elif linked and not inside:
            gain = link * n
        else:
            least = LEAST if linked else 0.3 if inside or plain else -MOST
            gain = n * min(MOST, max(least, weights.get(_kind(kind, value, linked, block, n), 1.0)))
        out.append(gain)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end of the contiguous region with the highest sum; the first such on ties, (0, 0) if none is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, gain in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += gain
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(page: str | None, weights: dict[str, float]) -> str:
    tokens = items(page)
    size = lambda some: sum(len(t[1].split()) for t in some if t[0] == "text" and not t[2] and not t[4])
    first, end = best_region(gains(tokens, weights, False))
    if size(tokens[first:end]) < TRUST * size(tokens):
        first, end = best_region(gains(tokens, weights, False, True))
    own = size(t for t in tokens if t[3])
    trusted = own > 0 and own >= TRUST * size(tokens[first:end])
    if trusted:
        first, end = best_region(gains(tokens, weights, True))
    blocks, block = [], []
    for kind, value, boiler, main, *_ in tokens[first:end]:
        if kind == "text":
            if not boiler and (main or not trusted):
                block.append(entities.unescape(value))
        elif value in BLOCKS:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x and not _IMPRINT.match(x))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    import pyarrow as pa

    shared = pages.sparkSession.sparkContext.broadcast(learn(pages))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(p, shared.value) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
