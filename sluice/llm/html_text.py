"""Main-text extraction with a host suffix array.

A page is parsed into blocks, each with its place: inside an article, another main
part, or neither, and whether an ancestor is boilerplate by element or by class (menus, site headers, footers, asides, notices, adverts, forms, comments).
Scripts, styles and other raw elements give no text.

Pages of a host with equal token streams are one content, so copies of a page
say nothing. Contents are dealt by host and, on hosts with more than ``run_pages`` contents,
by digest, so a host with a third of all pages is spread over partitions, and handled in runs
of about ``run_pages`` contents of one host. A run's token streams, all tokens outside a marked
body and all tokens inside it, are concatenated, with a separator
of its own after each, and sorted by their first ``depth`` tokens (suffix array by
prefix doubling). Neighbouring suffixes with the same first ``depth`` tokens are one
window, sent on as a 64-bit hash with its number of contents; numbers are added up
over all runs of a host. Windows on at least 3 contents of the host, and on 2 % of
them, are its boilerplate, so neither runs nor partitions matter. Fewer contents that
share a passage are taken for quotes of each other. Windows inside marked bodies are apart from
all others and are boilerplate from half of the host's contents on, 5 at least, because quoted
passages may repeat across articles and must stay.

Every window of a body counts, also across its blocks. What stands on half of a host's contents stands on half of
some run's, so a run sends the body windows on half of its contents, and before sorting it cuts out tokens on fewer.
The other runs are known to have less than half each; only where that leaves a window open are the pages of its host
parsed once more and such windows counted in all contents. So these numbers are exact, too.

In a last pass each page is parsed again and the tokens
that these windows cover are found. A host has at most 50 times as many such windows
as its contents have tokens on average.

What is kept: the repeats decide first. Covered tokens go, and of a marked body those sentences that are
covered from end to end (a notice inside the article, in blocks of its own or not), unless these
are half of the body or more (copies of one article); a sentence ends with its block or after a full stop, question or
exclamation mark, and one with a word of its own stays whole. On the unique runs the markup decides: a page that marks
its body (``article``, ``main`` or a usual class) keeps the body and loses what stands
outside; other pages lose what stands in boilerplate elements. ``n_by_repeats`` and
``n_by_marks`` tell how many tokens went by either. A repeat has ``depth`` tokens at least; shorter ones are the markup's.

Defined results: null or empty html gives empty text; null urls share a host of
their own; ids may be null or repeat; unclosed and truncated markup is read as
browsers do, to the end of the page; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, mix64, slices, small_batches, spread, table

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+|[^>]*+)>|<!--(?:.*?-->|.*+)|<[!?/][^>]*+>?""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
RAW = frozenset("script style noscript template iframe svg math object textarea title xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav footer aside form menu dialog button select head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class and id names that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup sidebar menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead comment comments commentlist disqus respond replies share sharing social related recommended widget toolbar "
    "login search".split()
)
UNMARKED = frozenset("html body article main".split())
#: Whole class and id names that mark the article where no element does.
BODIES = frozenset("article article-body article-content post-content post-body entry-content story-body main-content".split())
#: A passage is boilerplate if it stands on so many distinct contents of the host, and on so many per cent of them.
LEAST_PAGES, LEAST_PERCENT = 3, 2
#: The same inside marked bodies.
BODY_PAGES, BODY_PERCENT = 5, 50
#: How a sentence's last token ends.
_STOP = re.compile(r"""[.!?\u2026\u3002\uff01\uff1f\u061f\u0964]["'\u2019\u201d\u00bb)\]]*$""")
#: So many contents a task remembers, so as not to send them again.
_KNOWN = 1 << 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _marked(tag: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """(is boilerplate, 2 for an article, 1 for another main part or else 0) of an element by its attributes."""
    level = 2 if tag == "article" else int(tag == "main")
    if not attributes or attributes.isspace():
        return False, level
    names: set[str] = set()
    whole: set[str] = set()
    for key, a, b, c in _ATTR.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id"):
            whole.update(value.split())
            names.update(re.split(r"[^a-z0-9]+", value))
        elif key == "role":
            if value == "main":
                level = max(level, 1)
            elif value in ROLES:
                return True, 0
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True, 0
    if tag in UNMARKED:
        comment = tag == "article" and not names.isdisjoint(("comment", "comments", "reply", "respond"))
        return comment, 0 if comment else level
    if not names.isdisjoint(MARKS) or "side" in whole or ("header" in names and not in_article):
        return True, 0
    return False, level if whole.isdisjoint(BODIES) else 2


def parse(page: str) -> list[tuple[str, int, bool]]:
    """Blocks of a page in order: (text, 2 in an article, 1 in another main part or 0, inside boilerplate)."""
    blocks: list[tuple[str, int, bool]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # (element, boilerplate, article), both inherited
    drop, article = False, 0
    at, end = 0, len(page)

    def flush():
        if buffer:
            text = _SPACE.sub(" ", "".join(buffer)).strip(" ")
            buffer.clear()
            if text:
                blocks.append((text, article, drop))

    def take(text):
        buffer.append(entities.unescape(text) if "&" in text else text)

    while at < end:
        # Without a closing bracket ahead no tag can end: the rest is text, or markup that the end cuts off.
        m = _TAG.search(page, at) if page.find(">", at) >= 0 or page.startswith("<!--", page.find("<", at)) else None
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest[rest.rfind(">") + 1 :])  # a tag that the end of the page cuts off
            take(rest[: rest.rfind(">") + 1 + cut.start()] if cut else rest)
            break
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag not in BLOCK and any(s[0] in BLOCK for s in stack[k + 1 :]):
                        break  # inline end tags don't close blocks
                    del stack[k:]
                    drop, article = stack[-1][1:] if stack else (False, 0)
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if stack and stack[-1][0] == "p" and tag != "p" or tag == "p":
                # A paragraph ends where a block begins; inline elements left open in it end with it.
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCK:
                        break
                drop, article = stack[-1][1:] if stack else (False, 0)
        if tag in VOID:
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        bad, level = _marked(tag, m[3], article > 0)
        bad = bad or tag in BOILERPLATE or (tag == "header" and not article)
        drop, article = drop or bad, article if drop else max(article, level)
        if tag in BLOCK or bad:
            stack.append((tag, drop, article))
        else:
            drop, article = stack[-1][1:] if stack else (False, 0)
    flush()
    return blocks


def suffix_groups(streams: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array to ``depth`` tokens of the streams, each followed by ``depth`` separators of its own: (positions in
    order, where each group with the same first ``depth`` tokens begins, how many streams each group stands in)."""
    # With separators of its own, an equal prefix never reaches over a stream's end.
    top = max(int(s.max()) for s in streams if len(s)) + 1
    text = np.concatenate([np.concatenate((s, np.full(depth, top + k))) for k, s in enumerate(streams)]).astype(np.int64)
    owner = np.repeat(np.arange(len(streams)), [len(s) + depth for s in streams])
    rank, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while width < depth:
        step = min(width, depth - width)
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1
        rank, width = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1].astype(np.int64), width + step
    order = np.argsort(rank, kind="stable")  # the suffix array, sorted to ``depth`` tokens; owners rise in a group
    sorted_rank, sorted_owner = rank[order], owner[order]
    new = np.concatenate(([True], sorted_rank[1:] != sorted_rank[:-1]))
    head = np.flatnonzero(new)
    other = new | np.concatenate(([True], sorted_owner[1:] != sorted_owner[:-1]))
    return order, head, np.add.reduceat(other.astype(np.int64), head)


def repeated_tokens(streams: list[np.ndarray], depth: int = 8, least: int = 2) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run of ``depth`` tokens that stands in ``least`` or more streams."""
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    if lengths.sum() == 0:
        return [np.zeros(n, bool) for n in lengths]
    order, head, owners = suffix_groups(streams, depth)
    covered = _cover(order[np.repeat(owners >= least, np.diff(np.append(head, len(order))))], len(order), depth)
    at = np.cumsum(lengths + depth) - (lengths + depth)
    return [covered[a : a + n] for a, n in zip(at, lengths, strict=True)]


def _cover(starts: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Which of ``n`` tokens lie in one of the windows of ``depth`` tokens that begin at ``starts``."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + depth, n), -1)
    return np.cumsum(cover[:-1]) > 0


def body_level(blocks: list[tuple[str, int, bool]]) -> int:
    """Which blocks are the page's body: 2 for its article's, 1 for its main part's, 0 where neither is marked."""
    return max((b[1] for b in blocks if not b[2]), default=0)


def is_body(block: tuple[str, int, bool], best: int) -> bool:
    return best > 0 and block[1] == best and not block[2]


def decide(blocks: list[tuple[str, int, bool]], split: list[list[str]], covered: np.ndarray, gone: np.ndarray) -> tuple[str, int, int, int]:
    """(text, tokens, of them removed by repeats, of them removed by marks).

    ``covered`` tells the tokens outside a marked body that repeats cover, ``gone`` the tokens in it that they remove.
    """
    best, kept, at, by_marks = body_level(blocks), [], 0, 0
    by_repeats = int(covered.sum()) + int(gone.sum())
    touched = by_repeats > 0
    for block, w in zip(blocks, split, strict=True):
        mine, at = (covered[at : at + len(w)] | gone[at : at + len(w)]) if touched else None, at + len(w)
        repeated = int(mine.sum()) if touched else 0
        if not is_body(block, best) and (best or block[2]):
            by_marks += len(w) - repeated
        elif not repeated:
            kept.append(block[0])
        elif repeated < len(w):
            kept.append(" ".join(x for x, c in zip(w, mine, strict=True) if not c))
    return "\n".join(kept), at, by_repeats, by_marks


def least_of(contents: int, least_pages: int = LEAST_PAGES, percent: int = LEAST_PERCENT) -> int:
    """On how many of a host's distinct contents a passage stands at least to be boilerplate."""
    return max(least_pages, -(-contents * percent // 100))


def page_stream(blocks: list[tuple[str, int, bool]], split: list[list[str]], seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash, even and not 0, of each token; which tokens are in a marked body)."""
    best, out = body_level(blocks), []
    for words in split:
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w) & ~1 or 2
            out.append(h)
    inside = np.repeat(np.array([is_body(b, best) for b in blocks], bool), [len(w) for w in split]) if blocks else np.zeros(0, bool)
    return np.array(out, dtype=np.uint64), inside


def outside_stream(stream: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The tokens outside a marked body, with a 0 for each token in it."""
    return np.where(inside, np.uint64(0), stream)


def _odd(short: np.ndarray) -> np.ndarray:
    return short.astype(np.uint64) << np.uint64(1) | np.uint64(1)


def body_stream(stream: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The tokens in a marked body, by 32 bits of their hashes each.

    They are odd, so windows of a body are never those of its surroundings.
    """
    return _odd(stream[inside] >> np.uint64(32))


def window_hashes(stream: np.ndarray, depth: int, host: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``depth`` tokens at each token, odd in a marked body, and which windows are whole and without a 0."""
    n = len(stream)
    padded = np.concatenate((stream, np.zeros(depth, np.uint64)))
    total, factor, whole = np.full(n, host, np.uint64), np.uint64(1), np.ones(n, bool)
    for j in range(depth):
        part = padded[j : j + n]
        total += part * factor
        factor = np.multiply(factor, _FACTOR)
        whole &= part != 0
    return mix64(total) & ~np.uint64(1) | stream & np.uint64(1), whole


def window_counts(streams: list[np.ndarray], depth: int, host: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each distinct window of ``depth`` tokens, in how many streams it stands), by the streams' suffix array."""
    if not any(len(s) for s in streams):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ids = np.unique(np.concatenate(streams), return_inverse=True)[1]
    ends = np.cumsum([len(s) for s in streams])
    order, head, owners = suffix_groups(np.split(ids, ends[:-1]), depth)
    spaced = np.concatenate([np.concatenate((s, np.zeros(depth, np.uint64))) for s in streams])
    hashes, whole = window_hashes(spaced, depth, host)
    first = order[head]
    return hashes[first[whole[first]]], owners[whole[first]]


def covered_tokens(stream: np.ndarray, wanted: np.ndarray, depth: int, host: int) -> np.ndarray:
    """Which tokens lie in a window whose hash is in ``wanted``, which is sorted."""
    if not len(wanted) or not len(stream):
        return np.zeros(len(stream), bool)
    hashes, whole = window_hashes(stream, depth, host)
    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
    return _cover(np.flatnonzero(whole & (wanted[at] == hashes)), len(stream), depth)


def gone_tokens(split: list[list[str]], inside: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Which tokens of the page are in a sentence of its body that is ``covered`` from end to end, none if these make up half of
    the body: then the pages are copies of one article. ``covered`` tells it of the body's tokens only."""
    gone = np.zeros(len(inside), bool)
    if not covered.any():
        return gone
    last = np.zeros(len(inside), bool)
    last[np.cumsum([len(w) for w in split]) - 1] = True
    last[[k for k, w in enumerate(x for words in split for x in words) if _STOP.search(w)]] = True
    begins = np.concatenate(([0], np.flatnonzero(last[inside])[:-1] + 1))
    mine = np.repeat(np.logical_and.reduceat(covered, begins), np.diff(np.append(begins, len(covered))))
    if 2 * int(mine.sum()) < len(covered):
        gone[inside] = mine
    return gone


def content_digest(blocks: list[tuple[str, int, bool]]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(b[0] for b in blocks))


def told_stream(stream: np.ndarray, inside: np.ndarray) -> bytes:
    """What a page tells its host: the tokens outside a marked body with one 0 for each gap, after their number, then all
    of the body's tokens in 32 bits each."""
    out = outside_stream(stream, inside)
    said = out != 0
    out = out[said | np.concatenate(([True], said[:-1]))] if len(out) else out
    return np.uint64(len(out)).tobytes() + out.tobytes() + (stream[inside] >> np.uint64(32)).astype(np.uint32).tobytes()


def untold(told: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(tokens outside a marked body, tokens in it) of what a page told."""
    n = int(np.frombuffer(told, np.uint64, 1)[0])
    return np.frombuffer(told, np.uint64, n, 8), _odd(np.frombuffer(told, np.uint32, -1, 8 + 8 * n))


def content(blocks, stream: np.ndarray, inside: np.ndarray) -> tuple[bytes, int, bytes, bytes]:
    """(the content's digest, tokens outside a body, digest of what the page tells, what it tells). Of equal contents the one
    with the most tokens in a body tells, which has the least second and third part."""
    told = told_stream(stream, inside)
    return content_digest(blocks), len(inside) - int(np.count_nonzero(inside)), xxhash.xxh3_128_digest(told), told


def frequent_parts(streams: list[np.ndarray], least: int) -> list[np.ndarray]:
    """The streams with one 0 for each gap of tokens that stand in fewer than ``least`` of them: no window with such a token
    stands in more."""
    if least < 2:
        return streams
    tokens, counts = np.unique(np.concatenate([np.unique(s) for s in streams]), return_counts=True)
    wanted = tokens[counts >= least]
    out = []
    for s in streams:
        if not len(s) or not len(wanted):
            out.append(s[:0])
            continue
        said = wanted[np.minimum(np.searchsorted(wanted, s), len(wanted) - 1)] == s
        out.append(np.where(said, s, np.uint64(0))[said | np.concatenate(([True], said[:-1]))])
    return out


def run_windows(told: list[bytes], depth: int, host: int, least: int, least_body: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window, in how many contents of a run it stands): windows outside a body on ``least`` contents, windows
    in one on ``least_body``."""
    outside, body = zip(*map(untold, told), strict=True)
    found = [(*window_counts(list(outside), depth, host), least), (*window_counts(frequent_parts(list(body), least_body), depth, host), least_body)]
    keep = [counts >= needed for _, counts, needed in found]
    return tuple(np.concatenate([f[k][m] for f, m in zip(found, keep, strict=True)]) for k in (0, 1))


def extract_page(blocks, split, stream: np.ndarray, inside: np.ndarray, wanted: tuple[np.ndarray, np.ndarray], depth: int, host: int) -> tuple[str, int, int, int, int]:
    """(main text, tokens, tokens covered by repeats, removed by repeats, removed by marks).

    ``wanted`` has the sorted windows outside and inside of marked bodies.
    """
    covered = covered_tokens(outside_stream(stream, inside), wanted[0], depth, host)
    gone = gone_tokens(split, inside, covered_tokens(body_stream(stream, inside), wanted[1], depth, host) if len(wanted[1]) else np.zeros(0, bool))
    text, tokens, by_repeats, by_marks = decide(blocks, split, covered, gone)
    return text, tokens, int(covered.sum()) + int(gone.sum()), by_repeats, by_marks


def by_place(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted windows outside of marked bodies, sorted windows inside)."""
    windows = np.unique(windows)
    inside = (windows & np.uint64(1)).astype(bool)
    return windows[~inside], windows[inside]


def extract_run(pages: list[str], depth: int = 8) -> list[tuple[str, int, int]]:
    """(main text, tokens, tokens covered by repeats) of each page of one host."""
    parsed = [parse(p or "") for p in pages]
    tokens = [_split(blocks) for blocks in parsed]
    seen: dict[str, int] = {}
    streams = [page_stream(blocks, split, seen) for blocks, split in zip(parsed, tokens, strict=True)]
    contents: dict[bytes, tuple[int, bytes, bytes]] = {}
    for blocks, stream in zip(parsed, streams, strict=True):
        key, *mine = content(blocks, *stream)
        contents[key] = min(tuple(mine), contents.get(key, tuple(mine)))
    n = len(contents)
    wanted = by_place(run_windows([c[2] for c in contents.values()], depth, 0, least_of(n), least_of(n, BODY_PAGES, BODY_PERCENT))[0])
    return [extract_page(blocks, split, *stream, wanted, depth, 0)[:3] for blocks, split, stream in zip(parsed, tokens, streams, strict=True)]


def host_hash(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host)


def _split(blocks):
    return [b[0].split(" ") for b in blocks]


def _contents(run_chars: int, finish, types, names):
    """(host, x, html) in; what ``finish(host, x, content, stream, inside)`` makes of each page out, without most copies."""

    def run(batches):
        known: dict[tuple, tuple] = {}  # copies of a page would all go to one partition
        for batch in batches:
            for part in slices(batch, 2, run_chars):
                seen: dict[str, int] = {}
                found = []
                for host, x, page in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    blocks = parse(page or "")
                    stream, inside = page_stream(blocks, _split(blocks), seen)
                    mine = content(blocks, stream, inside)
                    if mine[1:3] >= known.get((host, mine[0]), (float("inf"),)):
                        continue
                    if len(known) >= _KNOWN:
                        known.clear()
                    known[host, mine[0]] = mine[1:3]
                    found.append(finish(host, x, mine, stream, inside))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(types)], names=names)

    return run


def _streams(run_chars: int):
    """(host, its deals, html) in; (host, its deals, the content's deal, its digest, tokens outside a body, digest of what the
    page tells its host, what it tells) out."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    finish = lambda host, deals, mine, stream, inside: (host, deals, int.from_bytes(mine[0][:4]) % deals, *mine)
    return _contents(run_chars, finish, types, ["host", "deals", "deal", "digest", "told", "mark", "stream"])


def _hits(open_windows, run_chars: int, depth: int):
    """(host, null, html) in; (host, the content's digest, tokens outside a body, digest of what the page tells, which of the
    body windows of ``open_windows`` it has) out."""

    def finish(host, _, mine, stream, inside):
        hashes, whole = window_hashes(body_stream(stream, inside), depth, host_hash(host))
        return host, *mine[:3], np.intersect1d(hashes[whole], open_windows.value).view(np.int64)

    types = [pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    return _contents(run_chars, finish, types, ["host", "digest", "told", "mark", "hits"])


def _count_runs(run_pages: int, run_chars: int, depth: int):
    """(host, its deals, deal, digest, stream), sorted by host, deal and digest, in; (host, window, in how many contents of a
    run, most contents of this run that an unsent body window can have) out, with a null window for all contents."""

    def finish(host, streams, whole):
        n = len(streams)
        # Of a host in one run the numbers are final, else body windows on half of no run can't be on half of all contents.
        least = (least_of(n), least_of(n, BODY_PAGES, BODY_PERCENT)) if whole else (1, least_of(n, 1, BODY_PERCENT))
        hashes, counts = run_windows(streams, depth, host_hash(host), *least)
        windows = pa.array(np.append(hashes.view(np.int64), 0), mask=np.append(np.zeros(len(hashes), bool), True))
        slack = 0 if whole else least[1] - 1
        return pa.RecordBatch.from_arrays(
            [pa.array([host] * len(windows), pa.string()), windows, pa.array(np.append(counts, n).astype(np.int64)), pa.array([slack] * len(windows), pa.int64())],
            names=["host", "window", "n", "slack"],
        )

    def run(batches):
        last, digest, streams, size, whole = None, None, [], 0, True
        for batch in batches:
            for host, deals, deal, key, stream in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (host, deal) != last:
                    if streams:
                        yield finish(last[0], streams, whole)
                    last, digest, streams, size, whole = (host, deal), None, [], 0, deals == 1
                if key == digest:
                    continue  # a copy, and the first of equal contents tells
                if streams and (len(streams) >= 2 * run_pages or size >= run_chars):
                    whole = False
                    yield finish(host, streams, whole)
                    streams, size = [], 0
                digest = key
                streams.append(stream)
                size += len(stream)
        if streams:
            yield finish(last[0], streams, whole)

    return run


def _extract_batches(wanted, run_chars: int, depth: int):
    """(page_id, url, host, html) in; extracted pages out. ``wanted`` is a broadcast of sorted window hashes
    outside and inside of marked bodies."""

    def run(batches):
        repeats = wanted.value
        for batch in batches:
            for part in slices(batch, 3, run_chars):
                seen: dict[str, int] = {}
                found = []
                for host, page in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    blocks = parse(page or "")
                    split = _split(blocks)
                    found.append(extract_page(blocks, split, *page_stream(blocks, split, seen), repeats, depth, host_hash(host)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([f[0] for f in found], pa.string()),
                        pa.array([len(f[0]) for f in found], pa.int64()),
                        pa.array([f[1] for f in found], pa.int64()),
                        *(pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4)),
                    ],
                    names=["page_id", "url", "text", "n_chars", "n_tokens", "n_repeated", "n_by_repeats", "n_by_marks"],
                )

    return run


def _blocks(windows: DataFrame, block_windows: int):
    """(host, window) by blocks of hosts, of some 8 * ``block_windows`` bytes each: (what tells a block's hosts, its windows)."""
    blocks = max(1, -(-windows.count() // block_windows))
    block = F.pmod(F.xxhash64("host"), F.lit(blocks))
    for k in range(blocks):
        found = windows.where(block == k).select("window").toArrow().column(0).to_numpy()
        yield block == k, np.unique(found.astype(np.int64).view(np.uint64))


def host_repeats(pages: DataFrame, run_pages: int, run_chars: int, depth: int, block_windows: int) -> DataFrame:
    """(host, window): hashes of the windows of ``depth`` tokens that are boilerplate of a host, by all its distinct contents."""
    spark = pages.sparkSession
    large = pages.groupBy("host").agg(F.approx_count_distinct("html").alias("n")).where(F.col("n") > run_pages)
    large = large.select("host", F.expr(f"(n + {run_pages - 1}) div {run_pages}").alias("deals"))
    dealt = pages.join(F.broadcast(large), "host", "left").select("host", F.coalesce("deals", F.lit(1).cast("long")).alias("deals"), "html")
    streams = dealt.mapInArrow(_streams(run_chars), "host string, deals long, deal long, digest binary, told long, mark binary, stream binary")
    runs = streams.repartition("host", "deal").sortWithinPartitions("host", "deal", "digest", "told", "mark").select("host", "deals", "deal", "digest", "stream")
    counts = runs.mapInArrow(_count_runs(run_pages, run_chars, depth), "host string, window long, n long, slack long")
    counts = counts.groupBy("host", "window").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack"))
    body = F.col("window").bitwiseAND(1) == 1
    counts = materialize(counts.where(F.col("window").isNull() | body | (F.col("n") >= LEAST_PAGES)), "html-windows")
    least = lambda pages_, percent: F.greatest(F.lit(pages_), F.expr(f"(n * {percent} + 99) div 100"))
    hosts = counts.where("window is null").select(
        "host", least(LEAST_PAGES, LEAST_PERCENT).alias("least"), least(BODY_PAGES, BODY_PERCENT).alias("least_body"), F.col("slack").alias("all_slack")
    )
    counts = counts.where("window is not null").join(hosts, "host")
    found = counts.where(F.col("n") >= F.when(body, F.col("least_body")).otherwise(F.col("least"))).select("host", "window")
    # Body windows that runs which did not send them may still bring to half of the contents: counted in all of them.
    rest = counts.where(body & F.expr("n < least_body and n + all_slack - slack >= least_body")).select("host", "window", "least_body")
    rest = materialize(rest, "html-open")
    for mine, windows in _blocks(rest, block_windows):
        if len(windows):
            there = pages.where(mine).join(rest.where(mine).select("host").distinct(), "host", "left_semi")
            there = there.select("host", F.lit(None).cast("long").alias("x"), "html")
            wanted = spark.sparkContext.broadcast(windows)
            hits = there.mapInArrow(_hits(wanted, run_chars, depth), "host string, digest binary, told long, mark binary, hits array<long>")
            hits = hits.groupBy("host", "digest").agg(F.min(F.struct("told", "mark", "hits")).alias("least"))
            n = hits.select("host", F.explode("least.hits").alias("window")).groupBy("host", "window").agg(F.count("*").alias("n"))
            found = found.unionByName(n.join(rest.where(mine), ["host", "window"]).where("n >= least_body").select("host", "window"))
    return found


def extract_text(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    run_pages: int = 512,
    run_chars: int = 2 << 20,
    depth: int = 8,
    block_windows: int = 2_000_000,
) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars, n_tokens (of all text), n_repeated (of them covered by repeats),
    n_by_repeats and n_by_marks (of them removed by either)."""
    spark = df.sparkSession
    small_batches(spark)
    url = F.col(url_col).cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = spread(df.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html")))
    repeats = host_repeats(rows.select("host", "html"), run_pages, run_chars, depth, block_windows)
    repeats = materialize(repeats, "html-repeats")
    schema = "page_id long, url string, text string, n_chars long, n_tokens long, n_repeated long, n_by_repeats long, n_by_marks long"
    out = None
    for mine, windows in _blocks(repeats, block_windows):
        wanted = spark.sparkContext.broadcast(by_place(windows))
        part = rows.where(mine).mapInArrow(_extract_batches(wanted, run_chars, depth), schema)
        out = part if out is None else out.unionByName(part)
    return out


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_text": op2_html_text}
ORACLE_SQL: dict[str, str] = {}  # parsing html is no SQL; tests compare with expected texts
