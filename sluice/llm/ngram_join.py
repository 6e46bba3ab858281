"""N-gram Jaccard join with signature trees.

A document is the set of its distinct word shingles (64-bit hashes). Documents
with equal sets are one class, known by a fingerprint of the set.

Routing, without loss. Two sets within the threshold t differ in at most
``H = (1 - t) / (1 + t) * (|x| + |y|)`` shingles. Sizes fall into intervals
``[l, l / t]``; a pair within t lies in one interval or two neighbouring ones.
For each interval the shingles are dealt by hash into somewhat more than
``H + 1`` segments, and a document announces a hash of each of its fullest
segments: all with at least q shingles, q being the largest number for which
these are ``H + 1`` or more. Of any ``H + 1`` segments of one side at least one is
the same on the other side; taking the side with the larger q, that segment is
full enough to be announced by both. Where classes announce the same they *meet*;
a common passage alone seldom makes a meeting, because a segment holds several
shingles and all must be equal. In each meeting a signature tree of the members'
bitmaps tells which pairs could be linked; these pairs join classes into *blocks*.

Joining. Each block builds a signature tree: leaves hold a bitmap of a class's
shingles and its size, inner nodes the OR of the bitmaps and the size range. A
dual traversal descends into pairs of nodes only while the greatest overlap
that bitmaps and sizes allow reaches the threshold, and never into a pair of
nodes whose members are already linked to each other. Surviving pairs of leaves
are verified on the sets themselves. A block above ``block_shingles`` is cut by
size into chunks whose pairs are separate tasks, so no task holds an unbounded
group.

Defined results: documents without words (and null texts) have no shingles and
are linked with nothing; fewer words than ``k`` make one shingle; rows that
repeat are in one component; a null id takes part, but is never the id of a
component unless all ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import hash_strings, lower_ascii, materialize, mix64, shuffle_width, slices, small_batches, spread, table, words
from .components import connected_components, edge_batches, forest

_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(all sets one after another, each sorted; size of each set)."""
    counts, codes, vocabulary = words(lower_ascii(texts))
    w = hash_strings(vocabulary)[codes]
    n = len(counts)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    each = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(n), each)
    at = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each))
    width = np.minimum(counts, k)[doc]
    h = width.astype(np.uint64)
    for i in range(k):
        more = width > i
        nxt = w[np.minimum(at + i, max(0, len(w) - 1))] if len(w) else h
        h = np.where(more, h * _P + nxt, h)
    h = mix64(h)
    ends = np.cumsum(each)
    for a, b in zip((ends - each).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    if not len(h):
        return h, each
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=n)


def fingerprints(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 63-bit fingerprint of each set, as int64; 0 for empty sets."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)))
    ends = np.cumsum(sizes)
    f = mix64(total[ends] - total[ends - sizes] + sizes.astype(np.uint64) * _P) >> np.uint64(1)
    return np.where(sizes > 0, f, np.uint64(0)).astype(np.int64)


def size_classes(limit: int, percent: int) -> np.ndarray:
    """The lower ends of the size intervals up to ``limit``; interval c is [ends[c], ends[c + 1])."""
    low, ends = 1, []
    while low <= limit:
        ends.append(low)
        low = low * 100 // percent + 1
    return np.array([*ends, low], dtype=np.int64)


def announcements(h: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of the segments that each set announces, for its size interval and the next.

    Tag t stands for pairs of a set in interval t with one in t or t - 1. The lowest bit of a hash tells whether
    the set is in interval t: pairs without such a member are the business of tag t - 1.
    """
    live = sizes > 0
    if not live.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = size_classes(int(sizes.max()), percent)
    own = np.searchsorted(ends, sizes, side="right") - 1
    tops = np.concatenate((ends[1:] - 1, [ends[-1] * 100 // percent]))
    differ = (2 * tops * (100 - percent)) // (100 + percent)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    member = mix64(h + _P)
    keys, owners = [], []
    for step in (0, 1):
        tag = own + step
        segments = np.where(live, (differ[tag] + 1) * 13 // 10 + 1, 0)
        base = np.cumsum(segments) - segments
        slot = base[doc] + ((h >> np.uint64(11)) % segments[doc].astype(np.uint64)).astype(np.int64)
        total = int(segments.sum())
        # The hash of a segment is the wrapped sum of its members' hashes: independent of their order.
        order = np.argsort(slot, kind="stable")
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(member[order], dtype=np.uint64)))
        filled = np.bincount(slot, minlength=total)
        upto = np.cumsum(filled)
        value = sums[upto] - sums[upto - filled]
        owner = np.repeat(np.arange(len(sizes)), segments)
        number = np.arange(total) - base[owner]
        # The fullest segments, all those with at least as many members as number H + 1 from the top.
        rank = np.lexsort((-filled, owner))
        least = np.zeros(len(sizes), np.int64)
        least[live] = filled[rank][(base + np.minimum(differ[tag], segments - 1))[live]]
        say = filled >= least[owner]
        name = mix64((tag[owner].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64))
        role = np.uint64(1 - step)
        keys.append((mix64(value + name) & ~np.uint64(1) | role)[say])
        owners.append(owner[say])
    return np.concatenate(keys), np.concatenate(owners)


def bit_width(sizes: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: the power of two from its size on, 64 to 32768."""
    return 1 << np.ceil(np.log2(np.clip(sizes, 64, 1 << 15))).astype(np.int64)


def bitmaps(h: np.ndarray, sizes: np.ndarray, width: np.ndarray | None = None) -> list[bytes]:
    """The OR of one bit per shingle, for each set; of two widths the narrower is the wider one folded in halves."""
    width = bit_width(sizes) if width is None else width
    at = np.cumsum(width // 64) - width // 64
    words_ = np.zeros(int((width // 64).sum()), dtype=np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    bit = (h >> np.uint64(20)) & (width[doc] - 1).astype(np.uint64)
    # Low bits choose the bit, so masking off the top halves of the position folds.
    np.bitwise_or.at(words_, at[doc] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return [words_[a : a + w].tobytes() for a, w in zip(at.tolist(), (width // 64).tolist(), strict=True)]


_PACKED = "part int, ids binary, prints binary, sizes binary, maps array<binary>"


def _announce(k: int, percent: int, parts: int):
    """(id, text) in. Rows of part -1: ids, validity and fingerprints; others: announcements packed by part."""

    def packed(part, a, b, c, maps=None):
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
        columns = (part, a, b, c, maps or [None] * len(part))
        names = ["part", "ids", "prints", "sizes", "maps"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    def flush(held):
        keys, prints = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        part = ((keys >> np.uint64(1)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        keys, prints, part = keys[order], prints[order], part[order]
        cut = np.searchsorted(part, np.arange(parts + 1))
        for at in range(0, parts, 64):
            some = [p for p in range(at, min(at + 64, parts)) if cut[p] < cut[p + 1]]
            if some:
                blobs = []
                for p in some:
                    which, where = np.unique(prints[cut[p] : cut[p + 1]], return_inverse=True)
                    own = keys[cut[p] : cut[p + 1]]
                    short = (((own >> np.uint64(1)) // np.uint64(parts) << np.uint64(1) | own & np.uint64(1)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    blobs.append((short.tobytes(), which.tobytes(), where.astype(np.uint32).tobytes()))
                yield packed(some, *zip(*blobs, strict=True))

    def run(batches):
        held, n = [], 0
        for whole in batches:
            for batch in slices(whole, 1):
                h, sizes = shingle_sets(batch.column(1), k)
                prints = fingerprints(h, sizes)
                ids = batch.column(0)
                blank = np.packbits(ids.is_null().to_numpy(zero_copy_only=False))
                known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield packed([-1], [known.tobytes() + blank.tobytes()], [prints.tobytes()], [sizes.astype(np.int64).tobytes()], [bitmaps(h, sizes)])
                keys, owner = announcements(h, sizes, percent)
                held.append((keys, prints[owner]))
                n += len(keys)
                if n > 800_000:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)
        pa.default_memory_pool().release_unused()

    return run


def _unpack_sets(batches):
    for batch in batches:
        for ids, prints, sizes, maps in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            f = np.frombuffer(prints, np.int64)
            n = len(f)
            known = np.frombuffer(ids[: 8 * n], np.int64)
            blank = np.unpackbits(np.frombuffer(ids[8 * n :], np.uint8))[:n].astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(known, mask=blank), pa.array(f), pa.array(np.frombuffer(sizes, np.int64)), pa.array(maps, pa.binary())],
                names=["id", "print", "n", "map"],
            )


def _meet(batches):
    """Packed announcements of some parts in; (meeting, print) of classes that announce the same out.

    A meeting is named by its members, so a family that meets in many segments alike is one meeting.
    """
    keys, prints = [], []
    for batch in batches:
        for part, short, which, where in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            keys.append((np.frombuffer(short, np.uint32).astype(np.uint64)) | (np.uint64(part) << np.uint64(32)))
            prints.append(np.frombuffer(which, np.int64)[np.frombuffer(where, np.uint32)])
    if not keys:
        return
    keys, prints = np.concatenate(keys), np.concatenate(prints)
    names = keys >> np.uint64(1)
    order = np.argsort(names, kind="stable")
    names, keys, prints = names[order], keys[order], prints[order]
    many = np.zeros(len(names), bool)
    many[1:] = names[1:] == names[:-1]
    many[:-1] |= many[1:]
    names, keys, prints = names[many], keys[many], prints[many]  # most announcements meet nobody
    order = np.lexsort((prints, names))
    names, keys, prints = names[order], keys[order], prints[order]
    if not len(names):
        return
    new = np.concatenate(([True], (names[1:] != names[:-1]) | (prints[1:] != prints[:-1])))
    role = np.maximum.reduceat(keys & np.uint64(1), np.flatnonzero(new))
    names, prints = names[new], prints[new]
    head = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    each = np.diff(np.append(head, len(names)))
    good = np.repeat((each > 1) & (np.maximum.reduceat(role, head) > 0), each)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(prints.view(np.uint64)), dtype=np.uint64)))
    meeting = np.repeat(mix64(sums[head + each] - sums[head] + each.astype(np.uint64)), each).view(np.int64)
    pairs = np.unique(np.stack((meeting[good], prints[good]), axis=1), axis=0) if good.any() else np.zeros((0, 2), np.int64)
    for at in range(0, len(pairs), 100_000):
        p = pairs[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["meeting", "print"])


def _fold(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps at the narrowest width among them."""
    width = min(len(m) for m in maps)
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, width), axis=0) for m in maps])


def _near_in_meetings(percent: int):
    """Rows (meeting, print, n, map), sorted by meeting, in; (a, b) of classes that their bitmaps let be linked out.

    Of each meeting only a spanning forest of such pairs: enough to keep every linked pair in one block.
    """

    def finish(small, big):
        a, b = [], []
        for prints, sizes, maps in big:
            tree = SignatureTree(_fold(maps), np.array(sizes))
            order, joined = tree.order, forest_of_possible(tree, percent)
            a += [prints[order[i]] for i, _ in joined]
            b += [prints[order[j]] for _, j in joined]
        by_width: dict[int, list] = {}
        for prints, sizes, maps in small:
            folded = _fold(maps)
            by_width.setdefault(folded.shape[1], []).append((prints, sizes, folded))
        for groups in by_width.values():
            maps = np.concatenate([g[2] for g in groups])
            sizes, prints = np.concatenate([g[1] for g in groups]), np.concatenate([g[0] for g in groups])
            ones = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
            x, y, base = [], [], 0
            for g in groups:
                i, j = np.triu_indices(len(g[0]), 1)
                x.append(i + base)
                y.append(j + base)
                base += len(g[0])
            x, y = np.concatenate(x), np.concatenate(y)
            for at in range(0, len(x), 1 << 14):
                i, j = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
                common = np.bitwise_count(maps[i] & maps[j]).sum(axis=1, dtype=np.int64)
                most = np.minimum(sizes[i] - ones[i] + common, sizes[j] - ones[j] + common)
                ok = 100 * most >= percent * np.maximum(sizes[i] + sizes[j] - most, most)
                a += prints[i[ok]].tolist()
                b += prints[j[ok]].tolist()
        return np.array(a, np.int64), np.array(b, np.int64)

    def run(batches):
        small, big, rows, current, held = [], [], [], None, 0

        def close():
            if len(rows) > 1:
                group = ([r[0] for r in rows], [r[1] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows])
                (small if len(rows) <= 16 else big).append(group)

        for batch in batches:
            for meeting, print_, n, map_ in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if meeting != current:
                    close()
                    current, rows = meeting, []
                    if held > 16 << 20:
                        yield from edge_batches(*forest(*finish(small, big)))
                        small, big, held = [], [], 0
                rows.append((print_, n, map_))
                held += len(map_)
        close()
        if small or big:
            yield from edge_batches(*forest(*finish(small, big)))

    return run


class SignatureTree:
    """Levels of nodes, leaf level first; each node has an OR bitmap, size range, least bit count and its children.

    Leaves stand in ``order``: by size within the least bit set, so that alike sets are near each other.
    """

    FAN = 8

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, order: np.ndarray | None = None):
        if order is None:
            order = np.lexsort((sizes, *maps.T[: min(4, maps.shape[1])]))
        self.order = order
        maps, sizes = maps[order], sizes[order].astype(np.int64)
        ones = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, ones)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, ones = self.levels[-1]
            cut = np.arange(0, len(maps), self.FAN)
            self.levels.append(
                (np.bitwise_or.reduceat(maps, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.minimum.reduceat(ones, cut))
            )

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether some pair below the node pairs could reach the threshold."""
        maps, low, high, ones = self.levels[level]
        out = np.zeros(len(a), bool)
        step = max(1, (1 << 20) // maps.shape[1])
        for at in range(0, len(a), step):
            x, y = a[at : at + step], b[at : at + step]
            common = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64)
            most = np.minimum(high[x] - np.maximum(0, ones[x] - common), high[y] - np.maximum(0, ones[y] - common))
            out[at : at + step] = 100 * most >= percent * (np.maximum(low[x] + low[y] - most, most))
        return out


class Union:
    """Union-find over n members."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)


def dual_traversal(tree: SignatureTree, percent: int, union: Union, meet) -> None:
    """Call ``meet(i, j)`` for pairs of leaves i < j that could be linked and are not in one part yet.

    Neighbours and a few members against all come first, so that the traversal meets whole nodes in one part and skips
    them.
    """
    n = len(tree.levels[0][0])
    every = np.arange(n)
    near = np.flatnonzero(tree.possible(0, every[:-1], every[1:], percent))
    for i in near.tolist():
        meet(i, i + 1)
    if n <= 2:
        return
    if n > 16:
        for centre in sorted({int(x) for x in np.linspace(0, n - 1, 4)}):
            for j in np.flatnonzero(tree.possible(0, np.full(n, centre), every, percent)).tolist():
                if j != centre and union.root(j) != union.root(centre):
                    meet(min(centre, j), max(centre, j))
    top, fan = len(tree.levels) - 1, SignatureTree.FAN
    label = [np.array([union.root(i) for i in range(n)])]
    for _ in range(top):
        cut = np.arange(0, len(label[-1]), fan)
        low, high = np.minimum.reduceat(label[-1], cut), np.maximum.reduceat(label[-1], cut)
        label.append(np.where((low == high) & (low >= 0), low, -1))

    def descend(level, a, b):
        one = label[level]
        apart = ~((one[a] >= 0) & (one[a] == one[b]))
        a, b = a[apart], b[apart]
        if not len(a):
            return
        stay = tree.possible(level, a, b, percent)
        a, b = a[stay], b[stay]
        if level == 0:
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                if i != j and union.root(i) != union.root(j):
                    meet(i, j)
            return
        below = len(tree.levels[level - 1][0])
        for at in range(0, len(a), 4096):
            x = (a[at : at + 4096, None, None] * fan + np.arange(fan)[None, :, None]).repeat(fan, axis=2).reshape(-1)
            y = (b[at : at + 4096, None, None] * fan + np.arange(fan)[None, None, :]).repeat(fan, axis=1).reshape(-1)
            ok = (x <= y) & (y < below) & (x < below)
            descend(level - 1, x[ok], y[ok])

    descend(top, np.zeros(1, np.int64), np.zeros(1, np.int64))


def forest_of_possible(tree: SignatureTree, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, in leaf positions, of the pairs that their bitmaps and sizes let be linked."""
    union, found = Union(len(tree.order)), []

    def meet(i, j):
        if union.root(i) != union.root(j):
            union.join(i, j)
            found.append((i, j))

    dual_traversal(tree, percent, union, meet)
    return found


def links(sets: list[np.ndarray], percent: int, left: int = 0, every: bool = False) -> list[tuple[int, int]]:
    """A spanning forest of all links: edges (i, j) that each join two parts not joined before. With ``every`` all links.

    With ``left`` > 0 the first ``left`` sets are one chunk and the rest another, and only links across count.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    maps = bitmaps(np.concatenate(sets), sizes, np.full(len(sizes), bit_width(sizes.max(keepdims=True))[0]))
    order = np.lexsort((sizes, np.array([s[0] for s in sets])))
    tree = SignatureTree(np.stack([np.frombuffer(m, np.uint64) for m in maps]), sizes, order)
    union, found, met = Union(len(sets)), [], set()

    def meet(a, b):
        i, j = int(order[a]), int(order[b])
        if (left and (i < left) == (j < left)) or union.root(a) == union.root(b) or (a, b) in met:
            return
        x, y = sets[i], sets[j]
        both = len(np.intersect1d(x, y, assume_unique=True))
        if every:
            met.add((a, b))  # parts stay apart, so that no pair is skipped; a pair may be met twice
        if 100 * both >= percent * (len(x) + len(y) - both):
            if not every:
                union.join(a, b)
            found.append((i, j))

    dual_traversal(tree, percent, union, meet)
    return found


def _join_blocks(k: int, percent: int, every: bool = False):
    """Rows (task, chunk, print, text), sorted by task, in; edges of verified links out, enough for the components or all."""

    def finish(rows):
        first: dict[int, tuple[int, str]] = {}
        for chunk, print_, text in rows:
            first.setdefault(print_, (chunk, text))
        h, sizes = shingle_sets(pa.array([t for _, t in first.values()], pa.large_string()), k)
        prints, chunks = fingerprints(h, sizes).tolist(), [c for c, _ in first.values()]
        ends = np.cumsum(sizes)
        # A row whose text is not the one that was announced (its id repeats) is not a member.
        member = [m for m, (p, want) in enumerate(zip(prints, first, strict=True)) if p == want]
        if len(member) < 2:
            return [], []
        member.sort(key=lambda m: chunks[m])
        sets = [h[ends[m] - sizes[m] : ends[m]] for m in member]
        low = chunks[member[0]]
        left = sum(chunks[m] == low for m in member)
        found = links(sets, percent, left if left < len(member) else 0, every)
        return [prints[member[i]] for i, _ in found], [prints[member[j]] for _, j in found]

    def run(batches):
        current, rows, a, b = None, [], [], []
        for batch in batches:
            for task, chunk, print_, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if task != current:
                    if rows:
                        x, y = finish(rows)
                        a += x
                        b += y
                    current, rows = task, []
                rows.append((chunk, print_, text))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        if rows:
            x, y = finish(rows)
            a += x
            b += y
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _print_of(k: int):
    """A function of a text that gives its set_id, null for texts without words."""

    @F.arrow_udf("long")
    def print_of(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0):
            h, sizes = shingle_sets(part.column(0), k)
            out += [p if n else None for p, n in zip(fingerprints(h, sizes).tolist(), sizes.tolist(), strict=True)]
        return pa.array(out, pa.int64())

    return print_of


def _components(
    df: DataFrame, id_col: str, text_col: str, k: int, percent: int, block_shingles: int = 250_000, meeting_classes: int = 50_000, every: bool = False
) -> DataFrame:
    """What ``ngram_join`` returns, and kept_set: of the sets in the component with its least id, the least set_id."""
    spark = df.sparkSession
    small_batches(spark)
    parts = shuffle_width(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = materialize(spread(rows).mapInArrow(_announce(k, percent, parts), _PACKED), "join-packed")
    sets = materialize(
        packed.where("part = -1").select("ids", "prints", "sizes", "maps").mapInArrow(_unpack_sets, "id long, print long, n long, map binary"),
        "join-sets",
    )
    said = packed.where("part >= 0").select("part", "ids", "prints", "sizes").repartitionById(parts, F.col("part"))
    met = materialize(said.mapInArrow(_meet, "meeting long, print long").distinct(), "join-met")

    # Bitmaps tell in each meeting who can be linked at all. A meeting too large for a task keeps all its members.
    maps = sets.where("n > 0").groupBy("print").agg(F.max("n").alias("n"), F.min("map").alias("map"))
    large = met.groupBy("meeting").agg(F.count("*").alias("members"), F.min("print").alias("least")).where(F.col("members") > meeting_classes)
    large = materialize(large, "join-large")  # at most a row per meeting_classes rows of met
    kept = met.join(large, "meeting", "left_anti").join(maps, "print").select("meeting", "print", "n", "map")
    ordered = kept.repartition("meeting").sortWithinPartitions("meeting")
    near = ordered.mapInArrow(_near_in_meetings(percent), "a long, b long")
    stars = met.join(large, "meeting").select(F.col("print").alias("a"), F.col("least").alias("b"))
    blocks = connected_components(near.unionByName(stars))

    # Chunks of a block by size; most blocks have one. Sizes, not members, are put in order: a size that alone exceeds
    # a chunk is split by hash.
    classes = sets.where("n > 0").groupBy("print").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    members = materialize(blocks.join(classes, blocks.node == classes.print).select("label", "print", "id", "n"), "join-members")
    sizes = members.groupBy("label", "n").agg(F.sum("n").alias("all"))
    upto = Window.partitionBy("label").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.select(
        F.col("label").alias("block"),
        F.col("n").alias("size"),
        F.floor((F.sum("all").over(upto) - F.col("all")) / block_shingles).alias("at"),
        F.greatest(F.lit(1), F.ceil(F.col("all") / block_shingles)).alias("split"),
    )
    piece = F.when(F.col("split") > 1, F.concat_ws(".", "at", "size", F.pmod(F.xxhash64("print"), F.col("split"))))
    members = members.join(sizes, (F.col("label") == F.col("block")) & (F.col("n") == F.col("size")))
    members = materialize(members.select("label", "print", "id", "n", F.coalesce(piece, F.col("at").cast("string")).alias("chunk")), "join-chunks")
    chunks = members.groupBy("label", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = chunks.select("label", F.col("chunk").alias("chunk2"), F.col("low").alias("low2"))
    ordered = F.struct("low", "chunk") <= F.struct("low2", "chunk2")
    pairs = chunks.join(other, "label").where(ordered & (F.col("high") * 100 >= F.col("low2") * percent))
    task = F.concat_ws(":", "label", "chunk", "chunk2")
    tasks = pairs.select("label", task.alias("task"), F.explode(F.array_distinct(F.array("chunk", "chunk2"))).alias("chunk"))
    wanted = materialize(members.join(tasks, ["label", "chunk"]).select("task", "chunk", "print", F.col("id").alias("want")), "join-wanted")
    few = wanted.count() <= BROADCAST_WANTED
    # Null ids and ids with several sets don't tell whose text is wanted: of these rows the set is told again.
    several = sets.where("n > 0 and id is not null").groupBy("id").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a != b")
    several = materialize(several.select("id"), "join-several")
    fetched = rows.join(F.broadcast(wanted) if few else wanted, F.col("id") == F.col("want"))
    if not several.isEmpty() or not wanted.where("want is null").isEmpty():
        fetched = fetched.join(several, "id", "left_anti")
        told = rows.where("id is null").unionByName(rows.join(several, "id", "left_semi"))
        told = told.withColumn("print", _print_of(k)("text")).where("print is not null").dropDuplicates(["id", "print"])
        fetched = fetched.select("task", "chunk", "print", "text").unionByName(
            told.join(wanted, (told.print == wanted.print) & F.col("id").eqNullSafe(F.col("want"))).select("task", "chunk", wanted.print, "text")
        )
    fetched = fetched.select("task", "chunk", "print", "text").repartition("task").sortWithinPartitions("task", "chunk", "print")
    pairs = fetched.mapInArrow(_join_blocks(k, percent, every), "a long, b long")
    if every:
        # A task of one chunk finds its pairs, a task of two those across: no pair is found twice.
        pairs = materialize(pairs, "join-pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("print")).groupBy("print").agg(F.count("*").alias("n_links"))
    verified = connected_components(pairs)

    linked = classes.join(verified, classes.print == verified.node, "left").select(
        "print", "id", F.coalesce("label", "print").alias("label")
    )
    least = linked.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print")).alias("kept"))
    of_class = linked.join(least, "label").select("print", F.col("kept.id").alias("component_id"), F.col("kept.print").alias("kept_set"))
    # Copies make one class hot on the side of the rows; of_class has one row a class, so AQE can split it.
    if every:
        of_class = of_class.join(ends, "print", "left")
    return sets.join(of_class, "print", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("print")).alias("set_id"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("kept_set")).alias("kept_set"),
        *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if every else []),
    )


def ngram_join(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 4,
    percent: int = 85,
    block_shingles: int = 250_000,
    meeting_classes: int = 50_000,
    links: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, set_id (the class of equal sets) and component_id.

    With ``links`` also n_links, with how many other classes the row's class is linked itself. All pairs of classes that the
    tree lets through are then verified, where components need a spanning forest only: the work of a group of n classes that
    are all near each other grows with n squared, in tasks of chunk pairs.
    """
    return _components(df, id_col, text_col, k, percent, block_shingles, meeting_classes, links).drop("kept_set")


#: Up to so many rows of (task, chunk, print, id), some 100 bytes each, are broadcast to fetch texts; beyond, texts are shuffled.
BROADCAST_WANTED = 200_000
#: Up to so many ids of dropped rows (8 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 500_000


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df``, with all their columns, but for near copies: of each component the row with the least id stays.

    Rows are judged by their own text, also where ids are null or repeat: null ids come last, and of equal ids the least
    set_id stays. Rows that repeat an id and a set, or an id and a text without words, leave one; rows with a null id and
    no words stay.
    """
    found = _components(df, id_col, text_col, k, percent)
    stays = F.col("set_id").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("set_id") == F.col("kept_set")))
    found = materialize(found.select("doc_id", "set_id", stays.alias("stays")), "near-components")
    names = {c: f"column_{k}" for k, c in enumerate(df.columns)}  # any column of the input may share a name with ours
    id_col, text_col = names[id_col], names[text_col]
    back = [F.col(n).alias(c) for c, n in names.items()]
    df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    keys = F.col(id_col).cast("long")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("stays").alias("stays"))
    ids = materialize(ids.where("n > 1 or not stays").select(F.col("doc_id").alias("near_id"), (F.col("n") > 1).alias("again")), "near-ids")
    dropped, again = ids.where("not again").select("near_id"), ids.where("again").select("near_id")
    few = dropped.count() <= BROADCAST_IDS
    kept = df.join(F.broadcast(dropped) if few else dropped, keys == F.col("near_id"), "left_anti")
    if again.isEmpty() and found.where("doc_id is null").isEmpty():
        return kept.select(*back)
    # An id tells one row only if it is neither null nor repeated; of the other rows the set is told again.
    once = kept.where(keys.isNotNull()).join(again, keys == F.col("near_id"), "left_anti")
    other = kept.where(keys.isNull()).unionByName(kept.join(again, keys == F.col("near_id"), "left_semi"))
    told = other.withColumn("near_print", _print_of(k)(F.col(text_col)))
    bare = told.where("near_print is null").drop("near_print")
    bare = bare.where(keys.isNull()).unionByName(bare.where(keys.isNotNull()).dropDuplicates([id_col, text_col]))
    least = found.where("stays and set_id is not null").join(again, F.col("doc_id") == F.col("near_id"), "left_semi")
    least = least.unionByName(found.where("stays and set_id is not null and doc_id is null"))
    least = least.select(F.col("doc_id").alias("near_id"), F.col("set_id").alias("near_set")).distinct()
    told = told.join(least, (F.col("near_print") == F.col("near_set")) & keys.eqNullSafe(F.col("near_id")), "left_semi")
    return once.unionByName(bare).unionByName(told.dropDuplicates([id_col, "near_print"]).drop("near_print")).select(*back)


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLE_SQL: dict[str, str] = {}  # all pairs in SQL are too slow on whole tables; tests compare with brute force
