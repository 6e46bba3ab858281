"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH, exact verification.

Texts are sequences of words (lower-cased, punctuation stripped at both ends;
what is nothing but punctuation is no word). A document contains an item if some
stretch of it is within ``max_edits`` (a share of the item's words) word edits
of the whole item.

The CGK embedding of a window walks over it: at step t it puts out the current
word and moves on if a random bit of (t, word) is set, so windows within a few
edits fall into step again and give strings of small Hamming distance. The LSH
samples coordinates of the embedding: coordinate 0 always, and ``samples`` more
among the first 2n of a window of n words, in ``repeats`` independent tables.
The windows of an item are its suffixes that start at one of its ``anchors``
longest words, in item-sized classes; a window of a document can share a bucket
only if it starts with such a word, so only those starts are embedded. With
``repeats * anchors`` tries a passage at the limit of edits is found with high
probability (tests measure the recall against brute force). Each bucket hit is
verified by exact approximate-substring alignment over the item's whole length.

Items are sent to the executors in blocks of at most ``block_words`` words; a
larger benchmark takes several passes over the documents.

Defined results: null and empty texts contain nothing and are contained in
nothing; rows that repeat are each reported; null ids stay null in the result;
an empty table on either side gives no pairs (and keeps all documents).
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hash_strings, mix64, slices, small_batches, spread, table, words

_STRIP = string.punctuation + "«»„“”‘’…–—¡¿"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
PAD = np.uint64(0)
ANY = np.uint64(2)  # no symbol: symbols are odd


@dataclass
class Limits:
    max_edits: float = 0.2
    anchors: int = 8
    repeats: int = 16
    samples: int = 3
    block_words: int = 2_000_000


def symbols(vocabulary: pa.Array) -> np.ndarray:
    """A 64-bit symbol per vocabulary entry; 0 where nothing but punctuation is left."""
    bare = pc.utf8_lower(pc.utf8_trim(vocabulary.cast(pa.large_string()), characters=_STRIP)).dictionary_encode()
    h = hash_strings(bare.dictionary) | np.uint64(1)
    h[pc.equal(pc.binary_length(bare.dictionary), 0).to_numpy(zero_copy_only=False)] = PAD
    return h[bare.indices.to_numpy(zero_copy_only=False)]


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts one after another, words of each text)."""
    counts, codes, vocabulary = words(texts)
    s = symbols(vocabulary)[codes]
    real = s != PAD
    if real.all():
        return s, counts
    doc = np.repeat(np.arange(len(counts)), counts)
    return s[real], np.bincount(doc[real], minlength=len(counts))


def walk_bits(s: np.ndarray, repeat: int, block: int) -> np.ndarray:
    """Random bits of 64 steps for each symbol."""
    return mix64(s + np.uint64((0x9E3779B97F4A7C15 * (1 + repeat * 64 + block)) % (1 << 64)))


def embed(s: np.ndarray, start: np.ndarray, end: np.ndarray, repeat: int, steps: np.ndarray) -> np.ndarray:
    """The CGK embeddings of the windows [start, end) at the given sorted steps: one row per window."""
    out = np.zeros((len(start), len(steps)), dtype=np.uint64)
    if not len(start) or not len(s):
        return out
    at, col, last = start.copy(), 0, len(s) - 1
    for t in range(int(steps[-1]) + 1):
        inside = at < end
        here = s[np.minimum(at, last)]
        while col < len(steps) and steps[col] == t:
            out[:, col] = np.where(inside, here, PAD)
            col += 1
        bit = (walk_bits(here, repeat, t >> 6) >> np.uint64(t & 63)) & np.uint64(1)
        at += (inside & (bit > 0)).astype(np.int64)
    return out


def same_bucket(s, start, end, repeat: int, steps: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Which windows have the wanted symbols at all the steps of their embedding; ``want`` has a row per window."""
    alive, at, t = np.arange(len(start)), start.copy(), 0
    for col, step in enumerate(steps.tolist()):
        while t < step and len(alive):
            here = s[np.minimum(at, len(s) - 1)]
            bit = (walk_bits(here, repeat, t >> 6) >> np.uint64(t & 63)) & np.uint64(1)
            at = at + ((at < end[alive]) & (bit > 0))
            t += 1
        here = np.where(at < end[alive], s[np.minimum(at, max(0, len(s) - 1))], PAD)
        same = (here == want[alive, col]) | (want[alive, col] == ANY)
        alive, at = alive[same], at[same]
    return alive


def class_of(n: int) -> int:
    """Windows of a class have lengths within a quarter of each other."""
    return int(np.log(max(1, n)) / np.log(1.25) + 1e-9)


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least word edits between the item and a stretch of the text, end of the first such stretch)."""
    m = len(text)
    row, steps = np.zeros(m + 1, dtype=np.int64), np.arange(m + 1)
    for i, x in enumerate(item, 1):
        new = np.empty(m + 1, dtype=np.int64)
        new[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (text != x), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min()), int(row.argmin())


@dataclass
class ItemIndex:
    """The items of one block with their LSH tables. Bounded by ``Limits.block_words``."""

    ids: list
    limits: Limits
    s: np.ndarray
    counts: np.ndarray
    tables: list = field(default_factory=list)  # of bucket samples, by repeat and class
    sieve: np.ndarray | None = None

    @classmethod
    def build(cls, ids: list, texts: list, limits: Limits) -> ItemIndex:
        s, counts = sequences(pa.array(texts, pa.large_string()))
        index = cls(ids, limits, s, counts)
        _, codes, vocabulary = words(pa.array(texts, pa.large_string()))
        length = np.fromiter((len(w.strip(_STRIP)) for w in vocabulary.to_pylist()), dtype=np.int64, count=len(vocabulary))[codes]
        length = length[symbols(vocabulary)[codes] != PAD]
        _, where, often = np.unique(s, return_inverse=True, return_counts=True)
        often = often[where]
        index.first = np.cumsum(counts) - counts
        starts, owner = [], []
        for k, n in enumerate(counts.tolist()):
            a = int(index.first[k])
            head = max(1, (n * 3 + 4) // 5) if n else 0
            # More starts than a passage within the limit can have edits, so some are left whichever words are edited.
            most = min(max(limits.anchors, int(limits.max_edits * n) + 2), max(3, n // 3))
            for j in np.lexsort((-length[a : a + head], often[a : a + head]))[:most].tolist():
                starts.append(a + j)
                owner.append(k)
        index.starts, index.owner = np.array(starts, np.int64), np.array(owner, np.int64)
        ends = (index.first + counts)[index.owner] if starts else index.starts
        kinds = np.array([class_of(int(n)) for n in ends - index.starts], dtype=np.int64)
        index.heads = np.unique(s[index.starts]) if starts else s[:0]
        # For each repeat and class: the sampled steps, and the samples of each window.
        rng = np.random.default_rng(20240229)
        for repeat in range(limits.repeats):
            found = {}
            for c in sorted(set(kinds.tolist())):
                reach = max(limits.samples, int(2 * 1.25**c))
                steps = np.sort(rng.choice(np.arange(1, reach + 1), size=limits.samples, replace=False))
                own = np.flatnonzero(kinds == c)
                samples = np.zeros((len(kinds), limits.samples), dtype=np.uint64)
                samples[own] = embed(s, index.starts[own], ends[own], repeat, steps)
                # An item that allows no edits ends within longer texts: what its walk meets after its end tells nothing.
                exact = own[(limits.max_edits * counts[index.owner[own]]).astype(np.int64) == 0]
                samples[exact] = np.where(samples[exact] == PAD, ANY, samples[exact])
                found[c] = (steps, samples)
            index.tables.append(found)
        index.kinds = kinds
        index.by_head = np.argsort(s[index.starts], kind="stable")
        index.head_keys = s[index.starts][index.by_head]
        return index

    def is_head(self, s: np.ndarray) -> np.ndarray:
        """Whether each symbol is one that an item's window begins with: a bit per hash first, then the symbols themselves."""
        if self.sieve is None:
            self.sieve = np.zeros(1 << 20, bool)
            self.sieve[(self.heads >> np.uint64(44)).astype(np.int64)] = True
        out = self.sieve[(s >> np.uint64(44)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        out[maybe] = np.isin(s[maybe], self.heads)
        return out

    def colliding(self, s: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``start``, window) of pairs in one bucket: equal at coordinate 0 and at all sampled coordinates.

        Coordinate 0 is compared first; a walk goes on only while the samples met so far are equal.
        """
        lo, hi = np.searchsorted(self.head_keys, s[start], "left"), np.searchsorted(self.head_keys, s[start], "right")
        many = hi - lo
        at = np.repeat(np.arange(len(start)), many)
        window = self.by_head[np.repeat(lo, many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
        hit = np.zeros(len(at), bool)
        for repeat, found in enumerate(self.tables):
            for c, (steps, samples) in found.items():
                alive = np.flatnonzero((self.kinds[window] == c) & ~hit)
                hit[alive[same_bucket(s, start[at[alive]], end[at[alive]], repeat, steps, samples[window[alive]])]] = True
        return at[hit], window[hit]

    def search(self, texts: pa.Array):
        """(row, item, edits, start, words) of each item that a text contains; start and end are word positions."""
        s, counts = sequences(texts)
        if not len(s) or not len(self.starts):
            return []
        ends = np.cumsum(counts)
        start = np.flatnonzero(self.is_head(s))
        doc = np.searchsorted(ends, start, side="right")
        at, window = self.colliding(s, start, ends[doc])
        item = self.owner[window]
        hits = np.stack((item, start[at] - (self.starts[window] - self.first[item]), doc[at]), axis=1)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for item, origin, d in np.unique(hits, axis=0).tolist():
            n, lowest = int(self.counts[item]), int(ends[d] - counts[d])
            allowed = int(self.limits.max_edits * n)
            held = best.get((d, item))
            if held is not None and held[0] == 0:
                continue
            low = max(lowest, origin - 2 * allowed)
            edits, stop = nearest(self.s[self.first[item] : self.first[item] + n], s[low : min(int(ends[d]), origin + n + 2 * allowed)])
            if edits <= allowed and (held is None or (edits, low + stop - lowest) < held):
                best[d, item] = (edits, low + stop - lowest)
        return [(d, item, edits, stop) for (d, item), (edits, stop) in sorted(best.items())]


def _blocks(items: DataFrame, item_col: str, text_col: str, limits: Limits):
    """Item indexes of bounded size, each for one pass; the items stream through the driver."""
    ids, texts, n = [], [], 0
    for row in items.select(F.col(item_col), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        n += len(row[1].split())
        if n >= limits.block_words:
            yield ItemIndex.build(ids, texts, limits)
            ids, texts, n = [], [], 0
    if ids:
        yield ItemIndex.build(ids, texts, limits)


def contained_items(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    limits: Limits | None = None,
) -> DataFrame:
    """One row per row of ``df`` and item it contains: doc_id, item_id, edits, item_words, end_word."""
    spark, limits = df.sparkSession, limits or Limits()
    small_batches(spark)
    schema = "doc_id long, item_id long, edits long, item_words long, end_word long"
    rows = spread(df.select(F.col(id_col).cast("long"), F.col(text_col)))

    def passing(sent):
        def run(batches):
            index = sent.value
            for whole in batches:
                for batch in slices(whole, 1):
                    found = index.search(batch.column(1))
                    if found:
                        at = pa.array([f[0] for f in found])
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(at),
                                pa.array([index.ids[f[1]] for f in found], pa.int64()),
                                pa.array([f[2] for f in found], pa.int64()),
                                pa.array([int(index.counts[f[1]]) for f in found], pa.int64()),
                                pa.array([f[3] for f in found], pa.int64()),
                            ],
                            names=["doc_id", "item_id", "edits", "item_words", "end_word"],
                        )

        return run

    out = None
    for index in _blocks(items, item_col, item_text_col, limits):
        found = rows.mapInArrow(passing(spark.sparkContext.broadcast(index)), schema)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(
    df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limits: Limits | None = None
) -> DataFrame:
    """The rows of ``df``, with all their columns, that contain no item."""
    spark, limits = df.sparkSession, limits or Limits()
    small_batches(spark)
    column = df.columns.index(text_col)
    df = spread(df)

    def passing(sent):
        def run(batches):
            index = sent.value
            for whole in batches:
                for batch in slices(whole, column):
                    clean = np.ones(batch.num_rows, bool)
                    clean[[f[0] for f in index.search(batch.column(column))]] = False
                    yield batch.filter(pa.array(clean))

        return run

    for index in _blocks(items, item_col, item_text_col, limits):
        df = df.mapInArrow(passing(spark.sparkContext.broadcast(index)), df.schema)
    return df


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE_SQL: dict[str, str] = {}  # approximate substring search; tests compare with brute force
