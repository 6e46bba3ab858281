"""LM scoring by context-tree weighting over bytes.

The model predicts each byte of the text (A-Z lower-cased, UTF-8) and an end
symbol, byte 0xFF, which UTF-8 never uses; contexts are the ``depth`` bytes
before, padded with 0xFF. A byte is eight binary decisions. In every context s
of every depth 0..``depth``, each decision has a Krichevsky-Trofimov estimate Pe(s)
from the training counts, and

    Pw(s) = 1/2 Pe(s) + 1/2 prod Pw(children of s)      (Pw = Pe at full depth)

so all depths are mixed; a decision's probability is that of the weighted tree.
A context never seen has no counts and predicts 1/2, so the model needs no
smoothing and its distribution sums to 1. ``code_length`` is bits per byte.

Whole corpus, no table on the driver. Documents are dealt by hash into blocks of
some ``block_bytes`` of text, one after another in a task. A block sends its distinct
(depth + 1)-grams and distinct words with training counts, packed, to groups dealt out by
the two bytes next to the predicted one (so a group holds whole subtrees) or by word. A
group's messages go to as many tasks as their size asks for; each merges them as they
come, and the group's sums are merged again, which gives the model: sorted keys with
counts, cut between subtrees. Trees are built per piece of the model and one binary decision
at a time. For the answers each task of a group reads the group's part of the model first
and then sends each block, message by message, the log-probabilities of just its
own grams. So a task holds a block's or a group's distinct keys, never their messages.
Only the nodes of depth 0 and 1 are gathered: at most 257 * 255 of them.

Defined results: null text counts as empty (its one token is the end); ids may
be null or repeat; if there is no training row, every count is 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hash_strings, lower_ascii, materialize, mix64, shuffle_width, slices, small_batches, table, words

DEPTH = 4
END = 0xFF
GRAMS, WORDS = 0, 1
#: Entries of a piece of the model at least, where it goes on behind the next subtree.
PIECE = 200_000


def _log_rising(n: np.ndarray, offset: float) -> np.ndarray:
    """log of offset * (1 + offset) * ... * (n - 1 + offset), that is log Gamma(n + offset) - log Gamma(offset)."""
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(64) + offset))))
    z = np.maximum(n, 64).astype(np.float64) + offset
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(n <= 64, small[np.minimum(n, 64)], series - math.lgamma(offset))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability."""
    return _log_rising(zeros, 0.5) + _log_rising(ones, 0.5) - _log_rising(zeros + ones, 1.0)


def gram_keys(texts: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(key of each predicted byte with its context, number of predictions of each text); texts are lower-cased.

    Key bytes from the top: the context from the nearest byte to the farthest, then the predicted byte. ``depth`` is 2 to 7.
    """
    n = len(texts)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(off)
    # ``depth`` end symbols before each text, one after it; between texts the runs overlap to ``depth`` in all.
    place = np.arange(len(raw)) + np.repeat(np.arange(1, n + 1) * depth, lengths)
    padded = np.full(len(raw) + (n + 1) * depth, END, np.uint8)
    padded[place] = raw
    want = np.ones(len(padded), bool)
    ends = np.cumsum(lengths) + np.arange(1, n + 1) * depth  # where each text's end symbol stands
    for k in range(1, depth):
        want[ends + k] = False
    want[:depth] = False
    wide = padded.astype(np.uint64)
    key = wide[depth:].copy()
    for d in range(1, depth + 1):
        key |= wide[depth - d : len(wide) - d] << np.uint64(8 * (depth + 1 - d))
    return key[want[depth:]], lengths + 1


def group_of_gram(keys: np.ndarray, groups: int, depth: int = DEPTH) -> np.ndarray:
    return (mix64(keys >> np.uint64(8 * (depth - 1))) % np.uint64(groups)).astype(np.int64)


def group_of_word(keys: np.ndarray, groups: int) -> np.ndarray:
    return (mix64(keys) % np.uint64(groups)).astype(np.int64)


class Tally:
    """Distinct keys with counts, merged whenever as many wait as there are, so the work is that of a few sorts."""

    def __init__(self):
        self.parts: list = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(1 << 18, len(self.parts[0][0])):
            self.parts, self.waiting = [self.total()], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return summed(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if not len(keys):
        return keys, counts
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[head], np.add.reduceat(counts[order], head)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.diff(np.append(head, len(keys)))


def level_nodes(keys: np.ndarray, counts: np.ndarray, depth: int, level: int, top: int = 2):
    """The nodes of one binary decision over sorted distinct grams with training counts, whole subtrees of depth ``top``.

    Returns (node at full depth of each gram, its bit, names of the nodes of depth ``top``, their log Pw, and from full
    depth to ``top`` (parent of each node of the depth below, zeros, ones, log Pe, sum of the children's log Pw)).
    A name is the context's bytes, then the decisions before.
    """
    symbol = keys & np.uint64(0xFF)
    name = keys >> np.uint64(8) << np.uint64(8) | symbol >> np.uint64(8 - level)
    head = np.concatenate(([True], name[1:] != name[:-1]))
    at = np.flatnonzero(head)
    bit = ((symbol >> np.uint64(7 - level)) & np.uint64(1)).astype(np.int64)
    ones = np.add.reduceat(counts * bit, at)
    zeros = np.add.reduceat(counts, at) - ones
    names, weighted = name[at], log_kt(zeros, ones)
    tables = [(None, zeros, ones, weighted, None)]
    for _ in range(depth - 1, top - 1, -1):
        names, parent = np.unique(names >> np.uint64(16) << np.uint64(8) | names & np.uint64(0xFF), return_inverse=True)
        zeros, ones = (np.bincount(parent, x, len(names)).astype(np.int64) for x in (zeros, ones))
        own, below = log_kt(zeros, ones), np.bincount(parent, weighted, len(names))
        weighted = np.logaddexp(own, below) - math.log(2)
        tables.append((parent, zeros, ones, own, below))
    return np.cumsum(head) - 1, bit, names, weighted, tables


def top_nodes(keys: np.ndarray, counts: np.ndarray, depth: int, top: int = 2):
    """(name, zeros, ones, sum of log Pw) of the nodes of depth ``top`` - 1 under which the subtrees stand.

    A name is the nearest byte times 256 plus the node's number in the binary tree of a byte.
    """
    for level in range(8):
        _, _, names, weighted, tables = level_nodes(keys, counts, depth, level, top)
        _, zeros, ones, _, _ = tables[-1]
        number = (names & np.uint64(0xFF)).astype(np.int64) | 1 << level
        found, where = np.unique((names >> np.uint64(8 * top)).astype(np.int64) * 256 + number, return_inverse=True)
        yield found, np.bincount(where, zeros).astype(np.int64), np.bincount(where, ones).astype(np.int64), np.bincount(where, weighted)


def log10_probabilities(keys: np.ndarray, counts: np.ndarray, depth: int, upper, top: int = 2) -> np.ndarray:
    """log10 of each gram's probability; ``upper`` is a list of (names, zeros, ones, log beta) of depths 1 and 0."""
    symbol = (keys & np.uint64(0xFF)).astype(np.int64)
    near = (keys >> np.uint64(8 * depth)).astype(np.int64)
    out = np.zeros(len(keys))
    for level in range(8):
        node, bit, _, _, tables = level_nodes(keys, counts, depth, level, top)
        p = None
        for parent, zeros, ones, own, below in tables:
            node = node if parent is None else parent[node]
            p = _step(p, zeros[node], ones[node], bit, None if below is None else (own - below)[node])
        number = (1 << level) | (symbol >> (8 - level))
        for k, (names, zeros, ones, beta) in enumerate(upper):
            at = np.searchsorted(names, number + (near * 256 if k == 0 else 0))
            p = _step(p, zeros[at], ones[at], bit, beta[at])
        out += np.log10(p)
    return out


def _step(deeper, zeros, ones, bit, log_beta):
    kt = (np.where(bit > 0, ones, zeros) + 0.5) / (zeros + ones + 1.0)
    if deeper is None:
        return kt
    w = 1.0 / (1.0 + np.exp(np.clip(-log_beta, -700, 700)))
    return w * kt + (1.0 - w) * deeper


def upper_levels(rows) -> list:
    """From (name, zeros, ones, sum of log Pw below) of depth 1: the nodes of depths 1 and 0 with their log beta."""
    names, zeros, ones, below = (np.array(x) for x in rows)
    order = np.argsort(names)
    names, zeros, ones, below = names[order], zeros[order], ones[order], below[order]
    own = log_kt(zeros, ones)
    mixed = np.logaddexp(own, below) - math.log(2)
    root, where = np.unique(names & 255, return_inverse=True)
    z, o = np.bincount(where, zeros).astype(np.int64), np.bincount(where, ones).astype(np.int64)
    return [(names, zeros, ones, own - below), (root, z, o, log_kt(z, o) - np.bincount(where, mixed))]


class HashTable:
    """Open addressing over distinct uint64 keys, built and probed with whole-array steps."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, (4 * max(1, len(keys)) - 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.at = np.full(size, -1, np.int32)
        self.keys, self.values = keys, values
        left, probe = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], probe)
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several for one slot the last stays
            left = left[self.at[slot] != left]
            probe += 1
        self.slots = keys[np.maximum(self.at, 0)] if len(keys) else np.zeros(size, np.uint64)

    def _slot(self, keys, probe):
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(32)) + np.uint64(probe) * ((h >> np.uint64(8)) | np.uint64(1))) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all present; a missing one is an error."""
        slot = self._slot(keys, 0)
        if not len(self.keys):
            if len(keys):
                raise KeyError("a key was not counted")
            return self.values[:0]
        out = self.values[self.at[slot]]
        miss, probe = np.flatnonzero(self.slots[slot] != keys), 1
        while len(miss):
            slot = self._slot(keys[miss], probe)
            if (self.at[slot] < 0).any():
                raise KeyError("a key was not counted")
            out[miss] = self.values[self.at[slot]]
            miss = miss[self.slots[slot] != keys[miss]]
            probe += 1
        return out


_SENT = "kind int, part int, block long, keys binary, counts binary, n long"
_MODEL = "kind int, part int, keys binary, counts binary"
_ANSWERS = "kind int, block long, keys binary, counts binary"
_ARROW = {"kind": pa.int32(), "part": pa.int32(), "block": pa.int64(), "keys": pa.binary(), "counts": pa.binary(), "n": pa.int64()}


def _packed(rows: list[tuple], schema: str):
    """Batches of rows of a schema above, of some MB each."""
    names = [x.split()[0] for x in schema.split(", ")]
    at, held = 0, 0
    for k, row in enumerate(rows):
        held += sum(len(x) for x in row if isinstance(x, bytes))
        if held > 4 << 20 or k - at >= 255 or k == len(rows) - 1:
            columns = zip(*rows[at : k + 1], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[n]) for n, c in zip(names, columns, strict=True)], names=names)
            at, held = k + 1, 0


def _rows_of(batch, names):
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _send(parts: int, depth: int):
    """(block, training, text), sorted by block, in; packed keys and training counts out."""

    def emit(block, kind, keys, counts):
        part = group_of_gram(keys, parts, depth) if kind == GRAMS else group_of_word(keys, parts)
        order = np.argsort(part, kind="stable")  # keys are sorted, so they stay sorted in each part
        keys, counts, part = keys[order], counts[order], part[order]
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else part
        rows = [
            (kind, int(part[a]), block, keys[a:b].tobytes(), counts[a:b].tobytes(), b - a) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=bool(len(cut)))
        ]
        yield from _packed(rows, _SENT)

    def run(batches):
        current, grams, vocab = None, Tally(), Tally()

        def close():
            if current is not None:
                yield from emit(current, GRAMS, *grams.total())
                yield from emit(current, WORDS, *vocab.total())

        for whole in batches:
            blocks = whole.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)] if len(blocks) else []
            for a, b in zip(cuts, cuts[1:]):
                if blocks[a] != current:
                    yield from close()
                    current, grams, vocab = int(blocks[a]), Tally(), Tally()
                for batch in slices(whole.slice(a, b - a), 2):
                    texts = lower_ascii(batch.column(2))
                    training = batch.column(1).to_numpy(zero_copy_only=False)
                    keys, n = gram_keys(texts, depth)
                    learn = np.repeat(training, n)
                    grams.add(*counted(keys[learn]))
                    if not training.all():
                        seen, _ = counted(keys[~learn])
                        grams.add(seen, np.zeros(len(seen), np.int64))
                    counts, codes, vocabulary = words(texts)
                    learn = np.repeat(training, counts)
                    vocab.add(*summed(hash_strings(vocabulary), np.bincount(codes[learn], minlength=len(vocabulary))))
        yield from close()
        pa.default_memory_pool().release_unused()

    return run


def _merge(depth: int):
    """(kind, part, keys, counts) in; the same summed by key over a whole task and cut into pieces between subtrees out."""

    def run(batches):
        tallies: dict[tuple[int, int], Tally] = {}
        for batch in batches:
            for kind, part, keys, counts in _rows_of(batch, ("kind", "part", "keys", "counts")):
                tallies.setdefault((kind, part), Tally()).add(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64))
        for (kind, part), tally in sorted(tallies.items()):
            keys, counts = tally.total()
            subtree = keys >> np.uint64(8 * (depth - 1)) if kind == GRAMS else keys
            a = 0
            while a < len(keys):
                b = int(np.searchsorted(subtree, subtree[min(a + PIECE, len(keys)) - 1], side="right"))
                yield from _packed([(kind, part, keys[a:b].tobytes(), counts[a:b].tobytes())], _MODEL)
                a = b

    return run


def _statistics(depth: int):
    """Pieces of the model in; nodes of depth 1 that their subtrees add to, and as row name -1 the words seen and distinct in training."""

    def run(batches):
        for batch in batches:
            for kind, keys, counts in _rows_of(batch, ("kind", "keys", "counts")):
                keys, counts = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                if kind == GRAMS:
                    names, zeros, ones, below = (np.concatenate(x) for x in zip(*top_nodes(keys, counts, depth), strict=True))
                else:
                    names, zeros, ones, below = (np.array([x]) for x in (-1, counts.sum(), (counts > 0).sum(), 0.0))
                columns = [pa.array(names, pa.int64()), pa.array(zeros, pa.int64()), pa.array(ones, pa.int64()), pa.array(below, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["name", "zeros", "ones", "below"])

    return run


def _values(sent, depth: int):
    """Pieces of the model in; with log10 probabilities in place of the counts of grams out."""

    def run(batches):
        upper = sent.value
        for batch in batches:
            for kind, part, keys, counts in _rows_of(batch, ("kind", "part", "keys", "counts")):
                if kind == GRAMS:
                    counts = log10_probabilities(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64), depth, upper).tobytes()
                yield from _packed([(kind, part, keys, counts)], _MODEL)

    return run


def _answers(batches):
    """(kind, block, keys, values) of one group, by kind with the model (null block) first, in; the values of each block's keys out."""
    of_kind, pieces, model = None, [], None
    for batch in batches:
        out = []
        for kind, block, keys, values in _rows_of(batch, ("kind", "block", "keys", "counts")):
            if kind != of_kind:
                of_kind, pieces, model = kind, [], None
            if block is None:
                pieces.append((np.frombuffer(keys, np.uint64), np.frombuffer(values, np.float64 if kind == GRAMS else np.int64)))
                continue
            if model is None:
                all_keys, all_values = (np.concatenate([p[k] for p in pieces]) for k in (0, 1))
                order, pieces = np.argsort(all_keys), []
                model = all_keys[order], all_values[order]
            out.append((kind, block, keys, model[1][np.searchsorted(model[0], np.frombuffer(keys, np.uint64))].tobytes()))
        yield from _packed(out, _ANSWERS)


def _score(total: int, distinct: int, documents: int, depth: int):
    """Rows (block, kind, id, held_out, text, keys, counts), answers before documents within a block, in; scores out."""

    def run(batches):
        block, parts, tables = None, {GRAMS: [], WORDS: []}, None
        for whole in batches:
            blocks, kinds = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(np.minimum(kinds, 2)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
                part = whole.slice(a, b - a)
                if blocks[a] != block:
                    block, parts, tables = blocks[a], {GRAMS: [], WORDS: []}, None
                if kinds[a] < 2:
                    for keys, values in zip(part.column(5).to_pylist(), part.column(6).to_pylist(), strict=True):
                        parts[int(kinds[a])].append((keys, values))
                    continue
                if tables is None:
                    tables = {}
                    for kind, dtype in ((GRAMS, np.float64), (WORDS, np.int64)):
                        keys = np.frombuffer(b"".join(k for k, _ in parts[kind]), np.uint64)
                        tables[kind] = HashTable(keys, np.frombuffer(b"".join(v for _, v in parts[kind]), dtype))
                    parts = {GRAMS: [], WORDS: []}
                for batch in slices(part, 4):
                    yield one(batch, tables)

    def one(batch, tables):
        texts = lower_ascii(batch.column(4))
        keys, n = gram_keys(texts, depth)
        sums = np.concatenate(([0.0], np.cumsum(tables[GRAMS].get(keys))))
        ends = np.cumsum(n)
        score = sums[ends] - sums[ends - n]
        counts, codes, vocabulary = words(texts)
        often = tables[WORDS].get(hash_strings(vocabulary))
        unit = np.log10((often + 1.0) / (total + distinct + 1.0))
        base = np.concatenate(([0.0], np.cumsum(unit[codes])))
        known = np.concatenate(([0], np.cumsum((often > 0)[codes])))
        ends = np.cumsum(counts)
        last = math.log10((documents + 1.0) / (total + distinct + 1.0))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(2),
                batch.column(3),
                pa.array(counts + 1),
                pa.array(known[ends] - known[ends - counts] + int(documents > 0)),
                pa.array(np.full(len(n), total, np.int64)),
                pa.array(base[ends] - base[ends - counts] + last),
                pa.array(score),
                pa.array(-score / math.log10(2) / np.maximum(n, 1)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    return run


def score_texts(
    df: DataFrame,
    train_where=None,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    block_bytes: int = 32 << 20,
    task_entries: int = 8_000_000,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``train_where`` tells the rows to learn from; by default all but a seventh, by the crc32 of the id as text. ``depth``
    is 2 to 7 bytes. No result depends on ``block_bytes`` or on ``task_entries``, the keys in the messages of a task.
    """
    if not 2 <= depth <= 7:
        raise ValueError("a context has 2 to 7 bytes")
    spark = df.sparkSession
    small_batches(spark)
    parts = shuffle_width(spark)
    held = F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2, F.lit(False))
    held = held if train_where is None else ~train_where
    rows = df.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if(~F.col("held_out")).alias("documents")).first()
    blocks, documents = max(parts, -(-size["bytes"] // block_bytes)), size["documents"]
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    home = F.pmod("block", F.lit(parts)).cast("int")
    dealt = rows.select("block", ~F.col("held_out"), "text").repartitionById(parts, home).sortWithinPartitions("block")
    sent = materialize(dealt.mapInArrow(_send(parts, depth), _SENT), "lm-sent")

    # As many tasks for a group as its messages ask for, numbered on: a row per group is all that the driver gets.
    sizes = sent.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    plan, tasks = [], 0
    for part, n in sizes:
        plan.append((part, tasks, max(1, -(-n // task_entries))))
        tasks += plan[-1][2]
    plan = F.broadcast(spark.createDataFrame(plan, "part int, first int, copies int"))
    task = (F.col("first") + F.pmod(F.xxhash64("block"), F.col("copies"))).cast("int").alias("task")
    tasks = max(1, tasks)
    first = sent.select("kind", "part", "block", "keys", "counts").join(plan, "part").select(task, "kind", "part", "keys", "counts")
    merged = first.repartitionById(tasks, F.col("task")).drop("task").mapInArrow(_merge(depth), _MODEL)
    model = materialize(merged.repartitionById(parts, F.col("part")).mapInArrow(_merge(depth), _MODEL), "lm-model")

    gathered = model.mapInArrow(_statistics(depth), "name long, zeros long, ones long, below double")
    stats = gathered.groupBy("name").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect()  # at most 257 * 255 + 1 rows
    total = sum(r[1] for r in stats if r[0] == -1) + documents
    distinct = sum(r[2] for r in stats if r[0] == -1) + int(documents > 0)
    nodes = [r for r in stats if r[0] >= 0]
    upper = spark.sparkContext.broadcast(upper_levels(list(zip(*nodes, strict=True))) if nodes else [])

    no = lambda kind: F.lit(None).cast(kind)
    valued = model.mapInArrow(_values(upper, depth), _MODEL).join(plan, "part")
    valued = valued.select(
        F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("task"), "kind", no("long").alias("block"), "keys", "counts"
    )
    asked = sent.select("kind", "part", "block", "keys").join(plan, "part").select(task, "kind", "block", "keys", no("binary").alias("counts"))
    ready = valued.unionByName(asked).repartitionById(tasks, F.col("task")).sortWithinPartitions("kind", F.asc_nulls_first("block"))
    answers = ready.select("kind", "block", "keys", "counts").mapInArrow(_answers, _ANSWERS)

    both = rows.select("block", F.lit(2).alias("kind"), "id", "held_out", "text", no("binary").alias("keys"), no("binary").alias("counts"))
    both = both.unionByName(
        answers.select("block", "kind", no("long").alias("id"), no("boolean").alias("held_out"), no("string").alias("text"), "keys", "counts")
    )
    ready = both.repartitionById(parts, home).sortWithinPartitions("block", "kind")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return ready.mapInArrow(_score(total, distinct, documents, depth), schema)


def op9_context_tree(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents")).drop("bits_per_byte")


QUERIES = {"op9_context_tree": op9_context_tree}
ORACLE_SQL: dict[str, str] = {}  # the model is no SQL; tests compare with a brute-force context tree and with SQL for the base
