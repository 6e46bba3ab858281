"""Language ID with bit-sliced Bloom filters over character n-grams.

Training takes the 3- and 4-grams of lower-cased words (a space marks each end;
anything that is no letter separates words) of all training rows. A language
holds every n-gram that stands in one of its texts; none is left out for being
rare or for being more common elsewhere.

The filters of all languages share their positions: each of the ``m`` positions
has machine words with bits per language, so the AND over an n-gram's ``k``
positions is the set of all languages that contain it. As a corpus grows, quotes
bring nearly every n-gram into every language, so besides the bit for ``contains``
a language has one for each of ``TIERS``: set where the n-gram's share of the
language's n-grams is at least that part of its share where it is most common.
The filters are built on the executors: positions and bits are combined with OR in
each task and then by slice of the table, and only the finished table comes to the
driver. It has 16 positions per n-gram of the fullest language, but ``max_bytes`` at
most; beyond, positions fill up, n-grams still all go in, and the correction grows.

Per language and tier the hits of a text are counted (a popcount per bit) and
corrected for the false positives that the bit's filter gives, ``fill ** k`` of the
n-grams that it does not hold. The language with the largest sum of corrected counts
wins; the score is the part of all counts it could have, ``lead`` by how much of
them it is ahead of the next language.

Defined results: ``und`` with score 0 for null texts and texts without letters,
or if there is nothing to learn from; ties go to the language with most training
n-grams, then to the first by code point; so does a text none of whose n-grams is
known, with score 0; rows that repeat give the same answer; a null id
counts as the empty string in the fold; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, mix64, slices, small_batches, spread, table, words

ORDERS = (3, 4)
HASHES = 3
#: A bit of a language is set from so large a part of an n-gram's greatest share on; 0 is for all n-grams that it contains.
TIERS = (0.0, 1 / 64, 1 / 16, 1 / 4)
_P = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def word_grams(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash) of each n-gram of the words, and whether each word has a letter."""
    lowered = [w.lower() for w in vocabulary.to_pylist()]
    n = len(lowered)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    text = " " + " ".join(lowered) + " "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, lowered), dtype=np.int64, count=n) + 1
    owner = np.concatenate(([0], np.repeat(np.arange(n), lengths)))
    letter = _letter_table()[points]
    before = np.concatenate(([True], letter[:-1]))
    stay = letter | before
    points, owner, letter = points[stay].astype(np.uint64), owner[stay], letter[stay]
    has = np.zeros(n, bool)
    has[owner[letter]] = True
    points[~letter] = 32
    owners, hashes = [], []
    for order in ORDERS:
        if len(points) < order:
            continue
        size = len(points) - order + 1
        h = np.full(size, order, dtype=np.uint64)
        inner = np.ones(size, bool)
        for k in range(order):
            h = h * _P + points[k : k + size]
            if 0 < k < order - 1:
                inner &= letter[k : k + size]
        owners.append(owner[1 : 1 + size][inner])  # the second character is a letter of the word
        hashes.append(mix64(h[inner]))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), has
    return np.concatenate(owners), np.concatenate(hashes), has


def _count_grams(batches):
    """(text, lang) in; (lang, gram, n) out, summed over the whole task."""
    sums: dict[str, list] = {}

    def merged(parts):
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)

    for whole in batches:
        for batch in slices(whole, 0):
            counts, codes, vocabulary = words(batch.column(0))
            owner, grams, _ = word_grams(vocabulary)
            doc = np.repeat(np.arange(batch.num_rows), counts)
            langs = batch.column(1).dictionary_encode()
            lang_of = langs.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                often = np.bincount(codes[lang_of[doc] == k], minlength=len(vocabulary))[owner]
                used = often > 0
                parts = sums.setdefault(lang, [])
                parts.append(merged([(grams[used], often[used])]))
                if len(parts) > 5:
                    sums[lang] = [merged(parts)]
    pa.default_memory_pool().release_unused()
    for lang, parts in sums.items():
        keys, n = merged(parts)
        for at in range(0, len(keys), 50_000):
            k, c = keys[at : at + 50_000], n[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(c)], names=["lang", "gram", "n"])


def planes_of(langs: int) -> int:
    return -(-max(1, langs * len(TIERS)) // 64)


def word_of(langs: int):
    """The least machine word for the bits of all languages, or 64 bits in several planes."""
    return next((w for w in (np.uint8, np.uint16, np.uint32) if langs * len(TIERS) <= 8 * np.dtype(w).itemsize), np.uint64)


class BitSlicedBloom:
    """Machine words per position; bit ``tier * languages + language``, counted over planes of 64 bits."""

    def __init__(self, langs: list[str], m: int, order: np.ndarray | None = None):
        """``order`` lists the languages as ties prefer them."""
        self.langs, self.m = langs, m
        self.order = np.arange(len(langs)) if order is None else order
        self.planes = planes_of(len(langs))
        self.table = np.zeros((self.planes, m), dtype=word_of(len(langs)))
        self.of_mask: np.ndarray | None = None

    @staticmethod
    def positions(grams: np.ndarray, m: int):
        step = mix64(grams ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        for i in range(HASHES):
            yield ((grams + np.uint64(i) * step) >> np.uint64(20)) & np.uint64(m - 1)

    def place(self, lang, tier: int):
        """(plane, shift) of a bit."""
        bit = tier * len(self.langs) + lang
        return bit // 64, bit % 64

    def add(self, grams: np.ndarray, lang: int, tier: int = len(TIERS) - 1) -> None:
        """Sets the language's bits of all tiers up to ``tier``."""
        for k in range(tier + 1):
            plane, shift = self.place(lang, k)
            for p in self.positions(grams, self.m):
                self.table[plane, p] |= self.table.dtype.type(1 << shift)

    def finish(self) -> BitSlicedBloom:
        self.false = np.zeros((len(TIERS), len(self.langs)))
        for tier in range(len(TIERS)):
            for lang in range(len(self.langs)):
                plane, shift = self.place(lang, tier)
                self.false[tier, lang] = float(np.mean((self.table[plane] & self.table.dtype.type(1 << shift)) != 0)) ** HASHES
        return self

    def holds(self, grams: np.ndarray, plane: int = 0) -> np.ndarray:
        """For each n-gram the bits (of a plane of 64) of all languages that contain it."""
        out = None
        for p in self.positions(grams, self.m):
            got = self.table[plane, p]
            out = got if out is None else out & got
        return out

    def weights(self) -> np.ndarray:
        """(language, mask): what an n-gram with the mask adds to a language's corrected hits; for words of up to 16 bits."""
        masks = np.arange(1 << (8 * self.table.dtype.itemsize), dtype=np.uint32)
        out = np.zeros((len(self.langs), len(masks)))
        for tier in range(len(TIERS)):
            for lang in range(len(self.langs)):
                hit, false = (masks >> np.uint32(self.place(lang, tier)[1])) & np.uint32(1), self.false[tier, lang]
                out[lang] += (hit - false) / max(1e-9, 1 - false)
        return out

    def counts(self, grams: np.ndarray, owner: np.ndarray, words_: int) -> np.ndarray:
        """(language, word): the corrected hits of the n-grams of each word, added up over the tiers."""
        masks = [self.holds(grams, plane) for plane in range(self.planes)]
        if self.table.dtype.itemsize <= 2:
            if self.of_mask is None:
                self.of_mask = self.weights()
            return np.stack([np.bincount(owner, w[masks[0]], minlength=words_) for w in self.of_mask])
        out = np.zeros((len(self.langs), words_))
        n = np.bincount(owner, minlength=words_)
        for tier in range(len(TIERS)):
            for lang in range(len(self.langs)):
                plane, shift = self.place(lang, tier)
                hit, false = (masks[plane] & self.table.dtype.type(1 << shift)) != 0, self.false[tier, lang]
                out[lang] += (np.bincount(owner[hit], minlength=words_) - n * false) / max(1e-9, 1 - false)
        return out


def _predict_batches(model):
    def run(batches):
        bloom = model.value if model is not None else None
        for whole in batches:
            for batch in slices(whole, 1):
                counts, codes, vocabulary = words(batch.column(1))
                owner, grams, has = word_grams(vocabulary)
                ends = np.cumsum(counts)

                def by_text(of_word):
                    total = np.concatenate(([0], np.cumsum(of_word[codes])))
                    return total[ends] - total[ends - counts]

                lettered = by_text(has.astype(np.int64)) > 0
                n = by_text(np.bincount(owner, minlength=len(vocabulary)))
                if bloom is None or not bloom.langs:
                    names, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                    lead = score
                else:
                    # In whole parts of 2 ** -20, so that sums are exact and don't depend on the other texts of a batch.
                    of_words = np.rint(bloom.counts(grams, owner, len(vocabulary)) * 2.0**20).astype(np.int64)
                    right = np.maximum(0, np.stack([by_text(w) for w in of_words])) / (2.0**20 * len(TIERS))
                    ranked = right[bloom.order]
                    first = ranked.argmax(axis=0)
                    best, most = bloom.order[first], ranked.max(axis=0) * lettered
                    ranked[first, np.arange(batch.num_rows)] = 0.0
                    score, lead = most / np.maximum(n, 1), (most - ranked.max(axis=0)) / np.maximum(n, 1)
                    names = [bloom.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                score, lead = np.clip(score, 0.0, 1.0), np.clip(lead, 0.0, 1.0) * lettered
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(score), pa.array(lead), *batch.columns[3:]],
                    names=["doc_id", "held_out", "lang_pred", "score", "lead", *batch.schema.names[3:]],
                )

    return run


CHUNK = 1 << 16


def _slice_positions(bloom: BitSlicedBloom):
    """(lang, tier, gram) in; (slice of the table, positions in it, bits) out, combined over some 2 million n-grams."""
    word, m, at = bloom.table.dtype.type, bloom.m, {x: k for k, x in enumerate(bloom.langs)}
    places = [[bloom.place(lang, tier) for lang in range(len(at))] for tier in range(len(TIERS))]

    def combined(parts):
        keys, bits = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, bits = keys[order], bits[order]
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, bits = keys[head], np.bitwise_or.reduceat(bits, head)
        chunk = keys // CHUNK
        cuts = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
        for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
            yield int(chunk[begin]), (keys[begin:end] % CHUNK).astype(np.uint16).tobytes(), bits[begin:end].tobytes()

    def packed(parts):
        rows = list(combined(parts))
        for k in range(0, len(rows), 256):
            columns = zip(*rows[k : k + 256], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "at", "bits"]
            )

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            lang = np.array([at[x] for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
            tier, grams = batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            for k, of_lang in enumerate(places):
                has, placed = tier >= k, np.array(of_lang)[lang]
                bit = np.left_shift(np.uint64(1), placed[has, 1].astype(np.uint64)).astype(word)
                for p in BitSlicedBloom.positions(grams[has], m):
                    parts.append((placed[has, 0] * m + p.astype(np.int64), bit))
            held += len(grams)
            if held > 2_000_000:
                yield from packed(parts)
                parts, held = [], 0
        if parts:
            yield from packed(parts)

    return run


def _finished_slices(word):
    """(slice, positions, bits), sorted by slice, in; (slice, its words) out."""

    def run(batches):
        current, words_ = None, None
        for batch in batches:
            for chunk, at, bits in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if chunk != current:
                    if current is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([words_.tobytes()])], names=["chunk", "words"])
                    current, words_ = chunk, np.zeros(CHUNK, word)
                words_[np.frombuffer(at, np.uint16)] |= np.frombuffer(bits, word)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([words_.tobytes()])], names=["chunk", "words"])

    return run


def train(df: DataFrame, text_col: str, lang_col: str, max_bytes: int = 1 << 27) -> BitSlicedBloom | None:
    """Learn the filters from all rows with a language. To the driver: a row per language, and the table of ``max_bytes`` at most."""
    small_batches(df.sparkSession)
    rows = spread(df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string")))
    counts = materialize(
        rows.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams"
    )
    of_lang = {r["lang"]: (r["t"], r["d"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("t"), F.count("*").alias("d")).collect()}
    if not of_lang:
        return None
    langs = sorted(of_lang)
    word = word_of(len(langs))
    most = max(max_bytes // (planes_of(len(langs)) * np.dtype(word).itemsize), CHUNK)
    m = min(1 << (16 * max(d for _, d in of_lang.values()) - 1).bit_length(), 1 << (most.bit_length() - 1))
    m = max(m, CHUNK)
    bloom = BitSlicedBloom(langs, m, np.array(sorted(range(len(langs)), key=lambda k: (-of_lang[langs[k]][0], langs[k]))))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, float(of_lang[k][0]))])
    shares = counts.withColumn("share", F.col("n") / share[F.col("lang")])
    # A row per n-gram lists its languages, so it has at most as many as there are languages.
    by_gram = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("all"))
    tier = sum((F.col("x.share") >= F.col("top") * part).cast("int") for part in TIERS[1:])
    tiers = by_gram.select("gram", "top", F.explode("all").alias("x")).select("x.lang", tier.alias("tier"), "gram")
    bare = BitSlicedBloom(langs, m)
    bare.table = bare.table[:, :0]  # the plan takes no table along
    told = tiers.mapInArrow(_slice_positions(bare), "chunk int, at binary, bits binary")
    done = told.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_finished_slices(word), "chunk int, words binary")
    table_ = bloom.table.reshape(-1)
    for batch in done.toArrow().to_batches():
        for chunk, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            table_[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(found, word)
    return bloom.finish()


def identify(
    df: DataFrame,
    train_where=None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, lead, and those named in ``keep``, as keep_<name>.

    ``train_where`` tells the rows to learn from; by default all but a quarter, by the crc32 of the id as text.
    """
    held = F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))
    train_where = ~held if train_where is None else train_where
    model = train(df.where(train_where), text_col, lang_col)
    sent = None if model is None else df.sparkSession.sparkContext.broadcast(model)
    extra = [F.col(c).alias(f"keep_{c}") for c in keep]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"), *extra)
    schema = ", ".join(
        ["doc_id long, held_out boolean, lang_pred string, score double, lead double", *(f"`keep_{c}` {df.schema[c].dataType.simpleString()}" for c in keep)]
    )
    return spread(rows).mapInArrow(_predict_batches(sent), schema)


def keep_identified(df: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df``, with all their columns, whose language holds at least ``min_score`` of their n-grams.

    The model learns from all rows with a language. Texts without letters are rejected. With no labelled row there is no
    model and nothing else is rejected.
    """
    if df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).isEmpty():
        return df.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    found = identify(df, F.lit(True), id_col, text_col, lang_col, keep=tuple(df.columns))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return kept.select(*[F.col(f"keep_{c}").alias(c) for c in df.columns])


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op6_language_id": op6_language_id}
ORACLE_SQL: dict[str, str] = {}  # a trained model: tests hold it against held-out labels
