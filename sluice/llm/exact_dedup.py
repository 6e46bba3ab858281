"""Exact dedup with a cuckoo-filter index of live digests.

Every text is normalised (A-Z lower-cased, null as empty) and digested in the
JVM. The digests are dealt out by digest; each task keeps a ``CuckooIndex``: a
cuckoo filter of short fingerprints whose slots also hold the key, so that a
hit is verified against the content of its bucket (the full digest and the
length of the text). When a newer row of the same content arrives, the live
entry is deleted and the newer one inserted. Before the shuffle the same index
runs over each input split, so a text that makes up a third of all rows leaves
each split as few rows: an index hands on what it holds at ``HELD`` entries. After the
shuffle rows come in order of the digest's first byte and each byte has an index of
its own, so an index holds a 256th of its partition's digests.

Defined results: null text counts as empty; rows with null id can be members
of a group but are kept only if all ids of the group are null; rows that repeat
both id and text are one document and share their fate; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import UPPER, LOWER, ascii_lower, materialize, spread, table


class CuckooIndex:
    """A cuckoo filter, four slots a bucket, whose entries can be deleted and whose hits are verified.

    ``keys`` maps nothing by itself: a lookup touches two buckets only. The stored keys serve to verify
    hits and to rebuild a table of twice the buckets when an insertion finds no place.
    """

    SLOTS, KICKS = 4, 64

    def __init__(self, buckets: int = 64):
        self._allocate(max(2, 1 << (buckets - 1).bit_length()))
        self.size = self.resizes = 0

    def _allocate(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [[] for _ in range(buckets)]
        self.entries = [[] for _ in range(buckets)]

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _first(self, key: bytes) -> int:
        return int.from_bytes(key[:8], "little") & self.mask

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & self.mask

    def get(self, key: bytes):
        """The live entry of ``key``: (key, value), or None. A matching fingerprint alone is not a hit."""
        p, i = self._print(key), self._first(key)
        for b in (i, self._other(i, p)):
            if p in self.prints[b]:
                for entry in self.entries[b]:
                    if entry[0] == key:
                        return entry
        return None

    def insert(self, key: bytes, value) -> None:
        entry = (key, value)
        while not self._place(entry):
            self._grow()
        self.size += 1

    def _place(self, entry) -> bool:
        p, i = self._print(entry[0]), self._first(entry[0])
        j = self._other(i, p)
        for b in (i, j):
            if len(self.prints[b]) < self.SLOTS:
                self.prints[b].append(p)
                self.entries[b].append(entry)
                return True
        moved, b = [], j
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            moved.append((b, slot))
            p, self.prints[b][slot] = self.prints[b][slot], p
            entry, self.entries[b][slot] = self.entries[b][slot], entry
            b = self._other(b, p)
            if len(self.prints[b]) < self.SLOTS:
                self.prints[b].append(p)
                self.entries[b].append(entry)
                return True
        for b, slot in reversed(moved):  # nothing is lost when the walk fails
            p, self.prints[b][slot] = self.prints[b][slot], p
            entry, self.entries[b][slot] = self.entries[b][slot], entry
        return False

    def delete(self, key: bytes) -> bool:
        p, i = self._print(key), self._first(key)
        for b in (i, self._other(i, p)):
            for at, entry in enumerate(self.entries[b]):
                if entry[0] == key:
                    del self.entries[b][at], self.prints[b][at]
                    self.size -= 1
                    return True
        return False

    def _grow(self) -> None:
        live = [e for b in self.entries for e in b]
        buckets = 2 * (self.mask + 1)
        while True:
            self.resizes += 1
            self._allocate(buckets)
            if all(self._place(e) for e in live):
                return
            buckets *= 2

    def items(self):
        for b in self.entries:
            yield from b


HELD = 250_000


def _live_rows(index: CuckooIndex):
    rows = list(index.items())
    for at in range(0, len(rows), 10_000):
        part = rows[at : at + 10_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[:32] for k, _ in part], pa.binary()),
                pa.array([int.from_bytes(k[32:], "little") for k, _ in part], pa.int64()),
                pa.array([v[0] for _, v in part], pa.int64()),
                pa.array([v[1] for _, v in part], pa.int64()),
            ],
            names=["digest", "n_bytes", "id", "n"],
        )


def _index_batches(in_order: bool, held: int = HELD):
    """(digest, length, id, n) rows in, a row for each live content out.

    Rows ``in_order`` of the digest's first byte give one row a content; others one for every ``held`` entries of the index.
    """

    def run(batches):
        index, first = CuckooIndex(), None
        for batch in batches:
            digests, lengths, ids, counts = (batch.column(k).to_pylist() for k in range(4))
            for digest, length, doc, n in zip(digests, lengths, ids, counts, strict=True):
                if index.size and (digest[0] != first if in_order else index.size >= held):
                    yield from _live_rows(index)
                    index = CuckooIndex()
                first = digest[0]
                key = digest + length.to_bytes(8, "little")
                live = index.get(key)
                if live is None:
                    index.insert(key, (doc, n))
                    continue
                before, seen = live[1]
                newest = before if doc is None or (before is not None and before >= doc) else doc
                index.delete(key)
                index.insert(key, (newest, seen + n))
        yield from _live_rows(index)

    return run


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = materialize(
        spread(df.select(id_col, text_col)).select(F.col(id_col).cast("long").alias("id"), text.alias("t")).select(
            "id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes")
        ),
        "dedup-digests",
    )
    schema = "digest binary, n_bytes long, id long, n long"
    local = rows.select("digest", "n_bytes", "id", F.lit(1).cast("long").alias("n")).mapInArrow(_index_batches(False, held), schema)
    dealt = local.repartition("digest").sortWithinPartitions(F.substring("digest", 1, 1))
    groups = dealt.mapInArrow(_index_batches(True), schema)
    groups = groups.select("digest", "n_bytes", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    # AQE splits the partition of a hot digest on the side of the rows: groups has one row a digest.
    return rows.join(groups, ["digest", "n_bytes"]).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}

ORACLE_SQL = {
    "op4_exact_dedup": f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       (d.doc_id IS NOT DISTINCT FROM g.keep_id) AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
}
