"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns; and each method on its own."""

from __future__ import annotations

import io
import math
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_ops_tables import base_spans, brute_components

from sluice.llm import _common, decontaminate, exact_dedup, html_text, langid, lm_score, mixing, ngram_join, pii, sharding, warc_zip
from sluice.llm.components import connected_components

LONG = " ".join(f"w{i % 5000}" for i in range(60_000))
EDGE = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "One two three four five", "en", None), (4, "One two three four five", "en", None)]
EDGE += [(5, "one two three four five", "en", "b"), (6, LONG, "fr", "b"), (None, "one two three four five", "en", "b"), (7, "é 𝔘 x", None, "c"), (8, "x", "en", "c")]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string")
    clash = "size shard slot kept score row id h skey block kind edge base chunk label print n key digest part".split()
    return df.withColumns({c: F.lit("clash") for c in clash})


OPS = {
    "pii": pii.find_pii,
    "sharding": sharding.shard_groups,
    "exact_dedup": exact_dedup.exact_dedup,
    "langid": langid.identify,
    "mixing": mixing.mix_sources,
    "lm_score": lm_score.score_texts,
    "ngram_join": ngram_join.ngram_join,
}


@pytest.mark.parametrize("name", list(OPS))
def test_edge_rows_and_empty_tables(edge, name):
    out = OPS[name](edge)
    assert out.count() == len(EDGE)
    assert OPS[name](edge.limit(0)).count() == 0
    assert out.columns[0] == "doc_id"


def by_id(df, column):
    got = {}
    for r in df.collect():
        got.setdefault(r["doc_id"], []).append(r[column])
    return got


def test_dedup_of_edge_rows(edge):
    out = exact_dedup.exact_dedup(edge)
    keep, size, kept = (by_id(out, c) for c in ("keep_id", "group_size", "kept"))
    assert keep[1] == keep[2] == [2] and size[1] == [2] and kept[1] == [False] and kept[2] == [True]
    assert keep[4] == [5, 5] and keep[None] == [5] and size[5] == [4] and kept[5] == [True] and kept[None] == [False]


def test_cuckoo_index_against_a_dict():
    rng, index, live = random.Random(3), exact_dedup.CuckooIndex(2), {}
    keys = [rng.randbytes(40) for _ in range(3000)]
    for _ in range(20_000):
        k = rng.choice(keys)
        if k in live and rng.random() < 0.5:
            assert index.delete(k)
            del live[k]
        elif k not in live:
            index.insert(k, len(live))
            live[k] = len(live)
        hit = index.get(k)
        assert (hit is not None) == (k in live) and (hit is None or hit[1] == live[k])
    assert index.resizes > 0 and {e[0] for e in index.items()} == set(live)


def test_same_fingerprint_is_no_hit():
    index = exact_dedup.CuckooIndex()
    index.insert(b"\1" * 10 + b"a" * 30, 1)
    assert index.get(b"\1" * 10 + b"b" * 30) is None


@pytest.mark.parametrize("held", [1, 3, 100])
def test_dedup_with_small_indexes(spark, held):
    rng = random.Random(held)
    rows = [(rng.choice([None, i, i]), rng.choice(["Hot", "hot", f"t{rng.randrange(90)}"])) for i in range(600)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), held=held)
    members = {}
    for i, t in rows:
        members.setdefault(t.lower(), []).append(i)
    want = sorted((i or -1, max((x for x in members[t.lower()] if x is not None), default=-1), len(members[t.lower()])) for i, t in rows)
    assert sorted((r.doc_id or -1, -1 if r.keep_id is None else r.keep_id, r.group_size) for r in out.collect()) == want


def brute_best_fit(sizes, capacity):
    bins, place = [], {}
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fit = [(room, b) for b, room in enumerate(bins) if room >= sizes[i]]
        if fit:
            room, b = min(fit)
            bins[b] = room - sizes[i]
        else:
            b = len(bins)
            bins.append(max(0, capacity - sizes[i]))
        place[i] = b
    return [place[i] for i in range(len(sizes))], len(bins)


def test_packing_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(0, 120))]
        assert sharding.pack(sizes, 70) == brute_best_fit(sizes, 70)
        place = sharding.level_pack(sizes, 4)
        assert len(place) == len(sizes) and all(0 <= p < 4 for p in place)


def test_shards_with_a_hot_text_and_small_cells(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i} " + "x" * (i % 50)) for i in range(600)]
    out = sharding.shard_groups(spark.createDataFrame(rows, "doc_id long, text string"), fine=4, cell_groups=50, slot_rows=10).toPandas()
    assert len(out) == 600 and out[out.doc_id % 3 == 0].shard.nunique() == 1
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sums = out.groupby("shard")["size"].sum()
    assert sums.max() <= 1.1 * sums.sum() / 8 + 51


def even_beside_the_hot(sums, hot):
    rest = [s for k, s in sums.items() if k not in hot]
    assert len(sums) == 8 and max(rest) <= 1.02 * min(rest)


def test_level_pack_with_large_items():
    for larges in ([1 / 3], [0.2], [0.13], [0.4, 0.2], [0.3, 0.13, 0.13], [0.999]):
        rest = [100 + i % 50 for i in range(2000)]
        sizes = [int(sum(rest) * s / (1 - sum(larges))) for s in larges] + rest
        sums, place = {}, sharding.level_pack(sizes, 8)
        for s, p in zip(sizes, place, strict=True):
            sums[p] = sums.get(p, 0) + s
        assert all(sums[place[k]] == sizes[k] for k in range(len(larges)))
        even_beside_the_hot(sums, place[: len(larges)])
    assert sharding.level_pack([], 8) == [] and sorted(sharding.level_pack([9, 5, 1], 8)) == [0, 1, 2]
    assert sharding.level_pack([9, 5, 1], 1) == [0, 0, 0]


@pytest.mark.parametrize("length", [200, 40_000])
def test_shards_with_a_text_of_a_third_or_nearly_all_bytes(spark, length):
    rows = [(i, "h" * length if i % 10 == 0 else f"text {i} " + "x" * (i % 50)) for i in range(3000)]
    out = sharding.shard_groups(spark.createDataFrame(rows, "doc_id long, text string"), fine=256).toPandas()
    hot = set(out[out.doc_id % 10 == 0].shard)
    sums = out.groupby("shard")["size"].sum().to_dict()
    assert len(out) == 3000 and len(hot) == 1 and sums[min(hot)] == 300 * (length + 1) > sum(sums.values()) / 3
    even_beside_the_hot(sums, hot)


@pytest.mark.parametrize("n", [2000, 8000])
def test_driver_items_stay_bounded_whatever_the_cells(spark, n):
    rng, shards, fine = random.Random(n), 4, 8
    rows = [(f"g{i}".encode(), rng.randrange(1, 60)) for i in range(n)]
    unit = sum(b for _, b in rows) // (shards * fine)
    of_item, pallets = sharding.pallets_of(spark.createDataFrame(rows, "item binary, bytes long"), n, unit, 3 * shards * fine, 10)
    assert len(pallets) <= 3 * shards * fine < n // 10
    got = {bytes(r.item): r.pallet for r in of_item.collect()}
    sums = {}
    for item, size in rows:
        sums[got[item]] = sums.get(got[item], 0) + size
    assert len(got) == n and sums == dict(pallets) and max(sums.values()) <= unit


def test_mix_targets(spark):
    rows = [(i, "w " * (i % 9), s) for i, s in enumerate(random.Random(2).choices(["a", "b", "c", None], [8, 40, 1, 3], k=3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df).toPandas().merge(df.toPandas()[["doc_id", "source"]], on="doc_id")
    assert (out.taken <= 3 * out["size"]).all()
    total = out["size"].sum()
    for _, part in out.groupby("source", dropna=False):
        assert part.target.iloc[0] <= 3 * part.source_size.iloc[0] + 1e-6
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 9
    assert math.isclose(out.groupby("source", dropna=False).target.first().sum(), total)
    again = mixing.mix_sources(df).toPandas().set_index("doc_id").taken
    assert (again == out.set_index("doc_id").taken).all()
    kept = mixing.take_mix(df).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    sized = out[out["size"] > 0].set_index("doc_id")
    assert (kept.reindex(sized.index).fillna(0) * sized["size"] == sized.taken).all()


def test_water_level():
    sizes, weights = [10, 1000, 5, 300], [1, 2, 3, 1]
    total, fixed = sum(sizes), set()
    while True:
        level = (total - sum(3 * sizes[i] for i in fixed)) / sum(weights[i] for i in range(4) if i not in fixed)
        more = {i for i in range(4) if i not in fixed and level * weights[i] > 3 * sizes[i]}
        if not more:
            break
        fixed |= more
    want = [3 * s if i in fixed else level * weights[i] for i, s in enumerate(sizes)]
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame([(f"0{i}", s) for i, s in enumerate(sizes)], "skey string, source_size long")
    got = {r.skey: r.target for r in mixing.source_targets(df, (1, 2, 3), 3).collect()}
    assert all(math.isclose(got[f"0{i}"], w) for i, w in enumerate(want))


def test_pii_base_spans_on_random_strings(spark):
    rng = random.Random(5)
    bits = ["a", "@", ".", "1", "2", "55", "+", "-", " ", "(", ")", "b.c", "x@y.z", "192.168.1.1", "4111 1111 1111 1111", "+1 (974) 555-3436", "é", "𝔘", "_", "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(400)]
    texts += [None, "", "1" * 30_000, "a" * 30_000 + "@x.y", "1." * 10_000, "+1" * 10_000, "@" * 10_000, "a@b.c_d@e.f", "999.1.1.1 1.2.3.4.5.6.7.8"]
    out = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    import hashlib

    assert len(out) == len(texts)
    for r in out:
        assert r.base_sha256 == hashlib.sha256(base_spans(texts[r.doc_id]).encode()).hexdigest()


def test_pii_adds_wider_spans_only_with_support(spark):
    texts = [f"mail: u{i}@site.com, call: +1 (212) 555-{1000 + i}, card 4111 1111 1111 1111 end" for i in range(40)]
    texts += [f"number {i}{i}{i}4567 89 and 1.2.3.{300 + i}" for i in range(40)]
    texts += ["write to: joe (at) mail (dot) com", "call: (212) 555-1234 now"]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[80].spans == "email:10:33" and out[81].spans == "phone:6:20"
    assert all(out[i].n_added == 0 for i in range(80))


def test_em_learns_reliabilities_without_known_classes():
    rng, counts = random.Random(4), {}
    for _ in range(4000):
        real = rng.random() < 0.3
        v = tuple((((1 if real else -1) if rng.random() < r else (-1 if real else 1)) if rng.random() < c else 0) for r, c in ((0.95, 1), (0.9, 0.9), (0.9, 0.6), (0.5, 1)))
        counts[0, v] = counts.get((0, v), 0) + 1
    post, rates = pii.em([(k, v, n) for (k, v), n in counts.items()])
    assert post[0, (1, 1, 1, -1)] > 0.95 and post[0, (-1, -1, -1, 1)] < 0.05
    for name, right in zip(pii.LABELERS, (0.95, 0.9, 0.9, 0.5), strict=True):
        real, false = rates[0, name]
        assert abs(real - right) < 0.05 and abs(1 - false - right) < 0.05


def planted_pii(rng):
    """(text, kind, what is planted or None) of texts that base patterns miss, and of numbers that are nobody's."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    name = "".join(rng.choices("abcdefgh", k=6))
    host = rng.choice(["site.com", "mail.example.org", "post.de"])
    hexes = "".join(rng.choices("0123456789abcdef", k=32))
    forms = [
        ("email", "mail: ", f"{name} (at) {host.replace('.', ' (dot) ')}"),
        ("email", "write to ", f"{name}[at]{host}"),
        ("phone", "tel. ", f"0{rng.randrange(1, 10)} {d(2)} {d(2)} {d(2)} {d(2)}"),
        ("phone", "call ", f"({rng.randrange(2, 10)}{d(2)}) {rng.randrange(2, 10)}{d(2)}-{d(4)}"),
        ("phone", "teléfono: ", f"6{d(2)} {d(3)} {d(3)}"),
        ("phone", "Telefon: ", f"030 {d(7)}"),
        ("ip", "server ", ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8))),
        ("secret", "token = ", '"' + hexes + '"'),
        ("secret", "the key ", "AKIA" + "".join(rng.choices("ABCDEFGHIJ234567", k=16))),
        (None, "order ", f"{d(3)} {d(3)} {d(4)}"),
        (None, "at ", f"{rng.randrange(10, 24)}:{d(2)}:{d(2)}"),
        (None, "version ", f"{d(1)}.{d(2)}.{d(1)}"),
        (None, "row of ", " ".join(d(rng.randrange(1, 5)) for _ in range(9))),
        (None, "commit ", hexes[:20]),
        (None, "see file ", f"chapter/section{d(2)}/figure-part{d(1)}"),
        (None, "isbn ", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"),
    ]
    return rng.choice(forms)


def test_pii_finds_planted_spans_that_base_patterns_miss(spark):
    rng = random.Random(12)
    rows, want = [], set()
    for i in range(3000):
        kind, before, what = planted_pii(rng)
        lead = f"é𝔘 some words {'x' * rng.randrange(9)} "
        rows.append((i, lead + before + what + " and more words"))
        if kind:
            quoted = what.startswith('"')
            start = len(lead + before) + quoted
            want.add((i, kind, start, start + len(what) - 2 * quoted))
    got = set()
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        base = set(filter(None, base_spans(rows[r.doc_id][1]).split(",")))
        for x in filter(None, [*r.spans.split(","), *r.secrets.split(",")]):
            if x not in base:
                kind, start, stop = x.split(":")
                got.add((r.doc_id, kind, int(start), int(stop)))
    assert len(got & want) / len(got) >= 0.95 and len(got & want) / len(want) >= 0.9
    for kind in ("email", "phone", "ip", "secret"):
        of = lambda s: {x for x in s if x[1] == kind}  # noqa: B023, E731
        assert len(of(got) & of(want)) >= 0.85 * len(of(want)), kind


def test_langid_mask_has_no_false_negatives():
    rng = np.random.default_rng(1)
    bloom = langid.BitSlicedBloom([f"l{i:02d}" for i in range(70)], 1 << 14)
    grams = {k: rng.integers(0, 2**63, 200).astype(np.uint64) for k in range(70)}
    for k, g in grams.items():
        bloom.add(g, k, k % 4)
    bloom.finish()
    for k, g in grams.items():
        for tier in range(k % 4 + 1):
            plane, shift = bloom.place(k, tier)
            assert ((bloom.holds(g, plane) >> np.uint64(shift)) & np.uint64(1)).all()
    fresh = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    seen = np.mean((bloom.holds(fresh, 0) & np.uint64(1)) > 0)
    assert abs(seen - bloom.false[0, 0]) < 0.01


def test_langid_keeps_every_ngram_of_every_language(spark):
    rng = random.Random(8)
    texts = {"a": ["".join(rng.choices("abcd", k=9)) for _ in range(400)], "b": ["".join(rng.choices("cdef", k=9)) for _ in range(30)], "c": ["cdcdcdcd", "ababab"]}
    rows = [(t, lang) for lang, ts in texts.items() for t in ts]
    bloom = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(7), "text", "lang")
    want = langid.BitSlicedBloom(bloom.langs, bloom.m)
    counts = {}
    for k, lang in enumerate(bloom.langs):
        _, grams, _ = langid.word_grams(pa.array(texts[lang]))
        grams, n = np.unique(grams, return_counts=True)
        counts[k] = dict(zip(grams.tolist(), (n / n.sum()).tolist()))
    for k, held in counts.items():
        for gram, share in held.items():
            top = max(c.get(gram, 0) for c in counts.values())
            want.add(np.array([gram], np.uint64), k, sum(share >= top * part for part in langid.TIERS) - 1)
    assert (want.table == bloom.table).all()
    small = langid.train(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", max_bytes=1)
    assert small.m == langid.CHUNK


def test_langid_counts_are_the_same_by_mask_and_by_bit():
    rng = np.random.default_rng(6)
    grams, owner = rng.integers(0, 2**63, 3000).astype(np.uint64), np.sort(rng.integers(0, 200, 3000))
    got = []
    for langs in (["a", "b", "c"], ["a", "b", "c", "d", "e", "f"]):  # words of 16 and of 32 bits
        bloom = langid.BitSlicedBloom(langs, 1 << 12)
        for lang in range(3):
            for tier in range(4):
                bloom.add(grams[lang * 700 + tier * 100 : lang * 700 + tier * 100 + 400], lang, tier)
        counts = bloom.finish().counts(grams, owner, 200)
        want = np.zeros((3, 200))
        for lang in range(3):
            for tier in range(4):
                plane, shift = bloom.place(lang, tier)
                hit = (bloom.holds(grams, plane) >> bloom.table.dtype.type(shift)) & bloom.table.dtype.type(1)
                np.add.at(want[lang], owner, (hit - bloom.false[tier, lang]) / (1 - bloom.false[tier, lang]))
        assert np.allclose(counts[:3], want)
        got.append(bloom.table.dtype.itemsize)
    assert got == [2, 4]


def test_langid_edges(edge):
    pred, score = by_id(langid.identify(edge), "lang_pred"), by_id(langid.identify(edge), "score")
    assert pred[1] == pred[2] == pred[3] == ["und"] and score[1] == [0.0]
    assert pred[8] != ["und"] and pred[7] != ["und"]
    none = langid.identify(edge.withColumn("lang", F.lit(None).cast("string")))
    assert set(r.lang_pred for r in none.collect()) == {"und"}
    kept = langid.keep_identified(edge)
    assert kept.columns == edge.columns and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())


def test_ngram_join_against_brute_force(spark):
    rng, vocab, texts = random.Random(9), [f"w{i}" for i in range(300)], {}
    passage = " ".join(rng.choices(vocab, k=60))
    for i in range(400):
        if i and rng.random() < 0.5:
            w = texts[rng.randrange(i)].split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            texts[i] = " ".join(w)
        else:
            texts[i] = " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 5, 12, 40, 90])))
            if rng.random() < 0.3:
                texts[i] += " " + passage
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for k, percent, block in ((4, 85, 1_000_000), (5, 80, 300)):
        component, size = brute_components(texts, k, percent)
        got = ngram_join.ngram_join(df, k=k, percent=percent, block_shingles=block, meeting_classes=5 if block == 300 else 50_000)
        got = got.toPandas().set_index("doc_id")
        assert got.component_id.to_dict() == component and got.n_shingles.to_dict() == size


@pytest.mark.parametrize("block", [200, 1_000_000])
def test_number_of_links_against_brute_force(spark, block):
    rng, vocab, texts = random.Random(21), [f"w{i}" for i in range(400)], {}
    for i in range(220):
        if i > 10 and rng.random() < 0.8:
            w = texts[rng.randrange(min(i, 40))].split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts[i] = " ".join(w)
        else:
            texts[i] = " ".join(rng.choices(vocab, k=rng.choice([2, 20, 60])))
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) or frozenset([tuple(w)])
    classes = set(sets.values())
    want = {i: sum(x != y and 100 * len(x & y) >= 85 * len(x | y) for y in classes) for i, x in sets.items()}
    got = ngram_join.ngram_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block_shingles=block, links=True).toPandas()
    assert got.set_index("doc_id").n_links.to_dict() == want and max(want.values()) > 5
    assert got.set_index("doc_id").component_id.to_dict() == brute_components(texts, 4, 85)[0]


def test_announcements_meet_at_the_threshold():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 6, 7, 8, 13, 20, 50, 177, 600):
        for percent in (80, 85):
            for _ in range(20):
                x = rng.integers(0, 2**63, n).astype(np.uint64)
                most = (100 - percent) * n // 100  # drop so many from x, or swap fewer
                y = x[: n - most] if rng.random() < 0.5 else np.append(x[: n - most // 2], rng.integers(0, 2**63, most // 2 - most // 8).astype(np.uint64))
                both = len(np.intersect1d(x, y))
                if not len(y) or 100 * both < percent * (len(x) + len(y) - both):
                    continue
                h, sizes = np.concatenate((np.sort(x), np.sort(y))), np.array([len(x), len(y)])
                keys, owner = ngram_join.announcements(h, sizes, percent)
                a, b = keys[owner == 0], keys[owner == 1]
                shared = set((a >> np.uint64(1)).tolist()) & set((b >> np.uint64(1)).tolist())
                roles = {int(v) for s in (a, b) for v in s & np.uint64(1) if True}
                assert shared and 1 in roles


def test_signature_tree_links_all(spark):
    rng = np.random.default_rng(5)
    core = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.sort(np.unique(np.concatenate((core[rng.random(200) > 0.05], rng.integers(0, 2**63, 5).astype(np.uint64))))) for _ in range(60)]
    sets += [np.sort(rng.integers(0, 2**63, int(rng.integers(1, 300))).astype(np.uint64)) for _ in range(60)]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in ngram_join.links(sets, 80):
        parent[root(i)] = root(j)
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                assert root(i) == root(j)


def test_drop_near_copies_keeps_one(spark):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (2, "something else entirely here now"), (2, "something else entirely here now"), (4, None), (5, "")]
    got = ngram_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 4, 5]


def test_drop_near_copies_with_null_and_repeated_ids(spark):
    clean = [" ".join(f"{c}{j}" for j in range(12)) for c in "abcdefg"]
    rows = [(1, clean[0]), (None, clean[0]), (None, clean[1]), (None, clean[2]), (None, clean[2] + " end"), (7, clean[0] + " end"), (7, clean[3])]
    rows += [(9, clean[4]), (9, clean[5]), (9, clean[5] + " end"), (9, clean[4]), (None, ""), (None, None), (11, ""), (11, ""), (12, clean[6]), (12, clean[6].upper())]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, at int")
    got = ngram_join.drop_near_copies(df)
    assert got.columns == df.columns
    found = sorted((r.doc_id or 0, (r.text or "").lower().removesuffix(" end")) for r in got.collect())
    assert found == sorted([(1, clean[0]), (0, clean[1]), (0, clean[2]), (7, clean[3]), (9, clean[4]), (9, clean[5]), (0, ""), (0, ""), (11, ""), (12, clean[6])])


def test_drop_near_copies_by_row_equals_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        if i % 4 and i > 20:
            w = rng.choice(rows)[1].split(" ")
            w[rng.choice([0, -1])] = f"e{i}"
            w = w[: len(w) - rng.randrange(3)] if len(w) > 20 else w
        else:
            w = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(25, 60))]
        rows.append((rng.choice([None, rng.randrange(25), 100 + i]), " ".join(w)))
    component, _ = brute_components({i: t for i, (_, t) in enumerate(rows)}, 5, 80)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, at int")
    members = {}
    for i, c in component.items():
        members.setdefault(c, []).append(i)
    assert len(members) < 120
    kept = [r["at"] for r in ngram_join.drop_near_copies(df).collect()]
    assert sorted(component[i] for i in kept) == sorted(members)
    rank = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    assert all(rank(i) == min(map(rank, members[component[i]])) for i in kept)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (60, 60)], "a long, b long")
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 51: 50}


def nearest_brute(item, text):
    best = len(item)
    for i in range(len(text) + 1):
        row = list(range(len(item) + 1))
        for x in [None, *text[i:]]:
            if x is not None:
                new = [row[0] + 1]
                for j, y in enumerate(item, 1):
                    new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
                row = new
            best = min(best, row[-1])
    return best


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, text = rng.integers(1, 5, rng.integers(1, 9)).astype(np.uint64), rng.integers(1, 5, rng.integers(0, 14)).astype(np.uint64)
        assert decontaminate.nearest(item, text)[0] == nearest_brute(item.tolist(), text.tolist())


def planted(share, seed=3):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    items = [" ".join(rng.choices(vocab, k=rng.randrange(13, 60))) for _ in range(60)]
    docs, want = [], []
    for k in range(180):
        it = items[k % 60].split()
        for _ in range(int(share * len(it))):
            p, op = rng.randrange(len(it)), rng.choice("sid")
            if op == "s":
                it[p] = rng.choice(vocab)
            elif op == "i":
                it.insert(p, rng.choice(vocab))
            else:
                del it[p]
        host = rng.choices(vocab, k=150)
        p = rng.randrange(150)
        docs.append(" ".join(host[:p] + it + host[p:]).upper() if k % 2 else " ".join(host[:p] + it + host[p:]))
        want.append((k, k % 60))
    return items, docs, want


@pytest.mark.parametrize("share, least", [(0.0, 1.0), (0.1, 0.99), (0.2, 0.95)])
def test_recall_of_edited_passages(share, least):
    items, docs, want = planted(share)
    index = decontaminate.ItemIndex.build(list(range(60)), items, decontaminate.Limits())
    found = {(r[0], r[1]) for r in index.search(pa.array(docs))}
    assert len(found & set(want)) >= least * len(want)
    clean = [" ".join(f"clean{i}x{j}" for j in range(100)) for i in range(20)]
    assert index.search(pa.array(clean)) == []


@pytest.mark.parametrize("sizes", [(1, 2, 3, 4), (5, 8, 12), (13, 30, 59), (40, 100)])
@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_recall_where_the_rarest_words_are_edited(sizes, share):
    rng = random.Random(17)
    vocab = [f"v{i:04d}" + "abcdefghij"[: i % 10] for i in range(4000)]
    items = [" ".join(rng.choices(vocab, k=rng.choice(sizes))) for _ in range(200)]
    often = {}
    for w in " ".join(items).split():
        often[w] = often.get(w, 0) + 1
    docs = []
    for x in items:
        w = x.split()
        for j in sorted(range(len(w)), key=lambda j: (often[w[j]], -len(w[j])))[: int(share * len(w))]:
            w[j] = f"zz{rng.randrange(10**6)}"
        docs.append(" ".join(rng.choices(vocab, k=150) + w + rng.choices(vocab, k=150)))
    index = decontaminate.ItemIndex.build(list(range(200)), items, decontaminate.Limits())
    found = {(r[0], r[1]) for r in index.search(pa.array(docs))}
    assert sum((k, k) in found for k in range(200)) >= (200 if share == 0 else 196)


def test_decontamination_edges(spark, edge):
    items = spark.createDataFrame([(1, "one two three four five"), (2, None), (3, ""), (4, "!!"), (5, "x")], "item_id long, text string")
    got = decontaminate.contained_items(edge, items, limits=decontaminate.Limits(block_words=4))
    assert sorted((r.doc_id or 0, r.item_id) for r in got.collect()) == [(0, 1), (4, 1), (4, 1), (5, 1), (7, 5), (8, 5)]
    kept = decontaminate.drop_contaminated(edge, items)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6]
    assert decontaminate.contained_items(edge, items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(edge, items.limit(0)).count() == len(EDGE)
    assert decontaminate.contained_items(edge.limit(0), items).count() == 0


def brute_tree(train, text, depth=lm_score.DEPTH):
    counts, kids = {}, {}

    def symbols(t):
        return [255] * depth + list(t.encode()) + [255]

    def decisions(x):
        node = 1
        for level in range(7, -1, -1):
            yield node, (x >> level) & 1
            node = node * 2 + ((x >> level) & 1)

    for t in train:
        s = symbols(t)
        for p in range(depth, len(s)):
            for d in range(depth + 1):
                context = tuple(s[p - 1 - k] for k in range(d))
                for node, bit in decisions(s[p]):
                    counts.setdefault((context, node), [0, 0])[bit] += 1
    for c, node in counts:
        if c:
            kids.setdefault((c[:-1], node), []).append((c, node))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def weighted(key):
        own = kt(*counts[key])
        if len(key[0]) == depth:
            return own
        below = sum(map(weighted, kids.get(key, [])))
        return float(np.logaddexp(own, below)) - math.log(2)

    def chance(path, node, bit, d=0):
        key = (path[:d], node)
        c = counts.get(key, [0, 0])
        here = (c[bit] + 0.5) / (sum(c) + 1)
        if d == depth:
            return here
        beta = kt(*c) - sum(map(weighted, kids.get(key, []))) if key in counts else 0.0
        w = 1 / (1 + math.exp(-beta))
        return w * here + (1 - w) * chance(path, node, bit, d + 1)

    s, total = symbols(text), 0.0
    for p in range(depth, len(s)):
        path = tuple(s[p - 1 - k] for k in range(depth))
        total += sum(math.log10(chance(path, node, bit)) for node, bit in decisions(s[p]))
    return total


def test_context_tree_equals_brute_force(spark):
    texts = ["abra cadabra", "abracadabra abra", "Cad é", "", None, "zz abra"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score_texts(df, F.col("doc_id") != 5).collect()}
    train = [(t or "").lower() for t in texts[:5]]
    for i, t in enumerate(texts):
        assert math.isclose(got[i], brute_tree(train, (t or "").lower()), rel_tol=1e-9)


@pytest.mark.parametrize("depth, block_bytes, task_entries", [(2, 5, 3), (4, 40, 7), (5, 1 << 20, 1), (7, 1 << 20, 1 << 20)])
def test_context_tree_of_any_depth_blocks_and_tasks(spark, depth, block_bytes, task_entries):
    rng = random.Random(depth)
    texts = ["".join(rng.choices("ab é", k=rng.randrange(25))) for _ in range(14)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scored = lm_score.score_texts(df, F.col("doc_id") % 5 != 2, depth=depth, block_bytes=block_bytes, task_entries=task_entries)
    train = [t or "" for i, t in enumerate(texts) if i % 5 != 2]
    for r in scored.collect():
        text = texts[r.doc_id] or ""
        assert math.isclose(r.score, brute_tree(train, text, depth), rel_tol=1e-9)
        assert math.isclose(r.bits_per_byte, -r.score / math.log10(2) / (len(text.encode()) + 1))


def test_model_pieces_hold_whole_subtrees():
    rng = np.random.default_rng(4)
    parts = [lm_score.counted(rng.integers(0, 1 << 40, 200_000).astype(np.uint64) & np.uint64(0x03030F0F0F)) for _ in range(4)]
    batch = next(lm_score._packed([(lm_score.GRAMS, 3, k.tobytes(), c.tobytes()) for k, c in parts], lm_score._MODEL))
    before, lm_score.PIECE = lm_score.PIECE, 100
    try:
        pieces = [row for b in lm_score._merge(4)([batch]) for row in lm_score._rows_of(b, ("keys", "counts"))]
    finally:
        lm_score.PIECE = before
    keys, counts = (np.concatenate([np.frombuffer(p[k], t) for p in pieces]) for k, t in ((0, np.uint64), (1, np.int64)))
    want = lm_score.summed(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
    assert len(pieces) > 3 and (keys == want[0]).all() and (counts == want[1]).all()
    trees = [set((np.frombuffer(p[0], np.uint64) >> np.uint64(24)).tolist()) for p in pieces]
    assert sum(map(len, trees)) == len(set().union(*trees))


def test_kt_series():
    a, b = np.array([0, 1, 63, 64, 65, 500, 10**6]), np.array([0, 0, 5, 70, 64, 1, 3])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(x + y + 1) for x, y in zip(a.tolist(), b.tolist())]
    assert np.allclose(lm_score.log_kt(a, b), want, rtol=1e-10, atol=1e-8)


def test_scores_without_training_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score_texts(df, F.lit(False)).collect()}
    assert got[1].train_tokens == 0 and got[1].n_known == 0 and got[1].base_score == 0.0
    assert math.isclose(got[1].score, 3 * 8 * math.log10(0.5)) and math.isclose(got[2].score, 8 * math.log10(0.5))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "text": F.lit("y"), "digest": F.lit("z")})


def test_warc_round_trip(spark):
    big = "<p>" + "same é " * 40 + "</p>"
    rows = [(5, "http://a/5", big), (3, None, big), (9, "http://a/9", big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (3, None, big)]
    rows += [(None, "u", big), (100 + 0, "u", "x" * 100_000)]
    manifest = warc_zip.write_archives(pages(spark, rows), archive_bytes=500)
    assert manifest.count() > 1
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload) for r in warc_zip.read_archives(manifest).collect()), key=repr)
    n = len(big.encode())
    assert [(a, b, c, d) for a, b, c, d, _ in got] == sorted(
        [(5, "revisit", 3, n), (3, "response", None, n), (3, "response", None, n), (9, "revisit", 3, n), (1, "response", None, 5), (2, "response", None, 5)]
        + [(4, "response", None, 0), (6, "response", None, 0), (0, "revisit", 3, n), (100, "response", None, 100_000)],
        key=repr,
    )
    texts = {a: p for a, b, _, _, p in got if b == "response"}
    assert bytes(texts[3]).decode() == big and bytes(texts[4]) == b""
    uri = manifest.first()["archive"]
    fs, path = warc_zip.open_fs(uri)
    with zipfile.ZipFile(io.BytesIO(fs.open_input_file(path).read())) as z:
        assert z.testzip() is None and z.namelist() == [warc_zip.DATA, warc_zip.INDEX]
    entry, record = next(warc_zip.read_archive(uri, lambda e: True))
    assert record["head"]["WARC-Type"] == entry["type"]


def test_warc_of_empty_table(spark):
    assert warc_zip.read_archives(warc_zip.write_archives(pages(spark, [(1, "u", "x")]).limit(0))).count() == 0


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directories(zip64):
    out = io.BytesIO()
    z = warc_zip.ZipWriter(out, zip64)
    z.add("a/ü.bin", [b"one", b"two"])
    z.add("b", [b"x" * 1000])
    z.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as check:
        assert check.read("a/ü.bin") == b"onetwo"
    reader = warc_zip.ZipReader(Bytes(out.getvalue()))
    assert reader.read("a/ü.bin") == b"onetwo"
    start, n = reader.locate("b")
    assert n == 1000 and reader.range(start + 10, 5) == b"xxxxx"


def test_zip_of_another_writer_with_comment_and_packed_member():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("s"), b"stored")
        z.writestr("d", b"deflated" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 is only a comment here, and long enough to look like an end"
    reader = warc_zip.ZipReader(Bytes(out.getvalue()))
    assert reader.read("s") == b"stored"
    with pytest.raises(ValueError, match="not stored"):
        reader.locate("d")
    with pytest.raises(ValueError, match="end of central directory"):
        warc_zip.ZipReader(Bytes(b"no archive at all, not even close to one"))


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="sidebar-open">
    <header><a>Site</a></header><nav><ul><li>Home</ul></nav><div class="cookie-notice"><p>We use cookies</div>
    <main><article><header><h1>Head &amp; <i>line</i></h1></header><p>One<br>two &lt;b&gt; &eacute; &#x41;&ampx</p><p>Open <b>bold
    <p>Next<script>var t="</p>";</script> part<!-- no --><div class="ad">Buy</div><form>Mail <input></form>
    <ul><li>i1<li>i2</ul><div class='share related'>Share</div>Tail</article><section id="comments"><article class="comment"><p>Nice</p></article></section></main>
    <aside>More</aside><footer>&copy; x</footer></body></html>"""
    assert html_text.extract_run([page])[0][0] == "Head & line\nOne two <b> é A&x\nOpen bold\nNext part\ni1\ni2\nTail"
    assert html_text.extract_run(["<article><p>cut <b>off</p><p>last wor<a href='"])[0][0] == "cut off\nlast wor"
    assert html_text.extract_run([None, "", "no tags at all"]) == [("", 0, 0), ("", 0, 0), ("no tags at all", 4, 0)]
    assert html_text.extract_run(["<p>a < b and c > d &unknown; <3</p>"])[0][0] == "a < b and c > d &unknown; <3"


def test_html_places():
    text = lambda page: html_text.extract_run([page])[0][0]
    assert text("<main><p>list</p><article><p>story</p></article><p>more</p></main>") == "story"
    assert text("<div>site</div><main><p>story</p></main>") == "story"
    assert text("<div>site</div><div class='post-content'><p class=side-by-side>story</div><div class='side'>x</div>") == "story"
    assert text("<article><p class=ad>buy<p>story<section class='reader-comments'><p>first!</section></article>") == "story"
    assert text("<article><p title=it's>one</p><p title='a>b' x=\"c>d\">it's two</p>") == "one\nit's two"
    assert text("<article><table><tr><td>a<td>b</table><pre>x\n  y</pre></article>") == "a\nb\nx y"


def test_repeats_across_pages_go_without_an_article_mark():
    shared = " ".join(f"s{i}" for i in range(12))
    runs = html_text.extract_run([f"<div>{shared}</div><p>u{i} own text v{i}</p><div>{shared} e{i} end</div>" for i in range(3)])
    assert [r[0] for r in runs] == [f"u{i} own text v{i}\ne{i} end" for i in range(3)]
    assert all(r[2] == 24 for r in runs)


def test_copies_and_quotes_stay_without_an_article_mark():
    own = [" ".join(f"p{i}w{j}" for j in range(30)) for i in range(4)]
    copies = html_text.extract_run([f"<div>{own[0]}</div>"] * 2 + [f"<p>{own[0]}</p>"] * 3)
    assert [r[0] for r in copies] == [own[0]] * 5
    quote = " ".join(f"q{j}" for j in range(9))
    texts = [f"{own[0]} {quote}", f"{own[1]} {quote}", own[2], own[3]]
    assert [r[0] for r in html_text.extract_run([f"<p>{t}</p>" for t in texts])] == texts
    marked = [f"<article><p>{quote}</p><p>{own[i]}</p></article>" for i in range(4)]
    assert html_text.extract_run([*marked, f"<p>{quote}</p>"])[4] == (quote, 9, 0)
    noticed = [f"<div>{quote}</div>{m}" for m in marked]
    assert html_text.extract_run([*noticed, f"<p>{quote} mine</p>"])[4] == ("mine", 10, 9)


@pytest.mark.parametrize("run_pages, run_chars, parts, block_windows", [(2, 1 << 20, 7, 1 << 20), (512, 1, 3, 10), (512, 1 << 20, 1, 1 << 20)])
def test_repeats_are_found_over_all_pages_of_a_host(spark, run_pages, run_chars, parts, block_windows):
    header, notice, quote = (" ".join(f"{c}{j}" for j in range(10)) for c in "hnq")
    rows, hosts = [], {}
    for i in range(60):
        host = "a" if i % 3 else f"b{i % 2}"
        own = " ".join(f"u{i % 50}v{j}" for j in range(12))
        said = f"{notice} " if i % 10 == 1 else ""
        told = f" {quote}" if i in (4, 5) else ""
        body = f"<article><p>{own} {header}</p></article>" if i % 7 == 0 else f"<p>{said}{own}{told}</p>"
        rows.append((i, f"http://{host}/{i}", f"<div>{header}</div>{body}"))
        hosts.setdefault(host, []).append(rows[-1])
    df = pages(spark, rows).repartition(parts, "page_id")
    got = {r.page_id: (r.text, r.n_tokens, r.n_repeated) for r in html_text.extract_text(df, run_pages=run_pages, run_chars=run_chars, block_windows=block_windows).collect()}
    for found in hosts.values():
        for row, want in zip(found, html_text.extract_run([r[2] for r in found]), strict=True):
            assert got[row[0]] == want
    assert all((header in text) == (i % 7 == 0) for i, (text, _, _) in got.items())
    assert notice not in got[1][0] + got[41][0] and quote in got[4][0] and quote in got[5][0]


@pytest.mark.parametrize("run_pages, parts", [(1, 1), (2, 5), (512, 1), (512, 200)])
def test_notices_inside_articles_go_and_quotes_stay(spark, run_pages, parts):
    notice, quote, header = (" ".join(f"{c}{j}" for j in range(20)) for c in "nqh")
    rows = []
    for i in range(24):
        blocks = [f"own{i} " + " ".join(f"u{i}v{j}" for j in range(30)), *([quote] if i % 3 == 0 else []), *([notice] if i % 4 else []), f"end {i}"]
        rows.append((i, "http://h/", f"<div>{header}</div><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"))
    rows += [(100 + i, "http://h/", f"<div>{header}</div><article><h1>short {i}</h1><p>{notice}</p></article><i>{i}</i>") for i in range(2)]
    got = {r.page_id: r for r in html_text.extract_text(pages(spark, rows).repartition(parts, "page_id"), run_pages=run_pages).collect()}
    for i in range(24):
        assert (quote in got[i].text) == (i % 3 == 0) and notice not in got[i].text and header not in got[i].text and got[i].text.endswith(f"end {i}")
        assert (got[i].n_by_repeats, got[i].n_by_marks) == (20 + 20 * (i % 4 > 0), 0)
    assert [got[k].text for k in (100, 101)] == [f"short 0\n{notice}", f"short 1\n{notice}"]  # too little else would be left


@pytest.mark.parametrize("run_pages", [1, 7, 512])
def test_every_window_of_an_article_counts(spark, run_pages):
    opening, notice, closing = (" ".join(f"{c}{j}" for j in range(9)) + "." for c in "onc")
    short = ["Sign up here", "for our daily letter", "it costs you nothing"]  # a passage of 11 tokens in blocks below 8
    rows, want = [], {}
    for i in range(30):
        own = [" ".join(f"b{k}u{i}v{j}" for j in range(40)) + "." for k in range(4)]
        said = [f"{opening} {own[0]} {closing}", f"{own[1]} {notice} {own[2]}", *short, own[3]]
        rows.append((i, "http://h/", "<article>" + "".join(f"<p>{b}</p>" for b in said) + "</article>"))
        want[i] = f"{own[0]}\n{own[1]} {own[2]}\n{own[3]}"
    got = {r.page_id: r for r in html_text.extract_text(pages(spark, rows).repartition(3), run_pages=run_pages).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all((r.n_repeated, r.n_by_repeats, r.n_by_marks) == (38, 38, 0) for r in got.values())


@pytest.mark.parametrize("run_pages, block_windows", [(3, 10), (6, 1 << 20), (10, 1), (512, 1 << 20)])
def test_windows_of_articles_are_counted_exactly_over_runs(spark, run_pages, block_windows):
    half, less = (" ".join(f"{c}{j}" for j in range(10)) for c in "hl")
    rows, n = [], 40
    for i in range(n):
        blocks = [" ".join(f"u{i}v{j}" for j in range(60)), *([half] if i % 2 else []), *([less] if i < n // 2 - 1 else [])]
        copies = 1 + 3 * (i % 5 == 0)  # copies say nothing
        rows += [(i, f"http://{h}/", "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>") for h in "ab" for _ in range(copies)]
    got = html_text.extract_text(pages(spark, rows).repartition(4), run_pages=run_pages, block_windows=block_windows).collect()
    assert len(got) == len(rows)
    assert all(half not in r.text and (less in r.text) == (r.page_id < n // 2 - 1) for r in got)


def test_cutting_out_rare_tokens_loses_no_frequent_window():
    rng = np.random.default_rng(3)
    for least in (1, 2, 5, 8):
        streams = [html_text._odd(rng.choice(12, rng.integers(0, 60), p=np.arange(12, 0, -1) / 78).astype(np.uint32)) for _ in range(10)]
        want = {}
        for s in streams:
            for gram in {tuple(s[j : j + 3].tolist()) for j in range(len(s) - 2)}:
                want[gram] = want.get(gram, 0) + 1
        hashes, counts = html_text.window_counts(html_text.frequent_parts(streams, least), 3, 5)
        got = dict(zip(hashes.tolist(), counts.tolist(), strict=True))
        key = lambda gram: int(html_text.window_hashes(np.array(gram, np.uint64), 3, 5)[0][0])
        assert {key(g): c for g, c in want.items() if c >= least} == {h: c for h, c in got.items() if c >= least}


def test_repeated_tokens_equal_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(30):
        streams = [rng.integers(0, 3, rng.integers(0, 30)) for _ in range(4)]
        want = []
        for k, s in enumerate(streams):
            cover = np.zeros(len(s), bool)
            for i in range(len(s) - 4):
                gram = tuple(s[i : i + 5])
                if any(gram == tuple(o[j : j + 5]) for m, o in enumerate(streams) if m != k for j in range(len(o) - 4)):
                    cover[i : i + 5] = True
            want.append(cover.tolist())
        assert [r.tolist() for r in html_text.repeated_tokens(streams, 5)] == want


def test_html_table_edges(spark):
    rows = [(1, None, "<article><p>a</p></article>"), (1, None, "<article><p>a</p></article>"), (None, "http://h/x", None), (2, "http://h/y", "<p>b " + "c " * 50_000)]
    got = html_text.extract_text(pages(spark, rows)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 100_001)]
    assert html_text.extract_text(pages(spark, rows).limit(0)).count() == 0


def test_scratch_tables_can_be_cleaned(spark):
    _common.materialize(spark.range(3), "test")
    path = _common._written[-1]
    assert _common.clean_scratch(spark) > 0 and not _common._written
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_slices_cover_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n else None for n in (5, 0, 100, 3, 3, 0)])], names=["t"])
    for limit in (1, 4, 6, 1000):
        parts = list(_common.slices(batch, 0, limit))
        assert sum(p.num_rows for p in parts) == 6 and all(p.num_rows for p in parts)
