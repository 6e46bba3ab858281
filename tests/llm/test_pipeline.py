"""Each stage of the pipeline against a brute-force version on a small table."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_ops_tables import brute_components

import corpus_pipeline
from sluice.llm._common import materialize


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.toPandas())
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out.append(docs.toPandas())
    return out


def test_stages_keep_the_columns(stages):
    for frame in stages[1:-1]:
        assert list(frame.columns) == list(stages[0].columns)


def test_language_stage_keeps_all_with_letters(stages):
    letters = stages[0][stages[0].text.map(lambda t: any(c.isalpha() for c in t or ""))]
    assert set(stages[1].doc_id) == set(letters.doc_id)


def test_one_of_each_group_stays(stages):
    component, _ = brute_components(dict(zip(stages[1].doc_id, stages[1].text)), 5, 80)
    assert sorted(stages[2].doc_id) == sorted(set(component.values()))


def test_leaks_go_and_clean_documents_stay(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = set(stages[3].doc_id)
    for r in stages[2].itertuples():
        if any(x in r.text for x in items):
            assert r.doc_id not in kept
    assert len(kept) >= 0.9 * len(stages[2])


def test_mix_takes_whole_copies(stages):
    copies = Counter(stages[4].doc_id)
    assert set(copies) <= set(stages[3].doc_id) and max(copies.values()) <= 3
    words = lambda f: f.text.map(lambda t: len((t or "").split())).sum()
    assert abs(words(stages[4]) - words(stages[3])) <= 0.25 * words(stages[3])


def test_shards_hold_every_row(stages):
    assert sorted(stages[5].doc_id) == sorted(stages[4].doc_id)
    assert set(stages[5].shard) == set(range(8))


def test_run_is_registered(spark):
    assert corpus_pipeline.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0


ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, "42 !", "en", "a"), (None, "one two three four five six", "en", "b"), (None, "seven words of a text without any id", "en", "b")]
ROWS += [(4, "One two three four five six", "en", None), (4, "another text under the same id as the last", "fr", None), (5, "a leaked passage of nine words in a text", "en", "c")]
ROWS += [(6, " ".join(f"w{i % 700}x" for i in range(30_000)), "de", "c"), (7, "7 eight", None, "c")]


@pytest.mark.parametrize("items", [[], [(1, "leaked passage of nine words in a text"), (2, None), (3, "")]])
def test_stages_on_nulls_repeats_clashes_and_empty_tables(spark, tmp_path, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars int")
    clash = "size shard slot score lead print id h skey near_id near_set keep_doc_id base edge copy label stays".split()
    for k, frame in enumerate((docs.withColumns({c: F.lit("clash") for c in clash}), docs.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            columns = frame.columns
            frame = materialize(stage(spark, frame, str(tmp_path)), name)
            assert name == "sharding" or frame.columns == columns
            if name == "language_id":
                assert sorted((r.doc_id or 0) for r in frame.collect()) == ([] if k else [0, 0, 4, 4, 5, 6])  # 7 is in no known language
            if name == "ngram_jaccard_join" and not k:
                found = sorted((r.doc_id or 0, (r.text or "")[:7]) for r in frame.collect())
                assert found == [(0, "seven w"), (4, "One two"), (4, "another"), (5, "a leake"), (6, "w0x w1x")]
            if name == "decontamination" and not k:
                assert frame.where("doc_id = 5").count() == (0 if items else 1)
        assert k == 0 or frame.count() == 0
