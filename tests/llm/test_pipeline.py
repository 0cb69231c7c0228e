"""The stages, each on what its predecessor kept."""

import collections

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_contracts import SCHEMA, first_copies, odd_rows, plain_groups, tokens
from tidewave.llm.shared import written


def test_stages_and_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        kept[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in docs.collect()})

    old, new = kept["language_id"]
    assert set(new) <= set(old) and len(new) > 0.95 * len(old)
    old, new = kept["near_dedup"]
    groups = plain_groups(list(old.items()), 5)
    assert set(new) == set(groups.values())
    old, new = kept["substring_dedup"]
    assert set(new) == set(old)
    ids = sorted(old)
    assert [new[i] for i in ids] == first_copies([old[i] for i in ids], 200)
    old, new = kept["decontaminate"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(old) - set(new) >= {i for i, t in old.items() if any(x in t for x in items)}

    packed = collections.Counter()
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        packed[r.doc_id] += r.n_tokens
    assert dict(packed) == {i: len(tokens(t)) for i, t in new.items() if tokens(t)}


def test_stages_on_odd_rows(spark, tmp_path):
    """Null keys, repeated rows, empty texts, clashing columns, and no rows at all."""
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(*r, "en", "s", len(r[1] or "")) for r in odd_rows()]
    odd = spark.createDataFrame(rows, SCHEMA + ", lang string, source string, n_chars long")
    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before = df.count()
            df = written(stage(spark, df, str(tmp_path)), "odd-stage")
            assert name == "pack" or df.columns == odd.columns and df.count() <= before
    kept = corpus_pipeline.near_dedup(spark, odd, "").collect()
    base = odd_rows()[6][1]
    assert sum(r.text == base for r in kept) == 1 and {r.doc_id for r in kept} >= {0, 1, 2, 14, None}
    left = corpus_pipeline.substring_dedup(spark, spark.createDataFrame(kept, odd.schema), "").collect()
    assert (6, base) in {(r.doc_id, r.text) for r in left}


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, SF).count() > 0
    assert {f"op{i}" for i in range(1, 11)} <= {q.split("_")[0] for q in __spark_entry__.queries()}
