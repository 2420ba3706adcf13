"""Each query beside its SQL on the smallest tables."""

import pytest

import verify
from tessera.plans import ORACLES, QUERIES

STREAMS = {n for n in QUERIES if n.startswith("stream_")}


@pytest.fixture(scope="module")
def con(sf):
    return verify.views(sf)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - STREAMS))
def test_query_matches_sql(spark, con, sf, name):
    assert verify.differs(spark, con, name, sf) == ""


@pytest.mark.parametrize("name", sorted(STREAMS))
def test_stream_matches_batch_twin(spark, con, sf, name):
    assert verify.differs(spark, con, name, sf) == ""


@pytest.mark.parametrize("name", ["stream_dedup", "stream_session", "stream_stale", "stream_publish", "stream_leases", "stream_contexts", "stream_delivery", "stream_roadmap", "stream_roadmap_items"])
def test_stream_does_not_depend_on_files(spark, sf, tmp_path, name):
    """Twelve files in no order of time, so several micro-batches, and each event delivered once."""
    spark.read.parquet(f"{sf}/events.parquet").repartition(12, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    assert verify.differs(spark, verify.views(str(tmp_path)), name, str(tmp_path)) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["conv_id", "turn", "question", "reply_turn", "answer"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sql_and_queries_are_plain_names():
    assert all(n.isidentifier() for n in QUERIES)


def test_entry_works_without_the_llm_package():
    """With the package's import blocked, the rest still imports and lists its queries."""
    import subprocess
    import sys

    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=verify.__file__.rsplit("/", 1)[0], check=True).stdout.split()
    assert int(out[0]) == len(QUERIES) and out[1] == "False"
