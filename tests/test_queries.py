"""Every registered query on the smallest data, beside its SQL where it has one."""

import pytest

from checks.catalog import ORACLES, QUERIES
from checks.compare import compare, connect

DECLARED_ROWS_ONLY = {
    "t9_seeded_sample", "m2_boosted_trees", "m3_export_nodes", "m9_permutation_importance",
    "m15_augmented_training", "m16_retrain_job",
}


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


def test_only_sampling_and_training_lack_sql():
    assert set(QUERIES) - set(ORACLES) == DECLARED_ROWS_ONLY


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, duck, name):
    frame = QUERIES[name](spark, data)
    if name in ORACLES:
        assert compare(duck, frame, ORACLES[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r["split"] for r in rows} == {"train", "val", "test"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_request_log_takes_an_arrival_of_several_files_as_one_micro_batch(spark, data, duck, monkeypatch):
    from checks import q_stream

    assert [q_stream.arrival_parts(n) for n in (0, 100, 6_000_000)] == [1, 1, 12]
    monkeypatch.setattr(q_stream, "arrival_parts", lambda n: 2)
    assert compare(duck, q_stream.logged_requests(spark, data), ORACLES["st4_request_log"]) is None
