import os
import threading

from rollbook import session


def test_intermediates_of_a_finished_job_are_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda _, purpose: str(tmp_path / f"{purpose}-1"))
    kept = session.materialise(spark.range(5), "kept")

    def other():
        session.materialise(spark.range(3), "other")

    with session.scratch(spark):
        inner = session.materialise(spark.range(7), "inner")
        assert inner.count() == 7
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
    assert sorted(n.split("-")[0] for n in os.listdir(tmp_path)) == ["kept", "other"] and kept.count() == 5
