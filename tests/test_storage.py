"""Shared storage: the folder it needs, and dropping what was stored."""

from pathlib import Path

import pytest

from geoscore.sources import storage


class Unset:
    """A session without the setting."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        getCheckpointDir = staticmethod(lambda: None)


def test_a_folder_is_required():
    with pytest.raises(ValueError, match=storage.CHECKPOINT_KEY):
        storage.shared_folder(Unset)


def test_recorded_tables_are_dropped(spark):
    with storage.recorded() as paths:
        kept = storage.store(spark.range(5).toDF("n"), "five")
    assert kept.count() == 5 and len(paths) == 1 and Path(paths[0]).exists()
    storage.drop(spark, paths)
    assert not Path(paths[0]).exists()
    storage.store(spark.range(1).toDF("n"), "later")
    assert len(paths) == 1
