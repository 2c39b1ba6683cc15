import os

import pytest

from lurescope.session import broadcast_if_small, local_copy, materialise, shared_dir, stage_scope


def test_stages_live_in_the_shared_folder_until_their_scope_ends(spark):
    root = shared_dir(spark).removeprefix("file:")
    kept = materialise(spark.range(3), "kept")
    with stage_scope(spark):
        stage = materialise(spark.range(5).withColumnRenamed("id", "n"), "scoped")
        assert stage.columns == ["n"] and stage.count() == 5
        made = [p for p in os.listdir(root) if p.startswith("scoped-")]
        assert made
    assert not [p for p in os.listdir(root) if p in made]
    assert kept.count() == 3


def test_a_scope_that_fails_cleans_up_too(spark):
    root = shared_dir(spark).removeprefix("file:")
    with pytest.raises(ValueError):
        with stage_scope(spark):
            materialise(spark.range(2), "broken")
            raise ValueError
    assert not [p for p in os.listdir(root) if p.startswith("broken-")]


def test_local_copies_are_bounded(spark):
    assert local_copy(spark.range(5), 4) is None
    assert local_copy(spark.range(4), 4).count() == 4
    assert "broadcast" in broadcast_if_small(spark.range(4), 4)._jdf.queryExecution().analyzed().toString().lower()
    assert broadcast_if_small(spark.range(9), 4).count() == 9
