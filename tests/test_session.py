"""Session rules: the cluster's checkpoint folder is reused, scratch tables
live under it with its URI scheme, and reliable checkpoints cut lineage."""

from emberline import session


def test_checkpoint_dir_is_reused_and_scratch_keeps_scheme(spark):
    d1 = session.ensure_checkpoint_dir(spark)
    d2 = session.ensure_checkpoint_dir(spark)
    assert d1 == d2 == spark.sparkContext.getCheckpointDir()
    p = session.scratch_path(spark, "x")
    assert p.startswith(d1.rstrip("/") + "/scratch/x-")
    assert p != session.scratch_path(spark, "x")


def test_reliable_checkpoint_and_bounds(spark):
    df = spark.range(100)
    ck = session.checkpoint(df.filter("id % 2 = 0"))
    assert ck.count() == 50
    assert session.has_at_most(df, 100) and not session.has_at_most(df, 99)
