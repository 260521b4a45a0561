import os

from candela.session import checkpointed, discard


def test_stored_tables_are_deleted_when_discarded(spark):
    kept, gone = checkpointed(spark.range(5)), checkpointed(spark.range(7).withColumnRenamed("id", "n"))
    assert gone.count() == 7
    discard(gone)
    assert not os.path.exists(gone.stored_at.removeprefix("file:")) and kept.count() == 5
    discard(kept)
