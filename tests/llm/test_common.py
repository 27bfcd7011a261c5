import os
import time

import pyarrow as pa
from pyspark.sql import functions as F

from sarfgrid.llm import common


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    common.small_batches(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    long = spark.range(0, 24, 1, 1).select("id", F.repeat(F.lit("x"), 4_000_000).alias("t"))
    short = spark.range(0, 1200, 1, 1).select("id", F.lit("x").alias("t"))
    rows = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
    assert sum(rows) == 24 and max(rows) * 4_000_000 <= common.ARROW_BYTES + 4_000_000
    rows = [r.n for r in short.mapInArrow(sizes, "n long").collect()]
    assert sum(rows) == 1200 and max(rows) == common.ARROW_ROWS


def shuffle_files(spark):
    """Names of the shuffle files that this process holds on its disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_")}


def test_a_write_leaves_no_shuffle_files(spark):
    mine, own = set(common.scratch()), spark.conf.get(common.FREES, None)
    for write in (lambda df: common.written(df, "some-rows"), lambda df: common.written_in_buckets(df, "some-table", "id", 4)):
        before = shuffle_files(spark)
        rows = write(spark.range(1000).repartition(5, "id"))
        deadline = time.time() + 10  # files go in the background
        while shuffle_files(spark) - before and time.time() < deadline:
            time.sleep(0.1)
        assert not shuffle_files(spark) - before and rows.count() == 1000
    assert spark.conf.get(common.FREES, None) == own
    common.release(spark, [x for x in common.scratch() if x not in mine])


def test_scratch_is_released_by_label(spark):
    before = set(common.scratch())
    a = common.written(spark.range(3), "kept-rows")
    common.written(spark.range(3), "spent-rows")
    b = common.written_in_buckets(spark.range(3), "spent-table", "id", 4)
    assert b.count() == 3
    mine = [x for x in common.scratch() if x not in before]
    assert len(mine) == 3
    common.release(spark, mine, ("spent",))
    left = [x for x in common.scratch() if x not in before]
    assert len(left) == 1 and a.count() == 3
    assert all(os.path.exists(x.removeprefix("file://")) == (x in left) for x in mine)
    common.release(spark, left)
    assert not set(common.scratch()) - before


def test_spread_strings_ranges_together():
    import numpy as np

    at, n = common.spread(np.array([3, 0, 5]), np.array([5, 0, 8]))
    assert at.tolist() == [3, 4, 5, 6, 7] and n.tolist() == [2, 0, 3]
