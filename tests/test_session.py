"""Files of passes that are over."""

import glob

from pyspark.sql import functions as F

from strataflow.session import FREE_SHUFFLES, materialise, shuffles_freed


def test_a_stored_table_leaves_no_shuffle_files(spark):
    files = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir', '/tmp')}/blockmgr-*/*/shuffle_*"))
    source = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count()
    before, own = files(), spark.conf.get(FREE_SHUFFLES, None)
    got = materialise(source)
    assert files() <= before and spark.conf.get(FREE_SHUFFLES, None) == own
    assert got.count() == 5000 and got.agg(F.sum("count")).first()[0] == 20_000


def test_the_setting_follows_the_last_of_those_who_asked(spark):
    own = spark.conf.get(FREE_SHUFFLES, None)
    with shuffles_freed(spark):
        with shuffles_freed(spark):
            assert spark.conf.get(FREE_SHUFFLES) == "true"
        assert spark.conf.get(FREE_SHUFFLES) == "true"
    assert spark.conf.get(FREE_SHUFFLES, None) == own
