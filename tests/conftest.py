import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from calyx.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", app="calyx-tests", shuffle_partitions=4,
                  extra={"spark.driver.memory": "4g"})
    checkpoint_dir(s)
    yield s
    s.stop()


def pages_df(spark, pages):
    """[(url, html), ...] -> pages table with ids in list order."""
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
