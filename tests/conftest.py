import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodeworks.session import session

    here = tmp_path_factory.mktemp("spark")
    s = session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.driver.host": "127.0.0.1", "spark.sql.warehouse.dir": str(here / "warehouse"), "spark.driver.extraJavaOptions": f"-Dderby.system.home={here}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *order):
    """Sorted plain tuples of a frame."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
