import pytest

from chunkyard.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[2]", 2)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.ansi.enabled", "true")
    yield s
    s.stop()
