import pytest

from pedigraph.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores="8")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
