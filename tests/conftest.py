import pytest

from corvane.session import builder


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = builder(4, "tests").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
