import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    tmp = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.local.dir", str(tmp / "local")).config("spark.sql.warehouse.dir", str(tmp / "warehouse")).config("spark.checkpoint.dir", f"file://{tmp}/shared").getOrCreate()
    )
    yield session
    session.stop()
