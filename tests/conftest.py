import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    with tempfile.TemporaryDirectory(prefix="corpusloom-tests-") as folder:
        session = (
            SparkSession.builder.master("local[*]")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "6g")
            .config("spark.ui.enabled", "false")
            .config("spark.checkpoint.dir", folder)
            .getOrCreate()
        )
        session.sparkContext.setLogLevel("ERROR")
        session.sparkContext.setCheckpointDir(folder)
        yield session
        session.stop()


SF = "/root/testdata/sf0.001"
