import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("cohortgrid-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden():
    """Folder with input/ and output/ of the golden runs; tests that need it skip without."""
    if "GOLDEN_DIR" not in os.environ:
        pytest.skip("GOLDEN_DIR is not set")
    folder = Path(os.environ["GOLDEN_DIR"])

    def find(part):
        found = sorted(folder.glob(part))
        if not found:
            pytest.skip(f"no golden file {part}")
        return str(found[0])

    return find
