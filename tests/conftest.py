import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rallygrid.streaming.live import STATE_STORE  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config(*STATE_STORE).config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
