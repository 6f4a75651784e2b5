import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


STEM = ("CAUGACUUAGUCAACG", "..((.(...).))...")
ROWS = "transcript_id string, sequence string, secondary_structure string, start string, `end` string"


@pytest.fixture(scope="session")
def records(spark):
    """Rows -> validated records, failing on the first bad one."""
    from foldgraph.operators.records import records_from_df

    def build(rows, **options):
        padded = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
        checked = records_from_df(spark.createDataFrame(padded, ROWS).coalesce(1), **options).checked()
        # Plain rows again, so that no test repeats the validation with every action.
        return spark.createDataFrame(checked.collect(), checked.schema).coalesce(1)

    return build
