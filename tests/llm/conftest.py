import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


ODD_TEXTS = [None, "", " ", "a", "\n\n", "a b", "É ß \x00 \x85 　x", "<|endoftext|>", "word " * 3000, "x" * 5000, "same text", "same text"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "clash", i * 1.5) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, length double")
