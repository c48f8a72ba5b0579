from pyspark.sql import SparkSession

from recall.session import build_session


def local_session() -> SparkSession:
    spark = build_session(
        "recall-tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
        spark__sql__shuffle__partitions="8",
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
