"""What the registered queries share: tables as roles (event stream, samples, signals), and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The event stream in SQL: onset in seconds since the start of 2024.
EV = "ev AS (SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS onset FROM events)"
#: Samples of trials in SQL: trial, order, x, y and time.
SM = EV + ", sm AS (SELECT user_id AS trial, event_id AS o, value AS x, CAST(k AS DOUBLE) AS y, onset AS time FROM ev)"
#: Signals in SQL: one vector is one signal of 64 samples.
SG = "sg AS (SELECT vec_id, label, pos - 1 AS pos, CAST(embedding[pos] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings))"


def query(name: str, sql: str | None = None):
    """Register a function of a ``Tables`` as a query, with its SQL."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return register


class Tables:
    """Tables of a folder, and views of them in the roles of the operators."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def ev(self) -> DataFrame:
        onset = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(1e6)
        return self.events.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"), onset.alias("onset"))

    def sm(self) -> DataFrame:
        return self.ev().select(F.col("user_id").alias("trial"), F.col("event_id").alias("o"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"), F.col("onset").alias("time"))

    def sg(self) -> DataFrame:
        return self.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
