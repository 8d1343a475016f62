"""Queries of scans, sinks and guards (SC, U17, M18, Q1): a given table is written to the shared folder, scanned back and compared."""

from __future__ import annotations

import io as bytes_io
import tempfile
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import checks, models, shape
from ..sources import io
from .base import SG, query, rounded

col = F.col
ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders"
SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"


def orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


def spread_files(df, key: str, name, folder: str):
    """One file per group, written by the tasks: ``name`` gives its name and bytes from the key and the rows."""

    def run(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        file, content = name(k[0], part)
        io.put_bytes(f"{folder}/{file}", content)
        return pd.DataFrame({"file": [file]})

    df.groupBy(key).applyInPandas(run, "file string").write.format("noop").mode("overwrite").save()
    return folder


@query("sc1_read_task_tables", ORDERS)
def _(t):
    folder = io.scratch_path(t.spark, "tasks")
    orders(t).write.csv(folder, sep="\t", header=True)
    return io.read_task_tables(t.spark, f"{folder}/*.csv", SCHEMA, drop=["file_id"])


@query("sc2_read_zip_members", "SELECT doc_id || '.txt' AS member, text, 'ok' AS status FROM documents WHERE text IS NOT NULL")
def _(t):
    def archive(k, part):
        out = bytes_io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i, text in zip(part["doc_id"], part["text"], strict=True):
                z.writestr(f"{i}.txt", text)
        return f"{k}.zip", out.getvalue()

    docs = t.documents.filter("text is not null").select("doc_id", "text", F.floor(col("doc_id") / 50).alias("g"))
    folder = spread_files(docs, "g", archive, io.scratch_path(t.spark, "archives"))
    return io.read_zip_members(t.spark, f"{folder}/*.zip", [".txt"]).select("member", "text", "status")


@query("sc3_read_recordings", f"WITH {SG} SELECT vec_id::VARCHAR AS channel, (pos // 16)::BIGINT AS chunk, list(round(round_even(v * 32767, 0) / 32767, 5) + 0.0 ORDER BY pos) AS samples FROM sg GROUP BY 1, 2")
def _(t):
    def recording(k, part):
        with tempfile.NamedTemporaryFile(suffix=".edf") as f:  # the task's own file, read at once
            io.write_recording(f.name, {str(i): (64, v) for i, v in zip(part["vec_id"], part["v"], strict=True)})
            return f"{k}.edf", open(f.name, "rb").read()

    vectors = t.embeddings.select("vec_id", F.floor(col("vec_id") / 50).alias("g"), col("embedding").cast("array<double>").alias("v"))
    folder = spread_files(vectors, "g", recording, io.scratch_path(t.spark, "recordings"))
    return io.read_recordings(t.spark, f"{folder}/*.edf", 0.25).select("channel", "chunk", F.transform("samples", lambda x: F.round(x, 5) + F.lit(0.0)).alias("samples"))


@query("sc5_read_csv_checked", ORDERS)
def _(t):
    folder = io.scratch_path(t.spark, "csv")
    orders(t).write.csv(folder, header=True)
    return io.read_csv_checked(t.spark, folder, ["o_orderkey", "o_totalprice"], SCHEMA)


@query("sc6_file_inventory", "SELECT item_id || '.txt' AS relative_path, octet_length(encode(text))::BIGINT AS length, sha256(text) AS sha256, true AS unchanged FROM benchmark")
def _(t):
    folder = spread_files(t.benchmark.select("item_id", "text"), "item_id", lambda k, part: (f"{k}.txt", part["text"].iloc[0].encode()), io.scratch_path(t.spark, "files"))
    return io.file_inventory(t.spark, folder, "/".join(folder.split("/")[-2:]) + "/").select("relative_path", "length", "sha256", "unchanged")


@query("sc7_write_table", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(t):
    folder = io.scratch_path(t.spark, "table")
    io.write_table(t.orders, folder, ["o_orderkey", "o_totalprice", "o_orderstatus"], ["o_orderstatus"])
    return t.spark.read.parquet(folder)


@query("sc8_combine_shards", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    shards = []
    for k in range(3):
        shards.append(f"{io.scratch_path(t.spark, 'shard')}/{k}")
        io.write_table(t.orders.filter(col("o_orderkey") % 3 == k), shards[-1], ["o_orderkey", "o_custkey", "o_totalprice"])
    return io.combine_shards(t.spark, shards)


@query("sc9_write_csv", "SELECT c_custkey, c_mktsegment FROM customer")
def _(t):
    folder = io.scratch_path(t.spark, "csv")
    io.write_csv(t.customer.select("c_custkey", "c_mktsegment"), folder)
    return t.spark.read.csv(folder, header=True, schema="c_custkey bigint, c_mktsegment string")


@query("sc10_dim", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def _(t):
    folder = io.scratch_path(t.spark, "dim")
    io.write_csv(t.nation.select("n_nationkey", "n_name"), folder)
    nations = io.dim(t.spark, folder, "n_nationkey bigint, n_name string")
    return t.customer.join(nations, col("c_nationkey") == col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("u17_registry", "SELECT status, weight, count(*) AS n, round(sum(o_totalprice) * weight, 2) AS weighted FROM orders JOIN (VALUES ('F', 1.0::DOUBLE), ('O', 0.5::DOUBLE)) r(status, weight) ON status = o_orderstatus GROUP BY 1, 2")
def _(t):
    weights = shape.registry(t.spark, [("F", 1.0), ("O", 0.5)], "status string, weight double")
    out = t.orders.join(weights, col("status") == col("o_orderstatus")).groupBy("status", "weight").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    return rounded(out.select("status", "weight", "n", (col("s") * col("weight")).alias("weighted")), 2)


@query("m18_assert_no_outcomes", "SELECT o_orderkey, o_custkey FROM orders")
def _(t):
    return models.assert_no_outcomes(t.orders.select("o_orderkey", "o_custkey"), ["price", "outcome"])


@query("q1_require_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    return checks.require_columns(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey", "o_orderstatus"])
