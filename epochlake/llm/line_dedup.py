"""Line dedup (operator 9, native): winnowing over line hashes, matches extended both ways, later copies deleted.

A line ends at a line break or after a sentence end (``. ``, ``! ``, ``? ``), so passages set into a paragraph count as
lines too. A run is what starts at a line and goes on until it has ``run_words`` words (spaces + 1 a line). Runs
depend on their own content alone, so equal passages have equal runs.

* winnowing: the least line hash of each run is its fingerprint. Neighbouring runs share a minimum, so only the places
  where it changes are counted; a run can only repeat if its fingerprint stands at two places;
* positions are joined by fingerprint, which leaves a fraction of the runs;
* from there matches are extended both ways: the runs that go on from each line, and those that go back from each line,
  through a repeated fingerprint are compared by fingerprint, first line, number of words and a sum of hashes of all
  neighbouring lines. Of equal runs the first in the order of (document id, place) stays, the lines of all later ones are
  deleted. Each line of a repeated stretch of at least ``run_words`` words lies in one or the other: a line with enough words
  from it to the stretch's end starts a run, any other lies in the run that goes back from the end. So a match is deleted
  as far as it extends to either side, short last lines included, and no pair of documents is formed: a match may hold
  runs whose first copies stand in different documents.

A line is deleted if and only if it lies in a stretch of at least ``run_words`` words that stood earlier; shorter repeats
stay. (``both_ways=False`` takes the runs that go on alone.) Defined results: null
text stays null, empty text stays empty, blank lines count for nothing and stay unless they lie inside a deleted
run; a document may end up empty but its row stays. A null id sorts first. Rows with equal ids count as one place: equal
runs at the same place in them all stay. U+0001 in a text is a line end and is lost where lines are deleted. Extra
columns are carried along; names that the result or its joins add are refused. A text is
taken whole where it is split: n bytes take some 10 n in its task; its lines are then rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, fresh_path, refuse_columns

RUN_WORDS = 40
MARK = "\x01"
#: After these a line ends.
ENDS = ["\n", ". ", "! ", "? "]
#: Bits of a fingerprint that hold the place; the others hold the line's hash.
PLACE_BITS = 20
#: Repeated fingerprints, and deleted stretches, up to this size are broadcast; above it both sides are shuffled.
BROADCAST_BYTES = 48_000_000
#: What a key takes in a broadcast table, and a stretch.
KEY_BYTES, STRETCH_BYTES = 25, 24


def lines_of(text: Column) -> Column:
    for e in ENDS:
        text = F.replace(text, F.lit(e), F.lit(e + MARK))
    return F.split(text, MARK)


def bare_lines_of(text: Column) -> Column:
    """The same lines without what separates them."""
    for e in ENDS:
        text = F.replace(text, F.lit(e), F.lit(e.strip() + MARK))
    return F.split(text, MARK)


def key_of(id_col: str, text: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("bigint"), F.col(text))


def if_small(df: DataFrame, more: Column | None = None) -> DataFrame:
    """The table, marked for broadcast if its keys and the bytes that ``more`` says fit the limit."""
    size = df.agg(F.coalesce(F.sum(F.lit(KEY_BYTES) + (F.lit(0) if more is None else more)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def place_of(runs: DataFrame) -> Column:
    """One number in the order of (id, place), null ids first: 64 bits wide if both fit, else a decimal."""
    most = runs.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("place").alias("place")).first()
    if (most["low"] or 0) > -1 << 42 and (most["high"] or 0) < 1 << 42 and (most["place"] or 0) < 1 << 20:
        return F.coalesce("id", F.lit(-(1 << 42))) * F.lit(1 << 20) + F.col("place")
    return (F.coalesce("id", F.lit(-1 << 62)).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(12,0)") + F.col("place")).cast("decimal(38,0)")


def deletions(df: DataFrame, id_col: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, both_ways: bool = True) -> DataFrame:
    """Rows (__key, stretches): the lines to delete as (first, last), one row per document that has any."""
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    keyed = texts.select("id", key_of("id", "text").alias("__key"), F.monotonically_increasing_id().alias("row"), "text")
    lines = keyed.select("id", "__key", "row", F.posexplode(bare_lines_of(F.col("text"))).alias("place", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    words = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lines = lines.select("id", "__key", "row", "place", F.xxhash64("line").alias("h"), words.cast("bigint").alias("n"))
    # All of a document's lines stand in one row of text, so each window below is one document.
    so_far = Window.partitionBy("row").orderBy("place")
    upto = so_far.rowsBetween(Window.unboundedPreceding, 0)
    step = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.lag("h").over(so_far), F.lit(0)), "h"), 24)
    placed = lines.withColumn("step", step).withColumns({"after": F.sum("n").over(upto), "steps": F.sum("step").over(upto)}).withColumn("before", F.col("after") - F.col("n"))
    low = (1 << PLACE_BITS) - 1
    mark = F.col("h").bitwiseAND(F.lit(~low)).bitwiseOR(F.col("place").cast("bigint").bitwiseAND(F.lit(low)))
    run = Window.partitionBy("row").orderBy("before").rangeBetween(0, run_words - 1)
    marked = placed.withColumn("mark", mark)
    # The places' order is that of the words before them, so this window needs no sort of its own.
    changes = lambda least: ~least.eqNullSafe(F.lag(least).over(Window.partitionBy("row").orderBy("before")))
    marked = marked.withColumn("least", F.min("mark").over(run))
    from_here = F.struct(
        "place", "h", "before", F.max("place").over(run).alias("last"), F.max("after").over(run).alias("end"), (F.max("steps").over(run) - F.col("steps")).alias("steps"), "least", changes(F.col("least")).alias("fresh")
    )
    runs = marked.withColumn("from_here", from_here)
    if both_ways:
        back = Window.partitionBy("row").orderBy("after").rangeBetween(1 - run_words, 0)
        to_here = F.struct(
            F.first("place").over(back).alias("place"), F.first("h").over(back).alias("h"), F.first("before").over(back).alias("before"), F.col("place").alias("last"), F.col("after").alias("end"),
            (F.col("steps") - F.first("steps").over(back)).alias("steps"), F.min("mark").over(back).alias("least"), F.lit(True).alias("fresh"),
        )
        # Where the words before this line don't suffice, the run back equals the run from its own first line.
        runs = runs.withColumn("to_here", to_here).withColumn("run", F.explode(F.array("from_here", F.when(F.col("before") - F.col("to_here.before") >= run_words, F.col("to_here")))))
    else:
        runs = runs.withColumn("run", F.col("from_here"))
    runs = runs.select("id", "__key", "run.*").filter(F.col("end") - F.col("before") >= run_words)
    path = fresh_path(spark, "line-runs")
    runs.select("id", "__key", "place", "last", F.col("least").bitwiseAND(F.lit(~low)).alias("print"), F.when(F.col("fresh"), F.xxhash64("__key", "least")).alias("at"), F.xxhash64("h", F.col("end") - F.col("before"), "steps").alias("run")).write.parquet(path)
    runs = spark.read.parquet(path)
    repeated = cut(runs.filter("at is not null").groupBy("print").agg(F.min("at").alias("a"), F.max("at").alias("b")).filter("a <> b").select("print"))
    likely = runs.join(if_small(repeated), "print", "left_semi")
    start = place_of(runs)
    likely = likely.select("print", "run", "__key", "place", "last", start.alias("start"))
    first = cut(likely.groupBy("print", "run").agg(F.min("start").alias("first"), F.max("start").alias("final")).filter("first <> final").select("print", "run", "first"))
    # ``first`` is written, so that Spark shuffles both sides for this join alone and can split a run that stands very often.
    later = likely.join(first, ["print", "run"]).filter("start > first").groupBy("__key", "place").agg(F.max("last").alias("last"))
    order = Window.partitionBy("__key").orderBy("place")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = later.withColumn("opens", (reached.isNull() | (F.col("place") > reached)).cast("int"))
    islands = opens.withColumn("island", F.sum("opens").over(order)).groupBy("__key", "island").agg(F.min("place").alias("first"), F.max("last").alias("last"))
    made = cut(islands.groupBy("__key").agg(F.collect_list(F.struct("first", "last")).alias("stretches")))
    discard(spark, path)
    return made


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, both_ways: bool = True) -> DataFrame:
    """All columns of ``df`` with the repeated runs cut out of the text, and ``n_deleted`` (lines, blank ones included)."""
    refuse_columns(df.columns, ["__key", "__text", "stretches", "n_deleted"])
    found = deletions(df, id_col, text, run_words, both_ways)
    keyed = df.withColumn("__text", F.col(text).cast("string")).withColumn("__key", key_of(id_col, "__text"))
    joined = keyed.join(if_small(found, F.lit(STRETCH_BYTES) * F.size("stretches")), "__key", "left")
    kept = F.filter(lines_of(F.col("__text")), lambda x, k: ~F.exists("stretches", lambda s: (k >= s["first"]) & (k <= s["last"])))
    rebuilt = F.when(F.col("stretches").isNull(), F.col("__text")).otherwise(F.array_join(kept, ""))
    gone = F.aggregate("stretches", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    other = [F.col(f"`{c}`") if c != text else rebuilt.alias(text) for c in df.columns]
    return joined.select(*other, F.coalesce(gone, F.lit(0).cast("bigint")).alias("n_deleted"))
