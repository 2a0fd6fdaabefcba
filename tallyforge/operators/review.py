"""Cases as an append-only event log: (seq, issue_id, actor, action, status, note, at)."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "seq long, issue_id string, actor string, action string, status string, note string, at timestamp"
#: From a status to the next; staying is allowed.
NEXT = {"Open": "Investigating", "Investigating": "Explained", "Explained": "Resolved"}


def detected(log: DataFrame, issues: DataFrame, at: str) -> DataFrame:
    """Events that open the issues that the log doesn't know yet; known ones keep their status."""
    start = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    new = issues.select("issue_id").distinct().join(log.select("issue_id").distinct(), "issue_id", "left_anti")
    # numbers follow the ids' order; ranges of ids are numbered one after another
    return new.select((F.row_number().over(Window.orderBy("issue_id")) + start).cast("long").alias("seq"), "issue_id", F.lit("system").alias("actor"), F.lit("Detected").alias("action"), F.lit("Open").alias("status"), F.lit(None).cast("string").alias("note"), F.lit(at).cast("timestamp").alias("at"))


def latest(log: DataFrame) -> DataFrame:
    """(issue_id, status, updated_at): each case as its last event leaves it."""
    return log.groupBy("issue_id").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"), F.max("at").alias("updated_at"))


def _append(log: DataFrame, issue_id: str, actor: str, action: str, status: str | None, note: str | None, at: str) -> DataFrame:
    seq = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
    row = log.sparkSession.createDataFrame([(seq, issue_id, actor, action, status, note)], "seq long, issue_id string, actor string, action string, status string, note string")
    return log.unionByName(row.withColumn("at", F.lit(at).cast("timestamp")))


def transition(log: DataFrame, issue_id: str, status: str, actor: str, at: str, note: str | None = None) -> DataFrame:
    """The log with a case moved on; a jump is an error."""
    now = latest(log.where(F.col("issue_id") == issue_id)).first()
    if now is None:
        raise ValueError(f"unknown case {issue_id}")
    if status != now["status"] and NEXT.get(now["status"]) != status:
        raise ValueError(f"{now['status']} can't become {status}")
    return _append(log, issue_id, actor, "Escalated" if status == now["status"] else status, status, note, at)


def comment(log: DataFrame, issue_id: str, body: str, actor: str, at: str) -> DataFrame:
    if not body.strip():
        raise ValueError("a comment needs text")
    return _append(log, issue_id, actor, "Comment", None, body.strip(), at)


def feedback(log: DataFrame, issue_id: str, verdict: str, actor: str, at: str) -> DataFrame:
    if verdict not in ("accept", "reject"):
        raise ValueError("feedback is accept or reject")
    return _append(log, issue_id, actor, f"Feedback: {verdict}", None, verdict, at)


def audit(log: DataFrame, issue_id: str) -> DataFrame:
    """A case's events, the newest first."""
    return log.where(F.col("issue_id") == issue_id).orderBy(F.col("seq").desc())


def illegal_steps(log: DataFrame) -> DataFrame:
    """(issue_id, seq, before, status): steps of a whole log that the states don't allow, by its order per case."""
    s = log.where("status IS NOT NULL").withColumn("before", F.lag("status").over(Window.partitionBy("issue_id").orderBy("seq")))
    fine = F.col("before") == F.col("status")
    for a, b in NEXT.items():
        fine = fine | ((F.col("before") == a) & (F.col("status") == b))
    return s.where(F.coalesce(~fine, F.col("status") != "Open")).select("issue_id", "seq", "before", "status")


SEVERITIES = ("High", "Medium", "Low")


def inbox(cases: DataFrame, text: str = "", severities: list[str] | None = None, types: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    """The cases that hold `text` in any of their columns (not as a pattern, in any case) and are of the severities, types and statuses, if given."""
    out = cases
    if text:
        out = out.where(F.exists(F.array(*[F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in cases.columns]), lambda x: F.contains(x, F.lit(text.lower()))))
    for column, wanted in (("severity", severities), ("issue_type", types), ("status", statuses)):
        if wanted:
            out = out.where(F.col(column).isin(wanted))
    return out


def page(cases: DataFrame, number: int, size: int = 25) -> DataFrame:
    """A page (from 1) of the cases, the severest first, then those of the largest impact; ties by id."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.nullif("severity", F.lit(""))), F.lit(9))
    order = [F.when(rank == 0, 9).otherwise(rank), F.col("impact").desc(), F.col("issue_id")]
    return cases.orderBy(*order).offset((number - 1) * size).limit(size)


def drill_down(tables: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """(source, ...): the rows of each table whose `id` is among ids (id); columns that a table lacks are null."""
    out = None
    for name, df in tables.items():
        part = df.join(ids.select("id").distinct(), "id", "left_semi").select(F.lit(name).alias("source"), *df.columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


class Store:
    """A review log in a folder of Parquet files: events are only ever added, one file for each call.

    An event's number is that of its file and its place in it, so numbers grow without a look at what is there; two
    writers take different files, as a file's name is its writer's time and a random part.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        """All events, as `latest` and `audit` take them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/*")

    def add(self, events: DataFrame) -> None:
        """Append events (issue_id, actor, action, status, note, at); their order is that of issue_id."""
        first = time.time_ns() // 1_000_000 << 20  # milliseconds, with room for as many events each
        numbered = events.withColumn("seq", F.lit(first).cast("long") + F.monotonically_increasing_id() % (1 << 20))
        numbered.select(*[x.split()[0] for x in SCHEMA.split(", ")]).write.parquet(f"{self.path}/{first}-{uuid.uuid4().hex[:8]}")

    def open(self, issues: DataFrame, at: str) -> None:
        """Open the issues that the log doesn't know yet."""
        new = issues.select("issue_id").distinct().join(self.log().select("issue_id").distinct(), "issue_id", "left_anti")
        self.add(new.select("issue_id", F.lit("system").alias("actor"), F.lit("Detected").alias("action"), F.lit("Open").alias("status"), F.lit(None).cast("string").alias("note"), F.lit(at).cast("timestamp").alias("at")))

    def move(self, issue_id: str, status: str, actor: str, at: str, note: str | None = None) -> None:
        """Move a case on, as `transition` allows it; the new event alone is written."""
        log = self.log().where(F.col("issue_id") == issue_id)
        self.add(transition(log, issue_id, status, actor, at, note).orderBy(F.col("seq").desc()).limit(1))

    def note(self, issue_id: str, body: str, actor: str, at: str) -> None:
        self.add(comment(self.log().where(F.col("issue_id") == issue_id), issue_id, body, actor, at).orderBy(F.col("seq").desc()).limit(1))

    def verdict(self, issue_id: str, verdict: str, actor: str, at: str) -> None:
        self.add(feedback(self.log().where(F.col("issue_id") == issue_id), issue_id, verdict, actor, at).orderBy(F.col("seq").desc()).limit(1))


def comments(log: DataFrame) -> DataFrame:
    """(seq, issue_id, actor, note, at): what was said on the cases."""
    return log.where("action = 'Comment'").select("seq", "issue_id", "actor", "note", "at")


def verdicts(log: DataFrame) -> DataFrame:
    """(issue_id, verdict): each case's last accept or reject."""
    return log.where("startswith(action, 'Feedback: ')").groupBy("issue_id").agg(F.max_by("note", "seq").alias("verdict"))
