"""Keeping an index up to date from a change feed.

A micro-batch is decided as a whole: it is deduplicated, unchanged revisions are
skipped, documents that landed become records and missing ones tombstones. Only
what changed is written, as one folder, which takes in the folders before it that
are no larger: a state of any size is some folders of falling size, and a change
is written again about as often as the state doubles. A manifest with the batch
id, the folders and the feed's token comes last of all; readers follow it, so that
a batch that fails leaves no trace, and one that is run again is not applied twice.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import dedupe
from ..sources.documents import read_change_feed
from ..storage import delete

#: A name's latest change: a record, or, with a reason, a tombstone.
CHANGES = "name string, batch_id bigint, rev string, doc string, deleted_seq string, reason string"
MANIFEST = "batch_id bigint, last_seq string, folders array<struct<path: string, rows: bigint>>, input bigint, requested bigint, fetched bigint, updated bigint, skipped bigint, deleted bigint"


#: Failures that another try may mend: time-outs and connections, and answers but for those of a wrong or forbidden request.
LASTING_STATUS = ("400", "401", "403", "404")
TRANSIENT = r"(?i)time[d ]*-? ?out|connection|unreachable|reset by peer|temporar|name resolution|urlopen error|\bHTTP(?: Error)? \d{3}\b"


class Retryable(RuntimeError):
    """A batch that may go through when it is tried again."""


class Fatal(RuntimeError):
    """A batch that can't go through as it is."""


def retryable(message: Column) -> Column:
    status = F.regexp_extract(message, r"\bHTTP(?: Error)? (\d{3})\b", 1)
    return F.coalesce(message.rlike(TRANSIENT) & ~status.isin(*LASTING_STATUS), F.lit(False))


def change_stream(spark: SparkSession, folder: str, files_per_batch: int = 1, whole: bool = True) -> DataFrame:
    """Landed feed pages, one JSON document a file (a line, if not `whole`); Spark's checkpoint is the place in the feed."""
    return spark.readStream.schema("doc string").option("wholetext", whole).option("maxFilesPerTrigger", files_per_batch).text(folder).withColumnRenamed("value", "doc")


def decide(events: DataFrame, packages: DataFrame, documents: DataFrame) -> DataFrame:
    """events (name, pos, seq, rev, deleted), packages (name, rev), documents (name, doc_rev, doc, error): one row a name with its action.

    skipped: the stored revision is that of the feed, or of the document that came;
    delete: the feed says so, or no document landed; error: fetching failed.
    """
    place = F.struct("page", "pos") if "page" in events.columns else F.col("pos")
    last = dedupe(events.select("name", place.alias("pos"), "seq", "rev", "deleted"), ["name"], "last")
    rows = last.join(packages.select("name", F.col("rev").alias("stored")), "name", "left").join(documents, "name", "left")
    known = F.col("stored").isNotNull()
    own = F.coalesce("doc_rev", "rev")
    action = (
        F.when(F.col("deleted"), "delete").when(known & (F.col("rev") == F.col("stored")), "skipped").when(F.col("error").isNotNull(), "error")
        .when(F.col("doc").isNull(), "missing").when(known & (own == F.col("stored")), "skipped-after-fetch").otherwise("update")
    )
    return rows.select("name", "seq", own.alias("rev"), "doc", action.alias("action"))


def split(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (name, rev, doc) and tombstones (name, rev, deleted_seq, reason)."""
    reason = F.when(F.col("action") == "missing", "packument_not_found").otherwise("deleted_in_feed")
    gone = decided.filter(F.col("action").isin("delete", "missing"))
    return decided.filter("action = 'update'").select("name", "rev", "doc"), gone.select("name", "rev", F.col("seq").alias("deleted_seq"), reason.alias("reason"))


def batch_counts(events: DataFrame, decided: DataFrame) -> DataFrame:
    """One row: input, requested, fetched, updated, skipped, deleted, errors."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    counts = decided.agg(F.count("*").alias("requested"), n("update", "skipped-after-fetch").alias("fetched"), n("update").alias("updated"), n("skipped", "skipped-after-fetch").alias("skipped"), n("delete", "missing").alias("deleted"), n("error").alias("errors"))
    return events.agg(F.count("*").alias("input")).crossJoin(counts)  # one row each


def latest(changes: DataFrame, *columns: str) -> DataFrame:
    """The last change of each name, with its name and these columns."""
    return changes.groupBy("name").agg(F.max_by(F.struct(*columns), "batch_id").alias("c")).select("name", "c.*")


class Index:
    """Folders of changes below a base, and their manifest."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.base}/manifest")
        except Exception as e:  # before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def last(self):
        return self.manifest().orderBy(F.desc("batch_id")).first()

    def _read(self, folders: list) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).parquet(*(f["path"] for f in folders))

    def changes(self) -> DataFrame:
        last = self.last()
        return self._read(last["folders"] if last else [])

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """packages (name, rev, doc) and tombstones (name, rev, deleted_seq, reason)."""
        changes = self.changes()
        packages = latest(changes, "rev", "doc", "reason").filter("reason IS NULL").drop("reason")
        return packages, latest(changes, "rev", "deleted_seq", "reason").filter("reason IS NOT NULL")

    def apply(self, pages: DataFrame, batch_id: int, documents: DataFrame) -> None:
        """One micro-batch of feed pages (doc), see `apply_events`."""
        self.apply_events(read_change_feed(pages.withColumn("batch_id", F.lit(batch_id)), "doc"), batch_id, documents)

    def apply_events(self, events: DataFrame, batch_id: int, documents: DataFrame) -> None:
        """One micro-batch of events (name, page, pos, seq, rev, deleted, last_seq); raises if any fetch failed, with nothing written. A batch without events leaves the token.

        What raises is `Fatal` if one of the failures is of the kind that another try won't mend.
        """
        last = self.last()
        if last is not None and last["batch_id"] >= batch_id:
            return
        folders = list(last["folders"]) if last else []
        events = events.persist()
        token = events.agg(F.max_by("last_seq", F.struct("page", "pos"))).first()[0] or (last["last_seq"] if last else None)
        # revisions are looked up for the names of the batch alone, without documents
        stored = self._read(folders).select("name", "batch_id", "rev", "reason").join(events.select("name").distinct(), "name", "left_semi")
        decided = decide(events, latest(stored, "rev", "reason").filter("reason IS NULL"), documents).persist()
        try:
            counts = batch_counts(events, decided).first()
            if counts["errors"]:
                lasting = decided.filter("action = 'error'").join(documents.select("name", F.col("error").alias("why")), "name").filter(~retryable(F.col("why"))).count()
                raise (Fatal if lasting else Retryable)(f"{counts['errors']} documents could not be fetched; batch {batch_id} is left for another try")
            rows = counts["updated"] + counts["deleted"]
            if rows:
                records, gone = split(decided)
                new = records.unionByName(gone, allowMissingColumns=True).withColumn("batch_id", F.lit(batch_id).cast("long"))
                folders.append(self._write(new, rows, batch_id, folders))
            row = (batch_id, token, [(f["path"], f["rows"]) for f in folders], *(counts[c] for c in ("input", "requested", "fetched", "updated", "skipped", "deleted")))
            self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{self.base}/manifest")
        finally:
            events.unpersist()
            decided.unpersist()

    def _write(self, new: DataFrame, rows: int, batch_id: int, folders: list) -> dict:
        """Writes the changes and those of the last folders that are no larger, which leave the list."""
        smaller = []
        while folders and folders[-1]["rows"] <= rows:
            smaller.append(folders.pop())
            rows += smaller[-1]["rows"]
        columns = [f.name for f in self._read([]).schema]
        new = new.select(*columns)
        if smaller:
            new = latest(self._read(smaller).unionByName(new), *columns[1:])
        seen, path = Observation(), f"{self.base}/batch-{batch_id:08d}"
        new.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
        return {"path": path, "rows": seen.get["n"]}

    def vacuum(self, keep: int = 10) -> None:
        """Deletes the folders that none of the last `keep` batches lists; for when no reader is older than these."""
        batches = self.manifest().withColumn("n", F.row_number().over(Window.orderBy(F.desc("batch_id"))))
        listed = batches.select("n", F.explode("folders.path").alias("path")).groupBy("path").agg(F.min("n").alias("n"))
        for row in listed.filter(F.col("n") > keep).toLocalIterator():
            delete(self.spark, row["path"])


def follow(spark: SparkSession, feed: str, base: str, documents, checkpoint: str, once: bool = True, poll: str = "30 seconds", files_per_batch: int = 1, whole: bool = True):
    """Runs the feed into the index: all that is there (`once`), or on and on. documents() gives what has landed."""
    index = Index(spark, base)
    writer = change_stream(spark, feed, files_per_batch, whole).writeStream.foreachBatch(lambda pages, i: index.apply(pages, i, documents())).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=poll)).start()


OUTCOME = "poll bigint, outcome string, batch_id bigint, last_seq string, fetched bigint, updated bigint, skipped bigint, deleted bigint, message string"


def sync_once(spark: SparkSession, stream: DataFrame, index: Index, documents: Callable[[], DataFrame], checkpoint: str) -> dict:
    """What one poll of a stream of events brings: its outcome (advanced, idle, transient, fatal) and its counts.

    A query that was stopped, or failed, goes on from its checkpoint: the batch that
    it left is run again with the same events, and not applied twice.
    """
    before = index.last()
    numbered = lambda events: events.withColumns({"pos": F.monotonically_increasing_id(), "page": F.lit(0).cast("long")})
    failed: list[Exception] = []

    def batch(events: DataFrame, i: int) -> None:
        try:
            index.apply_events(numbered(events), i, documents())
        except Exception as e:
            failed.append(e)
            raise

    message = None
    try:
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    except StreamingQueryException as e:
        message = str(failed[-1] if failed else e)
    after = index.last()
    moved = after is not None and (before is None or after["batch_id"] > before["batch_id"])
    counts = {c: after[c] if moved else 0 for c in ("fetched", "updated", "skipped", "deleted")}
    if message is not None:
        passing = re.search(TRANSIENT, message) is not None and not re.search(rf"HTTP(?: Error)? (?:{'|'.join(LASTING_STATUS)})\b", message)
        passing = isinstance(failed[-1], Retryable) or (passing and not isinstance(failed[-1], Fatal)) if failed else passing
        outcome = "transient" if passing else "fatal"
    else:
        outcome = "advanced" if any(counts[c] for c in ("updated", "skipped", "deleted")) else "idle"
    return {"outcome": outcome, "batch_id": after["batch_id"] if after else None, "last_seq": after["last_seq"] if after else None, **counts, "message": message}


def follow_tokens(
    spark: SparkSession, source: str, base: str, documents: Callable[[], DataFrame], checkpoint: str, since: str | None = None, limit: int = 1000,
    polls: int | None = None, poll: float = 30.0, idle: float = 60.0, wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Polls a feed registered by `feed.register` on and on (or so many times); its log, with the counts of each poll.

    After a batch it waits for `poll` seconds, after an idle poll or a failure that may
    pass for `idle` seconds. A lasting failure ends it with what failed; the log is
    kept beside the index in any case. `since` counts for a first run alone.
    """
    index, log = Index(spark, base), f"{base}/follow-log"
    options = {"limit": str(limit)} | ({"since": since} if since is not None else {})
    n = 0
    while polls is None or n < polls:
        n += 1
        stream = spark.readStream.format(source).options(**options).load()
        found = sync_once(spark, stream, index, documents, checkpoint)
        row = (n, *(found[c] for c in ("outcome", "batch_id", "last_seq", "fetched", "updated", "skipped", "deleted", "message")))
        spark.createDataFrame([row], OUTCOME).coalesce(1).write.mode("append").json(log)
        if found["outcome"] == "fatal":
            raise Fatal(found["message"])
        if polls is None or n < polls:
            wait(poll if found["outcome"] == "advanced" else idle)
    return spark.read.schema(OUTCOME).json(log)
