"""Change-feed batches over the fixture tables, decided for all batches' names at once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.tables import append_log, apply_sync_batch
from ..sources.documents import read_change_feed
from ..storage import shared_dir, written
from ..streaming import sync as S
from ..streaming.feed import folder_fetch, register
from .registry import query

_LAST = "last AS (SELECT name, max(seq) AS seq, arg_max(rev, seq) AS rev, arg_max(deleted, seq) AS deleted FROM fx_change GROUP BY name), o AS (SELECT *, CAST(substr(name, 5) AS BIGINT) AS k FROM last)"
_DECIDED = f"""{_LAST}, decided AS (SELECT name, seq, CASE WHEN k % 5 = 1 THEN 'doc' ELSE rev END AS rev, CASE WHEN deleted THEN 'delete' WHEN k % 4 = 0 THEN 'skipped' WHEN k % 5 = 0 THEN 'missing' WHEN k % 5 = 1 AND k % 4 = 1 THEN 'skipped-after-fetch' ELSE 'update' END AS action FROM o)"""


def _decided(f):
    events = f.fx_change.select("name", F.col("seq").alias("pos"), F.col("seq").cast("string").alias("seq"), "rev", "deleted")
    number = F.substring("name", 5, 20).cast("bigint")
    names = f.fx_change.groupBy("name").agg(F.max_by("rev", "seq").alias("rev")).withColumn("k", number)
    stored = F.when(F.col("k") % 4 == 0, F.col("rev")).when(F.col("k") % 4 == 1, "doc").otherwise("older")
    packages = names.select("name", stored.alias("rev"))
    documents = names.filter("k % 5 <> 0").select("name", F.when(F.col("k") % 5 == 1, "doc").alias("doc_rev"), F.lit("{}").alias("doc"), F.lit(None).cast("string").alias("error"))
    return events, packages, S.decide(events, packages, documents)


@query(f"WITH {_DECIDED} SELECT name, CAST(seq AS VARCHAR) AS seq, rev, action FROM decided")
def t2_sync_batch(f):
    return _decided(f)[2].select("name", "seq", "rev", "action")


@query(f"WITH {_DECIDED} SELECT name, rev, CAST(seq AS VARCHAR) AS deleted_seq, CASE WHEN action = 'missing' THEN 'packument_not_found' ELSE 'deleted_in_feed' END AS reason FROM decided WHERE action IN ('missing', 'delete')")
def t4_missing_documents(f):
    return S.split(_decided(f)[2])[1]


@query(f"WITH {_DECIDED} SELECT name FROM o WHERE k % 2 = 0 AND name NOT IN (SELECT name FROM decided WHERE action = 'update') UNION SELECT name FROM decided WHERE action IN ('missing', 'delete')")
def t5_restore_clears_tombstone(f):
    _, packages, decided = _decided(f)
    records, gone = S.split(decided)
    marks = packages.filter("CAST(substring(name, 5, 20) AS BIGINT) % 2 = 0").select("name", "rev", F.lit("0").alias("deleted_seq"), F.lit("earlier").alias("reason"))
    return apply_sync_batch(packages, marks, records.select("name", "rev"), gone)[1].select("name")


@query(f"""WITH {_DECIDED} SELECT (SELECT count(*) FROM fx_change) AS input, count(*) AS requested, count(*) FILTER (WHERE action IN ('update', 'skipped-after-fetch')) AS fetched, count(*) FILTER (WHERE action = 'update') AS updated,
    count(*) FILTER (WHERE action LIKE 'skipped%') AS skipped, count(*) FILTER (WHERE action IN ('delete', 'missing')) AS deleted, CAST(0 AS BIGINT) AS errors FROM decided""")
def t7_batch_progress(f):
    events, _, decided = _decided(f)
    return S.batch_counts(events, decided)


#: Pages of a landed file at most; a file is written by one task, as the feed is read in order.
_PAGES = 20_000


def _land(f) -> str:
    """A feed folder: pages of 100 events, one a line, in eight files or more that land one after the other in the feed's order, each with its pages in order."""
    item = F.to_json(F.struct(F.col("seq").cast("string").alias("seq"), F.col("name").alias("id"), F.array(F.struct("rev")).alias("changes"), F.when(F.col("deleted"), True).alias("deleted")))
    per = f.fx_change.groupBy(F.expr("seq div 100").alias("page")).agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("items"), F.max("seq").alias("last"))
    doc = F.concat(F.lit('{"results": ['), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit('], "last_seq": "'), F.col("last"), F.lit('-x"}'))
    pages, feed = written(per.select("page", doc.alias("doc")), "feed-pages"), _folder(f, "feed")
    last = pages.agg(F.max("page")).first()[0] or 0
    size = min(last // 8 + 1, _PAGES)
    for i in range(max(8, last // size + 1)):
        own = pages.filter(F.col("page").between(i * size, i * size + size - 1))
        own.repartition(1).sortWithinPartitions("page").select("doc").write.mode("append").text(feed)
    return feed


def _folder(f, name):
    return f"{shared_dir(f.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT coordinate, state_status, pos FROM fx_state")
def k5_append_log(f):
    path = _folder(f, "state-log")
    rows = f.fx_state.select("coordinate", "state_status", "pos")
    for part in (rows.filter("state_status = 'completed'"), rows.filter("state_status <> 'completed'")):
        append_log(part, path)
    return f.spark.read.schema(rows.schema).json(path)


@query("SELECT name, max(seq) AS last, count(*) AS events FROM fx_change GROUP BY name")
def t1_change_stream(f):
    feed, out = _land(f), _folder(f, "events")
    events = read_change_feed(S.change_stream(f.spark, feed, whole=False).withColumn("batch_id", F.lit(0)))
    events.writeStream.format("parquet").option("checkpointLocation", _folder(f, "stream")).trigger(availableNow=True).start(out).awaitTermination()
    found = f.spark.read.parquet(out)
    return found.groupBy("name").agg(F.max(F.col("seq").cast("bigint")).alias("last"), F.count("*").alias("events"))


# From the token of an event within a page on, a sixth of the feed a batch, each batch by a query that ends and leaves its checkpoint.
@query("SELECT name, max(seq) AS last, count(*) AS events FROM fx_change WHERE seq > 150 GROUP BY name")
def t1_token_stream(f):
    feed, out, checkpoint = _land(f), _folder(f, "events"), _folder(f, "stream")
    source, limit = f"feed_{uuid.uuid4().hex}", f.fx_change.count() // 6 + 1
    register(f.spark, source, folder_fetch(feed))
    for _ in range(7):
        events = f.spark.readStream.format(source).option("since", "150").option("limit", limit).load()
        events.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    found = f.spark.read.parquet(out)
    return found.groupBy("name").agg(F.max(F.col("seq").cast("bigint")).alias("last"), F.count("*").alias("events"))


@query("""WITH last AS (SELECT name, arg_max(rev, seq) AS rev, arg_max(deleted, seq) AS deleted, CAST(substr(name, 5) AS BIGINT) AS k FROM fx_change GROUP BY name)
SELECT CASE WHEN deleted OR k % 5 = 0 THEN 'tombstone' ELSE 'package' END AS kind, name, rev, CASE WHEN deleted THEN 'deleted_in_feed' WHEN k % 5 = 0 THEN 'packument_not_found' END AS reason FROM last""")
def t6_follow_feed(f):
    feed, base = _land(f), _folder(f, "index")
    names = f.fx_change.select("name").distinct().filter("CAST(substring(name, 5, 20) AS BIGINT) % 5 <> 0")
    documents = names.select("name", F.lit(None).cast("string").alias("doc_rev"), F.lit("{}").alias("doc"), F.lit(None).cast("string").alias("error"))
    S.follow(f.spark, feed, base, lambda: documents, _folder(f, "stream"), files_per_batch=4, whole=False).awaitTermination()
    packages, tombstones = S.Index(f.spark, base).tables()
    none = F.lit(None).cast("string").alias("reason")
    return packages.select(F.lit("package").alias("kind"), "name", "rev", none).union(tombstones.select(F.lit("tombstone"), "name", "rev", "reason"))
