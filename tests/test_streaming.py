"""The change feed by tokens, and what a follower does with failures."""

import json

import pytest
from pyspark.sql import functions as F

from gristmill.streaming import feed as FD
from gristmill.streaming import sync as S


def _land(folder, pages):
    for i, (events, last) in enumerate(pages):
        items = [{"seq": q, "id": n, "changes": [{"rev": "0"}, {"rev": r}], **({"deleted": True} if d else {})} if n is not None else q for q, n, r, d in events]
        (folder / f"page-{len(list(folder.iterdir())):04d}.json").write_text(json.dumps({"results": items, "last_seq": last}) + "\n")


PAGES = [
    ([("1-a", "x", "1", False), ("2-a", "y", "1", False), ("3-a", "z", "1", False)], "3-z"),
    ([("4-a", "x", "2", False), ("junk", None, None, None), ("5-a", " ", "1", False), ("6-a", "y", "2", True)], "6-z"),
    ([("7-a", "w", "1", False), ("8-a", "x", "3", False)], "8-z"),
]


def test_tokens_and_limits(tmp_path):
    _land(tmp_path, PAGES)
    fetch = FD.folder_fetch(str(tmp_path))
    reader = FD._Reader(fetch, FD.START, 2)
    rows, end = reader.read(reader.initialOffset())
    assert [r[1] for r in rows] == ["1-a", "2-a"] and end == {"since": "2-a"}
    rows, nxt = reader.read(end)
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [("z", "3-a", "1", False), ("x", "4-a", "2", False)]
    for limit in (1, 2, 3, 100):  # however a batch is asked for again, it has the same events
        assert [r[1] for r in FD._Reader(fetch, FD.START, limit).readBetweenOffsets(end, nxt)] == ["3-a", "4-a"]
    everything, since = [], FD.START
    while True:
        rows, after = reader.read({"since": since})
        if after["since"] == since:
            break
        everything, since = everything + [r[1] for r in rows], after["since"]
    assert everything == ["1-a", "2-a", "3-a", "4-a", "6-a", "7-a", "8-a"] and since == "8-z"
    with pytest.raises(ValueError, match="no token"):
        fetch("nothing", 10)


def test_a_stopped_query_goes_on(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    _land(folder, PAGES[:2])
    FD.register(spark, "stopped_feed", FD.folder_fetch(str(folder)))

    def poll(**options):
        events = spark.readStream.format("stopped_feed").options(**options).load()
        query = events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()

    poll(since="2-a", limit="2")
    poll(since="1-a", limit="2")  # the checkpoint's token counts, not the option
    _land(folder, PAGES[2:])
    for _ in range(3):
        poll(limit="2")
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["3-a", "4-a", "6-a", "7-a", "8-a"]


def test_follower_and_failures(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    _land(folder, PAGES[:1])
    FD.register(spark, "followed_feed", FD.folder_fetch(str(folder)))
    wrong, waits = {"x": "HTTP Error 503: busy"}, []

    def documents():
        rows = [(n, None, None if n in wrong else "{}", wrong.get(n)) for n in "xyzw"]
        return spark.createDataFrame(rows, "name string, doc_rev string, doc string, error string")

    def wait(seconds):
        waits.append(seconds)
        if len(waits) == 2:
            wrong.clear()
        if len(waits) == 4:
            _land(folder, PAGES[1:])
            wrong["w"] = "HTTP Error 403: no"

    base = str(tmp_path / "index")
    with pytest.raises(S.Fatal, match="could not be fetched"):
        S.follow_tokens(spark, "followed_feed", base, documents, str(tmp_path / "at"), limit=100, polls=9, poll=1.0, idle=2.0, wait=wait)
    log = [r.outcome for r in spark.read.schema(S.OUTCOME).json(f"{base}/follow-log").orderBy("poll").collect()]
    assert log == ["transient", "transient", "advanced", "idle", "fatal"] and waits == [2.0, 2.0, 1.0, 2.0]
    packages, tombstones = S.Index(spark, base).tables()
    assert {(r.name, r.rev) for r in packages.collect()} == {("x", "1"), ("y", "1"), ("z", "1")} and tombstones.isEmpty()
    assert S.Index(spark, base).last()["last_seq"] == "3-z"
    wrong.clear()
    log = S.follow_tokens(spark, "followed_feed", base, documents, str(tmp_path / "at"), limit=100, polls=1, wait=wait)
    packages, tombstones = S.Index(spark, base).tables()
    assert {(r.name, r.rev) for r in packages.collect()} == {("x", "3"), ("z", "1"), ("w", "1")} and [r.name for r in tombstones.collect()] == ["y"]
    assert S.Index(spark, base).last()["last_seq"] == "8-z"


def test_which_failures_may_pass(spark):
    texts = {"timed out": True, "Connection refused": True, "HTTP Error 500: x": True, "HTTP 429": True, "HTTP Error 404: x": False, "HTTP Error 401": False, "bad document": False, None: False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.r for r in rows.select("t", S.retryable(F.col("t")).alias("r")).collect()} == texts


def test_folder_batches_are_read_by_ranges(tmp_path, monkeypatch):
    folder = tmp_path / "feed"
    folder.mkdir()
    _land(folder, PAGES)
    seqs = ["1-a", "2-a", "3-a", "4-a", "6-a", "7-a", "8-a"]
    for piece in (1, FD.PIECE):
        monkeypatch.setattr(FD, "PIECE", piece)
        for limit in (1, 2, 3, 4, 100):
            reader, got, offset = FD._FolderReader(FD.folder_fetch(str(folder)), FD.START, limit), [], {"since": FD.START}
            while (end := reader.latestOffset()) != offset:
                rows = [r for p in reader.partitions(offset, end) for r in reader.read(p)]
                again = FD._FolderReader(FD.folder_fetch(str(folder)), FD.START, limit)  # after a restart: the same, from the token alone too
                for start, stop in ((offset, end), ({"since": offset["since"]}, {"since": end["since"]})):
                    assert [r for p in again.partitions(start, stop) for r in again.read(p)] == rows
                got, offset = got + [r[1] for r in rows], end
            assert got == seqs and offset["since"] == "8-z"


def test_a_folder_is_passed_over_once(tmp_path, monkeypatch):
    events = [([(f"{i}-a", f"n{i}", "1", False)], f"{i}-z") for i in range(200)]
    (tmp_path / "all.json").write_text("".join(json.dumps({"results": [{"seq": q, "id": n} for q, n, _, _ in e], "last_seq": last}) + "\n" for e, last in events))
    looked = []
    monkeypatch.setattr(FD, "json", type("J", (), {"loads": staticmethod(lambda t: looked.append(1) or json.loads(t))}))
    rows, end = FD._Reader(FD.folder_fetch(str(tmp_path)), FD.START, 1000).read({"since": FD.START})
    assert len(list(rows)) == 200 and end == {"since": "199-z"} and len(looked) <= 400


def test_pages_land_in_the_feeds_order(spark, sf_dir):
    from gristmill.fixtures import Fixtures
    from gristmill.plans.sync_queries import _land as land

    wide = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(7)
    f = Fixtures(spark, sf_dir)
    f.events = wide
    reader = FD._Reader(FD.folder_fetch(land(f)), FD.START, 10**9)
    seqs = [int(r[1]) for r in reader.read({"since": FD.START})[0]]
    assert seqs == sorted(seqs) and len(seqs) == wide.count()
