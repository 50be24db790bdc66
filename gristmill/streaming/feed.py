"""The change feed as a streaming source whose offset is the feed's own token.

A batch is asked for as the feed is: what comes after a token, so many events at
most, which may end within a page. Spark's checkpoint keeps the token, so that a
query that is stopped goes on where its last batch ended; a first run starts from
the token given, or from the beginning. Events are few and small (at most `limit`
a batch); documents are fetched by what the batch does with them.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..storage import opened

EVENTS = "name string, seq string, rev string, deleted boolean, last_seq string"
#: Fetches what comes after a token: (events of one page, each seq, id, changes, deleted; the page's last token).
Fetch = Callable[[str, int], tuple[list[dict], str]]


def http_fetch(url: str, timeout: float = 60.0) -> Fetch:
    """Pages of a feed that answers `since` and `limit`."""

    def fetch(since: str, limit: int) -> tuple[list[dict], str]:
        with urlopen(f"{url}?{urlencode({'since': since, 'limit': limit})}", timeout=timeout) as page:
            found = json.load(page)
        return found.get("results") or [], str(found.get("last_seq", since))

    return fetch


class FolderFeed:
    """Pages that landed in a folder, in the order in which they did, a JSON document a line: a feed that can be read again from any token.

    The folder is read through pyarrow's file systems (a path, or a URI of one that
    these know). A call is a `Fetch`. `plan` gives what a batch is made of as byte
    ranges, so that tasks read the events: one page at a time is looked at, and the
    place where a batch ends goes with its token, so that no page is passed over twice.
    """

    def __init__(self, folder: str):
        self.folder = folder
        self.place: tuple[str, tuple] | None = None  # the last token given, and where it stands

    def _pages(self, place: tuple | None):
        """Pages and where they are (file, first byte, byte after), from a place (file, byte) on; from the beginning, if its file is gone."""
        from pyarrow import fs

        system, path = opened(self.folder)
        infos = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        infos = sorted((i for i in infos if i.is_file and not i.base_name.startswith(("_", "."))), key=lambda i: (i.mtime_ns, i.path))
        at = next((k for k, i in enumerate(infos) if place and i.path == place[0]), None)
        for k, info in enumerate(infos[at or 0 :]):
            begin = place[1] if at is not None and k == 0 else 0
            for begin, end, page in _lines(system, info.path, begin):
                yield (info.path, begin, end), page

    def _after(self, since: str, place: tuple | None):
        """Pages after a token: where, how many events to leave out, the others, the page's last token."""
        begun, known = since == START or place is not None, place is not None
        for where, page in self._pages(place):
            items, last = page.get("results") or [], str(page.get("last_seq", since))
            skip = 0
            if not begun or known:
                seqs = [str(i.get("seq")) if isinstance(i, dict) else None for i in items]
                if since in seqs and since != last:
                    skip = seqs.index(since) + 1
                elif not begun:
                    begun = since == last
                    continue
                begun, known = True, False
            yield where, skip, items[skip:], last
        if not begun:
            raise ValueError(f"the feed has no token {since}")

    def __call__(self, since: str, limit: int) -> tuple[list[dict], str]:
        token = since
        for where, _, items, last in self._after(since, self.place[1] if self.place and self.place[0] == since else None):
            token, n = last, _cut(items, limit)
            if items:
                token = last if n >= len(items) else str(items[n - 1]["seq"])
                self.place = (token, (where[0], where[2] if n >= len(items) else where[1]))
                return items[:n], token
        return [], token

    def plan(self, since: str, limit: int | None = None, until: str | None = None, place: tuple | None = None) -> tuple[list[tuple], str, tuple | None]:
        """Pieces (file, first byte, byte after, events left out of the first page, events taken of the last page, its token), the token that they end with, and its place.

        They hold `limit` events, or those up to the token `until`.
        """
        pieces, token, left = [], since, limit
        for where, skip, items, last in self._after(since, place):
            n, seqs = len(items), None
            if until is not None and until != last:
                seqs = [str(i.get("seq")) if isinstance(i, dict) else None for i in items]
                n = seqs.index(until) + 1 if until in seqs else n
            elif left is not None:
                n = _cut(items, left)
            ends = n < len(items)
            token = str(items[n - 1]["seq"]) if ends else last
            place = (where[0], where[1] if ends else where[2])
            if n:
                grown = pieces and not skip and pieces[-1][0] == where[0] and pieces[-1][2] == where[1] and where[2] - pieces[-1][1] <= PIECE
                first, left_out = (pieces[-1][1], pieces[-1][3]) if grown else (where[1], skip)
                pieces[len(pieces) - bool(grown) :] = [(where[0], first, where[2], left_out, n if ends else None, token)]
            left = None if left is None else left - n
            if token == until or (left is not None and left <= 0):
                break
        if until is not None and token != until:
            raise ValueError(f"the feed ends before token {until}")
        return pieces, token, place

    def events(self, piece: tuple) -> Iterator[tuple]:
        path, begin, end, skip, taken, token = piece
        for _, stop, page in _lines(opened(self.folder)[0], path, begin, end):
            items, last = (page.get("results") or [])[skip:], str(page.get("last_seq", token))
            if stop == end and taken is not None:
                items, last = items[:taken], token
            skip = 0
            yield from filter(None, (_row(i, last) for i in items))


#: Bytes of a feed folder that one task reads.
PIECE = 4 << 20


def _lines(system, path: str, begin: int, end: int | None = None) -> Iterator[tuple[int, int, dict]]:
    """Pages of a file, a line each, and the bytes between which each stands."""
    with system.open_input_file(path) as file:
        file.seek(begin)
        stream = io.BufferedReader(file, 1 << 16)
        while (end is None or begin < end) and (line := stream.readline()):
            if line.strip():
                yield begin, begin + len(line), json.loads(line)
            begin += len(line)


def _cut(items: list, limit: int) -> int:
    """How many events of a page a batch takes: it ends with an event that has a token of its own, or with its page."""
    n = min(limit, len(items))
    while n < len(items) and not (isinstance(items[n - 1], dict) and items[n - 1].get("seq") is not None):
        n += 1
    return n


def folder_fetch(folder: str) -> FolderFeed:
    return FolderFeed(folder)


START = "0"


def _row(item, last: str):
    """An event's row; those that are no objects or have no name are none."""
    if not isinstance(item, dict) or not str(item.get("id") or "").strip():
        return None
    changes = [c.get("rev") for c in item.get("changes") or [] if isinstance(c, dict)]
    return (str(item["id"]), str(item.get("seq")), changes[-1] if changes else None, bool(item.get("deleted", False)), last)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, fetch: Fetch, since: str, limit: int):
        self.fetch, self.since, self.limit = fetch, since, limit

    def initialOffset(self) -> dict:
        return {"since": self.since}

    def _batch(self, since: str, limit: int) -> tuple[list, str]:
        """Events after a token, over as many pages as the limit allows."""
        rows, left = [], limit
        while left > 0:
            items, token = self.fetch(since, left)
            if token == since:
                break
            since, left = token, left - len(items)
            rows += [r for r in (_row(i, token) for i in items) if r]
        return rows, since

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._batch(start["since"], self.limit)
        return iter(rows), {"since": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same events again, after a restart: pages are asked for until the token that ended the batch."""
        since, rows = start["since"], []
        while since != end["since"]:
            more, token = self._batch(since, self.limit)
            if token == since:
                raise ValueError(f"the feed ends before token {end['since']}")
            at = next((i for i, r in enumerate(more) if r[1] == end["since"]), None)
            rows += more if at is None or token == end["since"] else more[: at + 1]
            since = token if at is None else end["since"]
        return iter(rows)


class _Piece(InputPartition):
    def __init__(self, piece: tuple):
        self.piece = piece


class _FolderReader(DataSourceStreamReader):
    """Batches of a feed folder: cut by the driver, read by tasks."""

    def __init__(self, feed: FolderFeed, since: str, limit: int):
        self.feed, self.since, self.limit = feed, since, limit
        self.at: dict | None = None  # the end of the last batch cut
        self.cut: tuple | None = None  # its start, end and pieces

    def initialOffset(self) -> dict:
        return {"since": self.since}

    def latestOffset(self) -> dict:
        start = self.at or self.initialOffset()
        pieces, token, place = self.feed.plan(start["since"], self.limit, place=_place(start))
        end = start if token == start["since"] else {"since": token, "file": place[0], "byte": place[1]}
        self.at, self.cut = end, (start, end, pieces)
        return end

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        # after a restart Spark asks for the last batch first, and goes on from its end
        self.at = self.at or end
        if start["since"] == end["since"]:
            return []
        cut = self.cut if self.cut and self.cut[:2] == (start, end) else (start, end, self.feed.plan(start["since"], until=end["since"], place=_place(start))[0])
        return [_Piece(p) for p in cut[2]]

    def read(self, partition: _Piece) -> Iterator[tuple]:
        return self.feed.events(partition.piece)


def _place(offset: dict) -> tuple | None:
    return (offset["file"], offset["byte"]) if "file" in offset else None


def register(spark: SparkSession, name: str, fetch: Fetch) -> None:
    """Makes `spark.readStream.format(name)` read a feed, with the options since (a token) and limit (events a batch, 1,000).

    The events of a `FolderFeed` are read by tasks; others come through the driver, one batch at a time.
    """

    class ChangeFeed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return EVENTS

        def _options(self) -> tuple:
            return fetch, self.options.get("since", START), int(self.options.get("limit", 1000))

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            if not isinstance(fetch, FolderFeed):
                return super().streamReader(schema)  # Spark then asks for the simple reader
            return _FolderReader(*self._options())

        def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
            return _Reader(*self._options())

    spark.dataSource.register(ChangeFeed)
