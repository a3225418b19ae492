"""Rows behind a cursor: a remote side gives the next rows after an id, some at a time, until a short page.

``spark.dataSource.register(CursorSource)`` makes the format ``cursor_pages``.  Options: ``base``, an address (GET base/form?after=id&limit=n gives a JSON list of
rows in order of id, GET base/form?last=1 the last row) or a folder of page files (base/form/first=id/*.json, a row a line, each page from its
first id on); ``key``, the id's field; ``forms``, separated by commas; ``size`` of a page; ``bounds``, ids at which a form's reading is split among tasks.
A schema field ``_page`` gets the number of the request.  As a stream, the last id of each form is the offset, so a restart goes on after it.
"""

from __future__ import annotations

import bisect
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: How often a request is tried, and the seconds between the first two tries; later ones wait twice as long each.
TRIES, PAUSE = 5, 0.2


@dataclass
class Part(InputPartition):
    """Rows of a form with after < id <= until; null is unbounded."""

    form: str
    after: int | None
    until: int | None


class Remote:
    """Pages of forms by HTTP."""

    def __init__(self, base: str, key: str):
        self.base, self.key = base.rstrip("/"), key

    def _get(self, form: str, **query: object) -> list[dict]:
        url = f"{self.base}/{urllib.parse.quote(form)}?{urllib.parse.urlencode(query)}"
        for n in range(TRIES):
            try:
                with urllib.request.urlopen(url, timeout=60) as reply:
                    return json.load(reply)
            except urllib.error.HTTPError as e:
                if n + 1 == TRIES or e.code != 429 and e.code < 500:
                    raise
                time.sleep(PAUSE * 2**n)
        raise AssertionError

    def page(self, form: str, after: int | None, size: int) -> list[dict]:
        return self._get(form, limit=size, **({} if after is None else {"after": after}))

    def last(self, form: str) -> int | None:
        return next((row[self.key] for row in self._get(form, last=1)), None)


class Folder:
    """Pages of forms as files, in any store that pyarrow opens."""

    def __init__(self, base: str, key: str):
        from pyarrow import fs  # only where files are read

        self.fs, self.base = fs.FileSystem.from_uri(base)
        self.select = fs.FileSelector
        self.key, self.listed = key, {}

    def _firsts(self, form: str) -> list[int]:
        if form not in self.listed:
            found = self.fs.get_file_info(self.select(f"{self.base}/{form}", allow_not_found=True))
            self.listed[form] = sorted(int(f.base_name.partition("=")[2]) for f in found if f.base_name.startswith("first="))
        return self.listed[form]

    def _rows(self, form: str, first: int) -> list[dict]:
        files = [f.path for f in self.fs.get_file_info(self.select(f"{self.base}/{form}/first={first}")) if f.base_name.endswith(".json")]
        rows = [json.loads(line) for p in sorted(files) for line in self.fs.open_input_stream(p).read().splitlines() if line]
        return sorted(rows, key=lambda r: r[self.key])

    def page(self, form: str, after: int | None, size: int) -> list[dict]:
        firsts, out = self._firsts(form), []
        at = 0 if after is None else max(0, bisect.bisect_right(firsts, after) - 1)
        while at < len(firsts) and len(out) < size:
            out += [r for r in self._rows(form, firsts[at]) if after is None or r[self.key] > after]
            at += 1
        return out[:size]

    def last(self, form: str) -> int | None:
        self.listed.clear()
        firsts = self._firsts(form)
        return self._rows(form, firsts[-1])[-1][self.key] if firsts else None


class _Pages:
    """What the readers of a source share."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.base, self.key, self.size = options["base"], options["key"], int(options.get("size", 100))
        self.forms = [f for f in options.get("forms", "").split(",") if f]
        self.bounds = [int(b) for b in options.get("bounds", "").split(",") if b]
        self.fields = schema.names

    def remote(self) -> Remote | Folder:
        return (Remote if self.base.startswith(("http://", "https://")) else Folder)(self.base, self.key)

    def rows(self, part: Part) -> Iterator[tuple]:
        """Page after page; a task holds one."""
        remote, after, number = self.remote(), part.after, 0
        while True:
            page = remote.page(part.form, after, self.size)
            for row in page:
                if part.until is not None and row[self.key] > part.until:
                    return
                yield tuple(number if f == "_page" else row.get(f) for f in self.fields)
            if len(page) < self.size:
                return
            after, number = page[-1][self.key], number + 1


class CursorReader(DataSourceReader):
    def __init__(self, pages: _Pages):
        self.pages = pages

    def partitions(self) -> list[Part]:
        ends = [None, *sorted(self.pages.bounds), None]
        return [Part(f, a, b) for f in self.pages.forms for a, b in zip(ends, ends[1:])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.pages.rows(partition)


class CursorStreamReader(DataSourceStreamReader):
    def __init__(self, pages: _Pages):
        self.pages = pages

    def initialOffset(self) -> dict:
        return {f: None for f in self.pages.forms}

    def latestOffset(self) -> dict:
        remote = self.pages.remote()
        return {f: remote.last(f) for f in self.pages.forms}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(f, start.get(f), end[f]) for f in end if end[f] is not None and end[f] != start.get(f)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.pages.rows(partition)


class CursorSource(DataSource):
    """The format ``cursor_pages``; the schema is the user's."""

    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def reader(self, schema: StructType) -> CursorReader:
        return CursorReader(_Pages(self.options, schema))

    def streamReader(self, schema: StructType) -> CursorStreamReader:
        return CursorStreamReader(_Pages(self.options, schema))
