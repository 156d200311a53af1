"""Change events of a folder as a streaming source. A batch compares the folder's listing with the one before it, so rewritten and deleted files
are seen, which the built-in file source doesn't report.

Folders are listed by executors: the files of the upper levels and each folder below them are partitions of their own. A partition keeps its listings as files of a shared folder, so what
it reports for two offsets is the difference of two written listings: the same again when a task or a whole query is run again, also in another process.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .tree import file_system

Listing = dict[str, list[int]]


def snapshot(root: str, recursive: bool = True) -> Listing:
    """Path to modification time (ns) and size of the files in a folder; none where the folder is gone."""
    from pyarrow import fs

    system, own = file_system(root)
    found = system.get_file_info(fs.FileSelector(own, recursive=recursive, allow_not_found=True))
    return {x.path: [x.mtime_ns or 0, x.size] for x in found if x.type == fs.FileType.File}


def changes(before: Listing, now: Listing) -> list[tuple[str, str]]:
    """(event type, path), by path; deletions first."""
    gone = [("deleted", p) for p in sorted(before.keys() - now.keys())]
    return gone + [("created" if p not in before else "modified", p) for p in sorted(now) if before.get(p) != now[p]]


class Part(InputPartition):
    """A folder between two offsets; where not ``recursive``, its own files only."""

    def __init__(self, path: str, recursive: bool, start: int, end: int, since: int = 0):
        self.path, self.recursive, self.start, self.end, self.since = path, recursive, start, end, since

    @property
    def key(self) -> str:
        return hashlib.sha256(f"{self.recursive} {self.path}".encode()).hexdigest()[:24]


class FolderReader(DataSourceStreamReader):
    """An offset is a number that each batch raises. ``state`` holds a folder for each partition, with its listings by offset and its name; the last of them stay."""

    def __init__(self, options: dict[str, str]):
        self.root, self.recursive = options["path"].rstrip("/"), options.get("recursive", "true").lower() == "true"
        self.existing, self.depth = options.get("existing", "false").lower() == "true", int(options.get("depth", "2"))
        if not options.get("state"):
            raise ValueError("option state: a folder that all machines share")
        self.system, self.state = file_system(options["state"])
        self.last: int | None = None
        self.since = int(options.get("since") or time.time_ns())

    def initialOffset(self) -> dict:
        # The first listing comes later than this.
        return {"n": 0, "since": self.since}

    def latestOffset(self) -> dict:
        # A new reader goes on after the highest offset that is planned already.
        if self.last is None:
            self.last = max([0, *(int(x) for x in self._names("planned"))])
        self.last += 1
        return {"n": self.last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        from pyarrow import fs

        self._write(f"planned/{end['n']}", "")
        level, known = [self.root], {(self.root, False)}
        for _ in range(self.depth if self.recursive else 0):
            level = [x.path if "://" not in self.root else self._uri(x.path) for f in level for x in self._inside(f) if x.type == fs.FileType.Directory]
            known |= {(f, False) for f in level}
        known = {(f, self.recursive if f in level and f != self.root else own) for f, own in known}
        # Folders that are gone still have files to report.
        known |= {tuple(json.loads(self._read(f"parts/{k}"))) for k in self._names("parts")}
        return [Part(f, deep, start["n"], end["n"], start.get("since", 0)) for f, deep in sorted(known)]

    def read(self, part: Part) -> Iterator[tuple]:
        at, end = f"seen/{part.key}", f"{part.end:015d}"
        there = sorted(self._names(at))
        if end not in there:
            now = {"at": datetime.now(UTC).isoformat(), "files": snapshot(part.path, part.recursive)}
            self._write(f"parts/{part.key}", json.dumps([part.path, part.recursive]))
            self._write(f"{at}/{end}", json.dumps(now))
        # Another run of this task may have been first; its listing counts.
        now = json.loads(self._read(f"{at}/{end}"))
        before = [n for n in there if int(n) <= part.start]
        if before:
            seen = json.loads(self._read(f"{at}/{before[-1]}"))["files"]
        else:
            # At the start of the stream what is there is no event, unless it was written after the start; a folder that comes later is new as a whole.
            seen = {} if self.existing or part.start else {p: x for p, x in now["files"].items() if x[0] < part.since}
        when = datetime.fromisoformat(now["at"]).replace(tzinfo=None)
        for kind, path in changes(seen, now["files"]):
            yield kind, path, None, False, when
        # The query goes on from ``start`` at the least, so older listings are of no use.
        for n in before[:-1]:
            self._remove(f"{at}/{n}")

    def commit(self, end: dict) -> None:
        for n in self._names("planned"):
            if int(n) < end["n"]:
                self._remove(f"planned/{n}")

    # Files of the state

    def _uri(self, path: str) -> str:
        scheme, _, rest = self.root.partition("://")
        return path if "://" in path else f"{scheme}://{rest.partition('/')[0]}{path}"

    def _inside(self, folder: str) -> list:
        from pyarrow import fs

        system, own = file_system(folder)
        return system.get_file_info(fs.FileSelector(own, allow_not_found=True))

    def _names(self, folder: str) -> list[str]:
        from pyarrow import fs

        found = self.system.get_file_info(fs.FileSelector(f"{self.state}/{folder}", allow_not_found=True))
        return [x.base_name for x in found if x.type == fs.FileType.File and not x.base_name.startswith("draft-")]

    def _read(self, name: str) -> str:
        with self.system.open_input_stream(f"{self.state}/{name}") as f:
            return f.read().decode()

    def _write(self, name: str, value: str) -> None:
        """A file appears whole, and only if there is none."""
        folder, _, own = f"{self.state}/{name}".rpartition("/")
        self.system.create_dir(folder, recursive=True)
        if own in self._names(folder.removeprefix(f"{self.state}/")):
            return
        draft = f"{folder}/draft-{uuid.uuid4().hex}"
        with self.system.open_output_stream(draft) as f:
            f.write(value.encode())
        self.system.move(draft, f"{folder}/{own}")

    def _remove(self, name: str) -> None:
        try:
            self.system.delete_file(f"{self.state}/{name}")
        except FileNotFoundError:  # another run of the task was first
            pass


class FolderEvents(DataSource):
    """``spark.readStream.format("folder_events").option("path", root).option("state", shared).load()``; options: recursive, existing (report what is there at the start), since (ns of the start; files written later
    are events), depth (levels
    whose folders are partitions of their own)."""

    @classmethod
    def name(cls) -> str:
        return "folder_events"

    def schema(self) -> str:
        return "event_type string, file_path string, dest_path string, is_directory boolean, ts timestamp"

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)
