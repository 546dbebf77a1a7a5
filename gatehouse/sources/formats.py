"""Spark data sources: a folder with access rules (batch and stream), and the listing of a drive.

    spark.read.format("gatehouse_folder").option("root", "/docs").load()
    spark.readStream.format("gatehouse_folder").option("root", "/docs").option("progress", "/state/docs.json").load()
    spark.read.format("gatehouse_drive").option("client", "package.module:make").load()

Folders and pages are listed on executors; the driver sees the upper folders
only. `register` makes the formats known to a session and lets it push
filters to Python sources; filters on uri prune folders.
"""

from __future__ import annotations

import base64
import heapq
import importlib
import json
import os
import time
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import quote

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from ..errors import SourceError
from . import filesystem as fs

FOLDER, DRIVE = "gatehouse_folder", "gatehouse_drive"
_SCHEMA = "document_id string, connector string, uri string, title string, version string, grants array<string>, denies array<string>, text string, error string"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, with the push-down of filters, which their readers take part in."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FolderSource, DriveSource):
        spark.dataSource.register(source)


@dataclass
class Share(D.InputPartition):
    """Folders that a task reads, each with or without those below it, and the part of the files that is its own."""

    folders: list[tuple[str, bool]]
    part: int = 0
    parts: int = 1
    after: tuple[int, str] | None = None
    upto: tuple[int, str] | None = None


@dataclass
class Folder:
    """What is read of a folder, and how it is dealt out."""

    root: str
    sidecar: str = fs.DIRECTORY_SIDECAR
    endings: tuple[str, ...] = fs.ENDINGS
    shares: int = 64
    parts: int = 1
    #: Uris that were filtered for: equal to one of these, or starting with all of those.
    equal: list[str] | None = None
    starts: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, options) -> Folder:
        if not options.get("root"):
            raise SourceError("a folder source needs the option root")
        root = Path(options["root"].removeprefix("file://")).expanduser().resolve()
        if not root.is_dir():
            raise SourceError("the root is not a directory")
        endings = tuple(e for e in options.get("endings", ",".join(fs.ENDINGS)).split(",") if e)
        return cls(str(root), options.get("sidecar", fs.DIRECTORY_SIDECAR), endings, int(options.get("shares", 64)), int(options.get("parts", 1)))

    def may_hold(self, folder: str) -> bool:
        """Whether what was filtered for may lie in or below a folder."""
        at = f"file://{quote(folder)}/"
        some = self.equal is None or any(u.startswith(at) for u in self.equal)
        return some and all(at.startswith(s) or s.startswith(at) for s in self.starts)

    def wanted(self, uri: str) -> bool:
        return (self.equal is None or uri in self.equal) and all(uri.startswith(s) for s in self.starts)

    def dealt(self, after: tuple[int, str] | None = None, upto: tuple[int, str] | None = None) -> list[Share]:
        """Shares of the tree: the driver goes down from the root until there are enough folders."""
        own, deep = [], [self.root]
        while deep and len(deep) < self.shares:
            own += deep
            deep = [e.path for d in deep for e in sorted(_entries(d), key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and self.may_hold(e.path)]
        all_ = [(d, False) for d in own] + [(d, True) for d in deep]
        groups = [g for g in (all_[i :: self.shares] for i in range(self.shares)) if g]
        return [Share(g, p, self.parts, after, upto) for g in groups for p in range(self.parts)]

    def rules_above(self, folder: str) -> str | None:
        """The sidecar that decides for a folder: its own, or that of the nearest one above it, up to the root."""
        at = Path(folder)
        for up in (at, *at.parents):
            if (own := up / self.sidecar).is_file():
                return str(own)
            if str(up) == self.root:
                return None
        return None

    def files(self, folder: str, deep: bool, rules: str | None | bool = True) -> Iterator[tuple[tuple[int, str], str, str | None, str]]:
        """((changed, path), path, deciding sidecar, version) of the documents of a folder. A document changes with its rules too."""
        rules = self.rules_above(folder) if rules is True else rules
        entries = {e.name: e for e in _entries(folder)}
        if self.sidecar in entries:
            rules = entries[self.sidecar].path
        for name in sorted(entries):
            e = entries[name]
            if e.is_dir(follow_symlinks=False):
                if deep and self.may_hold(e.path):
                    yield from self.files(e.path, True, rules)
            elif Path(name).suffix.lower() in self.endings and e.is_file():
                own = entries.get(name + fs.FILE_SIDECAR)
                deciding = own.path if own else rules
                version = e.stat().st_mtime_ns
                changed = max(version, os.stat(deciding).st_mtime_ns if deciding else 0)
                yield (changed, e.path), e.path, deciding, str(version)

    def rows(self, share: Share) -> Iterator[tuple]:
        parsed: dict[str, tuple[list[str], list[str]]] = {}
        for folder, deep in share.folders:
            for changed, path, rules, version in self.files(folder, deep):
                uri = f"file://{quote(path)}"
                if zlib.crc32(path.encode()) % share.parts != share.part or not self.wanted(uri):
                    continue
                if share.after and changed <= share.after or share.upto and changed > share.upto:
                    continue
                text = error = None
                try:
                    text = fs.path_of(uri, self.root).read_bytes().decode("utf-8", "replace")
                except (OSError, SourceError) as e:
                    error = type(e).__name__
                if rules and rules not in parsed:
                    parsed[rules] = _rules(rules, self.root)
                grants, denies = parsed[rules] if rules else ([], [])
                yield f"{fs.NAME}:{uri}", fs.NAME, uri, os.path.basename(path), version, grants, denies, text, error


def _entries(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            return list(found)
    except OSError:
        return []


def _rules(path: str, root: str) -> tuple[list[str], list[str]]:
    """Of a sidecar; nobody's, if it is malformed or can't be read."""
    try:
        return fs.parse_rules(fs.path_of(f"file://{quote(path)}", root).read_text(encoding="utf-8", errors="replace"))
    except (OSError, SourceError):
        return [], []


class FolderReader(D.DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """Takes equality with, membership of and prefixes of uris; others stay with Spark."""
        for f in filters:
            if isinstance(f, (D.EqualTo, D.In)) and f.attribute == ("uri",):
                values = [f.value] if isinstance(f, D.EqualTo) else list(f.value)
                self.folder.equal = [u for u in values if self.folder.equal is None or u in self.folder.equal]
            elif isinstance(f, D.StringStartsWith) and f.attribute == ("uri",):
                self.folder.starts.append(f.value)
            else:
                yield f

    def partitions(self) -> list[Share]:
        return self.folder.dealt() or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.folder.rows(partition)


class FolderStream(D.DataSourceStreamReader):
    """Documents as they change, in the order of change.

    An offset is the last change that was read: its time (of the file or of the
    rules that decide for it) and path. A batch has ``max_files`` changes at
    most, if ``progress`` names a file for the offset that was last done with;
    Spark tells a reader that starts again no offset before it asks for the
    latest one, so without the file a batch takes all there is. ``settle``: milliseconds for which a
    file must have been left alone. A deleted file isn't a change.
    """

    def __init__(self, folder: Folder, options):
        self.folder, self.progress = folder, options.get("progress")
        self.most = int(options.get("max_files", 1000)) if self.progress else None
        self.settle = int(options.get("settle", 1000)) * 1_000_000
        self.at = (0, "")
        if self.progress and os.path.exists(self.progress):
            self.at = _offset(json.loads(Path(self.progress).read_text()))

    def initialOffset(self) -> dict:
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:
        ready = time.time_ns() - self.settle
        changes = (c for c, *_ in self.folder.files(self.folder.root, True) if self.at < c and c[0] <= ready)
        # The smallest ones, of which no more than a batch are held.
        last = max(changes, default=None) if self.most is None else max(heapq.nsmallest(self.most, changes), default=None)
        self.at = last or self.at
        return {"changed": self.at[0], "path": self.at[1]}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        self.at = max(self.at, _offset(end))
        return self.folder.dealt(_offset(start), _offset(end)) or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        self.at = max(self.at, _offset(end))
        if self.progress:
            aside = f"{self.progress}.new"
            Path(aside).write_text(json.dumps(end))
            os.replace(aside, self.progress)


def _offset(of: dict) -> tuple[int, str]:
    return int(of["changed"]), of["path"]


class FolderSource(D.DataSource):
    """Options: root; sidecar, endings (comma-separated), shares (tasks, about), parts (tasks that divide each folder's files)."""

    @classmethod
    def name(cls) -> str:
        return FOLDER

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(Folder.of(self.options))

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(Folder.of(self.options), self.options)


def client_option(make) -> str:
    """What makes a client, as the value of an option: it is sent to executors and holds no credentials itself."""
    return "pickle:" + base64.b64encode(cloudpickle.dumps(make)).decode()


def client_of(option: str):
    """The client that an option's maker makes: ``package.module:name``, or of `client_option`."""
    if option.startswith("pickle:"):
        return cloudpickle.loads(base64.b64decode(option.removeprefix("pickle:")))()
    module, _, name = option.partition(":")
    return getattr(importlib.import_module(module), name)()


@dataclass
class Listed(D.InputPartition):
    mime: str


class DriveReader(D.DataSourceReader):
    """Pages are asked for by tasks, one for each MIME type, and yielded as they come; each names the next one."""

    def __init__(self, client: str, types: list[str]):
        self.client, self.types = client, types

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if isinstance(f, (D.EqualTo, D.In)) and f.attribute == ("mime",):
                values = [f.value] if isinstance(f, D.EqualTo) else list(f.value)
                self.types = [t for t in self.types if t in values]
            else:
                yield f

    def partitions(self) -> list[Listed]:
        return [Listed(t) for t in self.types] or [Listed("")]

    def read(self, partition: Listed) -> Iterator[tuple]:
        from . import drive

        if not partition.mime:
            return
        path, parameters = drive.FILES
        asked = parameters | {"q": f"mimeType={partition.mime!r} and trashed=false"}
        for page in drive.answers(client_of(self.client), path, asked):
            files = json.loads(page)
            files = files.get("files") if isinstance(files, dict) else None
            if not isinstance(files, list) or not all(isinstance(f, dict) for f in files):
                raise SourceError("drive: the listing is malformed")
            for f in files:
                if f.get("id") and f.get("mimeType", partition.mime) == partition.mime:
                    kind = "document" if partition.mime == drive.DOCUMENT_TYPE else "file"
                    yield f"{drive.PREFIX}{kind}/{f['id']}", f.get("name") or f["id"], f.get("modifiedTime") or None, partition.mime, kind, f["id"]


class DriveSource(D.DataSource):
    """Options: client (see `client_of`)."""

    @classmethod
    def name(cls) -> str:
        return DRIVE

    def schema(self) -> str:
        return "uri string, title string, version string, mime string, kind string, id string"

    def reader(self, schema) -> DriveReader:
        from . import drive

        if not self.options.get("client"):
            raise SourceError("a drive source needs the option client")
        return DriveReader(self.options["client"], [drive.DOCUMENT_TYPE, *drive.TEXT_TYPES])
