"""Source trees as a Spark data source: ``spark.read.format("source_tree").load(root)``.

Partitions are folders. Planning lists only as many as it needs to have work for all tasks, and each task
lists its folder further down and reads what it finds there. Ignored folders are never listed, nor are
folders outside a pushed filter on rel_path; files outside pushed filters on rel_path and language are
never opened. Filters are pushed where the session allows it for Python sources.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from graphloom.schemas import EXTENSIONS, IGNORED

SCHEMA = "rel_path string, language string, size_bytes long, content string"
#: Folders that planning aims at, and bytes of contents in one batch (or one larger file).
FOLDERS, BATCH_BYTES = 256, 16 << 20
LANGUAGES = {x: language for language, names in EXTENSIONS.items() for x in names}


@dataclass
class Folder(InputPartition):
    """A folder below the root ('' is the root), with or without what lies below it."""

    path: str
    deep: bool

    def __post_init__(self):
        self.value = self.path


@dataclass
class Wanted:
    """Conjunction of pushed filters on rel_path and language."""

    paths: list[set[str]] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    suffixes: list[str] = field(default_factory=list)
    languages: list[set[str]] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Adds a filter; False if it is none of those that are known here."""
        column = f.attribute if hasattr(f, "attribute") else ()
        if column == ("rel_path",) and isinstance(f, (EqualTo, In)):
            self.paths.append({f.value} if isinstance(f, EqualTo) else set(f.value))
        elif column == ("rel_path",) and isinstance(f, StringStartsWith):
            self.prefixes.append(f.value)
        elif column == ("rel_path",) and isinstance(f, StringEndsWith):
            self.suffixes.append(f.value)
        elif column == ("language",) and isinstance(f, (EqualTo, In)):
            self.languages.append({f.value} if isinstance(f, EqualTo) else set(f.value))
        else:
            return False
        return True

    def folder(self, path: str) -> bool:
        """Whether files that pass may lie below this folder."""
        below = path + "/" if path else ""
        return all(any(p is not None and p.startswith(below) for p in some) for some in self.paths) and all(below.startswith(p) or p.startswith(below) for p in self.prefixes)

    def file(self, path: str, language: str) -> bool:
        return (
            all(path in some for some in self.paths)
            and all(path.startswith(p) for p in self.prefixes)
            and all(path.endswith(s) for s in self.suffixes)
            and all(language in some for some in self.languages)
        )


class SourceTreeReader(DataSourceReader):
    def __init__(self, root: str, contents: bool, folders: int):
        self.root, self.contents, self.folders, self.wanted = root, contents, folders, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def _open(self) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        return system, base.rstrip("/") or "/"

    def _list(self, system: fs.FileSystem, base: str, path: str) -> tuple[list[str], list[fs.FileInfo]]:
        """Folders and files directly in a folder, without what is ignored or not wanted, in order of name."""
        folders, files = [], []
        for info in sorted(system.get_file_info(fs.FileSelector(posixpath.join(base, path) if path else base)), key=lambda i: i.base_name):
            rel = posixpath.join(path, info.base_name)
            if info.type == fs.FileType.Directory:
                if not (not path and info.base_name in IGNORED) and self.wanted.folder(rel) and not _is_link(system, info.path):
                    folders.append(rel)
            elif (language := language_of(rel)) is not None and self.wanted.file(rel, language):
                files.append(info)
        return folders, files

    def partitions(self) -> list[Folder]:
        system, base = self._open()
        done, ready = [], [""]
        while ready and len(done) + len(ready) < self.folders:
            below = []
            for path in ready:
                folders, files = self._list(system, base, path)
                below += folders
                if files:
                    done.append(Folder(path, False))
            ready = below
        return [*done, *(Folder(path, True) for path in ready)] or [Folder("", False)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, base = self._open()
        held: list[tuple] = []
        size, waiting = 0, [partition.path]
        while waiting:
            folders, files = self._list(system, base, waiting.pop())
            if partition.deep:
                waiting += reversed(folders)
            for info in files:
                rel = info.path[len(base) :].lstrip("/")
                text = None
                if self.contents:
                    with system.open_input_file(info.path) as stream:
                        data = stream.read()
                    try:
                        text = data.decode("utf-8")
                    except UnicodeDecodeError as e:
                        raise ValueError(f"not UTF-8: {rel}") from e
                held.append((rel, language_of(rel), info.size, text))
                size += info.size
                if size >= BATCH_BYTES:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)


def language_of(path: str) -> str | None:
    """Language by extension, case-sensitive, as ``tree.language_of`` finds it; None for unsupported files."""
    name = posixpath.basename(path)
    return LANGUAGES.get(name.rpartition(".")[2]) if "." in name else None


def _is_link(system: fs.FileSystem, path: str) -> bool:
    """Whether a local folder is a link: those are not followed, since they may lead back."""
    return isinstance(system, fs.LocalFileSystem) and os.path.islink(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["rel_path", "language", "size_bytes", "content"])


class SourceTree(DataSource):
    """Options: path (the root, on a file system that all executors see), contents (default true; false leaves content null and opens no file), folders."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SourceTreeReader:
        return SourceTreeReader(self.options["path"], self.options.get("contents", "true").lower() == "true", int(self.options.get("folders", FOLDERS)))
