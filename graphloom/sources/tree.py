"""Source trees: files of supported languages below a root, and changes between commits."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schemas import EXTENSIONS, IGNORED
from graphloom.sources.tree_source import SourceTree


def language_of(path: Column) -> Column:
    """Language by extension, case-sensitive; null for unsupported files."""
    extension = F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    out = F.when(F.lit(False), F.lit(""))
    for language, names in EXTENSIONS.items():
        out = out.when(extension.isin(names), F.lit(language))
    return out


def is_ignored(rel_path: Column) -> Column:
    """Whether the first part of a path is an ignored folder; deeper folders of these names count as sources."""
    return F.element_at(F.split(rel_path, "/"), 1).isin(IGNORED) & F.contains(rel_path, F.lit("/"))


def relative(path: Column, root: str) -> Column:
    """Path below the root, with forward slashes."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^file:/+", "/")
    return F.regexp_replace(plain, "^" + _quoted(root.rstrip("/")) + "/+", "")


def _quoted(text: str) -> str:
    return r"\Q" + text.removeprefix("file://").replace(r"\E", r"\E\\E\Q") + r"\E"


def source_tree(spark: SparkSession, root: str, contents: bool = True) -> DataFrame:
    """(rel_path, language, size_bytes, content) of every supported file below ``root``, by the data source of ``tree_source``.

    Contents that are not UTF-8 raise an error when they are read, so that a run never indexes half a
    file. Filters on rel_path and language of the result reach the listing: other files are not opened.
    Nothing is written; links to folders are not followed. An empty tree gives an empty result.
    """
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(SourceTree.name()).option("contents", contents).load(root)


def _git(repository: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repository, *args], capture_output=True, text=True)
    if done.returncode:
        raise ValueError(done.stderr.strip() or f"git {args[0]} failed in {repository}")
    return done.stdout


def resolve_commit(repository: str, reference: str) -> str:
    return _git(repository, "rev-parse", "--verify", f"{reference}^{{commit}}").strip()


def _diff(spark: SparkSession, lines: str) -> DataFrame:
    rows, parts = [], lines.split("\0")
    i = 0
    while i + 1 < len(parts):
        kind = parts[i][:1]
        moved = kind in "RC"
        rows.append((parts[i + 2] if moved else parts[i + 1], {"A": "added", "D": "deleted"}.get(kind, "modified")))
        i += 3 if moved else 2
    return spark.createDataFrame(rows, "path string, change_kind string")


def diff_commits(spark: SparkSession, repository: str, base: str, head: str) -> DataFrame:
    """(path, change_kind) between two commits; a renamed file is modified under its new path."""
    return _diff(spark, _git(repository, "diff", "--name-status", "-z", "-M", resolve_commit(repository, base), resolve_commit(repository, head)))


def diff_working_tree(spark: SparkSession, repository: str) -> DataFrame:
    """Changes of tracked files since the last commit; before the first commit every tracked file is added."""
    try:
        head = resolve_commit(repository, "HEAD")
    except ValueError:
        rows = [(p, "added") for p in _git(repository, "ls-files", "-z").split("\0") if p]
        return spark.createDataFrame(rows, "path string, change_kind string")
    return _diff(spark, _git(repository, "diff", "--name-status", "-z", "-M", head))


def canonical(path: str) -> str:
    """Absolute path with links and dots resolved."""
    return str(Path(path).resolve())
