"""Directory trees of notes as Spark data sources: ``vault`` (batch) and ``vault_changes`` (stream).

The built-in file source leaves out names that start with an underscore and
empty files, and its stream sees neither changes nor deletions; these do.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SUFFIX = ".md"


def glob_regex(pattern: str) -> str:
    """A relative glob as a regular expression on whole paths, matched from the right; ``**`` is one component."""
    parts = [fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z").replace(".*", "[^/]*").replace("[^/]*?", "[^/]") for p in pattern.strip("/").split("/") if p != "."]
    return r"^(?:.*/)?" + "/".join(re.sub(r"(?<![\\\]])\.(?![*\\])", "[^/]", p) for p in parts) + "$"


def glob_head(pattern: str) -> str:
    """A pattern without the slashes and asterisks at its end; paths that start so are left out as well."""
    return pattern.rstrip("/*")


def excluded(path: str, globs: list[str]) -> bool:
    """Hidden components anywhere, a glob, or a glob's head as a prefix."""
    p = PurePosixPath(path)
    return any(x.startswith(".") for x in p.parts) or any(p.match(g) or path.startswith(glob_head(g)) for g in globs)


def excluded_column(path: Column, globs: list[str]) -> Column:
    """The same as an expression, for tables of paths."""
    out = F.exists(F.split(path, "/"), lambda x: F.startswith(x, F.lit(".")))
    for g in globs:
        out = out | F.rlike(path, F.lit(glob_regex(g))) | F.startswith(path, F.lit(glob_head(g)))
    return out


def listing(root: str, globs: list[str]) -> list[tuple[str, float]]:
    """Relative paths and modification times, by path components. Only metadata is read here."""
    out = []
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if not n.startswith(".")]
        for name in files:
            if name.endswith(SUFFIX):
                full = os.path.join(folder, name)
                rel = os.path.relpath(full, root)
                if not excluded(rel, globs):
                    out.append((rel, os.stat(full).st_mtime))
    return sorted(out, key=lambda x: x[0].split("/"))


class _Files(InputPartition):
    def __init__(self, root: str, files: list[tuple[int, str, float]]) -> None:
        self.root, self.files = root, files


class VaultReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.globs = options["path"], json.loads(options.get("exclude", "[]"))
        self.per = int(options.get("filesPerPartition", 256))
        some = [options["file"]] if "file" in options else json.loads(options["files"]) if "files" in options else None
        self.some: list[str] | None = some

    def partitions(self) -> list[InputPartition]:
        found = listing(self.root, self.globs) if self.some is None else [(p, os.stat(os.path.join(self.root, p)).st_mtime) for p in self.some]
        files = [(i, p, m) for i, (p, m) in enumerate(found)]
        return [_Files(self.root, files[i : i + self.per]) for i in range(0, len(files), self.per)] or [_Files(self.root, [])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for seq, path, mtime in partition.files:
            try:
                with open(os.path.join(partition.root, path), encoding="utf-8") as f:  # text mode: line ends become \n
                    yield seq, path, mtime, f.read(), None
            except (OSError, UnicodeDecodeError) as e:
                yield seq, path, mtime, None, f"{path}: {e}"


class VaultSource(DataSource):
    """``spark.read.format('vault').load(root)``; options exclude (JSON list), file, files (JSON list), filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "seq long, path string, mtime double, text string, error string"

    def reader(self, schema) -> VaultReader:
        return VaultReader(dict(self.options))


class ChangeReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.globs = options["path"], json.loads(options.get("exclude", "[]"))

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = dict(listing(self.root, self.globs))
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = [(p, "added" if p not in start else "modified", m) for p, m in end.items() if start.get(p) != m]
        return iter(rows + [(p, "deleted", float(m)) for p, m in start.items() if p not in end])


class ChangeSource(DataSource):
    """``spark.readStream.format('vault_changes').load(root)``: path, kind (added, modified, deleted), mtime."""

    @classmethod
    def name(cls) -> str:
        return "vault_changes"

    def schema(self) -> str:
        return "path string, kind string, mtime double"

    def simpleStreamReader(self, schema) -> ChangeReader:
        return ChangeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    from marginalia.session import ship

    ship(spark)
    spark.dataSource.register(VaultSource)
    spark.dataSource.register(ChangeSource)
