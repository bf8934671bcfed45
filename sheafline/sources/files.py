"""A directory tree as a table: a Python data source that keeps names Spark's own readers hide."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.classify import decoded
from ..operators.paths import DEFAULT_IGNORE, path_regex

HEAD_BYTES = 8192


class _Chunk(InputPartition):
    def __init__(self, files: list[tuple[int, str, int]]):
        super().__init__(None)
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = schema.fieldNames()
        self.root = os.path.abspath(options["path"])
        self.hidden = options.get("hidden", "true").lower() == "true"
        self.prune = set(filter(None, options.get("prune", ".git,node_modules").split(",")))
        ignore = [p for p in options.get("ignore", "").split("\n") if p] + (list(DEFAULT_IGNORE) if options.get("noise", "keep") == "drop" else [])
        self.ignore = re.compile("|".join(f"(?:{path_regex(p)})" for p in ignore)) if ignore else None
        self.bytes_per_task = int(options.get("bytesPerTask", 64 << 20))
        self.max_bytes = int(options["maxBytes"]) if "maxBytes" in options else None

    def _walk(self) -> Iterator[tuple[str, int]]:
        for base, dirs, names in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if d not in self.prune and (self.hidden or not d.startswith(".")))
            for n in sorted(names):
                full = os.path.join(base, n)
                rel = os.path.relpath(full, self.root).replace(os.sep, "/")
                if (self.hidden or not n.startswith(".")) and not (self.ignore and self.ignore.search(rel)) and os.path.isfile(full):
                    yield rel, os.path.getsize(full)

    def partitions(self) -> Sequence[InputPartition]:
        chunks, current, used = [], [], 0
        for k, (rel, size) in enumerate(self._walk()):
            if current and (used + size > self.bytes_per_task or len(current) >= 10_000):
                chunks.append(_Chunk(current))
                current, used = [], 0
            current.append((k, rel, size))
            used += size
        return [*chunks, _Chunk(current)] if current or not chunks else chunks

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for k, rel, size in partition.files:
            row: dict[str, object] = {"ord": k, "path": rel, "size": size, "head": None, "content": None, "error": None}
            try:
                if "content" in self.columns and (self.max_bytes is None or size <= self.max_bytes):
                    with open(os.path.join(self.root, rel), "rb") as f:
                        row["content"] = f.read()
                    row["head"] = row["content"][:HEAD_BYTES]
                elif "head" in self.columns:
                    with open(os.path.join(self.root, rel), "rb") as f:
                        row["head"] = f.read(HEAD_BYTES)
            except OSError as e:
                row["error"] = type(e).__name__
            yield tuple(row[c] for c in self.columns)


class TreeSource(DataSource):
    """``spark.read.format("tree").option("path", dir)``.

    The ``read`` option says what is opened: ``list`` (names and sizes only), ``head``
    (the first 8 KiB) or ``content``. Other options: ``hidden``, ``prune`` (directories
    never entered), ``ignore`` (patterns, one a line), ``noise=drop``, ``maxBytes`` and
    ``bytesPerTask``.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        mode = self.options.get("read", "content")
        bodies = {"list": "", "head": ", head BINARY", "content": ", head BINARY, content BINARY"}[mode]
        return f"ord BIGINT, path STRING, size BIGINT{bodies}, error STRING"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(schema, self.options)


#: Characters of ignore files that a scan may gather; rules are few beside what they rule.
MOST_RULES = 16_000_000


def ignore_sources(tree: DataFrame) -> list[tuple[str, str]]:
    """``(directory, text)`` of the ignore files in a tree read with its content, outer ones first (S2), for :func:`ignore_rules`."""
    name = F.element_at(F.split("path", "/"), -1)
    found = tree.where((name == ".gitignore") & F.col("content").isNotNull()).select("path", decoded("content").alias("text"))
    size = found.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MOST_RULES:
        raise ValueError(f"{size} characters of ignore rules")
    return sorted(((r.path.rpartition("/")[0], r.text) for r in found.collect()), key=lambda x: (x[0].count("/") + bool(x[0]), x[0]))
