"""Bundles, result pages and notes as Spark data sources: a partition a file, options drop rows before they are made.

Files are listed and read by pyarrow.fs, so paths may be local, HDFS, S3 or GCS; the driver reads none.
What to read is said by options: filters that Spark pushes into a Python source stay with the
relation, and another query over it would miss rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.shipping import ship
from quarry.sources import cve, stix

_NOTE = "id string, title string, tlp string, trust_tier int, techniques array<string>, secret_terms array<string>, text string"
_ROWS = 2000


def _columns(fields: str) -> str:
    """The fields of a struct type as columns: a colon becomes a blank where no bracket is open."""
    out, depth = [], 0
    for c in fields:
        depth += (c == "<") - (c == ">")
        out.append(" " if c == ":" and not depth else c)
    return "".join(out)


def _opened(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))


def listed(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """A file itself, or a folder's files of these suffixes, by name; those whose names begin with . or _ are left out."""
    from pyarrow import fs

    system, where = _opened(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(where)] if path.endswith(where) else path.split("://")[0] + "://"
    if info.type == fs.FileType.File:
        return [prefix + info.path]
    found = system.get_file_info(fs.FileSelector(where))
    return sorted(prefix + x.path for x in found if x.type == fs.FileType.File and x.base_name.endswith(suffixes) and x.base_name[0] not in "._")


def _batch(rows: list[dict], kind: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch; most objects have few of the fields, so columns that none has are not looked up."""
    held = frozenset().union(*rows)
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) if f.name in held else pa.nulls(len(rows), f.type) for f in kind], schema=kind)


@dataclass
class File(D.InputPartition):
    path: str


class _Reader(D.DataSourceReader):
    """Reads a partition's file, drops rows that the options exclude, and sends the rest by Arrow."""

    suffixes: tuple[str, ...] = (".json",)
    dated: str | None = None

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.suffixes = (options["suffix"],) if options.get("suffix") else self.suffixes
        self.only = {k: frozenset(map(str, v)) for k, v in json.loads(options.get("only") or "{}").items()}
        self.since, self.before = options.get("from"), options.get("before")
        if unknown := set(self.only) - set(schema.names):
            raise ValueError(f"no columns {sorted(unknown)}")
        if (self.since or self.before) and not self.dated:
            raise ValueError("rows of this source have no date")

    def wanted(self, row: dict) -> bool:
        if any(row.get(k) is None or str(row[k]) not in v for k, v in self.only.items()):
            return False
        if not (self.since or self.before):
            return True
        at = row.get(self.dated)
        return at is not None and (not self.since or at >= self.since) and (not self.before or at < self.before)

    def partitions(self) -> list[D.InputPartition]:
        return [File(p) for p in listed(self.path, self.suffixes)] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, where = _opened(partition.path)
        with system.open_input_file(where) as f:
            content = f.read()
        kind, held = to_arrow_schema(self.schema), []
        for row in self.rows(content, partition.path):
            if self.wanted(row):
                held.append(row)
                if len(held) == _ROWS:
                    yield _batch(held, kind)
                    held = []
        if held:
            yield _batch(held, kind)

    def rows(self, content: bytes, path: str) -> Iterator[dict]:
        raise NotImplementedError


class _Stix(_Reader):
    def rows(self, content: bytes, path: str) -> Iterator[dict]:
        bundle = json.loads(content)
        if bundle.get("type") != "bundle":
            raise ValueError(f"{path} is no bundle")
        for pos, o in enumerate(bundle.get("objects") or []):
            yield {"pos": pos, **o}


class _Pages(_Reader):
    dated = "published"

    def rows(self, content: bytes, path: str) -> Iterator[dict]:
        for v in json.loads(content).get("vulnerabilities") or []:
            if v.get("cve") is not None:
                yield v["cve"]


class _Notes(_Reader):
    suffixes = (".yaml", ".yml")

    def rows(self, content: bytes, path: str) -> Iterator[dict]:
        import yaml

        from quarry.operators.access import TLP

        seen = set()
        for row in (yaml.load(content, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}).get("notes") or []:
            if missing := [k for k in ("id", "title", "tlp", "trust_tier", "text") if row.get(k) is None]:
                raise ValueError(f"note {row.get('id')!r} of {path} lacks {missing}")
            if row["tlp"] not in TLP:
                raise ValueError(f"note {row['id']!r} of {path} has unknown classification {row['tlp']!r}")
            if row["id"] in seen:
                raise ValueError(f"note {row['id']!r} appears twice in {path}")
            seen.add(row["id"])
            yield {**row, "trust_tier": int(row["trust_tier"]), "techniques": list(row.get("techniques") or []), "secret_terms": list(row.get("secret_terms") or [])}


class _Source(D.DataSource):
    """Options: path; suffix, of the files to read in a folder; only, a JSON object of columns and the values to keep; from and before, the dates to keep, as they are written."""

    reads: type[_Reader]
    kind: str

    def schema(self) -> str:
        return self.kind

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return self.reads(schema, dict(self.options))


class StixSource(_Source):
    """Objects of bundles, with pos, their place in their bundle."""

    reads = _Stix
    kind = "pos int, " + _columns(stix.SCHEMA.partition("array<struct<")[2].removesuffix(">>"))

    @classmethod
    def name(cls) -> str:
        return "stix"


class NvdSource(_Source):
    """Records of cached result pages."""

    reads = _Pages
    kind = _columns(cve.RECORD.removeprefix("struct<").removesuffix(">"))

    @classmethod
    def name(cls) -> str:
        return "nvd"


class NotesSource(_Source):
    """Internal notes; classification and tier have no defaults."""

    reads = _Notes
    kind = _NOTE

    @classmethod
    def name(cls) -> str:
        return "notes"


def register(spark: SparkSession) -> None:
    """Make spark.read.format("stix"), "nvd" and "notes" known to the session."""
    ship(spark)
    for source in (StixSource, NvdSource, NotesSource):
        spark.dataSource.register(source)
