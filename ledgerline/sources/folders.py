"""Folders of filings and of fund registries as Spark data sources: partitions of files by size, filters that choose files by name."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Files(InputPartition):
    """Files that one task reads: (folder or stem, name, path)."""

    files: list


@dataclass
class _Written(WriterCommitMessage):
    renames: list


class _FolderReader(DataSourceReader):
    """Files of a folder, grouped to partitions of about `maxPartitionBytes`; filters on the columns that their names tell choose among them."""

    def __init__(self, options: dict, named: tuple[str, ...], suffix: str):
        self.path, self.named, self.suffix = options["path"], named, suffix
        self.size = int(options.get("maxPartitionBytes", 8 << 20))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in self.named:
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, set(values)) & set(values)
            else:
                yield f

    def names(self, path: str) -> dict[str, str]:
        raise NotImplementedError

    def partitions(self) -> list[_Files]:
        store, base = _store(self.path)
        out, size = [[]], 0
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix) and not posixpath.basename(f.path).startswith((".", "_"))), key=lambda f: f.path):
            names = self.names(f.path)
            if any(names[k] not in v for k, v in self.wanted.items()):
                continue
            if out[-1] and size + f.size > self.size:
                out.append([])
                size = 0
            out[-1].append((names, f.path))
            size += f.size
        return [_Files(x) for x in out]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for names, path in partition.files:
            with store.open_input_stream(path) as f:
                yield from self.rows(names, f.read())

    def rows(self, names: dict[str, str], data: bytes) -> Iterator[tuple]:
        raise NotImplementedError


class _FilingReader(_FolderReader):
    def names(self, path: str) -> dict[str, str]:
        return {"form": posixpath.basename(posixpath.dirname(path)), "filing_id": posixpath.basename(path).removesuffix(self.suffix)}

    def rows(self, names, data):
        yield names["form"], names["filing_id"], data.decode("utf-8", "replace")


class _FilingWriter(DataSourceWriter):
    """One file a row, under a name of its own until the job commits: then all are renamed, and of a failed job none is seen."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> _Written:
        store, base = _store(self.path)
        renames = []
        for r in rows:
            if r["form"] is None or r["filing_id"] is None or "/" in r["form"] + r["filing_id"]:
                raise ValueError(f"no file name for {r['form']!r}, {r['filing_id']!r}")
            folder = f"{base}/{r['form']}"
            store.create_dir(folder, recursive=True)
            draft = f"{folder}/_{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as f:
                f.write((r["content"] or "").encode())
            renames.append((draft, f"{folder}/{r['filing_id']}.html"))
        return _Written(renames)

    def commit(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for draft, final in m.renames if m else []:
                store.move(draft, final)

    def abort(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for draft, _ in m.renames if m else []:
                store.delete_file(draft)


class FilingFolder(DataSource):
    """path/<form>/<filing_id>.html as (form, filing_id, content). Filters on form and filing_id choose files before any is read."""

    @classmethod
    def name(cls) -> str:
        return "filing_folder"

    def schema(self) -> str:
        return "form string, filing_id string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _FilingReader(self.options, ("form", "filing_id"), ".html")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("filings are added, not overwritten")
        return _FilingWriter(self.options)


class _RegistryReader(_FolderReader):
    def names(self, path: str) -> dict[str, str]:
        return {"registry": posixpath.basename(path).removesuffix(self.suffix)}

    def rows(self, names, data):
        # One document after the other, each an object with `funds`, a list of funds, or a fund.
        text, at, decoder = data.decode("utf-8", "replace"), 0, json.JSONDecoder()
        while True:
            while at < len(text) and text[at].isspace():
                at += 1
            if at == len(text):
                return
            doc, at = decoder.raw_decode(text, at)
            funds = doc if isinstance(doc, list) else doc.get("funds", [doc]) if isinstance(doc, dict) else []
            for fund in funds:
                if isinstance(fund, dict) and fund.get("cik") is not None:
                    name = fund.get("name")
                    yield names["registry"], None if name is None else str(name), str(fund["cik"])


class RegistryFolder(DataSource):
    """path/<registry>.json as (registry, name, cik): files of any number of JSON documents; funds without a cik are left out."""

    @classmethod
    def name(cls) -> str:
        return "fund_registries"

    def schema(self) -> str:
        return "registry string, name string, cik string"

    def reader(self, schema) -> DataSourceReader:
        return _RegistryReader(self.options, ("registry",), ".json")


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilingFolder)
    spark.dataSource.register(RegistryFolder)
