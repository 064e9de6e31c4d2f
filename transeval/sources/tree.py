"""Sample trees as a data source: one row per file, one file per row.

    <root>/<dataset>/<model>/<source>/<target>/temperature_T[-sanitized]/<task>/<idx><ext>

Reading: the driver lists the configuration folders, and only those that the filters on the
configuration leave. Each is a few partitions; a task lists the configuration's task folders
and reads the files of its share of them, empty ones too.

Writing: a task writes its files into a folder of its own attempt. The driver publishes the
attempts that Spark has accepted, one for each partition, by renaming; what a failed or
doubled attempt has written is removed, and never seen at its place. A file that is there
already is replaced, so a job that is run again leaves what one run leaves.

Files are reached through ``pyarrow.fs``: a mount that all machines have, or a store that
Arrow knows by its address.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

NAME = "sample_tree"
CFG = ["dataset", "model", "source_lang", "target_lang", "temperature", "stage"]
COLUMNS = [*CFG, "identifier", "task_id", "completion_id", "solution"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
PREFIX, SANITIZED = "temperature_", "-sanitized"
#: Partitions of one configuration, rows and bytes of one batch.
SLICES, BATCH_ROWS, BATCH_BYTES = 8, 256, 8 << 20
ASIDE = "_temporary"


def opened(root: str) -> tuple[afs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    if root.startswith("file:"):
        return afs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    if "://" not in root:
        return afs.LocalFileSystem(), root.rstrip("/")
    return afs.FileSystem.from_uri(root)


def names(fs: afs.FileSystem, path: str, kind: afs.FileType) -> list[str]:
    """Names of the files, or of the folders, directly inside a folder."""
    return sorted(i.base_name for i in fs.get_file_info(afs.FileSelector(path, allow_not_found=True)) if i.type == kind and i.base_name != ASIDE)


@dataclass
class Share(InputPartition):
    """A share of the task folders of one configuration."""
    folder: str
    config: tuple[str, ...]
    no: int
    of: int

    def has(self, task: str) -> bool:
        return zlib.crc32(task.encode()) % self.of == self.no


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.ext = options["path"], options["ext"]
        self.whole = options.get("level", "tree") == "tree"
        self.slices = int(options.get("slices", SLICES))
        self.allowed: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]):
        """Filters on the configuration choose folders; the others are Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in CFG and self.whole:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                known = self.allowed.get(f.attribute[0], values)
                self.allowed[f.attribute[0]] = known & values
            else:
                yield f

    def _fits(self, column: str, value: str) -> bool:
        return column not in self.allowed or value in self.allowed[column]

    def configurations(self) -> list[tuple[str, tuple[str, ...]]]:
        fs, root = opened(self.root)
        if not self.whole:
            return [(root, ("",) * len(CFG))]
        found: list[tuple[str, tuple[str, ...]]] = [(root, ())]
        for column in CFG[:4]:
            found = [(f"{path}/{n}", (*config, n)) for path, config in found for n in names(fs, path, afs.FileType.Directory) if self._fits(column, n)]
        out = []
        for path, config in found:
            for n in names(fs, path, afs.FileType.Directory):
                if n.startswith(PREFIX):
                    value = n.removeprefix(PREFIX)
                    stage = "sanitized" if value.endswith(SANITIZED) else "raw"
                    value = value.removesuffix(SANITIZED)
                    if self._fits("temperature", value) and self._fits("stage", stage):
                        out.append((f"{path}/{n}", (*config, value, stage)))
        return out

    def partitions(self) -> list[Share]:
        shares = [Share(path, config, i, self.slices) for path, config in self.configurations() for i in range(self.slices)]
        return shares or [Share("", ("",) * len(CFG), 0, 0)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if not partition.of:
            return
        fs, _ = opened(self.root)
        rows: list[tuple] = []
        size = 0
        for task in names(fs, partition.folder, afs.FileType.Directory):
            if not partition.has(task):
                continue
            for name in names(fs, f"{partition.folder}/{task}", afs.FileType.File):
                if not name.endswith(self.ext):
                    continue
                path = f"{partition.folder}/{task}/{name}"
                with fs.open_input_stream(path) as f:
                    text = f.read().decode("utf-8", "replace")
                rows.append((*partition.config, path, task, name.split(".")[0], text))
                size += len(text)
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=COLUMNS)


@dataclass
class Attempt(WriterCommitMessage):
    """What one attempt has written: its folder, and how many files."""
    folder: str
    files: int


class TreeWriter(DataSourceArrowWriter):
    """Rows of (file, solution), ``file`` below the root."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.aside = f"{ASIDE}/{uuid.uuid4().hex}"
        fs, root = opened(self.root)
        fs.create_dir(f"{root}/{self.aside}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        fs, root = opened(self.root)
        folder = f"{root}/{self.aside}/{uuid.uuid4().hex}"
        made: set[str] = set()
        n = 0

        def make(path: str) -> None:
            # not beyond the job's own folder: it is gone once the job has been given up, and
            # an attempt that is still at work then fails instead of writing it anew
            if path not in made:
                if path != folder:
                    make(path.rpartition("/")[0])
                fs.create_dir(path, recursive=False)
                made.add(path)

        for batch in iterator:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("solution").to_pylist(), strict=True):
                if file is None or text is None:
                    raise ValueError(f"a sample without a name or a text: {file}")
                if any(p in ("", ".", "..") for p in file.split("/")):
                    raise ValueError(f"not a name below the root: {file}")
                make(f"{folder}/{file}".rpartition("/")[0])
                with fs.open_output_stream(f"{folder}/{file}") as f:
                    f.write(text.encode())
                n += 1
        return Attempt(folder, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, root = opened(self.root)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: publish(fs, m.folder, root), [m for m in messages if m is not None and m.files]))
        self._clean(fs, root)

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clean(*opened(self.root))

    def _clean(self, fs: afs.FileSystem, root: str) -> None:
        info = fs.get_file_info(f"{root}/{self.aside}")
        if info.type == afs.FileType.Directory:
            fs.delete_dir(info.path)
        if fs.get_file_info(f"{root}/{ASIDE}").type == afs.FileType.Directory and not fs.get_file_info(afs.FileSelector(f"{root}/{ASIDE}")):
            fs.delete_dir(f"{root}/{ASIDE}")


def publish(fs: afs.FileSystem, source: str, target: str) -> None:
    """Move all files below ``source`` to the same places below ``target``, over what is there."""
    for info in fs.get_file_info(afs.FileSelector(source)):
        place = f"{target}/{info.base_name}"
        if info.type == afs.FileType.Directory:
            fs.create_dir(place)
            publish(fs, info.path, place)
        else:
            if fs.get_file_info(place).type == afs.FileType.File and not isinstance(fs, afs.LocalFileSystem):
                fs.delete_file(place)
            fs.move(info.path, place)


class SampleTree(DataSource):
    """``spark.read.format("sample_tree")`` with options ``path``, ``ext`` (of the files that
    are samples), ``level`` (``tree``, or ``configuration`` where the path is one) and
    ``slices``; writing needs ``path`` and the columns file and solution."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("a sample tree is appended to: files of the same name are replaced")
        if schema.fieldNames() != ["file", "solution"]:
            raise ValueError(f"columns file and solution are written, not {schema.fieldNames()}")
        return TreeWriter(dict(self.options))
