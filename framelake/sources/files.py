"""Files as bytes through Python data sources: blocks of any file, digests in constant memory, and a sink that commits or leaves nothing.

``framelake_blocks`` cuts files into blocks, dealt to tasks by byte range, so that neither a huge file nor its content is ever one row;
``framelake_digests`` reads whole files in steps and hashes them as it goes; ``framelake_blobs`` writes ``path, content`` rows as files.
Places are local folders or URIs that Arrow's file systems open; ``sources.images`` falls back to Spark's reader for others.
"""

from __future__ import annotations

import fnmatch
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from framelake.session import ship_package

STEP_BYTES = 4 << 20  #: bytes of one block, and of one read
TASK_BYTES = 128 << 20  #: bytes that one task reads


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    """Whether Arrow can open the place at all."""
    try:
        place(path)
    except (pa.ArrowException, OSError, ValueError, NotImplementedError):
        return False
    return True


@dataclass
class Piece:
    """A range of one file."""

    path: str
    size: int
    modified: float
    start: int
    stop: int


@dataclass
class Pieces(InputPartition):
    """What one task reads."""

    pieces: list[Piece]


def listed(path: str, pattern: str) -> list[tuple[str, int, float]]:
    """Path, size and time of all files below a folder (or of the one file) whose name matches; hidden ones are left out."""
    system, root = place(path)
    info = system.get_file_info(root)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
    kept = []
    for f in found:
        below = f.path[len(root) :].split("/") if not info.is_file else []
        if f.is_file and fnmatch.fnmatch(f.base_name, pattern) and not any(part[:1] in ("_", ".") for part in below):
            kept.append((f.path, f.size, f.mtime.timestamp() if f.mtime else 0.0))
    return sorted(kept)


def dealt(pieces: Iterator[Piece], most: int) -> list[Pieces]:
    """Consecutive pieces, packed up to ``most`` bytes a task."""
    tasks, held = [Pieces([])], 0
    for p in pieces:
        if tasks[-1].pieces and held + p.stop - p.start > most:
            tasks.append(Pieces([]))
            held = 0
        tasks[-1].pieces.append(p)
        held += p.stop - p.start
    return tasks


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.step, self.most = int(options.get("stepbytes", STEP_BYTES)), int(options.get("taskbytes", TASK_BYTES))

    def partitions(self):
        return dealt((p for f in listed(self.path, self.pattern) for p in self.cut(*f)), self.most)

    def cut(self, path: str, size: int, modified: float) -> Iterator[Piece]:
        yield Piece(path, size, modified, 0, size)


class _BlockReader(_Reader):
    def cut(self, path, size, modified):
        span = max(1, self.most // self.step) * self.step
        for start in range(0, max(size, 1), span):
            yield Piece(path, size, modified, start, min(size, start + span))

    def read(self, partition: Pieces):
        system, _ = place(self.path)
        for p in partition.pieces:
            with system.open_input_file(p.path) as source:
                source.seek(p.start)
                for start in range(p.start, max(p.stop, p.start + 1), self.step):
                    content = source.read(min(self.step, p.stop - start))
                    yield (p.path, p.size, start // self.step, start, content)


class _DigestReader(_Reader):
    def read(self, partition: Pieces):
        system, _ = place(self.path)
        for p in partition.pieces:
            digest = hashlib.sha256()
            with system.open_input_stream(p.path) as source:
                while content := source.read(self.step):
                    digest.update(content)
            yield (p.path, p.size, datetime.fromtimestamp(p.modified, UTC), digest.hexdigest())


class FileBlocks(DataSource):
    """``uri, size, block, start, content``: every file in blocks; an empty file is one empty block."""

    @classmethod
    def name(cls):
        return "framelake_blocks"

    def schema(self):
        return "uri STRING, size BIGINT, block BIGINT, start BIGINT, content BINARY"

    def reader(self, schema):
        return _BlockReader(self.options)


class FileDigests(DataSource):
    """``uri, size, modified, sha256`` per file."""

    @classmethod
    def name(cls):
        return "framelake_digests"

    def schema(self):
        return "uri STRING, size BIGINT, modified TIMESTAMP, sha256 STRING"

    def reader(self, schema):
        return _DigestReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    """The files one task wrote, below its own temporary folder."""

    folder: str
    names: list[str]


class _BlobWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.waiting = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, root = place(self.path)
        folder = f"{root}/{self.waiting}/{uuid.uuid4().hex}"
        system.create_dir(folder)
        names, made = [], {folder}
        for batch in iterator:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if name is None or not content.is_valid:
                    raise ValueError("a file needs a path and content")
                if name.startswith(("/", "_", ".")) or any(part in ("", ".", "..") for part in name.split("/")):
                    raise ValueError(f"not a path below the folder: {name}")
                target = f"{folder}/{name}"
                if (above := target.rsplit("/", 1)[0]) not in made:
                    system.create_dir(above)
                    made.add(above)
                with system.open_output_stream(target) as out:
                    out.write(content.as_buffer())
                names.append(name)
        return Written(folder, names)

    def commit(self, messages):
        system, root = place(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same path")
        if self.overwrite:
            new = set(names)
            for path, _, _ in listed(root, "*"):
                if path.removeprefix(f"{root}/") not in new:
                    system.delete_file(path)
        made = set()
        for m in done:
            for name in m.names:
                target = f"{root}/{name}"
                if (above := target.rsplit("/", 1)[0]) not in made:
                    system.create_dir(above)
                    made.add(above)
                system.move(f"{m.folder}/{name}", target)
        self._clean(system, root)

    def abort(self, messages):
        system, root = place(self.path)
        self._clean(system, root)

    def _clean(self, system, root):
        folder = f"{root}/{self.waiting}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class FileBlobs(DataSource):
    """Sink for ``path, content`` rows: one file per row, all of them or none."""

    @classmethod
    def name(cls):
        return "framelake_blobs"

    def schema(self):
        return "path STRING, content BINARY"

    def writer(self, schema, overwrite):
        if sorted(schema.names) != ["content", "path"]:
            raise ValueError("rows must have the columns path and content")
        return _BlobWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the three formats known to a session and its workers."""
    ship_package(spark)
    for source in (FileBlocks, FileDigests, FileBlobs):
        spark.dataSource.register(source)
