"""A worktree as a file manifest, and small text sources that configure a run."""

from __future__ import annotations

import hashlib
import os
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.storage import kept


#: Folders that one task lists, bytes that one task reads, and bytes read at once.
FOLDERS_A_TASK, BYTES_A_TASK, AT_ONCE = 64, 256 << 20, 1 << 20


def _opened(root: str):
    """A file system and the path in it; ``root`` is a path that every executor sees, or a URI that pyarrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _entries(files, folder: str):
    """(name, is a folder, size) of what a folder holds; symbolic links and other special files are passed over."""
    from pyarrow import fs

    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(folder) as held:
            for e in held:
                if not e.is_symlink() and (e.is_dir() or e.is_file()):
                    yield e.name, e.is_dir(), 0 if e.is_dir() else e.stat().st_size
    else:
        for e in files.get_file_info(fs.FileSelector(folder)):
            if e.type in (fs.FileType.File, fs.FileType.Directory):
                yield e.base_name, e.type == fs.FileType.Directory, e.size or 0


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, size_bytes) of the regular files below ``root`` that are not ignored, empty ones included.

    Tasks list the folders, level by level; the folders of a level are a table, and the driver sees their number only.
    An ignored folder is never opened. One folder is listed by one task, whatever it holds.
    """

    def look(batches):
        files, base = _opened(root)
        for batch in batches:
            rows = [(f"{inside}/{name}".removeprefix("/"), folder, size) for inside in batch.column(0).to_pylist() for name, folder, size in _entries(files, f"{base.rstrip('/')}/{inside}" if inside else base)]
            for at in range(0, len(rows), 10_000):
                some = rows[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), (pa.string(), pa.bool_(), pa.int64()), strict=True)], ["file_path", "is_folder", "size_bytes"])

    found = []
    folders, n = spark.createDataFrame([("",)], "file_path string"), 1
    while n:
        level = folders.repartition(-(-n // FOLDERS_A_TASK), "file_path").mapInArrow(look, "file_path string, is_folder boolean, size_bytes long")
        # What a folder's name and a slash make ignored is ignored with all below it.
        path = F.when(F.col("is_folder"), F.concat("file_path", F.lit("/"))).otherwise(F.col("file_path"))
        level = kept(level.where(~text.is_ignored(path) & ~text.is_ignored(F.col("file_path"))), "level")
        found.append(level.where("NOT is_folder").select("file_path", "size_bytes"))
        folders = level.where("is_folder").select("file_path")
        n = folders.count()
    return reduce(DataFrame.unionByName, found)


def _read(root: str, content: bool):
    def read(batches):
        files, base = _opened(root)
        for batch in batches:
            for inside in batch.column(0).to_pylist():
                digest, size, held = hashlib.sha256(), 0, []
                with files.open_input_stream(f"{base.rstrip('/')}/{inside}") as source:
                    while piece := source.read(AT_ONCE):
                        if b"\x00" in piece:
                            break
                        digest.update(piece)
                        size += len(piece)
                        if content:
                            held.append(piece)
                    else:
                        row = [inside], [digest.hexdigest()], pa.array([size], pa.int64())
                        yield pa.RecordBatch.from_arrays([*map(pa.array, row), *([pa.array([b"".join(held)], pa.binary())] if content else [])], ["file_path", "content_sha256", "size_bytes", *(["content"] if content else [])])

    return read


def manifest(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(file_path, content_sha256, size_bytes, flags, and content if asked): files that are text, not ignored.

    A file with a NUL byte is left out; it is read up to the first one only. Files are dealt to tasks by their
    number and size, and read in pieces: without ``content`` a file of any size takes the memory of one piece.
    """
    files = listing(spark, root)
    total = files.agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes")).first()
    tasks = max(1, -(-(total["bytes"] or 0) // BYTES_A_TASK), min(total["n"], 2 * spark.sparkContext.defaultParallelism))
    schema = "file_path string, content_sha256 string, size_bytes long" + (", content binary" if content else "")
    return with_flags(files.select("file_path").repartition(tasks, "file_path").mapInArrow(_read(root, content), schema))


def with_flags(files: DataFrame) -> DataFrame:
    path = F.col("file_path")
    return files.withColumns(
        {
            "language": text.language(path),
            "is_generated": text.is_generated(path),
            "is_vendor": text.is_vendor(path),
            "is_test": text.is_test(path),
        }
    )


def revision(root: str, name: str = "HEAD") -> str:
    """HEAD as the commit it names, read from the folder of the repository; any other name as it is."""
    if name != "HEAD":
        return name
    git = Path(root) / ".git"
    head = (git / "HEAD").read_text().strip()
    if not head.startswith("ref: "):
        return head
    ref = head.removeprefix("ref: ")
    loose = git / ref
    if loose.exists():
        return loose.read_text().strip()
    packed = git / "packed-refs"
    for line in packed.read_text().splitlines() if packed.exists() else []:
        commit, _, found = line.partition(" ")
        if found == ref:
            return commit
    raise ValueError(f"{ref} has no commit")


def env_values(content: str) -> dict[str, str]:
    """``key=value`` lines; blank lines and comments drop, a line without ``=`` raises with its number."""
    out = {}
    for number, raw in enumerate(content.splitlines(), 1):
        line = raw.strip()
        if line and not line.startswith("#"):
            key, found, value = line.partition("=")
            if not found:
                raise ValueError(f"line {number} has no value")
            out[key.strip()] = value.strip()
    return out
