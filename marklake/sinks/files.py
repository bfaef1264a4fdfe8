"""Single files on a file system that all executors share: one for each conversation, and media in parts.

Paths are those that pyarrow's file systems know (local or mounted folders, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SUFFIX = "_extracted"
STAGED, COMMITTED = "_staged-", "_committed"
#: Sub-folders by a hash of the id, so that no folder gets too long to list.
FOLDERS = 256


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path on it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _write(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    with fs.open_output_stream(path) as out:
        out.write(data)


def file_name(conv_id: str, part: int = 0) -> str:
    """``{id}_extracted.json`` below its sub-folder; further parts of a long conversation carry their number."""
    folder = int(hashlib.md5(conv_id.encode()).hexdigest()[:8], 16) % FOLDERS
    return f"{folder:02x}/{quote(conv_id, safe=' ')}{SUFFIX}{f'.{part}' if part else ''}.json"


@dataclass
class Attempt(WriterCommitMessage):
    """The folder in which a task that succeeded left its files."""

    folder: str


class ConversationFiles(DataSource):
    """Writes ``conv_id, part, value`` as a file for each row, below a staging folder until all tasks are done."""

    @classmethod
    def name(cls) -> str:
        return "marklake_conversation_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ConversationWriter(self.options["path"], self.options["job"])


class _ConversationWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str) -> None:
        self.path, self.job = path, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        fs, root = file_system(self.path)
        folder = f"{root}/{STAGED}{self.job}/{uuid.uuid4().hex}"
        made = set()
        for batch in iterator:
            for conv_id, part, value in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "value")), strict=True):
                name = file_name(conv_id, part)
                if name[:2] not in made:
                    fs.create_dir(f"{folder}/{name[:2]}", recursive=True)
                    made.add(name[:2])
                _write(fs, f"{folder}/{name}", value.encode())
        return Attempt(folder if made else "")

    def commit(self, messages: list) -> None:
        """From here on the attempts count: what was lost on the way to this point is not listed."""
        fs, root = file_system(self.path)
        fs.create_dir(f"{root}/{STAGED}{self.job}", recursive=True)
        done = sorted(m.folder.rsplit("/", 1)[-1] for m in messages if m is not None and m.folder)
        _write(fs, f"{root}/{STAGED}{self.job}/{COMMITTED}", "\n".join(done).encode())

    def abort(self, messages: list) -> None:
        fs, root = file_system(self.path)
        if fs.get_file_info(f"{root}/{STAGED}{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{STAGED}{self.job}")


def write_conversation_files(documents: DataFrame, path: str) -> None:
    """``{id}_extracted.json`` for each document (``conv_id[, part], ..``), in sub-folders by a hash of the id.

    Two phases: tasks write below a staging folder; when all have succeeded the job commits the list of their folders, and
    the files are moved to their places. Lost executors and repeated tasks thus leave no half-written or missing file, and
    a job that dies before the commit shows nothing. One that dies between commit and moves is completed by the next
    call. A file replaces the one that its id had; of repeated ids in one table either row counts. Ids must not be null.
    A file for each conversation is for readers that need it so; at many millions of documents use the line format.
    """
    spark = documents.sparkSession
    finish_conversation_files(spark, path)
    part = F.col("part").cast("int") if "part" in documents.columns else F.lit(0)
    content = F.struct(*[c for c in documents.columns if c != "part"])
    rows = documents.select("conv_id", part.alias("part"), F.to_json(content, {"ignoreNullFields": "false"}).alias("value"))
    spark.dataSource.register(ConversationFiles)
    rows.write.format(ConversationFiles.name()).mode("append").option("path", path).option("job", uuid.uuid4().hex).save()
    finish_conversation_files(spark, path)


def finish_conversation_files(spark: SparkSession, path: str) -> None:
    """Second phase: move the files of committed jobs to their places. Repeating it does no harm."""
    fs, root = file_system(path)
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        return
    for job in fs.get_file_info(pafs.FileSelector(root)):
        marker = f"{job.path}/{COMMITTED}"
        if not job.base_name.startswith(STAGED) or fs.get_file_info(marker).type != pafs.FileType.File:
            continue
        with fs.open_input_stream(marker) as listed:
            attempts = listed.read().decode().split()
        if attempts:
            work = spark.createDataFrame([(f"{job.path}/{a}",) for a in attempts], "folder string")
            work = work.select("folder", F.explode(F.sequence(F.lit(0), F.lit(FOLDERS - 1))).alias("sub")).repartition("folder", "sub")
            work.mapInArrow(_mover(path), "moved long").agg(F.sum("moved")).first()
        fs.delete_dir(job.path)


def _mover(path: str):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        for batch in batches:
            moved = 0
            for folder, sub in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                selector = pafs.FileSelector(f"{folder}/{sub:02x}", allow_not_found=True)
                found = [f for f in fs.get_file_info(selector) if f.type == pafs.FileType.File]
                if found:
                    fs.create_dir(f"{root}/{sub:02x}", recursive=True)
                for file in found:
                    fs.move(file.path, f"{root}/{sub:02x}/{file.base_name}")
                moved += len(found)
            yield pa.RecordBatch.from_pydict({"moved": pa.array([moved], type=pa.int64())})

    return move


def read_conversation_files(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id, part, value`` of the files that :func:`write_conversation_files` left below ``path``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{SUFFIX}*.json").text(path, wholetext=True)
    # The path is a URI; the name in it is quoted once more.
    name = F.substring_index("_metadata.file_path", "/", -1)
    for _ in range(2):
        name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    pattern = rf"(?s)^(.*){SUFFIX}(?:\.(\d+))?\.json$"
    number = F.regexp_extract(name, pattern, 2)
    part = F.when(number == "", 0).otherwise(number.try_cast("int"))
    return files.select(F.regexp_extract(name, pattern, 1).alias("conv_id"), part.alias("part"), "value")


class FolderSink:
    """Media in parts, below a folder: an object appears under its key when it is complete."""

    def __init__(self, root: str) -> None:
        self.root = root

    def begin(self, key: str, content_type: str | None = None) -> dict:
        fs, root = file_system(self.root)
        path = f"{root}/{key}"
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        held = f"{path}.{uuid.uuid4().hex}.part"
        return {"fs": fs, "held": held, "path": path, "out": fs.open_output_stream(held), "key": key}

    def part(self, upload: dict, number: int, data: bytes) -> int:
        upload["out"].write(data)
        return len(data)

    def complete(self, upload: dict, receipts: list[int]) -> str:
        upload["out"].close()
        upload["fs"].move(upload["held"], upload["path"])
        return f"{self.root.rstrip('/')}/{upload['key']}"

    def abort(self, upload: dict) -> None:
        upload["out"].close()
        if upload["fs"].get_file_info(upload["held"]).type == pafs.FileType.File:
            upload["fs"].delete_file(upload["held"])
