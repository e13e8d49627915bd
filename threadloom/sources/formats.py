"""Machine files as data sources: spark.read.format("dst"), df.write.format("pes"), and so on, once `register` has been called.

Reading: a folder's files (or one file) are packed into partitions of about PACK bytes by their sizes, so a million small files are not a million
tasks; a row is a record of a file, and a file that can't be read is one row with its error.  Writing: rows of stitches, whole designs in
order within a partition (`clustered` sees to that), each of which becomes a file.  A task writes into a folder of its own under _staging; the
commit moves each task's folder to its place, which is one rename for a task and not for a file, and an abort deletes the staging.  Files are
opened by pyarrow's file systems, so any store works that they know."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from threadloom.kernels import codec

from .files import PES_RECORDS, RECORDS, plan_of

PACK = 8 << 20
STITCHES = "design_id bigint, block_idx bigint, run_idx bigint, seq bigint, x int, y int, r int, g int, b int, connection string"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _hidden(path: str) -> bool:
    return any(p[:1] in ("_", ".") for p in path.split("/"))


@dataclass
class Pack(InputPartition):
    """Some files that one task reads."""

    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    folder: str | None
    files: int


class Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str, rows, names: list[str], pack: int):
        self.path, self.suffix, self.rows, self.names, self.pack = path, suffix, rows, names, pack

    def partitions(self) -> list[Pack]:
        store, at = _opened(self.path)
        if store.get_file_info(at).type == fs.FileType.File:
            return [Pack((at,))]
        found = [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(self.suffix) and not _hidden(f.path[len(at) :])]
        packs, held, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            if held and size + f.size > self.pack:
                packs, held, size = [*packs, Pack(tuple(held))], [], 0
            held.append(f.path)
            size += f.size
        return [*packs, Pack(tuple(held))] if held else packs

    def read(self, partition: Pack) -> Iterator[tuple]:
        store, _ = _opened(self.path)
        for path in partition.paths:
            try:
                with store.open_input_file(path) as f:
                    out = [(path, *r, None) for r in self.rows(f.read())]
            except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is said in its row
                out = [(path, *[None] * (len(self.names) - 2), f"{type(e).__name__}: {e}")]
            yield from out


class Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str, write, overwrite: bool):
        self.path, self.suffix, self.encode, self.overwrite = path, suffix, write, overwrite
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        store, at = _opened(self.path)
        task = TaskContext.get()
        folder = f"{at}/_staging-{self.job}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        names = [c.split()[0] for c in STITCHES.split(", ")]
        done, held, key = set(), [], None

        def close() -> None:
            if key in done:
                raise ValueError(f"design {key} comes twice in a partition: rows have to be clustered by design")
            done.add(key)
            store.create_dir(folder)
            with store.open_output_stream(f"{folder}/design-{key}{self.suffix}") as f:
                f.write(self.encode(plan_of(pd.DataFrame(held, columns=names), f"DESIGN{key}")))

        for row in rows:
            if held and row.design_id != key:
                close()
                held = []
            key = row.design_id
            held.append(tuple(row[n] for n in names))
        if held:
            close()
        return Written(folder if done else None, len(done))

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _opened(self.path)
        before = [f.path for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if not f.path.endswith(f"_staging-{self.job}")] if self.overwrite else []
        store.create_dir(at)
        for m in messages:
            if m is not None and m.folder:
                store.move(m.folder, f"{at}/{m.folder.rsplit('/', 1)[1]}-{self.job[:8]}")
        for path in before:
            (store.delete_dir if store.get_file_info(path).type == fs.FileType.Directory else store.delete_file)(path)
        self._end(store, at)
        with store.open_output_stream(f"{at}/_SUCCESS") as f:
            f.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        self._end(*_opened(self.path))

    def _end(self, store: fs.FileSystem, at: str) -> None:
        if store.get_file_info(f"{at}/_staging-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/_staging-{self.job}")


class _Files(DataSource):
    suffix, records = "", ""

    def schema(self) -> str:
        return f"{self.records}, error string"

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a path is needed")
        return self.options["path"].rstrip("/")

    def reader(self, schema) -> Reader:
        return Reader(self._path(), self.suffix, type(self).rows, schema.names, int(self.options.get("packBytes", PACK)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self._path(), self.suffix, type(self).encode, overwrite)


class DstFiles(_Files):
    suffix, records = ".dst", RECORDS

    @classmethod
    def name(cls) -> str:
        return "dst"

    @staticmethod
    def rows(data: bytes) -> list[tuple]:
        if len(data) < 512:
            raise ValueError("shorter than a header")
        return [(k, kind, dx, dy) for k, (dx, dy, kind) in enumerate(codec.read_dst(data)["records"])]

    @staticmethod
    def encode(plan: dict) -> bytes:
        return codec.write_dst(plan)


class PesFiles(_Files):
    suffix, records = ".pes", PES_RECORDS

    @classmethod
    def name(cls) -> str:
        return "pes"

    @staticmethod
    def rows(data: bytes) -> list[tuple]:
        p = codec.read_pes(data)
        return [(k, kind, dx, dy, p["label"], p["palette"]) for k, (kind, dx, dy) in enumerate(p["ops"])]

    @staticmethod
    def encode(plan: dict) -> bytes:
        return codec.write_pes(plan)


def register(spark: SparkSession) -> None:
    for source in (DstFiles, PesFiles):
        spark.dataSource.register(source)


def clustered(stitches: DataFrame) -> DataFrame:
    """The columns that writers take, whole designs within partitions and in order."""
    names = [c.split()[0] for c in STITCHES.split(", ")]
    return stitches.select(*names).repartition("design_id").sortWithinPartitions("design_id", "block_idx", "run_idx", "seq")


def image_files(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Pictures of all kinds that the JVM decodes (JPEG, PNG, GIF, BMP), as (design_id, file, content, error) with PNG contents for plans.pictures, the longer
    side at most `most` pixels; a file that can't be read has its error instead of contents."""
    import numpy as np
    from pyspark.sql import functions as F

    from threadloom.kernels import pictures

    most = most or pictures.MOST
    read = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")

    def run(batches):
        for batch in batches:
            out = []
            for file, h, w, n, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if h is None or h <= 0 or n not in (1, 3, 4):
                    out.append((file, None, "no picture that can be read"))
                    continue
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                rgba = np.full((h, w, 4), 255, np.uint8)
                rgba[..., :3] = a[..., 2::-1] if n > 1 else a
                if n == 4:
                    rgba[..., 3] = a[..., 3]
                out.append((file, pictures.encode_png(pictures.shrunk(rgba, most)), None))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.string())], ["file", "content", "error"])

    made = read.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "file string, content binary, error string")
    return made.select(F.xxhash64("file").alias("design_id"), "file", "content", "error")


def pixel_rows(pictures_: DataFrame) -> DataFrame:
    """(img, x, y, r, g, b, a) of pictures (design_id, content), for what is done with label maps and colours set at a time."""
    import numpy as np

    from threadloom.kernels import pictures

    def run(batches):
        for batch in batches:
            for img, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content is None:
                    continue
                rgba = pictures.decode(content)
                h, w = rgba.shape[:2]
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, img)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), *(pa.array(rgba[..., c].ravel().astype(np.int32)) for c in range(4))], ["img", "x", "y", "r", "g", "b", "a"])

    return pictures_.select("design_id", "content").mapInArrow(run, "img long, x int, y int, r int, g int, b int, a int")
