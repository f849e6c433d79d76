"""Result files as a data source: one file a model and snapshot, read in parallel, judged, and taken up where a run stopped.

Layout: `path`/snapshot=S/model=M/*.parquet with the columns `item` and a metric.  Options: path, metric (acc), expected
(rows that a file must have; 0: any), files (most files of a micro-batch or run).  A partition is a file.  A file is either
rows (snapshot, model, item, correct) or one row with the reason of its rejection: `rowcount:a!=b`, `non-binary-primary`,
`rowcount:0`, or the error in reading it.  The offset of a stream is the last file by (time of change, name); a run takes
the next `files` files after the ones of the run before, whose last one it finds in what that run wrote, and the checkpoint
keeps a batch that was planned and not finished.  Paths are those that pyarrow's file systems open: local, HDFS
(hdfs://, viewfs://), object stores.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .storage import exists

SCHEMA = "snapshot string, model string, item long, correct int, reason string, time long, file string"
FORMAT = "result_files"


class File(InputPartition):
    def __init__(self, time: int, path: str):
        super().__init__(path)
        self.time, self.path = time, path


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


def listed(path: str) -> list[tuple[int, str]]:
    """(time of change, name) of all result files, in order."""
    from pyarrow import fs

    system, root = _open(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((int(i.mtime_ns or 0), i.path) for i in found if i.is_file and i.path.endswith(".parquet") and "/_" not in i.path.removeprefix(root) and "/." not in i.path.removeprefix(root))


def judged(table: pa.Table, metric: str, expected: int) -> tuple[pa.Table | None, str | None]:
    """(item, correct as 0 and 1) or the reason why not."""
    if not table.num_rows or (expected and table.num_rows != expected):
        return None, f"rowcount:{table.num_rows}" + (f"!={expected}" if expected else "")
    value = table.column(metric).cast(pa.float64())
    if value.null_count or not pc.all(pc.is_in(value, pa.array([0.0, 1.0]))).as_py():
        return None, "non-binary-primary"
    return pa.table({"item": table.column("item").cast(pa.int64()), "correct": value.cast(pa.int32())}), None


class Reader:
    def __init__(self, options: dict[str, str]):
        self.path, self.metric = options["path"], options.get("metric", "acc")
        self.expected, self.files = int(options.get("expected", 0)), int(options.get("files", 1000))

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        names = dict(part.split("=", 1) for part in partition.path.split("/") if "=" in part)
        try:
            system, _ = _open(self.path)
            with system.open_input_file(partition.path) as f:
                rows, reason = judged(pq.ParquetFile(f).read(columns=["item", self.metric]), self.metric, self.expected)
        except (pa.ArrowException, KeyError, OSError) as e:
            rows, reason = None, f"{type(e).__name__}"
        if rows is None:
            rows = pa.table({"item": pa.array([None], pa.int64()), "correct": pa.array([None], pa.int32())})
        n = rows.num_rows
        of = lambda value: pa.array([value] * n, pa.string())
        yield from pa.table({"snapshot": of(names.get("snapshot")), "model": of(names.get("model")), "item": rows["item"], "correct": rows["correct"], "reason": of(reason), "time": pa.array([partition.time] * n, pa.int64()), "file": of(partition.path)}).to_batches()


class BatchReader(Reader, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [File(t, name) for t, name in listed(self.path)]


START = [-1, ""]


class StreamReader(Reader, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.at = json.loads(options.get("after", json.dumps(START)))  # where the last batch ended

    def initialOffset(self) -> dict:
        return {"at": json.dumps(START)}

    def _after(self, at: list) -> list[list]:
        return [[t, name] for t, name in listed(self.path) if [t, name] > at]

    def latestOffset(self) -> dict:
        """The end of the next `files` files."""
        self.at = (self._after(self.at)[: self.files] or [self.at])[-1]
        return {"at": json.dumps(self.at)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = json.loads(start["at"]), json.loads(end["at"])
        return [File(t, name) for t, name in self._after(a) if [t, name] <= b]

    def commit(self, end: dict) -> None:
        pass


class ResultFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options)


def harvest(spark: SparkSession, path: str, state: str, expected: int = 0, metric: str = "acc", files: int = 1000) -> None:
    """One run over the next files: accepted rows to state/cells, rejections to state/rejects, and how far it came to
    state/files; a folder a batch, which a repeated batch writes anew."""
    spark.dataSource.register(ResultFiles)
    options = {"path": path, "metric": metric, "expected": str(expected), "files": str(files)}
    if exists(spark, f"{state}/files"):
        last = spark.read.schema("time long, file string, batch long").parquet(f"{state}/files").agg(F.max(F.struct("time", "file")).alias("last")).head().last
        options["after"] = json.dumps([last.time, last.file]) if last else json.dumps(START)
    stream = spark.readStream.format(FORMAT).options(**options).load()

    def put(batch: DataFrame, number: int) -> None:
        whole = f"{state}/batches/batch={number}"
        batch.write.mode("overwrite").parquet(whole)
        batch = spark.read.schema(SCHEMA).parquet(whole)
        batch.where("reason IS NULL").select("snapshot", "model", "item", "correct").write.mode("overwrite").parquet(f"{state}/cells/batch={number}")
        batch.where("reason IS NOT NULL").select("snapshot", "model", "reason").write.mode("overwrite").parquet(f"{state}/rejects/batch={number}")
        batch.select("time", "file").distinct().coalesce(1).write.mode("overwrite").parquet(f"{state}/files/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def harvested(spark: SparkSession, state: str) -> tuple[DataFrame, DataFrame]:
    """(snapshot, model, item, correct) and (snapshot, model, reason) of all runs; a file that was taken up twice counts
    once."""
    cells, rejects = "snapshot string, model string, item long, correct int", "snapshot string, model string, reason string"
    of = lambda part, schema: spark.read.schema(f"{schema}, batch long").parquet(f"{state}/{part}").drop("batch").distinct() if exists(spark, f"{state}/{part}") else spark.createDataFrame([], schema)
    return of("cells", cells), of("rejects", rejects)


def newest(cells: DataFrame) -> DataFrame:
    """entity, item, f of each model's newest accepted snapshot."""
    last = cells.groupBy("model").agg(F.max("snapshot").alias("snapshot"))
    return cells.join(last, ["model", "snapshot"], "left_semi").select(F.col("model").alias("entity"), "item", (1 - F.col("correct")).alias("f"))
