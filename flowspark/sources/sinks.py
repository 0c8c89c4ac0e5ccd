"""Packets written as captures: ``format("pcap_files")`` makes one file per flow, or one per partition."""

from __future__ import annotations

import dataclasses
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

INDEX_VERSION = 1
WAITING = "_waiting"
COPY_BYTES = 4 << 20


def global_header(link: int) -> bytes:
    return struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)


@dataclasses.dataclass
class Written(WriterCommitMessage):
    """Files of one task's successful attempt: where they wait, the name they get, and the task's number."""

    files: list[tuple[str, str]]
    task: int


class CaptureWriter(DataSourceWriter):
    """Each task writes its own files, one for every name and link type in turn, under a name of its attempt.

    Only when all tasks are done are the files of their successful attempts given their names; those
    of failed, lost or repeated attempts wait in a folder that is then removed. With ``single`` the
    files of all tasks are strung together, in the tasks' order, to one for each link type.
    """

    def __init__(self, options, schema):
        self.path, self.single = options["path"], options.get("single", "false") == "true"
        self.columns = [f.name for f in schema.fields]

    def store(self):
        from pyarrow import fs

        if "://" in self.path:
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), "/" + self.path[5:].lstrip("/") if self.path.startswith("file:") else self.path

    def write(self, iterator):
        from pyspark import TaskContext

        store, folder = self.store()
        store.create_dir(f"{folder}/{WAITING}", recursive=True)
        context = TaskContext.get()
        attempt, task = context.taskAttemptId(), context.partitionId()
        files, current, out = [], None, None
        for row in iterator:
            link = row["data_link_type"]
            if (row["name"], link) != current:
                if out:
                    out.close()
                current = row["name"], link
                name = row["name"] if link == 1 else f"{row['name']}-link{link}"
                files.append((f"{folder}/{WAITING}/{attempt}-{len(files)}", name))
                out = store.open_output_stream(files[-1][0])
                out.write(global_header(link))
            data = bytes(row["bytes"])
            out.write(struct.pack("<IIII", row["ts_us"] // 1_000_000, row["ts_us"] % 1_000_000, len(data), row["original_length"]) + data)
        if out:
            out.close()
        return Written(files, task)

    def commit(self, messages):
        store, folder = self.store()
        done = sorted((m for m in messages if m), key=lambda m: m.task)
        if self.single:
            outs: dict = {}
            for waiting, name in (f for m in done for f in m.files):
                with store.open_input_stream(waiting) as part:
                    head = part.read(24)
                    if name not in outs:
                        outs[name] = store.open_output_stream(f"{folder}/{name}.pcap")
                        outs[name].write(head)
                    while piece := part.read(COPY_BYTES):
                        outs[name].write(piece)
            for out in outs.values():
                out.close()
        else:
            for m in done:
                for waiting, name in m.files:
                    store.move(waiting, f"{folder}/{name.replace('%', f'{m.task:05d}')}.pcap")
        self.clear()

    def abort(self, messages):
        self.clear()

    def clear(self) -> None:
        from pyarrow import fs

        store, folder = self.store()
        if store.get_file_info(f"{folder}/{WAITING}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{WAITING}")


class CaptureFiles(DataSource):
    @classmethod
    def name(cls):
        return "pcap_files"

    def writer(self, schema, overwrite):
        return CaptureWriter(self.options, schema)


def write_captures(packets: DataFrame, path: str, by_flow: bool = False, single: bool = False) -> None:
    """Write packets (ts_us, original_length, bytes, packet_index and, ``by_flow``, flow_index) in packet order as captures under ``path``.

    With ``by_flow`` every flow has a file of its own; with ``single`` all packets are one file; else
    each range of packet numbers has one. Packets of another link type (data_link_type, Ethernet
    where the column is missing) than Ethernet get files whose names say it.
    """
    packets.sparkSession.dataSource.register(CaptureFiles)
    if "data_link_type" not in packets.columns:
        packets = packets.withColumn("data_link_type", F.lit(1))
    if by_flow:
        named = packets.withColumn("name", F.concat(F.lit("flow-"), F.lpad(F.col("flow_index").cast("string"), 8, "0"))).repartition("flow_index")
        named = named.sortWithinPartitions("flow_index", "data_link_type", "packet_index")
    else:
        named = packets.withColumn("name", F.lit("packets" if single else "packets-%")).repartitionByRange("packet_index")
        named = named.sortWithinPartitions("data_link_type", "packet_index")
    named = named.select("name", "data_link_type", "ts_us", "original_length", "bytes")
    named.write.format("pcap_files").option("single", str(single).lower()).mode("append").save(path)


def write_index(spark: SparkSession, packets: DataFrame, flows: DataFrame, path: str, sources: DataFrame | None = None) -> None:
    """The packets and flows of a capture as Parquet tables, with what is known of its source files and, last, the index's version."""
    packets.write.parquet(f"{path}/packets")
    flows.write.parquet(f"{path}/flows")
    if sources is not None:
        sources.write.parquet(f"{path}/sources")
    spark.createDataFrame([(INDEX_VERSION, sources is not None)], "version int, has_sources boolean").write.parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """packets, flows and sources of an index; ValueError for another version, an error of Spark for one that was not finished."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != INDEX_VERSION:
        raise ValueError(f"index version {meta['version']}, not {INDEX_VERSION}")
    return spark.read.parquet(f"{path}/packets"), spark.read.parquet(f"{path}/flows"), spark.read.parquet(f"{path}/sources") if meta["has_sources"] else None
