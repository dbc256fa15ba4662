"""Binary memory containers as a Spark data source.

``spark.read.format("memory_container").load(folder)`` yields one row per
record: (file, section, record JSON). ``df.write.format("memory_container")``
writes one complete container per task, so neither side ever holds more than
one task's share. Folders must be on storage every executor mounts.
"""

from __future__ import annotations

import glob
import os
import struct
import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# The container layout (big-endian).
MAGIC = b"\x89SYN"
VERSION = (1, 0)
HEADER = struct.Struct(">4sBBHQII8x")  # magic, major, minor, flags, microseconds, sections, crc, reserved
ENTRY = struct.Struct(">HHQQ")  # section type, reserved, offset, length
RECORD = struct.Struct(">BI")  # record type, payload length
DATA, END = 0x01, 0xFF
SECTIONS = {"memories": 1, "edges": 2, "concepts": 3, "episodes": 4, "metadata": 5}
NAMES = {v: k for k, v in SECTIONS.items()}
SCHEMA = "file string, section string, record string"


def read_directory(path: str) -> tuple[dict, list[tuple[str, int, int]]]:
    """Header fields and (section, offset, length) entries of one container."""
    with open(path, "rb") as f:
        head = f.read(HEADER.size)
        if len(head) < HEADER.size or head[:4] != MAGIC:
            raise ValueError(f"not a memory container: {path}")
        _, major, minor, flags, usec, count, crc = HEADER.unpack(head)
        if major > VERSION[0]:
            raise ValueError(f"container version {major}.{minor} is newer than this reader: {path}")
        entries = [ENTRY.unpack(f.read(ENTRY.size)) for _ in range(count)]
    info = {"flags": flags, "timestamp": usec / 1e6, "crc": crc, "version": (major, minor)}
    return info, [(NAMES.get(kind, str(kind)), offset, length) for kind, _, offset, length in entries]


class _Slice(InputPartition):
    def __init__(self, path: str, section: str, offset: int, length: int):
        self.path, self.section, self.offset, self.length = path, section, offset, length


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        wanted = options.get("sections")
        self.sections = {s.strip() for s in wanted.split(",")} if wanted else set(SECTIONS)

    def partitions(self):
        """One partition per file and wanted section: other sections are never read."""
        files = sorted(glob.glob(os.path.join(self.path, "*.mem"))) if os.path.isdir(self.path) else [self.path]
        out = []
        for path in files:
            _, entries = read_directory(path)
            out += [_Slice(path, s, o, n) for s, o, n in entries if s in self.sections]
        return out

    def read(self, part):
        with open(part.path, "rb") as f:
            f.seek(part.offset)
            end = part.offset + part.length
            while f.tell() < end:
                kind, size = RECORD.unpack(f.read(RECORD.size))
                if kind == END:
                    break
                payload = f.read(size)
                if len(payload) < size:
                    raise ValueError(f"truncated record in {part.path}")
                yield part.path, part.section, payload.decode("utf-8")


class _Commit(WriterCommitMessage):
    def __init__(self, staged: str | None):
        self.staged = staged


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.usec = int(float(options.get("timestamp", "0")) * 1e6)
        self.flags = int(options.get("flags", "0"))

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        spools = {s: tempfile.TemporaryFile() for s in SECTIONS}
        count = 0
        for row in rows:
            payload = row["record"].encode("utf-8")
            spools[row["section"]].write(RECORD.pack(DATA, len(payload)) + payload)
            count += 1
        if not count:
            return _Commit(None)
        crc, sizes = 0, {}
        for name, spool in spools.items():
            spool.write(RECORD.pack(END, 0))
            sizes[name] = spool.tell()
            spool.seek(0)
            while chunk := spool.read(1 << 20):
                crc = zlib.crc32(chunk, crc)
        staged = os.path.join(self.path, f".{uuid.uuid4().hex}.staged")
        with open(staged, "wb") as f:
            f.write(HEADER.pack(MAGIC, *VERSION, self.flags, self.usec, len(SECTIONS), crc))
            offset = HEADER.size + ENTRY.size * len(SECTIONS)
            for name, kind in SECTIONS.items():
                f.write(ENTRY.pack(kind, 0, offset, sizes[name]))
                offset += sizes[name]
            for spool in spools.values():
                spool.seek(0)
                while chunk := spool.read(1 << 20):
                    f.write(chunk)
        return _Commit(staged)

    def commit(self, messages):
        """Publish the files of successful tasks under their final names."""
        for i, m in enumerate(messages):
            if m is not None and m.staged:
                os.replace(m.staged, os.path.join(self.path, f"part-{i:05d}-{uuid.uuid4().hex[:8]}.mem"))

    def abort(self, messages):
        for m in messages:
            if m is not None and m.staged and os.path.exists(m.staged):
                os.remove(m.staged)


class ContainerSource(DataSource):
    @classmethod
    def name(cls):
        return "memory_container"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)


def export(
    path: str,
    memories: DataFrame,
    edges: DataFrame | None = None,
    bridge: DataFrame | None = None,
    episodes: DataFrame | None = None,
    now: float = 0.0,
    source_agent: str = "unknown",
) -> None:
    """Write a store to a folder of containers; edges need both ends exported."""
    spark = memories.sparkSession
    register(spark)

    def records(df: DataFrame, section: str) -> DataFrame:
        return df.select(F.lit(path).alias("file"), F.lit(section).alias("section"), F.to_json(F.struct(*df.columns)).alias("record"))

    rows = records(memories.withColumnRenamed("memory_id", "id"), "memories")
    ids = memories.select("memory_id")
    if edges is not None:
        inside = edges.join(ids.withColumnRenamed("memory_id", "source_id"), "source_id", "left_semi").join(
            ids.withColumnRenamed("memory_id", "target_id"), "target_id", "left_semi"
        )
        rows = rows.unionByName(records(inside, "edges"))
    if bridge is not None:
        # One record per link: a concept's member list may be as large as the store.
        rows = rows.unionByName(records(bridge.join(ids, "memory_id", "left_semi"), "concepts"))
    if episodes is not None:
        rows = rows.unionByName(records(episodes.join(ids, "memory_id", "left_semi"), "episodes"))
    meta = spark.createDataFrame([(path, "metadata", f'{{"source_agent": "{source_agent}", "exported_at": {now}}}')], SCHEMA)
    rows.unionByName(meta).write.format("memory_container").option("timestamp", str(now)).mode("append").save(path)


def read_section(spark: SparkSession, path: str, section: str, schema: str | None = None) -> DataFrame:
    """One section as typed columns (or raw records without a schema)."""
    register(spark)
    raw = spark.read.format("memory_container").option("sections", section).load(path)
    if schema is None:
        return raw
    return raw.select(F.from_json("record", schema).alias("r")).select("r.*")


def filter_export(
    memories: DataFrame,
    since: float | None = None,
    until: float | None = None,
    memory_types: list[str] | None = None,
    tags: list[str] | None = None,
    concept_text: list[str] | None = None,
    bridge: DataFrame | None = None,
) -> DataFrame:
    """Rows an export takes: time range, types, tags, concept-name substrings."""
    from ..operators.lifecycle import tags_of

    out = memories
    if since is not None:
        out = out.filter(F.col("created_at") >= since)
    if until is not None:
        out = out.filter(F.col("created_at") <= until)
    if memory_types:
        out = out.filter(F.col("memory_type").isin(memory_types))
    if tags:
        out = out.filter(F.arrays_overlap(tags_of(F.col("metadata")), F.array(*[F.lit(t) for t in tags])))
    if concept_text and bridge is not None:
        named = bridge.filter(F.exists(F.array(*[F.lit(c.lower()) for c in concept_text]), lambda c: F.contains(F.lower("concept"), c)))
        out = out.join(named.select("memory_id"), "memory_id", "left_semi")
    return out


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(file, ok): CRC check of every container, one task per file."""
    files = sorted(glob.glob(os.path.join(path, "*.mem")))
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(len(files), 1))

    def check(batches):
        for pdf in batches:
            ok = []
            for name in pdf["file"]:
                info, entries = read_directory(name)
                crc = 0
                with open(name, "rb") as f:
                    f.seek(min(o for _, o, _ in entries))
                    while chunk := f.read(1 << 20):
                        crc = zlib.crc32(chunk, crc)
                ok.append(crc == info["crc"])
            yield pdf.assign(ok=ok)

    return listed.mapInPandas(check, "file string, ok boolean")
