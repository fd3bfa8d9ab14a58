"""A Spark data source of landed payloads, for batches and streams: spark.read.format("landed_payloads").load(folder)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of files that one task reads, unless a single file is larger.
TASK_BYTES = 64 * 1024 * 1024


def register_landed(spark: SparkSession) -> None:
    """V1: make the format landed_payloads known to the session.

    Rows are (file, source, payload). Options: path, a local folder or a URI of a file system that Arrow knows; source, the
    feed's name, else the name of the folder right under path; lines, whether a
    line is a payload (true, false, or else by the ending .jsonl), read one by one, or a whole file is. Names that begin with "_" or "." are no payloads; an empty or missing folder gives no rows.

    A stream's cursor is the last file it read, in the order of names: files must land under names that rise (time stamps
    or numbers), each in one step. A restart continues after the cursor that Spark wrote, and a batch that is run again
    reads the same files.
    """
    spark.dataSource.register(_source())


def _source() -> type[DataSource]:
    """The classes are made in here so that they travel to executors by value, without this package being installed there."""

    def system(path: str):
        from pyarrow import fs

        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def listed(path: str) -> list[tuple[str, int]]:
        """(name below path, bytes) of all payloads in the order of names; only names come to the driver."""
        from pyarrow import fs

        files, root = system(path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = [(f.path.removeprefix(root.rstrip("/") + "/"), f.size) for f in found if f.type == fs.FileType.File]
        return sorted((n, size) for n, size in names if not any(part[0] in "_." for part in n.split("/")))

    class Share(InputPartition):
        def __init__(self, names: Sequence[str]) -> None:
            self.names = list(names)

    def shares(files: Sequence[tuple[str, int]]) -> list[Share]:
        out: list[list[str]] = []
        room = 0
        for name, size in files:
            if not out or size > room:
                out.append([])
                room = TASK_BYTES
            out[-1].append(name)
            room -= size
        return [Share(names) for names in out] or [Share([])]

    def payloads(options: dict[str, str], share: Share) -> Iterator[tuple[str, str, str]]:
        files, root = system(options["path"])
        for name in share.names:
            source = options.get("source") or (name.split("/")[0] if "/" in name else None)
            with files.open_input_stream(f"{root.rstrip('/')}/{name}") as raw:
                if options.get("lines", str(name.endswith(".jsonl"))).lower() != "true":
                    yield name, source, raw.read().decode("utf-8", "replace")
                    continue
                rest = b""
                while block := raw.read(1 << 20):
                    *lines, rest = (rest + block).split(b"\n")
                    yield from ((name, source, x.decode("utf-8", "replace")) for x in lines if x.strip())
                if rest.strip():
                    yield name, source, rest.decode("utf-8", "replace")

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]) -> None:
            self.options = options

        def partitions(self) -> list[Share]:
            return shares(listed(self.options["path"]))

        def read(self, partition: Share) -> Iterator[tuple[str, str, str]]:
            return payloads(self.options, partition)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]) -> None:
            self.options = options

        def initialOffset(self) -> dict:
            return {"after": ""}

        def latestOffset(self) -> dict:
            files = listed(self.options["path"])
            return {"after": files[-1][0] if files else ""}

        def partitions(self, start: dict, end: dict) -> list[Share]:
            return shares([f for f in listed(self.options["path"]) if start["after"] < f[0] <= end["after"]])

        def read(self, partition: Share) -> Iterator[tuple[str, str, str]]:
            return payloads(self.options, partition)

    class LandedPayloads(DataSource):
        @classmethod
        def name(cls) -> str:
            return "landed_payloads"

        def schema(self) -> str:
            return "file string, source string, payload string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(dict(self.options))

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return StreamReader(dict(self.options))

    return LandedPayloads
