"""Append-only line files as a streaming source with offsets of its own.

Every file of a folder may grow at its end at any time, and new files may come. A batch takes, of each file, the
complete lines between two byte positions; a line that is still being written waits for its end. The positions are
the stream's offsets, so that a query that is stopped and started again from its checkpoint reads no line twice and
loses none, and a line's (file, position) names it for good.

    spark.dataSource.register(LineFiles)
    spark.readStream.format("weftline_lines").option("path", folder).load()

Options: `path`, a folder that driver and executors reach (a local path, or any URI that pyarrow's file systems open);
`suffix` of the files (default: all); `batchBytes`, about how much a batch takes (default 1 GiB); `partitionBytes`, about
how much a task reads (default 32 MiB). Columns: file, position (of the line's first byte), value. A file is cut into
ranges of bytes, whose lines are those that begin in the range; so one large file is read by many tasks. Bytes
that are no UTF-8 are replaced. Offsets hold one number for each file of the folder: move files away that no
one appends to any more. A file that has become shorter is an error, since lines that were read are gone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes that are looked at once when an end of line is sought, and lines to a batch of rows.
_LOOK = 1 << 16
_LINES = 4096
NAMES = ("file", "position", "value")


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at `start` or later and before `end`."""

    file: str
    start: int
    end: int


def _opened(path: str):
    """(file system, path within it)."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def sizes(path: str, suffix: str = "") -> dict[str, int]:
    """The size of each file of the folder, by name."""
    from pyarrow import fs

    system, folder = _opened(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    names = {f.base_name: f.size for f in found if f.type == fs.FileType.File}
    return {n: s for n, s in sorted(names.items()) if n.endswith(suffix) and n[0] not in "._"}


def line_end(path: str, name: str, start: int, limit: int) -> int:
    """The end of the last complete line of the file that lies within start and limit; `start` if there is none."""
    system, folder = _opened(path)
    with system.open_input_file(f"{folder}/{name}") as f:
        high = limit
        while high > start:
            low = max(start, high - _LOOK)
            at = f.read_at(high - low, low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return start


def next_line(path: str, name: str, start: int, limit: int) -> int:
    """Where the first line that begins at `start` or later begins; `limit` if none does."""
    if not start:
        return 0
    system, folder = _opened(path)
    with system.open_input_file(f"{folder}/{name}") as f:
        low = start - 1
        while low < limit:
            part = f.read_at(min(_LOOK, limit - low), low)
            at = part.find(b"\n")
            if at >= 0:
                return low + at + 1
            low += len(part)
    return limit


def cut(start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `size` bytes from start to end."""
    n = max(1, -(-(end - start) // size))
    edges = [start + (end - start) * i // n for i in range(n + 1)]
    yield from zip(edges, edges[1:], strict=False)


def lines(path: str, part: Range, until: int) -> Iterator[pa.RecordBatch]:
    """The lines of the range; `until` is where the file's complete lines end."""
    system, folder = _opened(path)
    at = next_line(path, part.file, part.start, until)
    places: list[int] = []
    texts: list[str] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([part.file] * len(places)), pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=NAMES)

    with system.open_input_file(f"{folder}/{part.file}") as raw:
        raw.seek(at)
        rest = b""
        while at < part.end:
            # lines that begin before the range's end are read whole; a long one in ever larger parts
            read = raw.read(max(0, min(max(_LOOK * 16, len(rest)), until - at - len(rest))))
            found = (rest + read).split(b"\n")
            rest = found.pop()
            for line in found:
                if at >= part.end:
                    break
                places.append(at)
                texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                at += len(line) + 1
            if len(places) >= _LINES:
                yield batch()
                places, texts = [], []
            if not read:
                break
    if places:
        yield batch()


class _Reader:
    def __init__(self, options: dict[str, str]):
        # names of options arrive in lower case
        if not options.get("path"):
            raise ValueError("the option path must name a folder")
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.batch, self.size = int(options.get("batchbytes", 1 << 30)), int(options.get("partitionbytes", 32 << 20))

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        found: list[InputPartition] = []
        for name, high in end.items():
            low = start.get(name, 0)
            if high < low:
                raise ValueError(f"{name} has become shorter: {high} bytes after {low}")
            if high > low:
                found += [Range(name, a, b) for a, b in cut(low, high, self.size)]
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        # a range ends where a line ends or in the middle of one, which then ends by the end of the complete lines
        whole = sizes(self.path, self.suffix).get(partition.file, 0)
        yield from lines(self.path, partition, max(whole, partition.end))


class LineStream(_Reader, DataSourceStreamReader):
    """Offsets are the ends of the complete lines that have been taken, by file.

    A restarted query does not say where it stands before it asks for the first batch's end: that batch takes all there is.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.taken: dict[str, int] = {}
        self.placed = False

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        left = self.batch if self.placed else 1 << 62
        for name, size in sizes(self.path, self.suffix).items():
            low = self.taken.get(name, 0)
            if size < low:
                raise ValueError(f"{name} has become shorter: {size} bytes after {low}")
            if size > low and left > 0:
                high = line_end(self.path, name, low, min(size, low + left))
                if high == low and size > low + left:  # one line is longer than a batch
                    high = next_line(self.path, name, low + left, size)
                    high = line_end(self.path, name, low, high)
                self.taken[name] = high
                left -= high - low
        return dict(self.taken)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # after a restart the first call tells how far the batches before have come
        for name, at in end.items():
            self.taken[name] = max(at, self.taken.get(name, 0))
        self.placed = True
        return self.ranges(start, end)

    def commit(self, end: dict) -> None:
        pass


class LineBatch(_Reader, DataSourceReader):
    """All complete lines that the folder holds now."""

    def partitions(self) -> list[InputPartition]:
        return self.ranges({}, {n: line_end(self.path, n, 0, s) for n, s in sizes(self.path, self.suffix).items()})


class LineFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weftline_lines"

    def schema(self) -> str:
        return "file string, position long, value string"

    def reader(self, schema) -> DataSourceReader:
        return LineBatch({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LineStream({k.lower(): v for k, v in self.options.items()})
