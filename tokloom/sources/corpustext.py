"""A corpus as flat text files, and a data source that reads it in pieces of bounded size.

The corpus is one stream of text: the files of a folder in the order of their names.
The reader divides it into chunks by bytes, whatever its files and documents, so a document of any size is read by many
tasks, each in bounded memory. A chunk begins and ends where white space follows something else: there a
pre-token piece always ends, so the pieces of the parts are the pieces of the whole. A row is a chunk; a partition holds
several that follow each other when the stream has many, so that tasks grow with the bytes and not with the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes that a reader holds at a time while it looks for a place to cut.
READ_BYTES = 1 << 16
#: A stream of more than ``FEW_PARTS`` chunks is read in partitions of several chunks, of up to ``PART_BYTES`` (or one chunk).
FEW_PARTS, PART_BYTES = 256, 8 << 20
BLANKS = b" \t\n\r"


def write_text(corpus: DataFrame, path: str, parts: int | None = None) -> None:
    """The documents of ``corpus`` (``doc, start_byte``; every one ends with a line end) as text files in corpus order."""
    order = corpus.repartitionByRange(parts, "start_byte") if parts else corpus.repartitionByRange("start_byte")
    (order.sortWithinPartitions("start_byte").select(F.expr("substring(doc, 1, length(doc) - 1)").alias("value"))
     .write.mode("overwrite").text(path))


def _open(path: str):
    """File system and path; local paths need no scheme."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


class Stream:
    """Files read as one run of bytes."""

    def __init__(self, path: str, files: Sequence[tuple[str, int]]) -> None:
        self.fs, _ = _open(path)
        self.files = files
        self.size = sum(n for _, n in files)

    def read(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at`` on, across files."""
        out = []
        for name, size in self.files:
            if n > 0 and at < size:
                with self.fs.open_input_file(name) as f:
                    f.seek(at)
                    got = f.read(min(n, size - at))
                out.append(got)
                n -= len(got)
                at += len(got)
            at -= size
            if at < 0 and n <= 0:
                break
            at = max(at, 0)
        return b"".join(out)

    def cut(self, at: int) -> int:
        """The first place from ``at`` on where white space follows something else (0 and the end are places too)."""
        if at <= 0:
            return 0
        at -= 4                                  # the character before ``at`` has at most four bytes
        while at < self.size:
            start = max(0, at)
            block = self.read(start, READ_BYTES)
            if not block:
                break
            for i in range(4 if at >= 0 else 4 + at, len(block)):
                if block[i] in BLANKS and self._ends(block[max(0, i - 4):i]):
                    return start + i
            if start + len(block) >= self.size:
                break
            at = start + len(block) - 4
        return self.size

    @staticmethod
    def _ends(before: bytes) -> bool:
        """Whether the last character is no white space and no control character."""
        tail = before.decode("utf-8", "ignore") if before and before[-1] < 0x80 else before.lstrip(
            bytes(range(0x80, 0xC0))).decode("utf-8", "ignore")
        return bool(tail) and not tail[-1].isspace() and tail[-1] > " "


@dataclass
class Span(InputPartition):
    """Bytes of the stream that a partition begins in."""
    first: int
    last: int


class CorpusTextReader(DataSourceReader):
    def __init__(self, path: str, chunk: int) -> None:
        from pyarrow import fs
        self.path, self.chunk = path, chunk
        system, root = _open(path)
        info = system.get_file_info(fs.FileSelector(root))
        self.files = sorted((f.path, f.size) for f in info if f.is_file and not f.base_name.startswith(("_", ".")))

    def partitions(self) -> list[Span]:
        size = sum(n for _, n in self.files)
        step = self.chunk * max(1, min(PART_BYTES, size // FEW_PARTS) // self.chunk)
        return [Span(a, min(a + step, size)) for a in range(0, size, step)] or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[tuple[int, str]]:
        s = Stream(self.path, self.files)
        a = s.cut(partition.first)
        for first in range(partition.first, partition.last, self.chunk):
            last = min(first + self.chunk, partition.last)
            z = s.cut(last) if last < s.size else s.size
            if a < z:
                yield a, s.read(a, z - a).decode("utf-8", "replace")
            a = max(a, z)


class CorpusText(DataSource):
    """``spark.read.format("corpus_text").option("path", folder).option("chunk_bytes", n)``: ``start_byte, text``,
    a row per part of about ``chunk_bytes`` (a part without white space runs on to the next)."""

    @classmethod
    def name(cls) -> str:
        return "corpus_text"

    def schema(self) -> str:
        return "start_byte long, text string"

    def reader(self, schema: StructType) -> CorpusTextReader:
        return CorpusTextReader(self.options["path"], int(self.options.get("chunk_bytes", 8 << 20)))


def read_text(spark: SparkSession, path: str, chunk_bytes: int = 8 << 20) -> DataFrame:
    """The stream below ``path`` in parts, cut where no piece is cut."""
    spark.dataSource.register(CorpusText)
    return spark.read.format("corpus_text").option("path", path).option("chunk_bytes", str(chunk_bytes)).load()
