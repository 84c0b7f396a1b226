"""Order exports: CSV files and the archives they come in."""

from __future__ import annotations

import codecs
import csv
import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.money import parse_cents
from reviewlens.functions.parsing import normalize_date
from reviewlens.operators.orders import merge_exports, orders_from_items

# --- fixed values: header names, compared without case and punctuation -----------------------
HEADERS = {
    "order_id": ("orderid",),
    "date_text": ("orderdate",),
    "total_text": ("totalowed", "itemtotal", "total"),
    "title": ("productname", "title"),
    "status": ("orderstatus", "orderstatuscode"),
}
NEEDED = ("order_id", "date_text")
MEMBER = r"Retail\.OrderHistory.*\.csv$"
HEAD_BYTES = 1 << 14
_CELL = rb'(?:"(?:[^"]|"")*+"[^,\r\n]*+|(?!")[^,\r\n]*+)'
RECORD = re.compile(rb"[\r\n]*+(" + _CELL + rb"(?:," + _CELL + rb")*+)[\r\n]")
ROWS_PER_BATCH = 10_000
WIDTH = 64
NO_MEMBER = "no order history in the archive"
NO_COLUMNS = "an order history without order id and date columns"
BAD_ARCHIVE = "the archive can't be read"


def plain(header: str) -> str:
    return re.sub(r"[^a-z0-9]", "", header.lower())


def header_positions(headers: Sequence[str]) -> dict[str, int | None]:
    """Where each wanted column is: the first header that carries any of its names."""
    names = [plain(h or "") for h in headers]
    return {
        column: next((i for i, n in enumerate(names) if n in wanted), None) for column, wanted in HEADERS.items()
    }


def _to_items(raw: DataFrame) -> DataFrame:
    return raw.select(
        "source", "row_no", "order_id",
        normalize_date("date_text").alias("order_date"),
        parse_cents("total_text").alias("cents"),
        "title", "status",
    )


def _first_record(spark: SparkSession, file: str) -> str:
    """The first record of a file, read from as many bytes as it takes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
    conf = spark._jsc.hadoopConfiguration()
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    stream = path.getFileSystem(conf).open(path)
    try:
        stream = codec.createInputStream(stream) if codec else stream
        found, more, record = b"", HEAD_BYTES, None
        while record is None:
            chunk = bytes(stream.readNBytes(more))
            found = (found + chunk).removeprefix(codecs.BOM_UTF8)
            record, more = RECORD.match(found), len(found)
            if not chunk:
                return found.strip(b"\r\n").decode(errors="replace")
    finally:
        stream.close()
    return record[1].decode(errors="replace")


def _heads(spark: SparkSession, files: Sequence[str], width: int) -> list[tuple]:
    """Path and places (from 0) of the wanted columns of each file whose first record names the needed ones; none where it doesn't."""
    with ThreadPoolExecutor(16) as pool:
        texts = list(pool.map(lambda file: _first_record(spark, file), files))
    schema = ", ".join(f"_c{i} string" for i in range(width + 1))
    given = spark.createDataFrame([(f, t) for f, t in zip(files, texts)], "file string, text string")
    record = F.from_csv("text", schema, {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false"})
    out = []
    for file, cells in given.select("file", record).collect():
        cells = list(cells) if cells else []
        if cells and cells[width] is not None:
            raise ValueError(f"more than {width} columns in {file}")
        at = header_positions(cells[:width])
        out.append((_local(file), *(at.values() if all(at[c] is not None for c in NEEDED) else [None] * len(at))))
    return out


def _local(path: str) -> str:
    return re.sub(r"^\w+:/+", "/", path)


def read_order_csv(spark: SparkSession, paths: Sequence[str], width: int = WIDTH) -> DataFrame:
    """Item rows of export files; a file without order id and date gives none.

    A file's first record holds its headers. The driver reads them from the first bytes of each file, and one scan reads the columns
    that any file wants: a cell that a row lacks costs the reader an error of its own, so the others are left alone. Places of the
    wanted columns are sent to all tasks, a row per file, so the plan doesn't grow with the number of files. `source` orders
    the files as `paths` does, files of a folder by name. A file of more than `width` columns is an error: one more is read to see it.
    """
    schema = ", ".join(f"_c{i} string" for i in range(width + 1))
    scan = spark.read.schema(schema).csv(
        list(paths), header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False
    )
    heads = _heads(spark, sorted(scan.inputFiles()), width)
    used = sorted({i for _, *at in heads for i in at if i is not None})
    wide = F.raise_error(F.concat(F.lit(f"more than {width} columns in "), F.col("_metadata.file_path"))).cast("string")
    rows = scan.select(
        F.when(F.col(f"_c{width}").isNull(), F.regexp_replace("_metadata.file_path", r"^\w+:/+", "/")).otherwise(wide).alias("file"),
        F.monotonically_increasing_id().alias("row_no"),
        F.array(*[F.col(f"_c{i}") for i in used]).cast("array<string>").alias("cells"),
    )
    placed = [(file, *(None if i is None else used.index(i) for i in at)) for file, *at in heads]
    named = spark.createDataFrame(placed, "known string, " + ", ".join(f"at_{c} int" for c in HEADERS))
    given = spark.createDataFrame([(_local(path), f"{n:09d}") for n, path in enumerate(paths)], "file string, part string")
    unread = F.raise_error(F.concat(F.lit("no headers were read of "), F.col("file"))).cast("boolean")
    found = (
        rows.join(F.broadcast(named), F.col("file") == F.col("known"), "left")
        .filter(F.when(F.col("known").isNull(), unread).otherwise(F.col(f"at_{NEEDED[0]}").isNotNull()))
        .join(F.broadcast(given), "file", "left")
    )
    return _to_items(
        found.select(
            F.concat(F.coalesce("part", F.lit("~")), F.lit(" "), "file").alias("source"), "row_no",
            *[F.get("cells", F.col(f"at_{c}")).alias(c) for c in HEADERS],
        )
    )


def orders_from_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Orders of several export parts; the first part that has an order wins."""
    per_part = orders_from_items(read_order_csv(spark, paths), ["order_id", "source"])
    return merge_exports(per_part, ["source"]).drop("source")


def _member_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "source", "row_no", *HEADERS, "error"]

    def problem(path: str, text: str) -> pd.DataFrame:
        return pd.DataFrame([(path, None, None, *[None] * len(HEADERS), text)], columns=columns, dtype=object)

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = [m for m in archive.namelist() if re.search(MEMBER, m, re.IGNORECASE)]
                    if not members:
                        yield problem(path, NO_MEMBER)
                    for n, member in enumerate(members):
                        with archive.open(member) as raw:
                            reader = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline=""))
                            at = header_positions(next(reader, []))
                            if at["order_id"] is None or at["date_text"] is None:
                                yield problem(path, NO_COLUMNS)
                                continue
                            rows = []
                            for row_no, row in enumerate(reader):
                                cells = [row[i] if i is not None and i < len(row) else None for i in at.values()]
                                rows.append((path, f"{path}#{n:06d}", row_no, *cells, None))
                                if len(rows) == ROWS_PER_BATCH:
                                    yield pd.DataFrame(rows, columns=columns, dtype=object)
                                    rows = []
                            if rows:
                                yield pd.DataFrame(rows, columns=columns, dtype=object)
            except (zipfile.BadZipFile, zlib.error, EOFError, UnicodeDecodeError, csv.Error, RuntimeError) as broken:
                yield problem(path, f"{BAD_ARCHIVE}: {broken}")


def read_order_archives(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Raw rows of the order-history members of ZIP archives; what can't be read is a row with `error`."""
    archives = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    text = ", ".join(f"{c} string" for c in HEADERS)
    return archives.mapInPandas(_member_rows, f"path string, source string, row_no long, {text}, error string")


def archive_errors(raw: DataFrame) -> DataFrame:
    """(path, error) of archives and members that gave no rows."""
    return raw.filter("error is not null").select("path", "error")


def orders_of_archives(raw: DataFrame) -> DataFrame:
    """Orders of the raw rows; the first file that has an order wins."""
    per_file = orders_from_items(_to_items(raw.filter("error is null")), ["order_id", "source"])
    return merge_exports(per_file, ["source"]).drop("source")


def ingest_order_archives(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Orders in the order-history members of ZIP archives, one task per archive; unreadable ones give none."""
    return orders_of_archives(read_order_archives(spark, paths))
