"""Sources and sinks: delimited reports, NDJSON event logs, binary documents and images."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPLOAD_CAP, MOST_PIXELS = 128 << 20, 80_000_000
_IMAGES = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])


def delimited(spark: SparkSession, path: str, columns: list[str], separator: str = ",") -> DataFrame:
    """A CSV or TSV report with a header, all columns as strings; a folder without files is an empty report."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("sep", separator).csv(path)


def number(column: Column) -> Column:
    """A numeric field of a report; 'n/a', blanks and other text are NULL."""
    return column.try_cast("double")


def write_delimited(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.option("header", True).option("sep", separator).mode("overwrite").csv(path)


def ndjson(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """Lines of an event log: blank lines skipped, each with its fields, and `malformed` set where it isn't JSON."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = F.from_json("value", f"{payload}, _corrupt_record string", {"mode": "PERMISSIVE"})
    return lines.select(read.alias("e")).select("e.*").withColumn("malformed", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def uploads(spark: SparkSession, path: str, cap: int = UPLOAD_CAP, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """Documents of a folder and the rejected ones with a reason: empty, or over the cap (0: no cap)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    fits = (F.col("length") <= cap) | F.lit(cap == 0)
    glob = spark._jvm.org.apache.hadoop.fs.Path(path, pattern)
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    empty = [(str(x.getPath()), 0, "empty") for x in found if x.isFile() and x.getLen() == 0]  # Spark's reader leaves these out
    large = files.where(~fits).select("path", "length", F.lit("too large").alias("reason"))
    return files.where(fits), large.union(spark.createDataFrame(empty, "path string, length long, reason string"))


def orientation(content: bytes) -> int:
    """EXIF orientation of a JPEG file, 1 where it has none or is damaged."""
    at, order = content.find(b"Exif\0\0"), "<"
    if content[:2] != b"\xff\xd8" or at < 0:
        return 1
    tiff = content[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        first = struct.unpack_from(f"{order}I", tiff, 4)[0]
        for k in range(struct.unpack_from(f"{order}H", tiff, first)[0]):
            tag, _, _, value = struct.unpack_from(f"{order}HHIH", tiff, first + 2 + 12 * k)
            if tag == 0x0112:
                return value if 1 <= value <= 8 else 1
    except (struct.error, TypeError):
        pass
    return 1


def upright(pixels: np.ndarray, turn: int) -> np.ndarray:
    """Rows of pixels as they are looked at, by EXIF orientation."""
    if turn in (2, 3, 6, 7):  # mirrored ones first, then turned
        pixels = {2: pixels[:, ::-1], 3: pixels[::-1, ::-1], 6: pixels[::-1].swapaxes(0, 1), 7: pixels[::-1, ::-1].swapaxes(0, 1)}[turn]
    elif turn in (4, 5, 8):
        pixels = {4: pixels[::-1], 5: pixels.swapaxes(0, 1), 8: pixels.swapaxes(0, 1)[::-1]}[turn]
    return np.ascontiguousarray(pixels)


def flattened(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Red, green and blue of an image as Spark decodes it (blue first), alpha flattened on white."""
    grid = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(grid, 3, axis=2)
    colour = grid[:, :, 2::-1]
    if channels == 3:
        return colour
    alpha = grid[:, :, 3:].astype(np.uint16)
    return ((colour.astype(np.uint16) * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)


def images(spark: SparkSession, path: str, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """Every image of a folder: path, height, width, pixels (rows of red, green, blue, upright, on white), error.

    A damaged image or one of over `most_pixels` has no pixels but an error, and is not left out.
    """
    decoded = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("origin"), F.substring("content", 1, 1 << 16).alias("head"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                told = {"path": row["origin"], "height": None, "width": None, "pixels": None, "error": None}
                if row["nChannels"] not in (1, 3, 4):
                    told["error"] = "damaged"
                elif row["height"] * row["width"] > most_pixels:
                    told["error"] = f"over {most_pixels} pixels"
                else:
                    grid = upright(flattened(row["data"], row["height"], row["width"], row["nChannels"]), orientation(row["head"] or b""))
                    told |= {"height": grid.shape[0], "width": grid.shape[1], "pixels": grid.tobytes()}
                yield pa.RecordBatch.from_pylist([told], schema=_IMAGES)

    joined = decoded.join(files, "origin", "left")
    return joined.select("origin", "height", "width", "nChannels", "data", "head").mapInArrow(rows, "path string, height int, width int, pixels binary, error string")


def result_body(text: Column) -> Column:
    """A result file's text after its first rule, where the file begins with a heading."""
    at = F.position(F.lit("\n---\n"), text)
    return F.when(text.startswith("# ") & (at > 0), F.substring(text, at + 5, F.length(text))).otherwise(text)


def settings(text: Column) -> Column:
    """'KEY=value' lines as a map; blank lines and comments are left out, quotes around values dropped."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & F.contains(x, F.lit("=")))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.btrim(F.trim(F.substring(x, F.position(F.lit("="), x) + 1, F.length(x))), F.lit("\"'")))
    return F.map_from_entries(F.transform(lines, pair))
