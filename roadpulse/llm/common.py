"""What the operators share: words, bound expressions, files in the shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# The white space that separates words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

# Rows of one Arrow batch: whole texts travel in them, so they are few.
BATCH_ROWS = 500


def words(text: Column) -> Column:
    """The words of a text; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def without(text: Column, chars: str) -> Column:
    """The text with all of these characters taken out."""
    return F.translate(text, chars, "")


def let(value: Column, body) -> Column:
    """body(value), with `value` computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """Keep few whole texts in a Python worker at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- files that tasks write and read, in the shared folder ---


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, as a URI."""
    path = scratch_path(spark, name)
    return re.sub(r"^file:/+", "file:///", path)


def file_system(uri: str):
    """The file system of a folder URI, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Committed:
    """A file written under a temporary name and renamed once it is complete:
    a lost or repeated task leaves the final name whole or absent."""

    def __init__(self, folder: str, name: str):
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{name}"
        self.temp = f"{root}/_{name}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def commit(self) -> str:
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.path


def open_input(folder: str, name: str):
    """A committed file, open for reading."""
    fs, root = file_system(folder)
    return fs.open_input_file(f"{root}/{name}")
