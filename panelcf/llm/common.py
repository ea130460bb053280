"""What the operators share: word rules, stored intermediate tables, row keys."""

from __future__ import annotations

import os
import string
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: White space of the plain word rule: blank and the five control characters that bytes.split() also cuts at.
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
#: What separates words of the alphanumeric rule: all ASCII but digits and letters.
NOT_WORD_PATTERN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same rule for bytes: A-Z become a-z, separators become blanks, the bytes of other characters stay.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder in ``spark.checkpoint.dir``.

    A session of one process, as in tests, gets a temporary folder where the setting is missing;
    a cluster session without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "panelcf-shared")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: computed once, lineage cut, safe from lost executors."""
    path = shared_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column, pattern: str) -> Column:
    """The words between separators; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), pattern), lambda w: w != "")


def remainder(doc_id: Column, folds: int = 5) -> Column:
    """The fold of a document: crc32 of the decimal id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def keyed(docs: DataFrame, prefix: str = "__llm") -> tuple[DataFrame, list[str]]:
    """Rows with two key columns: the id and a hash of the text. Rows equal in both count as one document."""
    names = [f"{prefix}_id", f"{prefix}_text"]
    return docs.withColumns({names[0]: F.col("doc_id"), names[1]: F.xxhash64("text")}), names


def match_keys(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Join on the key columns, nulls meeting nulls; the right side's keys are dropped."""
    right = right.withColumnsRenamed({n: f"{n}_r" for n in names})
    on = [left[n].eqNullSafe(right[f"{n}_r"]) for n in names]
    out = left.join(right, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"{n}_r" for n in names])


def text_groups(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(first, end) of rows that hold about ``limit`` bytes together; a longer text is a group by itself."""
    first = total = 0
    for k, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if total and total + n > limit:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(texts):
        yield first, len(texts)
