"""Helpers that the training-data operators share.

Conventions of all operators in this subpackage
-----------------------------------------------
* Input is any DataFrame with an id column and a text column (`id_col`, `text_col`); further
  columns are ignored or carried along inside one struct, so their names never clash.
* A null text counts as empty.  A null id is an ordinary id that sorts after all others.
* White space and words are ASCII based: `[\\x20\\x09-\\x0D]` and `[^\\x20\\x09-\\x0D]+`.
* Intermediate tables go to the folder all executors share (`spark.checkpoint.dir`), as Parquet:
  that cuts lineage, survives the loss of executors and is compressed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..tables import drop_scratch, new_folder, scratch, shared_dir, written

__all__ = ["arrow_map", "by_key", "col", "drop_scratch", "lower_words", "new_folder", "scratch", "shared_dir", "small_batches", "split_words", "table", "texts", "written"]

#: Fixed value: the white space of the contracts.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def small_batches(spark: SparkSession, records: int = 2000, size: str = "16m") -> None:
    """Bounds the Arrow batches that Python workers get, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def arrow_map(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], dict | None]]) -> DataFrame:
    """mapInArrow with a function from a batch to columns; `make` runs once for each task.

    Columns that are Arrow arrays already, such as those carried along, keep their type.
    """
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, t.type) for t, x in zip(arrow, out.values(), strict=True)],
                    names=arrow.names,
                )

    return df.mapInArrow(run, kind)


def lower_words(text: str) -> list[bytes]:
    """The words, A-Z in lower case; bytes split at just the contracts' white space."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def split_words(text: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(offsets, words) of texts: words [offsets[k], offsets[k + 1]) are those of text k, A-Z in lower case, coded.

    Arrow's ASCII white space is just the contracts'.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    words = lists.flatten()
    there = pc.not_equal(pc.binary_length(words), 0)  # white space at the ends leaves empty words
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    return before[offsets - offsets[0]], words.filter(there).dictionary_encode()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that hold this share of the rows are hot: at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 64
LEAST_HOT = 1000


def by_key(rows: DataFrame, values: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """`rows` with the columns of `values`, which has each key once (nulls are equal); rows without a value go.

    weight: the column of `values` with the number of rows that hold the key; it is left out.  Hot keys, of which
    there are at most 64, are joined by broadcast, so no task gets all rows of one.  Both are read more than once.
    """
    total = values.agg(F.sum(weight)).head()[0] or 0
    is_hot = F.col(weight) >= max(LEAST_HOT, total * HOT_SHARE)
    named = values.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in values.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    out = [*rows.columns, *[c for c in values.columns if c not in (*keys, weight)]]
    hot = F.broadcast(named.filter(is_hot))
    cold = rows.join(hot.select(*[f"_of_{k}" for k in keys]), same, "left_anti").join(named.filter(~is_hot), same)
    return rows.join(hot, same).select(*out).unionByName(cold.select(*out))
