"""Token ids as flat unsigned integer files with 64-bit document offsets.

One write has, per Spark partition, `<name>.ids` (little-endian unsigned integers, 16 or 32 bits wide),
`<name>.offsets` (unsigned 64-bit, one more than documents, counted in ids from the file's start) and
`<name>.docs` (signed 64-bit document ids). Files are in ascending order of doc_id, and so are documents
inside a file. Readers map files into memory, so the folder must be one that every executor mounts.

A task writes under a name of its own attempt and reports it; only files of reported attempts belong to
the result, so a lost executor or a second attempt leaves at most files that nobody reads. The driver sees
one row per file and turns their id counts into bases by a prefix sum.

A null doc_id comes first and is stored as the least 64-bit number; a null text counts as empty and has the
end id only. Repeated rows are written once per row. An empty table gives no files.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import text as tx
from seriesforge.llm import tokens
from seriesforge.sources import staging

NO_ID = -(1 << 63)
_PARTS = "name string, first long, docs long, ids long"


@dataclass(frozen=True)
class IdFiles:
    folder: str
    width: int  # bytes of an id
    parts: tuple[tuple[str, int, int], ...]  # name, ids of all files before it, documents; in order


def mounted(folder: str) -> str:
    """The path of a folder that every executor mounts."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted folder, not {folder}")
    return url.path


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> IdFiles:
    """Encode every text, append `end_id` to each and write the files below `folder`."""
    path = mounted(folder)
    content = docs.sparkSession.sparkContext.broadcast(tokens.file_text(tokenizer_path))  # the file has under 2 MB
    width = 2 if tokens.library(content.value).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    # The second key splits rows that share one id among partitions.
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokens.library(content.value)
        name, count, docs, first = uuid.uuid4().hex, 0, 0, None
        os.makedirs(path, exist_ok=True)
        base = f"{path}/{name}"
        with open(f"{base}.ids", "wb") as ids_file, open(f"{base}.offsets", "wb") as offsets_file, open(f"{base}.docs", "wb") as docs_file:
            offsets_file.write(np.zeros(1, "<u8").tobytes())
            for block in tx.blocks(batches, "text"):
                ids, at = tokens.with_end(*library.encode(block.column(1))[:2], end_id)
                ids_file.write(ids.astype(f"<u{width}").tobytes())
                offsets_file.write((at[1:] + count).astype("<u8").tobytes())
                keys = block.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                docs_file.write(keys.tobytes())
                first = int(keys[0]) if first is None else first
                count, docs = count + len(ids), docs + len(keys)
        if docs:
            yield pa.RecordBatch.from_pylist([{"name": name, "first": first, "docs": docs, "ids": count}])
        else:
            for ending in ("ids", "offsets", "docs"):
                os.remove(f"{base}.{ending}")

    # One row per file, in the order of partitions, which is that of the keys.
    parts = ordered.mapInArrow(run, _PARTS).collect()
    bases = accumulate((part.ids for part in parts), initial=0)
    return IdFiles(path, width, tuple((part.name, base, part.docs) for part, base in zip(parts, bases)))


DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def maps(files: IdFiles, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and document ids of one file, mapped into memory."""
    kinds = (("ids", f"<u{files.width}"), ("offsets", "<u8"), ("docs", "<i8"))
    return tuple(np.memmap(f"{files.folder}/{name}.{ending}", kind, "r") for ending, kind in kinds)


def read(spark: SparkSession, files: IdFiles) -> DataFrame:
    """One row per document, from the files: its first id's place among all ids, its ids' number and checksum."""
    listed = spark.createDataFrame([(name, base) for name, base, _ in files.parts], "name string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(*(column.to_pylist() for column in batch.columns)):
                ids, offsets, docs = maps(files, name)
                for low in range(0, len(docs), 20_000):
                    high = min(low + 20_000, len(docs))
                    at = offsets[low : high + 1].astype(np.int64)
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    keys = docs[low:high]
                    columns = [pa.array(keys.tolist(), pa.int64(), mask=np.asarray(keys == NO_ID)), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in DIGESTS.split(", ")])

    return listed.repartition(max(1, len(files.parts))).mapInArrow(run, DIGESTS)


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write to a fresh shared folder and read the files back."""
    spark = docs.sparkSession
    return read(spark, write(docs, tokenizer_path, staging.fresh_path(spark, "token-ids"), end_id))
