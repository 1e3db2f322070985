"""Token-id files coded by a static range asymmetric numeral system (see ans.py).

A data set of token ids is a folder of Parquet files whose rows are containers: the ids of consecutive documents
in one rANS stream, beside the documents' ids and lengths. Spark's writer commits them, so a lost executor or a
repeated task leaves no half-written or doubled container, and any reader of Parquet finds the containers in any store.

Cases: a null text counts as empty; a document without tokens holds the end id alone; rows with a null doc_id come
first; rows that share a doc_id are ordered by a hash of their texts and each is kept; an empty table gives an empty
folder of files; other columns of the input are ignored; a very long document makes one large container; a container of more
than 2^19 different ids, more than the vocabulary has, is an error.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONTAINER = "part int, before long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, payload binary"
#: Bytes of text that are tokenized together.
TOGETHER = 1 << 22


def write_token_files(docs: DataFrame, path: str, *, vocabulary: str, end_id: int = 1, container_ids: int = 1 << 21, text: str = "text") -> None:
    """Encode every whole text and write the containers in ascending doc_id order."""

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from . import ans, tokens

        encoder = tokens.WordEncoder.shared(vocabulary)
        part, before = TaskContext.get().partitionId(), 0
        names, lengths, parts, held = [], [], [], 0

        def container():
            columns = [[part], [before], [held], [names], [np.concatenate(lengths)], [ans.encode(np.concatenate(parts))]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "before", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in tokens.batches(batch.column("text"), min(TOGETHER, 4 * container_ids)):
                ids, ends = encoder.ended(texts, end_id)
                names += doc_ids[at : at + len(texts)]
                lengths.append(np.diff(ends, prepend=0))
                parts.append(ids)
                held += len(ids)
                if held >= container_ids:
                    yield container()
                    before += held
                    names, lengths, parts, held = [], [], [], 0
        if parts:
            yield container()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie").mapInArrow(encode, CONTAINER).write.mode("errorifexists").parquet(path)


def read_token_files(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, decoded from the files. start: ids of all documents before it."""

    def decode(batches):
        import pyarrow as pa

        from . import ans

        for batch in batches:
            for row in range(batch.num_rows):
                part, before, names, lengths, payload = (batch.column(c)[row].as_py() for c in ("part", "before", "doc_ids", "lengths", "payload"))
                ids = ans.decode(payload)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist())]
                out = [pa.array([part] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(starts + before, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(out, [*("part", "doc_id", "start", "n_tokens", "ids_crc32"), *["ids"] * with_ids])

    files = spark.read.schema(CONTAINER).parquet(path)
    # One row for each task of the writer, so the window and the broadcast are small at any size of data.
    bases = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = files.drop("n_ids").mapInArrow(decode, "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids)
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
