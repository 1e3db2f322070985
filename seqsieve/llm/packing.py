"""Packing token sequences into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows; what remains of each, and every shorter document,
is one piece. Pieces are dealt by a hash into groups of a few thousand, and each group is packed by itself: pieces
in descending length, each into the open window with the least room that still holds it, found in a segment tree
indexed by remaining capacity. A group wastes about one window, so the padding added by grouping is well under
one window in a thousand, while no task ever holds more than its groups.

Cases: a null text counts as empty and packs its end id alone; rows with a null or a repeated doc_id are each packed;
ties of length go by doc_id and then by checksum; a very long text is tokenized whole in its task and cut into full windows;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, *, vocabulary: str, end_id: int = 2, window: int = 4096, text: str = "text") -> DataFrame:
    """Pieces of every document's ids (with the end id): full windows and one shorter rest."""

    def cut(batches):
        import pyarrow as pa

        from . import tokens

        encoder = tokens.WordEncoder.shared(vocabulary)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in tokens.batches(batch.column("text"), 1 << 22):
                ids, ends = encoder.ended(texts, end_id)
                data, out, begin = memoryview(ids.tobytes()), [], 0
                for doc_id, end in zip(doc_ids[at : at + len(texts)], ends.tolist()):
                    for a in range(begin, end, window):
                        z = min(end, a + window)
                        out.append((doc_id, a - begin, z - a, zlib.crc32(data[4 * a : 4 * z]), end - begin))
                    begin = end
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, PIECES)


class RoomTree:
    """Counts of open windows by remaining room, in a segment tree."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, length: int) -> int:
        """The least room of at least `length` that an open window has, or -1."""
        at, count = length + self.size, self.count
        if count[at]:
            return length
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths, window: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each length; lengths must come in descending order and fit a window."""
    tree, by_room = RoomTree(window), {}
    of, offset, opened = [], [], 0
    for n in lengths:
        room = tree.tightest(n)
        if room < 0:
            room, w = window, opened
            opened += 1
        else:
            tree.add(room, -1)
            w = by_room[room].pop()
        of.append(w)
        offset.append(window - room)
        if room > n:
            tree.add(room - n, 1)
            by_room.setdefault(room - n, []).append(w)
    return of, offset


def pack(pieces: DataFrame, *, window: int = 4096, group: int = 4096) -> DataFrame:
    """pieces(..., place long) with sequence_id and offset. pieces is read twice, so pass a written table."""
    groups = max(1, round(pieces.count() / group))

    def fit(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        of, offset = best_fit_decreasing(pdf["length"].tolist(), window)
        pdf["sequence_id"] = pdf["bucket"].astype("int64") * (1 << 32) + np.array(of, "int64")
        pdf["offset"] = np.array(offset, "int64")
        return pdf.drop(columns="bucket")

    # `place` deals rows that are equal in all else to different groups.
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "place"), F.lit(groups))).drop("place")
    return dealt.groupBy("bucket").applyInPandas(fit, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, vocabulary: str, end_id: int = 2, window: int = 4096, group: int = 4096, text: str = "text") -> DataFrame:
    pieces = cut_pieces(docs, vocabulary=vocabulary, end_id=end_id, window=window, text=text)
    pieces = written(pieces.withColumn("place", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, window=window, group=group)
