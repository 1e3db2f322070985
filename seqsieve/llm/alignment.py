"""Tokens of two tokenizers aligned by byte ranges, and how often the corpus links their ids.

A is a byte-level BPE vocabulary (tokenizers), B a sentencepiece vocabulary; both encode a space and the text. Byte offsets where
tokens of both end cut the tokens into groups. Groups are found by pointer jumping: every token points to the token that
overlaps it and reaches farthest right (of an A and a B token that end together the A token points to the B token, and the B
token to itself); doubling all pointers at once until nothing moves leads each token to its group's last one.

Neither tokenizer has a token across a single space between two other characters: B's pieces hold the space mark at their
beginning only (checked), and A's pre-tokenizer begins a piece at such a space. So a text's tokens, groups and links are those of
its stretches between such places, and each different stretch is encoded and aligned once by a worker while it remembers it.

The corpus-wide counts never pass through one task or the driver: a task writes, for each few megabytes of text, one row with the
documents' figures, their links as numbers, and the different linked id pairs; the pairs are summed over all rows, joined
back to them, and each row's documents are summed with these counts. Only the highest count of each B id is broadcast, at
most one row for each entry of B's vocabulary.

Cases: a text that is null, empty or no valid UTF-8, or whose joined A or B bytes differ from the space and the text (it holds
B's space mark, say) has no tokens: zeros and empty groups; special tokens' strings in a text are plain text; repeated rows
count as often as they occur; rows with a null doc_id count and are returned; a very long text is aligned whole, in its task; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
_MARK = "▁"
#: Bytes of text whose documents share a row; a worker takes some 160 MB while it aligns them.
TOGETHER = 1 << 20
_PLACES = re.compile(r"(?<=\S)(?= \S)")
#: An id pair as one number.
_B_BITS = 32
_ROWS = (
    "batch long, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, sha256 array<string>, "
    "groups array<string>, cuts array<array<bigint>>, low binary, high binary, pairs array<bigint>, times array<bigint>"
)


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A and each B token, the B token that ends its group. The ends ascend from a common begin to a common end."""
    n_a, n_b = len(a_ends), len(b_ends)
    tokens = np.concatenate((a_ends, b_ends))
    right_b = np.searchsorted(b_ends, a_ends, "left")  # the B token that holds an A token's last byte
    right_a = np.searchsorted(a_ends, b_ends, "left")
    to = np.concatenate((n_a + right_b, np.where(a_ends[right_a] > b_ends, right_a, n_a + np.arange(n_b))))
    if len(tokens):
        while True:
            after = to[to]
            if np.array_equal(after, to):
                break
            to = after
    return to[:n_a] - n_a, to[n_a:] - n_a


class Stretches:
    """Aligned stretches of text by number; what a Python worker remembers of them between batches."""

    def __init__(self, a_path: str, b_path: str, keep: int = 150_000, keep_chars: int = 1 << 23):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        from .tokens import _SHOWN

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: b for b, c in _SHOWN.items()}
        entries = self._a.get_vocab()
        self._a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self._a_bytes[k] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        pieces = [self._b.id_to_piece(k) for k in range(self._b.vocab_size())]
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("a piece of B spans a space between two characters")
        self._b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(k) else p.replace(_MARK, " ").encode() for k, p in enumerate(pieces)]
        self._a_size, self._b_size = (np.array([len(x) for x in own], np.int64) for own in (self._a_bytes, self._b_bytes))
        self._marked = [f"{k}{mark}" for k in range(max(len(self._a_bytes), len(pieces))) for mark in (",", "|", ";", "")]
        self._keep, self._keep_chars = keep, keep_chars
        self.clear()

    @classmethod
    def shared(cls, a_path: str, b_path: str) -> "Stretches":
        from .tokens import kept

        return kept(("stretches", a_path, b_path), lambda: cls(a_path, b_path))

    def clear(self) -> None:
        self._slot: dict[str, int] = {}
        self._chars = 0
        self.figures = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, bytes, 1 if the bytes differ
        self._links = np.zeros((2, 0), np.int64)  # pair, end in the stretch
        self._first_link = np.zeros(1, np.int64)  # where each stretch's links begin
        self._shown = np.zeros(0, np.int32)  # ids in the order in which groups are written, each with the mark after it
        self._first_shown = np.zeros(1, np.int64)

    def numbers(self, stretches: list[str]) -> np.ndarray:
        """The numbers of the stretches, valid until the next call."""
        if len(self._slot) > self._keep or self._chars > self._keep_chars:
            self.clear()
        fresh = [s for s in dict.fromkeys(stretches) if s not in self._slot]
        for at in range(0, len(fresh), 20_000):
            self._align(fresh[at : at + 20_000])
        return np.fromiter(map(self._slot.__getitem__, stretches), np.int64, len(stretches))

    def _encoded(self, encode, known: list[bytes], size: np.ndarray, lines: list[str], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all lines in a row, where each text's ids end), the lines being the texts in a row. A text whose tokens do not
        have its bytes has no ids."""
        ids = np.fromiter(chain.from_iterable(encode(lines)), np.int64)
        ends, stops = np.cumsum(size[ids]), np.cumsum([len(t) for t in texts])
        stop = np.searchsorted(ends, stops) + 1
        if b"".join(map(known.__getitem__, ids.tolist())) == b"".join(texts) and np.array_equal(ends[stop - 1], stops):
            return ids, stop
        own = [x if b"".join(map(known.__getitem__, x)) == t else [] for x, t in zip(encode([t.decode() for t in texts]), texts)]
        return np.fromiter(chain.from_iterable(own), np.int64), np.cumsum([len(x) for x in own])

    def _align(self, fresh: list[str]) -> None:
        # In a row, stretches that begin and end clearly are cut where they are joined.
        clear = [not s[1].isspace() and not s[-1].isspace() for s in fresh]
        fresh = [s for s, c in zip(fresh, clear) if c] + [s for s, c in zip(fresh, clear) if not c]
        n_clear = sum(clear)
        lines = ["".join(fresh[at : min(at + 500, n_clear)]) for at in range(0, n_clear, 500)] + fresh[n_clear:]
        texts = [s.encode() for s in fresh]
        a, stop_a = self._encoded(lambda x: [e.ids for e in self._a.encode_batch_fast(x, add_special_tokens=False)], self._a_bytes, self._a_size, lines, texts)
        b, stop_b = self._encoded(lambda x: self._b.encode([s[1:] for s in x], num_threads=1), self._b_bytes, self._b_size, lines, texts)  # B puts the first space itself
        n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        if (odd := (n_a == 0) | (n_b == 0)).any():
            a, b = a[~np.repeat(odd, n_a)], b[~np.repeat(odd, n_b)]
            n_a[odd] = n_b[odd] = 0
        a_ends, b_ends = np.cumsum(self._a_size[a]), np.cumsum(self._b_size[b])
        a_group, b_group = group_ends(a_ends, b_ends)  # by the number of the group's last B token
        is_last_a, is_last_b = (np.diff(g, append=-1) != 0 for g in (a_group, b_group))
        last_a, last_b = np.flatnonzero(is_last_a), np.flatnonzero(is_last_b)
        n_groups = np.diff(np.searchsorted(last_a, np.concatenate(([0], np.cumsum(n_a)))))
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.concatenate(([0], np.cumsum(np.where(n_a > 0, size, 0))[:-1]))
        links = np.stack(((a[last_a] << _B_BITS) | b[last_b], a_ends[last_a] - np.repeat(begin, n_groups)))
        # A group's A tokens are written before its B tokens: an A token follows the A tokens before it and the earlier groups' B tokens.
        group_of_a = np.cumsum(is_last_a) - is_last_a
        earlier_b = np.concatenate(([0], last_b + 1))[group_of_a]
        shown = np.full(len(a) + len(b), -1, np.int64)
        shown[np.arange(len(a)) + earlier_b] = 4 * a + np.where(is_last_a, 1, 0)
        shown[shown < 0] = 4 * b + np.where(is_last_b, 2, 0)
        self._slot.update(zip(fresh, range(len(self._slot), len(self._slot) + len(fresh))))
        self._chars += int(size.sum())
        self.figures = np.concatenate((self.figures, np.stack((n_a, n_b, n_groups, size, (n_a == 0).astype(np.int64)), 1)))
        self._links = np.concatenate((self._links, links), 1)
        self._first_link = np.concatenate((self._first_link, self._first_link[-1] + np.cumsum(n_groups)))
        self._shown = np.concatenate((self._shown, shown.astype(np.int32)))
        self._first_shown = np.concatenate((self._first_shown, self._first_shown[-1] + np.cumsum(n_a + n_b)))

    def links(self, numbers: np.ndarray) -> np.ndarray:
        """(pair, end in its stretch) of all links of the stretches in a row."""
        return self._links[:, _stretched(self._first_link, numbers)]

    def shown(self, numbers: np.ndarray) -> list[str]:
        """The ids of the stretches in a row, each with the mark after it: together, the groups as a1,a2|b1;a3|b2,b3;"""
        return list(map(self._marked.__getitem__, self._shown[_stretched(self._first_shown, numbers)].tolist()))


def _stretched(first: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The places of the stretches' entries in a row."""
    begin, n = first[numbers], first[numbers + 1] - first[numbers]
    stop = np.cumsum(n)
    return np.repeat(begin - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)


def _aligned(own: Stretches, texts: list[bytes], with_groups: bool):
    """The arrays of _ROWS, but for batch and doc_ids, of UTF-8 texts."""
    split = []
    for t in texts:
        try:
            split.append(_PLACES.split(" " + t.decode()) if t else [])
        except UnicodeDecodeError:
            split.append([])
    n = np.array([len(x) for x in split], np.int64)
    numbers = own.numbers(list(chain.from_iterable(split)))
    sums = np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(own.figures[numbers], 0)))
    edges = np.concatenate(([0], np.cumsum(n)))
    figures = np.diff(sums[edges], axis=0)
    valid = figures[:, 4] == 0
    numbers = numbers[np.repeat(valid, n)]
    figures, n = np.where(valid[:, None], figures, 0), np.where(valid, n, 0)
    shown, at, digests, groups = own.shown(numbers), 0, [], []
    for k in (figures[:, 0] + figures[:, 1]).tolist():
        whole = "".join(shown[at : at + k])[:-1]
        at += k
        digests.append(hashlib.sha256(whole.encode()).hexdigest() if whole else "")
        groups.append(whole if with_groups else None)
    pair, end = own.links(numbers)
    cuts = None
    if with_groups:
        begin = np.concatenate(([0], np.cumsum(own.figures[numbers, 3])))
        stretch_base = begin[:-1] - np.repeat(begin[np.concatenate(([0], np.cumsum(n)))[:-1]], n)  # within its text
        ends = end + np.repeat(stretch_base, own.figures[numbers, 2]) - 1  # without the space before the text
        cuts = np.split(ends, np.cumsum(figures[:, 2])[:-1])
    pairs, which, times = np.unique(pair, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")  # frequent pairs get small numbers, so that the links' high halves are mostly zero
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    local = place[which]
    return figures, digests, groups, cuts, (local & 0xFFFF).astype("<u2").tobytes(), (local >> 16).astype("<u2").tobytes(), pairs[order], times[order]


def align(docs: DataFrame, *, a_path: str, b_path: str, with_groups: bool = True, text: str = "text") -> DataFrame:
    """For each row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see the query's contract).

    A link is an A and a B token that end together; a pair's count is the number of links of its ids over all rows; n_best has the links
    whose count is the highest of their B id; count_sum is the sum of the links' counts. with_groups adds groups, as text in
    the form a1,a2|b1;a3|b2,b3, and cuts, the byte offsets in the text where the groups end."""

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from . import tokens

        own = Stretches.shared(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        longs = pa.list_(pa.int64())
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in tokens.batches(batch.column("text"), TOGETHER):
                figures, digests, groups, cuts, low, high, pairs, times = _aligned(own, texts, with_groups)
                columns = [
                    pa.array([number], pa.int64()), pa.array([doc_ids[at : at + len(texts)]], longs), *(pa.array([figures[:, k]], longs) for k in range(3)),
                    pa.array([digests], pa.list_(pa.string())), pa.array([groups if with_groups else None], pa.list_(pa.string())),
                    pa.array([cuts], pa.list_(longs)), pa.array([low], pa.binary()), pa.array([high], pa.binary()), pa.array([pairs], longs), pa.array([times], longs),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ROWS.split(", ")])
                number += 1

    def counted(row, known):
        import pyarrow as pa

        from . import tokens

        tokens.kept(("counts",))  # the stretches are not needed any more
        get = {c: row.column(c)[0] for c in row.column_names}
        n_a, n_b, n_groups = (np.array(get[c].as_py(), np.int64) for c in ("n_a", "n_b", "n_groups"))
        count, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        place = known.column("place").to_numpy()
        count[place], best[place] = known.column("count").to_numpy(), known.column("best").to_numpy()
        low, high = (np.frombuffer(get[c].as_buffer(), "<u2") for c in ("low", "high"))
        local = low.astype(np.int64) | high.astype(np.int64) << 16
        edges = np.concatenate(([0], np.cumsum(n_groups)))
        n_best, count_sum = (np.diff(np.concatenate(([0], np.cumsum(x[local])))[edges]) for x in (best, count))
        values = [get["doc_ids"].values, n_a, n_b, n_groups, n_groups, n_best, count_sum, get["sha256"].values]
        if with_groups:
            values += [get["groups"].values, get["cuts"].values]
        return pa.Table.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in values], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups", "cuts"] * with_groups]
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string, cuts array<bigint>" * with_groups
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    aligned = written(rows.mapInArrow(encode, _ROWS), "aligned")
    local = aligned.select("batch", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "p")).select("batch", F.col("place").cast("long").alias("place"), F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    totals = local.groupBy("pair").agg(F.sum("times").alias("count"))
    totals = written(totals.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1))), "pair-counts")
    highest = totals.groupBy("b").agg(F.max("count").alias("highest"))  # at most a row for each entry of B's vocabulary
    valued = totals.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    # A row and its pairs meet in one group, which goes to Python alone: rows are a few megabytes each.
    back = local.join(valued, "pair").select(F.col("batch").alias("of"), "place", "count", "best")
    return aligned.drop("pairs", "times").groupBy("batch").cogroup(back.groupBy("of")).applyInArrow(counted, schema)
