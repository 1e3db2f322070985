"""Maximal periodic runs of words, found by string synchronising sets, and texts without their repeated periods.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word
extends, of at least four periods and `least` words. Runs are found scale by scale, tau = 1, 2, 4, ...:

- words get numbers, and stretches of tau words get names by prefix doubling; a stretch that occurs once in its document has
  no name any more, as no run of four periods holds it;
- the synchronising set of a scale has the positions i where the least hash of the names at i, ..., i + tau stands at i or at
  i + tau. It depends on the 2 tau words from i on only, so equal contexts are chosen alike. Positions inside regions of a
  period of tau / 4 or less are left out, which keeps the set sparse;
- two neighbouring chosen positions with equal contexts, tau to 2 tau - 1 apart, propose their distance as a period, and
  comparing words to both sides shows how far it holds. Any run of that period and four repeats has such a pair;
- the left-out regions of small periods are runs themselves, known from the smaller scales, which supply them.

The documents of a batch are searched together; names are a document's own. Nothing is shuffled: a row's result depends on its
text (and doc_id, see `tail`) alone.

Cases: a null, empty or blank text has no words and no runs, its collapsed text is empty; words are compared by their bytes, so
case and marks count; a null doc_id keeps its text as it is; repeated rows are answered alike; ties for the longest run go to
the smallest start, then period; a very long text is searched whole, in its task; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Periods that a run holds at least. The sets above find every run of four or more.
REPEATS = 4
#: Bytes of text that are searched together.
TOGETHER = 1 << 22
_NONE = np.uint64(2**64 - 1)


def stated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from a on repeat their first p, for a tenth of the documents by the CRC-32 of the id; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _hashed(names: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of names: different names never share a hash."""
    x = names.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, names, number of names) of the keys that occur twice or more."""
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    often = count > 1
    names = (np.cumsum(often) - 1)[which]
    keep = often[which]
    return at[keep], names[keep], int(often.sum())


def _matching(ids: np.ndarray, x: int, d: int, end: int) -> int:
    """The first y >= x with ids[y] != ids[y + d], or end - d."""
    size = 32
    while x < end - d:
        stop = min(x + size, end - d)
        differ = ids[x:stop] != ids[x + d : stop + d]
        if differ.any():
            return x + int(differ.argmax())
        x, size = stop, 2 * size
    return max(x, end - d)


def _matching_back(ids: np.ndarray, x: int, d: int, begin: int) -> int:
    """The least y <= x such that ids[z] == ids[z + d] for all z in [y, x)."""
    size = 32
    while x > begin:
        start = max(begin, x - size)
        differ = ids[start:x] != ids[start + d : x + d]
        if differ.any():
            return x - int(differ[::-1].argmax())
        x, size = start, 2 * size
    return begin


def runs_of(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (document, start, end, period), sorted, of all runs of REPEATS periods or more in consecutive documents of numbered
    words; ends: where each document ends in ids. Starts and ends count from the first word of all."""
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    doc_of = np.repeat(np.arange(len(ends)), ends - begins)
    found: set[tuple[int, int, int, int]] = set()
    if not len(ids):
        return np.zeros((0, 4), np.int64)
    at, name, n_names = _repeated(np.arange(len(ids)), doc_of * (int(ids.max()) + 1) + ids)
    named = np.full(len(ids), -1)  # names by position, of the scale at hand
    tau = 1
    while len(at):
        # Contexts: stretches of 2 tau words, where both halves have names.
        named[at] = name
        first = np.flatnonzero(at + tau < len(ids))
        after = named[at[first] + tau]
        whole = (after >= 0) & (doc_of[np.minimum(at[first] + tau, len(ids) - 1)] == doc_of[at[first]])
        first, after = first[whole], after[whole]
        next_at, next_name, next_names = _repeated(at[first], name[first] * n_names + after)
        if len(next_at):
            _add_runs(found, ids, begins, ends, doc_of, at, name, next_at, next_name, tau)
        named[at] = -1
        at, name, n_names, tau = next_at, next_name, next_names, 2 * tau
    return np.array(sorted(found), np.int64).reshape(-1, 4)


def _add_runs(found: set, ids, begins, ends, doc_of, at, name, context_at, context, tau: int) -> None:
    """Add the runs of periods from tau to 2 tau - 1."""
    hashes = _hashed(name)
    periodic = np.zeros(len(at) + 1, np.int64)
    for _, start, end, q in found:
        if REPEATS * q <= tau <= end - start:
            periodic[np.searchsorted(at, start)] += 1
            periodic[np.searchsorted(at, end - tau, "right")] -= 1
    hashes[np.cumsum(periodic[:-1]) > 0] = _NONE
    # A context occurs twice, so the stretches in it have names: its positions stand side by side in `at`.
    i = np.searchsorted(at, context_at)
    least, width = hashes, 1
    while width < tau:  # the least of each `width` neighbours
        least = np.minimum(least, np.concatenate((least[width:], np.full(min(width, len(least)), _NONE))))
        width *= 2
    least = np.minimum(least[i], hashes[i + tau])
    chosen = (least != _NONE) & ((hashes[i] == least) | (hashes[i + tau] == least))
    where, which = context_at[chosen], context[chosen]
    order = np.argsort(which, kind="stable")
    where, which = where[order], which[order]
    apart = np.diff(where)
    pairs = np.flatnonzero((which[1:] == which[:-1]) & (apart >= tau) & (apart < 2 * tau))
    last: dict[int, int] = {}  # by period, where the last stretch ended
    for x, d in sorted(zip(where[pairs].tolist(), apart[pairs].tolist())):
        if x < last.get(d, 0):
            continue
        doc = int(doc_of[x])
        stop = _matching(ids, x, d, int(ends[doc]))
        start = _matching_back(ids, x, d, int(begins[doc]))
        last[d] = stop
        if stop + d - start >= REPEATS * d:
            found.add((doc, start, stop + d, d))


def _words(texts: list[bytes]):
    """(dictionary of words, numbers of all words, ends of the texts) of UTF-8 texts, by ASCII white space."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    ids, edges = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
    words = coded.dictionary.view(pa.large_binary())
    blank = np.flatnonzero(pc.binary_length(words).to_numpy() == 0)  # white space at a text's begin or end leaves an empty word
    real = np.isin(ids, blank, invert=True) if len(blank) else np.ones(len(ids), bool)
    before = np.concatenate(([0], np.cumsum(real)))
    return words, ids[real], before[edges[1:] - edges[0]]


def _planted(ids: np.ndarray, ends: np.ndarray, doc_ids: list, tail) -> np.ndarray:
    out, begin = ids.copy(), 0
    for doc_id, end in zip(doc_ids, ends.tolist()):
        if (ap := tail(doc_id, end - begin)) is not None:
            a, p = ap
            out[begin + a : end] = np.resize(ids[begin + a : begin + a + p], end - begin - a)
        begin = end
    return out


def find_runs(docs: DataFrame, *, least: int = 6, tail=None, with_runs: bool = True, text: str = "text") -> DataFrame:
    """For each row: doc_id, n_words, n_runs, the longest run's start, length, period and exponent_milli (null without runs),
    SHA-256 of all runs' lines `start,length,period` and of the collapsed text, which drops each run's words after its first
    period. with_runs adds both themselves: runs array<struct<start, length, period>>, collapsed string.

    tail(doc_id, n) -> (a, p) or None makes a document's words from a on repeat their first p before the search."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from . import tokens

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for at, texts in tokens.batches(batch.column("text"), TOGETHER):
                doc_ids = names[at : at + len(texts)]
                words, ids, ends = _words(texts)
                if tail is not None:
                    ids = _planted(ids, ends, doc_ids, tail)
                begins = np.concatenate(([0], ends[:-1]))
                runs = runs_of(ids, ends)
                runs = runs[runs[:, 2] - runs[:, 1] >= least]
                drop = np.zeros(len(ids) + 1, np.int64)
                np.add.at(drop, runs[:, 1] + runs[:, 3], 1)
                np.add.at(drop, runs[:, 2], -1)
                keep = np.cumsum(drop[:-1]) == 0
                kept = words.take(pa.array(ids[keep]))
                edges = np.concatenate(([0], np.cumsum(keep)))[np.append(begins, ends[-1])]
                collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges), kept), pa.scalar(b" ", pa.large_binary())).to_pylist()
                own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for doc, start, end, q in runs.tolist():
                    own[doc].append((start - int(begins[doc]), end - start, q))
                best = [min(x, key=lambda r: (-r[1], r[0], r[2])) if x else (None, None, None) for x in own]
                listed = ["".join("%d,%d,%d\n" % r for r in x).encode() for x in own]
                columns = {
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "n_words": pa.array(ends - begins, pa.int64()),
                    "n_runs": pa.array([len(x) for x in own], pa.int64()),
                    **{c: pa.array([b[k] for b in best], pa.int64()) for k, c in enumerate(("start", "length", "period"))},
                    "exponent_milli": pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64()),
                    "runs_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in listed]),
                    "collapsed_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in collapsed]),
                }
                if with_runs:
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                    columns["runs"] = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in own], kind)
                    columns["collapsed"] = pa.array([x.decode("utf-8", "replace") for x in collapsed])
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string" * with_runs
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
