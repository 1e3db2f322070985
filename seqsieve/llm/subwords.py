"""Hashed subword embeddings, averaged over a document and fed to a linear softmax, trained by SGD in numpy.

A word is a maximal run of letters and digits, lower-cased. Its subwords are the character n-grams of the word between
boundary marks and the word itself, hashed into a fixed number of buckets. A word's embedding is the mean of its
subwords' vectors, a document's the mean of its words'. Both vectors and softmax weights are learned together, so a word
never seen, a misspelling say, gets a vector from the n-grams it shares with known ones.

After training, bucket vectors times softmax weights give a table with a number for each bucket and class; a document's
logits are averages of table entries, so scoring needs no embedding. Text is taken token by token (runs between ASCII
white space); what a token adds is computed once and remembered, within bounded memory.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np

_KINDS: dict[str, np.ndarray] = {}


def _kind(name: str) -> np.ndarray:
    """For each code point, whether str.<name>() holds."""
    if name not in _KINDS:
        _KINDS[name] = np.fromiter((getattr(chr(c), name)() for c in range(0x110000)), bool, 0x110000)
    return _KINDS[name]


def features(tokens: list[str], sizes: tuple[int, ...], buckets: int):
    """(bucket, weight, token number) of every subword, and each token's number of words.

    A subword weighs one over the number of subwords of its word, so a token's weights sum to its number of words.
    """
    text = "\n" + "\n".join(t.lower().replace("\n", " ") for t in tokens) + "\n"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _kind("isalnum")[code]
    token = np.cumsum(code == 10) - 1
    begins = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    n_words = np.bincount(token[begins], minlength=len(tokens))[: len(tokens)]
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), n_words
    word = np.cumsum(np.concatenate(([False], letter[1:] & ~letter[:-1]))) - 1
    mark = np.where(letter, code, np.uint32(1))
    found, owner = [], []
    for n in sizes:
        m = len(mark) - n + 1
        if m <= 0:
            continue
        inside = letter[1 : 1 + m].copy()
        h = mark[:m] * np.uint32(0x9E3779B1)
        for k in range(1, n):
            if 1 < k < n - 1:
                inside &= letter[k : k + m]
            h = (h ^ mark[k : k + m]) * np.uint32(0x01000193)
        at = np.flatnonzero(inside)
        h = h[at]
        found.append((h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x2C1B3C6D) >> np.uint32(7))
        owner.append(word[at + 1])
    place = np.flatnonzero(letter)
    depth = (place - begins[word[place]]).astype(np.uint32)
    whole = np.add.reduceat((code[place] * (np.uint32(2) * depth + np.uint32(1)) * np.uint32(0x9E3779B1)) ^ (code[place] << np.uint32(7)), np.searchsorted(place, begins), dtype=np.uint32)
    found.append((whole ^ (whole >> np.uint32(13))) * np.uint32(0x5BD1E995) >> np.uint32(7))
    owner.append(np.arange(len(begins)))
    found, owner = np.concatenate(found).astype(np.int64) % buckets, np.concatenate(owner)
    weight = 1.0 / np.bincount(owner, minlength=len(begins))
    return found, weight[owner], token[begins][owner], n_words


def counted(text: str) -> dict[str, int]:
    """Times of each token of a text."""
    return Counter(t.decode("utf-8", "replace") for t in text.encode("utf-8", "replace").split())


def document_rows(texts: list[str], sizes, buckets, together: int = 100):
    """CSR (edges, bucket, weight) of the texts' subwords; weights of a document sum to 1 (or it has no words).

    Some documents at a time are cut into subwords, so memory is that of the result.
    """
    edges, cols, vals = [0], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for first in range(0, len(texts), together):
        group = [counted(t) for t in texts[first : first + together]]
        tokens = list({t for d in group for t in d})
        number = {t: i for i, t in enumerate(tokens)}
        bucket, weight, token, n_words = features(tokens, sizes, buckets)
        order = np.argsort(token, kind="stable")
        bucket, weight = bucket[order], weight[order]
        edge = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(tokens)))))
        for d in group:
            ids = np.fromiter((number[t] for t in d), np.int64, len(d))
            times = np.fromiter(d.values(), np.float64, len(d))
            lens = edge[ids + 1] - edge[ids]
            at = np.repeat(edge[ids] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            own, back = np.unique(bucket[at], return_inverse=True)
            cols.append(own.astype(np.int32))
            vals.append((np.bincount(back, weight[at] * np.repeat(times, lens), len(own)) / max(1.0, float((times * n_words[ids]).sum()))).astype(np.float32))
            edges.append(edges[-1] + len(own))
    joined = []
    for parts in (cols, vals):  # parts go as they are joined, so that nothing is there twice
        out, at = np.empty(edges[-1], parts[0].dtype), 0
        for i, part in enumerate(parts):
            out[at : at + len(part)] = part
            at += len(part)
            parts[i] = None
        joined.append(out)
    return np.array(edges), *joined


def _give_back() -> None:
    """Return freed memory to the system, where the C library can: a driver goes on with other work after training."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


@dataclass(frozen=True)
class Model:
    """table[bucket, class]: what an n-gram adds to the logit of a class; logits = scale * mean + bias, over temperature."""

    classes: list
    table: np.ndarray
    bias: np.ndarray
    sizes: tuple[int, ...]
    temperature: float = 1.0

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(texts: list[str], labels: list, *, classes: list, sizes=(3, 4, 5), buckets=1 << 17, dim=8, scale=100.0, steps=700, batch=64, rate=0.2, decay=1e-6, min_documents=5, seed=0) -> Model:
    """Fit embeddings and softmax together by minibatch SGD with per-coordinate step sizes (Adagrad).

    Subwords in fewer than min_documents documents keep a vector of zero.
    """
    rng = np.random.default_rng(seed)
    edges, cols, vals = document_rows(texts, sizes, buckets)
    n, k = len(labels), len(classes)
    y = np.array([classes.index(v) for v in labels], np.int64)
    used = np.flatnonzero(np.bincount(cols, minlength=buckets) >= min_documents)
    at = np.full(buckets, -1, np.int32)
    at[used] = np.arange(len(used))
    cols = at[cols]
    own = cols >= 0
    vals, cols = vals[own], cols[own]
    vals *= np.float32(scale)
    edges = np.where(edges > 0, np.cumsum(own, dtype=np.int32)[edges - 1], 0) if len(own) else edges
    del own
    e = (rng.uniform(-1, 1, (len(used), dim)) / dim).astype(np.float32)
    w = rng.normal(0, 0.1, (dim, k)).astype(np.float32)
    bias = np.log((np.bincount(y, minlength=k) + 1.0) / (n + k))
    ge, gw, gb = np.full(e.shape, 1e-6, np.float32), np.full(w.shape, 1e-6, np.float32), np.full(k, 1e-6)
    order, groups = rng.permutation(n), []
    lens = np.diff(edges)[order]
    stops = np.concatenate(([0], np.cumsum(lens)))

    def in_order(values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        for first in range(0, n, batch):
            docs, own = order[first : first + batch], lens[first : first + batch]
            out[stops[first] : stops[first] + own.sum()] = values[np.repeat(edges[docs] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
        return out

    vals, cols = in_order(vals), in_order(cols)
    for first in range(0, n, batch):  # a batch's layout is worked out once, in the place of its columns
        docs, own = order[first : first + batch], lens[first : first + batch]
        part = slice(stops[first], stops[first] + own.sum())
        which, cols[part] = np.unique(cols[part], return_inverse=True)
        groups.append((docs, which, np.repeat(np.arange(len(docs), dtype=np.uint8 if batch < 256 else np.int32), own), cols[part], vals[part]))
    turn = np.concatenate([rng.permutation(len(groups)) for _ in range(-(-steps // max(1, len(groups))))])[:steps]
    for done, g in enumerate(turn):
        docs, which, row, back, v = groups[g]
        step = np.float32(rate * (1 - done / len(turn)))
        a = np.zeros((len(docs), len(which)), np.float32)
        a[row, back] = v
        x = a @ e[which]
        z = x @ w + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(docs)), y[docs]] -= 1
        p = (p / len(docs)).astype(np.float32)
        de, dw, db = a.T @ (p @ w.T) + decay * e[which], x.T @ p + decay * w, p.sum(0)
        ge[which] += de * de
        gw += dw * dw
        gb += db * db
        e[which] -= step * de / np.sqrt(ge[which])
        w -= step * dw / np.sqrt(gw)
        bias = bias - step * db / np.sqrt(gb)
    table = np.zeros((buckets, k), np.float32)
    table[used] = scale * (e @ w)
    del groups, vals, cols
    _give_back()
    return Model(classes, table, bias, tuple(sizes))


class Scorer:
    """Mean logits of whole texts by a model, with a bounded memory of tokens."""

    def __init__(self, model: Model, keep: int = 150_000):
        self._model, self._keep = model, keep
        self._reset()

    def _reset(self) -> None:
        self._number: dict[bytes, int] = {}
        self._sums = np.zeros((1024, len(self._model.classes) + 1))

    def _learn(self, tokens: list[bytes]) -> None:
        k = len(self._model.classes)
        while len(self._number) + len(tokens) > len(self._sums):
            self._sums = np.concatenate((self._sums, np.zeros_like(self._sums)))
        for at in range(0, len(tokens), 20_000):
            part = tokens[at : at + 20_000]
            bucket, weight, token, n_words = features([t.decode("utf-8", "replace") for t in part], self._model.sizes, len(self._model.table))
            base = len(self._number)
            out = self._sums[base : base + len(part)]
            for j in range(k):
                out[:, j] = np.bincount(token, self._model.table[bucket, j] * weight, len(part))
            out[:, k] = n_words
            self._number.update(zip(part, range(base, base + len(part))))

    def means(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(mean table entry by class, number of words) of each text; a text without words has mean 0."""
        split = [t.split() for t in texts]
        if len(self._number) > self._keep:
            self._reset()
        number = self._number
        fresh = {t for ts in split for t in ts if t not in number}
        if fresh:
            self._learn(list(fresh))
        total = np.zeros((len(texts), self._sums.shape[1]))
        for i, ts in enumerate(split):
            total[i] = self._sums[np.fromiter(map(number.__getitem__, ts), np.int64, len(ts))].sum(0)
        words = total[:, -1]
        return total[:, :-1] / np.maximum(1, words)[:, None], words
