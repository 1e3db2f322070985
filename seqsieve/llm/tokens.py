"""Token ids of whole texts by a public tokenizer, inside Arrow batches.

The tokenizer of word_bpe_49k.json never lets a token span ASCII white space: its normaliser composes
characters (no composition crosses a space), folds white space and lower-cases, and its pieces hold no
white space. So the ids of a text are the ids of its white-space-separated words in order. Arrow splits a batch of texts
into words and finds the different ones; most are a run of letters with marks around it, whose ids are the runs' ids, and a
run met before is not encoded again. New runs go to the tokenizer's model together, other words to the whole tokenizer.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A word of Latin-1 letters with marks around it: the pre-tokenizer parts letters from marks, so each run has its own ids.
_MARKS, _LETTERS = r"[!-&(-/:-@\[-`{-~]*", "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_PLAIN = f"^(?P<a>{_MARKS})(?P<b>{_LETTERS})(?P<c>{_MARKS})$"
#: A word of more bytes is encoded whole and not remembered.
_LONG = 64


def _byte_characters() -> dict[int, str]:
    """The character that byte-level BPE shows for each byte: itself if it is printable Latin-1, else the next one from 256 on."""
    out, other = {}, 256
    for byte in range(256):
        plain = 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174
        out[byte] = chr(byte if plain else other)
        other += not plain
    return out


_SHOWN = _byte_characters()


_kept: dict = {}


def kept(key, make=None):
    """What this Python worker remembers between tasks: one thing at a time, made anew when another was asked for since.

    Workers serve the tasks of all stages, so what one operator remembers would otherwise stay beside the next one's."""
    if _kept.get("key") != key:
        _kept.clear()
        if make is not None:
            _kept.update(key=key, value=make())
    return _kept.get("value")


def _gathered(arena: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of the arena, one after the other."""
    ends = np.cumsum(length)
    return arena[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)]


class _Memory:
    """Ids by key, in one array; emptied when more than `keep` keys are held."""

    def __init__(self, keep: int):
        self._keep = keep
        self.clear()

    def clear(self) -> None:
        self._slot: dict[str, int] = {}
        self._start, self._length, self._arena, self._used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 14, np.uint16), 0

    def find(self, keys: list[str], encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(arena, start, length) for the keys; encode(new keys) gives (ids, lengths)."""
        if len(self._slot) > self._keep:
            self.clear()
        slot = self._slot
        fresh = [k for k in keys if k not in slot]
        if fresh:
            ids, lengths = encode(fresh)
            base, used = len(slot), self._used
            while base + len(fresh) > len(self._start):
                self._start, self._length = (np.concatenate((x, np.zeros_like(x))) for x in (self._start, self._length))
            while used + len(ids) > len(self._arena):
                self._arena = np.concatenate((self._arena, np.zeros_like(self._arena)))
            self._arena[used : used + len(ids)] = ids
            self._start[base : base + len(fresh)] = used + np.cumsum(lengths) - lengths
            self._length[base : base + len(fresh)] = lengths
            self._used = used + len(ids)
            slot.update(zip(fresh, range(base, base + len(fresh))))
        at = np.fromiter(map(slot.__getitem__, keys), np.int64, len(keys))
        return self._arena, self._start[at], self._length[at]


class WordEncoder:
    """ids(texts): uint16 ids of each UTF-8 text. At most `keep` runs and a quarter as many other words are remembered
    between batches."""

    def __init__(self, path: str, keep: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        whole = Tokenizer.from_file(path)
        self._whole = whole.encode_batch
        model = Tokenizer(whole.model)  # runs are pieces already, in lower case
        model.pre_tokenizer = WhitespaceSplit()
        self._model = model.encode_batch_fast
        vocabulary = model.get_vocab(with_added_tokens=False)
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)
        self._last[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self._runs, self._odd = _Memory(keep), _Memory(keep // 4)

    @classmethod
    def shared(cls, path: str) -> "WordEncoder":
        """One encoder for each Python worker, so that its words serve all the worker's tasks."""
        return kept(("words", path), lambda: cls(path))

    def _encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many runs in one line; the last id of each says so."""
        ids, lengths = [np.zeros(0, np.uint16)], np.zeros(len(runs), np.int64)
        where = np.array([k for k, x in enumerate(runs) if x], np.int64)
        for at in range(0, len(where), 500):
            some = [runs[k] for k in where[at : at + 500]]
            shown = [x if x.isascii() else x.encode().decode("latin-1").translate(_SHOWN) for x in some]
            (line,) = self._model([" ".join(shown)], add_special_tokens=False)
            own = np.array(line.ids, np.uint16)
            ends = np.flatnonzero(self._last[own])
            if len(ends) != len(some) or ends[-1] != len(own) - 1:
                raise ValueError("the vocabulary does not mark the ends of its pieces")
            ids.append(own)
            lengths[where[at : at + 500]] = np.diff(ends, prepend=-1)
        return np.concatenate(ids), lengths

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [array("H", e.ids) for at in range(0, len(words), 20_000) for e in self._whole(words[at : at + 20_000], add_special_tokens=False)]
        return np.frombuffer(b"".join(x.tobytes() for x in parts), np.uint16), np.array([len(x) for x in parts], np.int64)

    def _words(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(arena, start, length) of an Arrow array of different words."""
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.and_(pc.less_equal(pc.binary_length(words), _LONG), pc.invert(pc.match_substring(words, "<|")))  # special tokens are not cut
        parted = pc.extract_regex(pc.if_else(plain, words, None), _PLAIN)
        is_plain = parted.is_valid().to_numpy(zero_copy_only=False)
        n = int(is_plain.sum())
        a, b, c = (x.filter(parted.is_valid()) for x in parted.flatten())
        runs = pa.concat_arrays([a, pc.utf8_lower(b), c]).dictionary_encode()
        arena, start, length = self._runs.find(runs.dictionary.to_pylist(), self._encode_runs)
        which = runs.indices.to_numpy().reshape(3, n).T.reshape(-1)  # a, b, c of the first word, then of the second
        length_of_runs = length[which].reshape(n, 3)
        found = [_gathered(arena, start[which], length[which])]
        lengths = np.zeros(len(words), np.int64)
        lengths[is_plain] = length_of_runs.sum(1)
        begins = np.zeros(len(words), np.int64)
        begins[is_plain] = np.cumsum(lengths[is_plain]) - lengths[is_plain]
        if n < len(words):
            odd = words.filter(parted.is_null())
            brief = pc.less_equal(pc.binary_length(odd), _LONG).to_numpy(zero_copy_only=False)
            for short in (True, False):
                own = odd.filter(pa.array(brief == short)).to_pylist()
                if own:
                    memory = self._odd if short else _Memory(0)
                    arena, start, length = memory.find(own, self._encode_words)
                    places = np.flatnonzero(~is_plain)[brief == short]
                    lengths[places] = length
                    begins[places] = sum(map(len, found)) + np.cumsum(length) - length
                    found.append(_gathered(arena, start, length))
        return np.concatenate(found), begins, lengths

    def flat_ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ends of the texts in it)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        try:
            column = pa.array(texts, pa.large_string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            column = pa.array([t.decode("utf-8", "replace") for t in texts], pa.large_string())
        split = pc.ascii_split_whitespace(column)
        coded = split.flatten().dictionary_encode()
        arena, start, length = self._words(coded.dictionary.cast(pa.large_string()))
        which, edges = coded.indices.to_numpy(), split.offsets.to_numpy()
        lengths = length[which]
        ends = np.concatenate(([0], np.cumsum(lengths)))[edges - edges[0]]
        return _gathered(arena, start[which], lengths), ends[1:]

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        flat, ends = self.flat_ids(texts)
        return np.split(flat, ends[:-1]) if len(texts) else []

    def ended(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(little-endian unsigned 32-bit ids of all texts with an end id after each, ends of the texts in it)."""
        flat, ends = self.flat_ids(texts)
        return np.insert(flat.astype("<u4"), ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)


def batches(column, most: int = 1 << 20):
    """(first row, UTF-8 texts) of an Arrow text column in runs of at most `most` bytes (one text at least); null is empty."""
    import pyarrow as pa

    texts = [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end
