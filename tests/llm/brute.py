"""Plain versions of the operators, for small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text, words=3):
    import xxhash

    w = WORD.findall(low(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(rows, distance=2, words=3):
    """{index: component id} of rows [(doc_id, text)]."""
    fp = [simhash(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)].append(doc_id)
    return fp, [min(ids[find(i)], default=None) for i in range(len(rows))]


def token_ids(texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: target} by repeated resharing; sizes {source: words}."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        rest = total - sum(capped.values())
        got = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > most * sizes[s]]
        if not over:
            return capped | got
        capped |= {s: most * sizes[s] for s in over}


def words(text):
    return len(WORD.findall(text or ""))


def maglev(shards, slots, preference):
    """Round-robin claims written out from whole preference lists."""
    lists = []
    for s in shards:
        offset, skip = preference(s, slots)
        lists.append([(offset + j * skip) % slots for j in range(slots)])
    table = {}
    while len(table) < slots:
        for k, prefer in enumerate(lists):
            if len(table) < slots:
                table[next(x for x in prefer if x not in table)] = k
    return [table[i] for i in range(slots)]


def top_scores(vectors, every=50, k=5):
    """[(query_id, rank, vec_id, score)] of [(vec_id, vector)]."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(kept):
        if i is None or i % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, u)), j) for b_at, (j, u) in enumerate(kept) if b_at != at and len(u) == len(v))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


M = (1 << 32) - 1


def subwords_of(token, sizes, buckets):
    """[(bucket, weight)] and number of words of one token, letter by letter."""
    text = "\n" + token.lower().replace("\n", " ") + "\n"
    words, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end].isalnum():
            end += 1
        if end > at:
            words.append((at, end))
        at = max(end, at + 1)
    mark = lambda i: ord(text[i]) if text[i].isalnum() else 1
    out = []
    for a, z in words:
        own = []
        for n in sizes:
            for i in range(len(text) - n + 1):
                if not a <= i + 1 < z or not all(text[i + k].isalnum() for k in range(1, max(2, n - 1))):
                    continue
                h = mark(i) * 0x9E3779B1 & M
                for k in range(1, n):
                    h = (h ^ mark(i + k)) * 0x01000193 & M
                own.append(((h ^ h >> 15 ^ (n * 0x85EBCA6B & M)) * 0x2C1B3C6D & M) >> 7)
        w = sum(((ord(text[i]) * (2 * (i - a) + 1) * 0x9E3779B1) ^ (ord(text[i]) << 7)) & M for i in range(a, z)) & M
        own.append(((w ^ w >> 13) * 0x5BD1E995 & M) >> 7)
        out += [(x % buckets, 1 / len(own)) for x in own]
    return out, len(words)


def class_chances(model, text):
    """Softmax of a subword model over a whole text, summed subword by subword."""
    total, words = [0.0] * len(model.classes), 0
    for token in (text or "").encode().split():
        found, n = subwords_of(token.decode(), model.sizes, len(model.table))
        words += n
        for bucket, weight in found:
            for k in range(len(total)):
                total[k] += float(model.table[bucket, k]) * weight
    z = [(t / max(1, words) + float(b)) / model.temperature for t, b in zip(total, model.bias)]
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


__all__ = [x for x in dir() if not x.startswith("_")] + ["Counter"]


def runs(w, least=6, repeats=4):
    """[(start, length, period)] of all maximal runs of a list of words."""
    out = set()
    for q in range(1, len(w) // repeats + 1):
        x = 0
        while x + q < len(w):
            y = x
            while y + q < len(w) and w[y] == w[y + q]:
                y += 1
            stop = y + q
            if stop - x >= max(least, repeats * q) and not any(all(w[z] == w[z + p] for z in range(x, stop - p)) for p in range(1, q)):
                out.add((x, stop - x, q))
            x = max(y, x) + 1
    return sorted(out)


def repeated_tail(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def collapsed(w, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def aligned(texts):
    """[(groups, links)] by whole texts, one at a time; None without tokens."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        ia, ib, whole = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        ba = [bytes(shown[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ib]
        if b"".join(ba) != whole or b"".join(bb) != whole:
            out.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, links, x, y = [], [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            x2, y2 = ends_a.index(cut, x) + 1, ends_b.index(cut, y) + 1
            groups.append((ia[x:x2], ib[y:y2], cut - 1))
            links.append((ia[x2 - 1], ib[y2 - 1]))
            x, y = x2, y2
        out.append((groups, links))
    return out


def page_text(html):
    """The article of the given tables' pages, whose markup is always the same, by cutting the text."""
    import html as entities

    inside = html[html.index("<article>") + 9 : html.rindex("</article>")]
    inside = inside.replace("<b>", "").replace("<br>", " ")
    blocks = (" ".join(entities.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(x for x in blocks if x)
