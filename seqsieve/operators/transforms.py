"""Fourier transforms of packed series inside a task, for lengths with a large prime factor, where numpy's are slow.

Such a length is parted into the prime and the rest: a transform of the rest's length in numpy, one of the prime's by a chirp,
whose products are a convolution of a length with small factors. Other lengths, and short ones, are numpy's.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Primes up to this, and series shorter than this, are left to numpy; complex values of a block; longest table that is kept.
PRIME, SHORT, BLOCK, KEPT = 100, 4096, 1 << 16, 1 << 20


@lru_cache(64)
def largest_prime(n: int) -> int:
    best, p = 1, 2
    while p * p <= n:
        while n % p == 0:
            best, n = p, n // p
        p += 1
    return max(best, n)


def _smooth(n: int) -> int:
    """The least number from n on that is a power of two times 1, 3, 5, 9, 15, 25, 27 or 45."""
    return min(v << max(0, (-(-n // v) - 1).bit_length()) for v in (1, 3, 5, 9, 15, 25, 27, 45))


@lru_cache(2)
def _chirp(p: int) -> tuple[np.ndarray, np.ndarray]:
    """exp(-i pi k^2 / p), and the transform of its conjugates laid round a circle."""
    k = np.arange(p, dtype=np.int64)
    w = np.exp(-1j * np.pi * (k * k % (2 * p)) / p)
    around = np.zeros(_smooth(2 * p - 1), complex)
    around[:p] = w.conj()
    around[len(around) - p + 1 :] = w[1:][::-1].conj()
    return w, np.fft.fft(around)


def _turns(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    return np.exp(-2j * np.pi * (a * b % n) / n)


@lru_cache(2)
def _halves(n: int) -> np.ndarray:
    return _turns(np.arange(n // 2 + 1), np.int64(1), n)


def _half_turns(n: int) -> np.ndarray:
    return _halves(n) if n <= KEPT else _halves.__wrapped__(n)


@lru_cache(2)
def _kept_turns(p: int, q: int) -> np.ndarray:
    return _turns(np.arange(q)[:, None], np.arange(p)[None], p * q)


def fft(z: np.ndarray) -> np.ndarray:
    """numpy.fft.fft of a vector of complex numbers."""
    n, p = len(z), largest_prime(len(z)) if len(z) >= SHORT else 1
    if p <= PRIME:
        return np.fft.fft(z)
    q, (w, filtered) = n // p, _chirp(p)
    rows, size = z.reshape(p, q).T.copy(), len(filtered)  # row j holds the values at j, j + q, ...; z, which may be read-only, stays as it is
    kept = _kept_turns(p, q) if n <= KEPT else None
    step = max(1, BLOCK // size)
    for a in range(0, q, step):
        part = rows[a : a + step]
        wide = np.fft.fft(part * w, size, axis=1)
        wide *= filtered
        part[:] = np.fft.ifft(wide, axis=1)[:, :p]
        part *= w
        if q > 1:
            part *= _turns(np.arange(a, a + len(part))[:, None], np.arange(p)[None], n) if kept is None else kept[a : a + step]
    return np.fft.fft(rows, axis=0).reshape(-1) if q > 1 else rows[0]


def rfft(x: np.ndarray) -> np.ndarray:
    """numpy.fft.rfft of a vector. One of even length is transformed as complex numbers of half the length."""
    n = len(x)
    if n < SHORT or largest_prime(n) <= PRIME:
        return np.fft.rfft(x)
    x = np.ascontiguousarray(x, float)
    if n % 2:
        return fft(x.astype(complex))[: n // 2 + 1]
    z = fft(x.view(complex))
    z = np.concatenate((z, z[:1]))
    mirrored = z[::-1].conj()
    odd = z - mirrored
    odd *= _half_turns(n)
    odd *= -0.5j
    z += mirrored
    z *= 0.5
    z += odd
    return z


def irfft(f: np.ndarray, n: int) -> np.ndarray:
    """numpy.fft.irfft to a vector of n numbers."""
    if n < SHORT or largest_prime(n) <= PRIME:
        return np.fft.irfft(f, n)
    f = np.array(f[: n // 2 + 1], complex)
    f[0] = f[0].real
    if n % 2:
        return fft(np.concatenate((f, f[:0:-1].conj())).conj()).real / n
    f[-1] = f[-1].real
    mirrored = f[::-1].conj()
    odd = f - mirrored
    odd *= _half_turns(n).conj()
    odd *= 0.5j
    f += mirrored
    f *= 0.5
    f += odd
    z = fft(f[:-1].conj())
    np.conj(z, z)
    return z.view(float) / (n // 2)
