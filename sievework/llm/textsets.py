"""Vectorised text-to-set helpers shared by the set-similarity operators.

A text is measured as the set of its distinct pieces of ``PIECE`` characters, taken
after NFKC, lower-casing and dropping everything that is not a letter or a digit.  All
functions work on whole Arrow batches: the characters of a batch form one array, and
every step (rolling piece hash, minwise signature, band key) is one pass over it.

Defined results: a text with fewer than ``PIECE`` characters but at least one forms one
piece (the whole text); a null or characterless text forms no set and relates to nothing.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

PIECE = 5
_NOT_ALNUM = re.compile(r"[\W_]+")
#: Characters that every normal form leaves alone or turns into others that are dropped as well.
_PLAIN_MARKS = re.compile("[ -/:-@\\[-`{-~\t\n\r，。！？：；、“”‘’（）《》「」『』…—]+")
_NOT_PLAIN = re.compile("[^0-9A-Za-zÀ-ÖØ-öø-ÿ一-鿼]")
_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def normalise(text: str | None) -> str:
    """NFKC, lower case, letters and digits only; null gives ''."""
    if not text:
        return ""
    plain = _PLAIN_MARKS.sub("", text)
    if not _NOT_PLAIN.search(plain):  # nothing here composes, so the marks could go first
        return plain.lower()
    return _NOT_ALNUM.sub("", unicodedata.normalize("NFKC", text).lower())


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of a batch in one array, and the start of each text (with the end last)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return codes, starts


def piece_hashes(texts: list[str], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all pieces of a batch (repeats kept) and the start of each text's run.

    Texts shorter than a piece are padded with an unused code point, so they form one piece.
    """
    texts = [t if len(t) >= piece or not t else t + "\x00" * (piece - len(t)) for t in texts]
    codes, starts = code_points(texts)
    if len(codes) < piece:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    wide = codes.astype(np.uint64)
    n = len(codes) - piece + 1
    h = wide[:n] * _MULTIPLIERS[0]
    for k in range(1, piece):
        h += wide[k : k + n] * _MULTIPLIERS[k]
    lengths = np.maximum(np.diff(starts) - (piece - 1), 0)
    out = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    keep = np.arange(out[-1], dtype=np.int64) + np.repeat(starts[:-1] - out[:-1], lengths)
    return mix64(h[keep]), out


def distinct_sets(texts: list[str], piece: int = PIECE) -> list[np.ndarray]:
    """The sorted distinct piece hashes of each text."""
    h, starts = piece_hashes(texts, piece)
    return [np.unique(h[a:b]) for a, b in zip(starts[:-1], starts[1:])]


def band_keys(texts: list[str], bands: int, rows: int, piece: int = PIECE) -> np.ndarray:
    """Minwise band keys, one 64-bit key per text and band; all-zero rows for empty sets.

    Each of the ``bands * rows`` minwise values uses its own multiply-shift permutation of the
    upper 32 bits of the piece hash; the ``rows`` values of a band are folded into one key,
    salted with the band number.
    """
    out = np.zeros((len(texts), bands), np.uint64)
    rng = np.random.default_rng(bands * 1009 + rows)
    mult = rng.integers(1, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    step = 0
    while step < len(texts):
        stop, size = step, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= 60_000):  # stays in the cache
            size += len(texts[stop]) + 1
            stop += 1
        h, starts = piece_hashes(texts[step:stop], piece)
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            low = (h >> np.uint64(32)).astype(np.uint32)
            at, buffer = starts[:-1][some], np.empty_like(low)
            for band in range(bands):
                key = np.full(len(some), band + 1, np.uint64)
                for row in range(band * rows, (band + 1) * rows):
                    np.multiply(low, mult[row], out=buffer)
                    np.bitwise_xor(buffer, add[row], out=buffer)
                    key = key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(buffer, at)
                    key ^= key >> np.uint64(29)
                out[step + some, band] = mix64(key) | np.uint64(1)
        step = stop
    return out


def jaccard_block(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Exact Jaccard similarities of every left set with every right set (sorted distinct hashes).

    The pieces of both sides are numbered and multiplied as 0/1 matrices, ``width`` pieces at a
    time, so memory stays at (left + right) * width whatever the texts' lengths.
    """
    nl, nr = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    if not nl.sum() or not nr.sum():
        return np.zeros((len(left), len(right)))
    hl, hr = np.concatenate(left), np.concatenate(right)
    voc = np.intersect1d(hl, hr)
    il, ir = np.repeat(np.arange(len(left)), nl), np.repeat(np.arange(len(right)), nr)
    common = np.zeros((len(left), len(right)), np.float32)
    if len(voc):
        pl, pr = np.searchsorted(voc, hl), np.searchsorted(voc, hr)
        okl, okr = voc[np.minimum(pl, len(voc) - 1)] == hl, voc[np.minimum(pr, len(voc) - 1)] == hr
        il, pl, ir, pr = il[okl], pl[okl], ir[okr], pr[okr]
        for lo in range(0, len(voc), width):
            span = min(width, len(voc) - lo)
            a, b = np.zeros((len(left), span), np.float32), np.zeros((len(right), span), np.float32)
            s = (pl >= lo) & (pl < lo + span)
            a[il[s], pl[s] - lo] = 1
            s = (pr >= lo) & (pr < lo + span)
            b[ir[s], pr[s] - lo] = 1
            common += a @ b.T
    union = nl[:, None] + nr[None, :] - common
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)
