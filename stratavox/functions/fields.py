"""Random fields over the places of an image: a value depends on the image's word, the place and a stream number only.

The numbers come from integer mixing that SQL engines can repeat, so a noised image has a twin in plain SQL; a whole image is
mixed at once on arrays.
"""

from __future__ import annotations

import numpy as np

LOW_32 = 0xFFFFFFFF
# Odd multipliers of the mixing steps.
PLACE, STREAM, TURN, MIX = 0x9E3779B1, 0x85EBCA6B, 0x632BE5AB, 0x45D9F3B
TWO_32 = 4294967296.0
#: Poisson means from here on are drawn by rejection, smaller ones by inversion.
LARGE_MEAN = 10.0
INVERSION_STEPS = 48
ATTEMPTS = 16
#: Streams 0 and 1 serve normal fields and inversion, those from here on attempts, two each.
FIRST_ATTEMPT = 2


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX)) & np.uint64(LOW_32)
    return x ^ (x >> np.uint64(16))


def uniform_field(word: int, places: np.ndarray, stream: int = 0) -> np.ndarray:
    """In (0, 1), one per place (whole numbers below 2**31)."""
    x = (np.uint64(word) + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(PLACE)) & np.uint64(LOW_32)
    x = (_mix(x) + np.uint64((stream + 1) * STREAM & LOW_32)) & np.uint64(LOW_32)
    return (_mix(x).astype(float) + 0.5) / TWO_32


def normal_field(word: int, shape: tuple[int, ...]) -> np.ndarray:
    """Standard normal values by Box-Muller, places in the order of the array."""
    places = np.arange(int(np.prod(shape)))
    radius = np.sqrt(-2.0 * np.log(uniform_field(word, places, 0)))
    return (radius * np.cos(2 * np.pi * uniform_field(word, places, 1))).reshape(shape)


def log_factorial(k: np.ndarray) -> np.ndarray:
    """ln k! by Stirling's series, moved up by seven so that it holds from 0 on."""
    shift = np.zeros_like(k)
    for step in range(1, 8):
        shift += np.log(k + step)
    z = k + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def _inverted(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Smallest k whose cumulated probability reaches u."""
    k = np.zeros(len(u))
    p = np.exp(-mean)
    total = p.copy()
    for i in range(1, INVERSION_STEPS):
        k += u > total
        p = p * mean / i
        total = total + p
    return k


def _rejected(word: int, places: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Transformed rejection for means of ``LARGE_MEAN`` and more: the first accepted of ``ATTEMPTS`` pairs of uniforms.

    About one in five attempts fails; should all fail (once in 10**11 draws), the mean is taken.
    """
    # The hat of the transformed rejection method.
    b = 0.931 + 2.53 * np.sqrt(mean)
    a = -0.059 + 0.02483 * b
    scale = 1.1239 + 1.1328 / (b - 3.4)
    sure = 0.9277 - 3.6224 / (b - 2)
    out = np.floor(mean)
    left = np.arange(len(mean))
    for attempt in range(ATTEMPTS):
        u = uniform_field(word, places[left], FIRST_ATTEMPT + 2 * attempt) - 0.5
        v = uniform_field(word, places[left], FIRST_ATTEMPT + 2 * attempt + 1)
        m, aa, bb = mean[left], a[left], b[left]
        room = 0.5 - np.abs(u)
        k = np.floor((2 * aa / room + bb) * u + m + 0.43)
        held = np.maximum(k, 0.0)
        below = np.log(v) + np.log(scale[left]) - np.log(aa / (room * room) + bb) <= -m + held * np.log(m) - log_factorial(held)
        fits = ((room >= 0.07) & (v <= sure[left])) | ((k >= 0) & ~((room < 0.013) & (v > room)) & below)
        out[left[fits]] = k[fits]
        left = left[~fits]
        if not len(left):
            break
    return out


def poisson_field(word: int, mean: np.ndarray) -> np.ndarray:
    """Poisson values with the given means (0 and up), places in the order of the array."""
    flat = mean.ravel().astype(float)
    out, places = np.zeros(len(flat)), np.arange(len(flat))
    small, large = np.flatnonzero(flat < LARGE_MEAN), np.flatnonzero(flat >= LARGE_MEAN)
    out[small] = _inverted(uniform_field(word, places[small], 0), flat[small])
    out[large] = _rejected(word, places[large], flat[large])
    return out.reshape(mean.shape)


class Words:
    """The word of an image, and a new one for every field that is drawn for it."""

    def __init__(self, word: int):
        self.word, self.turn = word, 0

    def next(self) -> int:
        self.turn += 1
        return (self.word + (self.turn - 1) * TURN) & LOW_32
