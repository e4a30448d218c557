"""SHA-256 with a state that can be handed from one task to the next, for digests over data that is too long for one task.

The blocks are hashed by libcrypto where the machine has it, else in Python; states and results are the same."""

from __future__ import annotations

import ctypes
import ctypes.util
import struct
from functools import cache

_MASK = 0xFFFFFFFF


def _root(n: int, k: int) -> int:
    """The integer k-th root."""
    lo, hi = 0, 1 << (n.bit_length() // k + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid**k <= n else (lo, mid - 1)
    return lo


_PRIMES = [n for n in range(2, 312) if all(n % p for p in range(2, int(n**0.5) + 1))]
_START = tuple(_root(p << 64, 2) & _MASK for p in _PRIMES[:8])
_ROUND = [_root(p << 96, 3) & _MASK for p in _PRIMES]


@cache
def _library():
    """libcrypto, if it has the function on a context that can be read."""
    name = ctypes.util.find_library("crypto")
    try:
        return ctypes.CDLL(name).SHA256_Update if name else None
    except (OSError, AttributeError):
        return None


def _turn(x: int, n: int) -> int:
    return (x >> n | x << 32 - n) & _MASK


def _block(words: tuple[int, ...], block: bytes) -> tuple[int, ...]:
    w = list(struct.unpack(">16I", block))
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append((w[i - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ a >> 3) + w[i - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ b >> 10)) & _MASK)
    a, b, c, d, e, f, g, h = words
    for k, x in zip(_ROUND, w):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (e & f ^ ~e & _MASK & g) + k + x
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b ^ a & c ^ b & c)
        a, b, c, d, e, f, g, h = (one + two) & _MASK, a, b, c, (d + one) & _MASK, e, f, g
    return tuple((x + y) & _MASK for x, y in zip(words, (a, b, c, d, e, f, g, h)))


def _blocks(words: tuple[int, ...], data: bytes) -> tuple[int, ...]:
    """The words of the state after data, which is whole blocks."""
    if update := _library():
        context = (ctypes.c_uint32 * 64)(*words)  # the state's words come first; the rest counts what is held back
        context[27] = 32
        update(ctypes.byref(context), data, ctypes.c_size_t(len(data)))
        return tuple(context[:8])
    for i in range(0, len(data), 64):
        words = _block(words, data[i : i + 64])
    return words


class Sha256:
    """As hashlib's, and made anew from state()."""

    def __init__(self, state: bytes | None = None):
        *words, self._size = struct.unpack(">8IQ", state[:40]) if state else (*_START, 0)
        self._words, self._rest, self._held = tuple(words), [state[40:]] if state else [], (len(state) - 40 if state else 0)

    def update(self, data: bytes) -> None:
        self._rest.append(data)
        self._held += len(data)
        self._size += len(data)
        if self._held >= 1 << 16:
            self._settle()

    def _settle(self) -> None:
        data = b"".join(self._rest)
        whole = len(data) // 64 * 64
        if whole:
            self._words = _blocks(self._words, data[:whole])
        self._rest, self._held = [data[whole:]], len(data) - whole

    def state(self) -> bytes:
        self._settle()
        return struct.pack(">8IQ", *self._words, self._size) + self._rest[0]

    def hexdigest(self) -> str:
        self._settle()
        rest = self._rest[0]
        words = _blocks(self._words, rest + b"\x80" + bytes(-(len(rest) + 9) % 64) + struct.pack(">Q", 8 * self._size))
        return struct.pack(">8I", *words).hex()
