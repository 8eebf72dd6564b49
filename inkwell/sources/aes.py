"""AES in cipher block chaining, as encrypted PDF files need it: decryption of all blocks at once, encryption block by block."""

from __future__ import annotations

from functools import cache

import numpy as np


def doubled(x: int) -> int:
    return (x << 1 ^ (0x11B if x & 0x80 else 0)) & 0xFF


def times(a: int, b: int) -> int:
    """The product in the field of 256 elements."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = doubled(a), b >> 1
    return out


@cache
def boxes() -> tuple[list[int], list[int]]:
    """The substitution and its inverse: the affine image of each element's inverse in the field."""
    power, log, x = [], [0] * 256, 1
    for k in range(255):
        power.append(x)
        log[x] = k
        x ^= doubled(x)
    box = []
    for a in range(256):
        b = power[-log[a] % 255] if a else 0
        box.append(b ^ 0x63)
        for turn in range(1, 5):
            box[a] ^= (b << turn | b >> (8 - turn)) & 0xFF
    back = [0] * 256
    for a, b in enumerate(box):
        back[b] = a
    return box, back


@cache
def round_tables() -> list[list[int]]:
    """For each row of the state: what a byte adds to its column, substitution and mixing in one."""
    box, _ = boxes()
    first = [times(s, 2) << 24 | s << 16 | s << 8 | times(s, 3) for s in box]
    return [[(w >> 8 * k | w << (32 - 8 * k)) & 0xFFFFFFFF for w in first] for k in range(4)]


def round_keys(key: bytes) -> list[int]:
    """Four 32-bit words for each round, for keys of 16 or 32 bytes."""
    box, _ = boxes()
    n = len(key) // 4
    words, constant = [int.from_bytes(key[i : i + 4], "big") for i in range(0, len(key), 4)], 1
    while len(words) < 4 * (n + 7):
        w = words[-1]
        if len(words) % n == 0:
            w = (w << 8 | w >> 24) & 0xFFFFFFFF
        if len(words) % n == 0 or n > 6 and len(words) % n == 4:
            w = int.from_bytes(bytes(box[b] for b in w.to_bytes(4, "big")), "big")
        if len(words) % n == 0:
            w ^= constant << 24
            constant = doubled(constant)
        words.append(words[-n] ^ w)
    return words


def encrypt(key: bytes, start: bytes, data: bytes) -> bytes:
    """data: a multiple of 16 bytes."""
    keys, box, (t0, t1, t2, t3) = round_keys(key), boxes()[0], round_tables()
    out, last = bytearray(), [int.from_bytes(start[i : i + 4], "big") for i in range(0, 16, 4)]
    for at in range(0, len(data), 16):
        a, b, c, d = (int.from_bytes(data[at + i : at + i + 4], "big") ^ last[i // 4] ^ keys[i // 4] for i in range(0, 16, 4))
        for k in range(4, len(keys) - 4, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ keys[k],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ keys[k + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ keys[k + 2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ keys[k + 3],
            )
        last = [
            (box[w >> 24] << 24 | box[x >> 16 & 255] << 16 | box[y >> 8 & 255] << 8 | box[z & 255]) ^ keys[len(keys) - 4 + i]
            for i, (w, x, y, z) in enumerate(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c)))
        ]
        out += b"".join(w.to_bytes(4, "big") for w in last)
    return bytes(out)


def decrypt(key: bytes, start: bytes, data: bytes) -> bytes:
    """What encrypt() made; a rest of less than 16 bytes is left out."""
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    if not len(blocks):
        return b""
    keys = np.frombuffer(b"".join(w.to_bytes(4, "big") for w in round_keys(key)), np.uint8).reshape(-1, 16)
    back = np.array(boxes()[1], np.uint8)
    by = {n: np.array([times(x, n) for x in range(256)], np.uint8) for n in (9, 11, 13, 14)}
    shift = np.array([4 * ((c - r) % 4) + r for c in range(4) for r in range(4)])
    state = blocks ^ keys[-1]
    for k in range(len(keys) - 2, -1, -1):
        state = back[state[:, shift]] ^ keys[k]
        if k:
            a, b, c, d = (state[:, r::4] for r in range(4))
            state = np.empty_like(state)
            for r, (w, x, y, z) in enumerate(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))):
                state[:, r::4] = by[14][w] ^ by[11][x] ^ by[13][y] ^ by[9][z]
    before = np.vstack([np.frombuffer(start, np.uint8)[None], blocks[:-1]])
    return (state ^ before).tobytes()


def padded(data: bytes) -> bytes:
    """To a multiple of 16 bytes, each added byte their number."""
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def unpadded(data: bytes) -> bytes:
    return data[: -data[-1]] if data and 1 <= data[-1] <= 16 else data
