"""AES in CBC mode, as PDF files use it, without further libraries."""

from __future__ import annotations

import hashlib


def _tables() -> tuple[list[int], list[int]]:
    """The cipher's substitution box and its inverse, from inverses in GF(2^8) and an affine map."""
    power, log, x = [0] * 256, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    box, back = [0] * 256, [0] * 256
    for v in range(256):
        b = power[(255 - log[v]) % 255] if v else 0
        s = 0x63
        for r in range(5):
            s ^= ((b << r) | (b >> (8 - r))) & 0xFF
        box[v], back[s] = s, v
    return box, back


_BOX, _BACK = _tables()


def _twice(a: int) -> int:
    return ((a << 1) ^ 0x1B) & 0xFF if a & 0x80 else a << 1


def _product(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = _twice(a), b >> 1
    return out


_MUL = {k: [_product(v, k) for v in range(256)] for k in (2, 3, 9, 11, 13, 14)}


def _schedule(key: bytes) -> list[list[int]]:
    n = len(key) // 4
    words, turn = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [_BOX[b] for b in w[1:] + w[:1]]
            w[0] ^= turn
            turn = _twice(turn)
        elif n > 6 and i % n == 4:
            w = [_BOX[b] for b in w]
        words.append([a ^ b for a, b in zip(words[i - n], w, strict=True)])
    return [sum(words[i : i + 4], []) for i in range(0, len(words), 4)]


def _decrypt_block(block: bytes, keys: list[list[int]]) -> list[int]:
    s = [a ^ b for a, b in zip(block, keys[-1], strict=True)]
    m9, m11, m13, m14 = _MUL[9], _MUL[11], _MUL[13], _MUL[14]
    for k in reversed(keys[:-1]):
        s = [_BACK[s[(i - 4 * (i % 4)) % 16]] ^ k[i] for i in range(16)]
        if k is not keys[0]:
            t = []
            for c in range(0, 16, 4):
                a, b, d, e = s[c : c + 4]
                t += [
                    m14[a] ^ m11[b] ^ m13[d] ^ m9[e], m9[a] ^ m14[b] ^ m11[d] ^ m13[e],
                    m13[a] ^ m9[b] ^ m14[d] ^ m11[e], m11[a] ^ m13[b] ^ m9[d] ^ m14[e],
                ]
            s = t
    return s


def _encrypt_block(block: bytes, keys: list[list[int]]) -> list[int]:
    s = [a ^ b for a, b in zip(block, keys[0], strict=True)]
    m2, m3 = _MUL[2], _MUL[3]
    for k in keys[1:]:
        s = [_BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
        if k is not keys[-1]:
            t = []
            for c in range(0, 16, 4):
                a, b, d, e = s[c : c + 4]
                t += [m2[a] ^ m3[b] ^ d ^ e, a ^ m2[b] ^ m3[d] ^ e, a ^ b ^ m2[d] ^ m3[e], m3[a] ^ b ^ d ^ m2[e]]
            s = t
        s = [a ^ b for a, b in zip(s, k, strict=True)]
    return s


def cbc_decrypt(key: bytes, data: bytes, iv: bytes | None = None, padded: bool = True) -> bytes:
    """Plain bytes; the first block is the vector unless one is given. Bad padding is left as it is."""
    if iv is None:
        iv, data = data[:16], data[16:]
    keys, out = _schedule(key), bytearray()
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out += bytes(a ^ b for a, b in zip(_decrypt_block(block, keys), iv, strict=True))
        iv = block
    if padded and out and 1 <= out[-1] <= 16:
        del out[-out[-1] :]
    return bytes(out)


def cbc_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    """Whole blocks only."""
    keys, out = _schedule(key), bytearray()
    for i in range(0, len(data), 16):
        iv = bytes(_encrypt_block(bytes(a ^ b for a, b in zip(data[i : i + 16], iv, strict=True)), keys))
        out += iv
    return bytes(out)


def hash_r6(password: bytes, salt: bytes, more: bytes = b"") -> bytes:
    """The standard's hash of a password for revision 6."""
    k, i, last = hashlib.sha256(password + salt + more).digest(), 0, 0
    while i < 64 or last > i - 32:
        e = cbc_encrypt(k[:16], (password + k + more) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i, last = i + 1, e[-1]
    return k[:32]


def file_key(e: dict, password: bytes) -> bytes | None:
    """Key of a file encrypted with revisions 5 and 6, or None if the password doesn't fit as user or owner."""
    revision, u, o = e.get("R"), (e.get("U") or b"")[:48], (e.get("O") or b"")[:48]
    make = hash_r6 if revision == 6 else lambda p, s, m=b"": hashlib.sha256(p + s + m).digest()
    password = password[:127]
    for entry, wrapped, more in ((u, e.get("UE"), b""), (o, e.get("OE"), u)):
        if len(entry) == 48 and isinstance(wrapped, bytes) and make(password, entry[32:40], more) == entry[:32]:
            return cbc_decrypt(make(password, entry[40:48], more), wrapped[:32], bytes(16), padded=False)
    return None
