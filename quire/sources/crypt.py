"""The standard security handler of PDF, revisions 2 to 6: RC4, AES-128 and AES-256.

AES runs in the library that Python's own hashes are linked with, where it has it, else in plain Python.
"""

from __future__ import annotations

import ctypes
import hashlib
import os

PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class _Held:
    """What a process has made once. A copy that is sent to another process is empty."""

    def __init__(self):
        self.made: dict = {}

    def __reduce__(self):
        return _Held, ()

    def get(self, name, make):
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]


_held = _Held()


def _linked_rc4():
    """rc4() by the linked library; None where it has none, or gives something else than the test vector."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.RC4_set_key.argtypes = [ctypes.c_char_p, ctypes.c_int, ctypes.c_char_p]
        lib.RC4.argtypes = [ctypes.c_char_p, ctypes.c_size_t, ctypes.c_char_p, ctypes.c_char_p]
    except (ImportError, OSError, AttributeError):
        return None

    def run(key: bytes, data: bytes) -> bytes:
        state, out = ctypes.create_string_buffer(2048), ctypes.create_string_buffer(len(data) + 16)
        lib.RC4_set_key(state, len(key), key)
        lib.RC4(state, len(data), data, out)
        return out.raw[: len(data)]

    return run if run(b"Key", b"Plaintext") == bytes.fromhex("bbf316e8d940af0ad3") else None


def rc4(key: bytes, data: bytes, plain: bool = False) -> bytes:
    """RC4; with plain, in plain Python."""
    if not plain and key and (linked := _held.get("rc4", _linked_rc4)) is not None:
        return linked(key, data)
    s, j = list(range(256)), 0
    for i, k in enumerate((key * (256 // len(key) + 1))[:256]):
        x = s[i]
        j = (j + x + k) & 255
        s[i], s[j] = s[j], x
    out, i, j = bytearray(len(data)), 0, 0
    for n, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _boxes() -> tuple[bytes, bytes]:
    p = q = 1
    box = [0] * 256
    while True:
        p = p ^ (p << 1 & 255) ^ (0x1B if p & 128 else 0)
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 255
        if q & 128:
            q ^= 9
        x = q ^ (q << 1 | q >> 7) ^ (q << 2 | q >> 6) ^ (q << 3 | q >> 5) ^ (q << 4 | q >> 4)
        box[p] = (x ^ 0x63) & 255
        if p == 1:
            break
    box[0] = 0x63
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back)


SBOX, BACK = _boxes()


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 128 else 0)
        b >>= 1
    return out


MUL = {k: bytes(_times(x, k) for x in range(256)) for k in (2, 3, 9, 11, 13, 14)}
_SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]  # where each byte comes from when rows turn
_UNSHIFT = [(i - 4 * (i % 4)) % 16 for i in range(16)]


class Aes:
    """AES with a key of 16 or 32 bytes, block by block."""

    def __init__(self, key: bytes):
        n = len(key) // 4
        self.last = n + 6
        w, rcon = [list(key[i : i + 4]) for i in range(0, len(key), 4)], 1
        for i in range(n, 4 * (self.last + 1)):
            t = w[-1]
            if i % n == 0:
                t = [SBOX[t[1]] ^ rcon, SBOX[t[2]], SBOX[t[3]], SBOX[t[0]]]
                rcon = _times(rcon, 2)
            elif n > 6 and i % n == 4:
                t = [SBOX[x] for x in t]
            w.append([a ^ b for a, b in zip(w[i - n], t)])
        self.rounds = [bytes(sum(w[4 * r : 4 * r + 4], [])) for r in range(self.last + 1)]

    def encrypt(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.rounds[0])]
        for r in range(1, self.last + 1):
            s = [SBOX[s[i]] for i in _SHIFT]
            if r < self.last:
                out = []
                for c in range(0, 16, 4):
                    a, b, d, e = s[c : c + 4]
                    out += [MUL[2][a] ^ MUL[3][b] ^ d ^ e, a ^ MUL[2][b] ^ MUL[3][d] ^ e, a ^ b ^ MUL[2][d] ^ MUL[3][e], MUL[3][a] ^ b ^ d ^ MUL[2][e]]
                s = out
            s = [a ^ b for a, b in zip(s, self.rounds[r])]
        return bytes(s)

    def decrypt(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.rounds[self.last])]
        for r in range(self.last - 1, -1, -1):
            s = [BACK[s[i]] for i in _UNSHIFT]
            s = [a ^ b for a, b in zip(s, self.rounds[r])]
            if r:
                out = []
                for c in range(0, 16, 4):
                    a, b, d, e = s[c : c + 4]
                    out += [MUL[14][a] ^ MUL[11][b] ^ MUL[13][d] ^ MUL[9][e], MUL[9][a] ^ MUL[14][b] ^ MUL[11][d] ^ MUL[13][e], MUL[13][a] ^ MUL[9][b] ^ MUL[14][d] ^ MUL[11][e], MUL[11][a] ^ MUL[13][b] ^ MUL[9][d] ^ MUL[14][e]]
                s = out
        return bytes(s)


def _library():
    """The functions of the linked library that AES needs; None where there are none."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        for name in ("EVP_CIPHER_CTX_new", "EVP_aes_128_cbc", "EVP_aes_256_cbc"):
            getattr(lib, name).restype = ctypes.c_void_p
        lib.EVP_CipherInit_ex.argtypes = [ctypes.c_void_p] * 3 + [ctypes.c_char_p] * 2 + [ctypes.c_int]
        lib.EVP_CIPHER_CTX_set_padding.argtypes = [ctypes.c_void_p, ctypes.c_int]
        lib.EVP_CipherUpdate.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.POINTER(ctypes.c_int), ctypes.c_char_p, ctypes.c_int]
        lib.EVP_CIPHER_CTX_free.argtypes = [ctypes.c_void_p]
        return lib
    except (ImportError, OSError, AttributeError):
        return None


def cbc(key: bytes, data: bytes, iv: bytes, encrypt: bool, plain: bool = False) -> bytes:
    """Whole blocks in cipher block chaining, without padding; with plain, in plain Python."""
    if not plain and (library := _held.get("aes", _library)) is not None:
        ctx = library.EVP_CIPHER_CTX_new()
        try:
            kind = library.EVP_aes_256_cbc() if len(key) == 32 else library.EVP_aes_128_cbc()
            out, n = ctypes.create_string_buffer(len(data) + 32), ctypes.c_int(0)
            if library.EVP_CipherInit_ex(ctx, kind, None, key, iv, int(encrypt)) and library.EVP_CIPHER_CTX_set_padding(ctx, 0) and library.EVP_CipherUpdate(ctx, out, ctypes.byref(n), data, len(data)) and n.value == len(data):
                return out.raw[: n.value]
        finally:
            library.EVP_CIPHER_CTX_free(ctx)
    cipher, last, blocks = Aes(key), iv, []
    for i in range(0, len(data), 16):
        block = data[i : i + 16]
        if encrypt:
            last = cipher.encrypt(bytes(a ^ b for a, b in zip(block, last)))
            blocks.append(last)
        else:
            blocks.append(bytes(a ^ b for a, b in zip(cipher.decrypt(block), last)))
            last = block
    return b"".join(blocks)


def cbc_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    n = 16 - len(data) % 16
    return iv + cbc(key, data + bytes([n]) * n, iv, True)


def cbc_decrypt(key: bytes, data: bytes) -> bytes:
    whole = data[16 : len(data) - len(data) % 16]
    raw = cbc(key, whole, data[:16], False) if whole else b""
    return raw[: -raw[-1]] if raw and 1 <= raw[-1] <= 16 else raw


# --- AES-256: revisions 5 and 6 ------------------------------------------------


def hash_256(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    """The hash of a password of revision 5 (one SHA-256) or 6 (at least 64 rounds)."""
    k = hashlib.sha256(password + salt + user).digest()
    i = 0
    while revision >= 6:
        e = cbc(k[:16], (password + k + user) * 64, k[16:32], True)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            break
    return k[:32]


def entries_256(user: bytes, owner: bytes, p: int) -> tuple[bytes, dict[str, bytes]]:
    """(a new file key, the entries U, UE, O, OE and Perms that seal it) of revision 6."""
    key, none = os.urandom(32), bytes(16)
    salts = [os.urandom(8) for _ in range(4)]
    u = hash_256(user[:127], salts[0], b"", 6) + salts[0] + salts[1]
    o = hash_256(owner[:127], salts[2], u, 6) + salts[2] + salts[3]
    perms = (p & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff\xff\xff\xffTadb" + os.urandom(4)
    return key, {
        "U": u, "UE": cbc(hash_256(user[:127], salts[1], b"", 6), key, none, True),
        "O": o, "OE": cbc(hash_256(owner[:127], salts[3], u, 6), key, none, True), "Perms": cbc(key, perms, none, True),
    }


def unlock_256(password: bytes, o: bytes, u: bytes, oe: bytes, ue: bytes, revision: int) -> bytes | None:
    """The file's key, for the user's or the owner's password; None for a wrong one."""
    password, o, u = password[:127], o[:48], u[:48]
    if hash_256(password, u[32:40], b"", revision) == u[:32]:
        return cbc(hash_256(password, u[40:48], b"", revision), ue[:32], bytes(16), False)
    if hash_256(password, o[32:40], u, revision) == o[:32]:
        return cbc(hash_256(password, o[40:48], u, revision), oe[:32], bytes(16), False)
    return None


# --- RC4 and AES-128 -------------------------------------------------------------


def file_key(password: bytes, o: bytes, p: int, file_id: bytes, revision: int, length: int, open_meta: bool = True) -> bytes:
    h = hashlib.md5((password + PAD)[:32] + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + file_id + (b"" if revision < 4 or open_meta else b"\xff" * 4)).digest()
    n = 5 if revision == 2 else length
    if revision >= 3:
        for _ in range(50):
            h = hashlib.md5(h[:n]).digest()
    return h[:n]


def owner_key(password: bytes, revision: int, length: int) -> bytes:
    h = hashlib.md5((password + PAD)[:32]).digest()
    if revision >= 3:
        for _ in range(50):
            h = hashlib.md5(h).digest()
    return h[: 5 if revision == 2 else length]


def owner_entry(owner: bytes, user: bytes, revision: int, length: int) -> bytes:
    key, out = owner_key(owner or user, revision, length), (user + PAD)[:32]
    for i in range(1 if revision == 2 else 20):
        out = rc4(bytes(b ^ i for b in key), out)
    return out


def user_entry(key: bytes, file_id: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(key, PAD)
    out = hashlib.md5(PAD + file_id).digest()
    for i in range(20):
        out = rc4(bytes(b ^ i for b in key), out)
    return out + bytes(16)


def unlock(password: bytes, o: bytes, u: bytes, p: int, file_id: bytes, revision: int, length: int, open_meta: bool = True) -> bytes | None:
    """The file's key, for the user's or the owner's password; None for a wrong one."""

    def attempt(user: bytes) -> bytes | None:
        key = file_key(user, o, p, file_id, revision, length, open_meta)
        n = 32 if revision == 2 else 16
        return key if user_entry(key, file_id, revision)[:n] == u[:n] else None

    if (key := attempt(password)) is not None:
        return key
    own, user = owner_key(password, revision, length), o
    for i in range(0 if revision == 2 else 19, -1, -1):
        user = rc4(bytes(b ^ i for b in own), user)
    return attempt(user)


def object_key(key: bytes, num: int, gen: int, aes: bool) -> bytes:
    if len(key) == 32:  # AES-256 has one key for all objects
        return key
    salt = num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if aes else b"")
    return hashlib.md5(key + salt).digest()[: min(len(key) + 5, 16)]


def seal(key: bytes, num: int, data: bytes, aes: bool, gen: int = 0) -> bytes:
    k = object_key(key, num, gen, aes)
    return cbc_encrypt(k, data, os.urandom(16)) if aes else rc4(k, data)


def reveal(key: bytes, num: int, data: bytes, aes: bool, gen: int = 0) -> bytes:
    k = object_key(key, num, gen, aes)
    return cbc_decrypt(k, data) if aes else rc4(k, data)
