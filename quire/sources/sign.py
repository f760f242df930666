"""Signatures of PDF files: PKCS#7 messages over byte ranges, made and checked by the library that Python's hashes are linked with."""

from __future__ import annotations

import ctypes
import hashlib
import re
import struct
import time
from datetime import UTC, datetime

from quire.sources import pdfedit
from quire.sources.pdf import Name, Op, Pdf, PdfError, pdf_text

BINARY, DETACHED, NO_CHAIN = 0x80, 0x40, 0x20
#: Bytes kept free for a signature in a file.
ROOM = 8192
#: The attribute that holds a time stamp (1.2.840.113549.1.9.16.2.14), as it is written.
TIMESTAMP = bytes.fromhex("060b2a864886f70d010910020e")


def _lib():
    """The library; every pointer is passed and given as one."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        for name in ("EVP_PKEY_Q_keygen", "X509_new", "X509_get_serialNumber", "X509_getm_notBefore", "X509_getm_notAfter", "X509_gmtime_adj", "X509_get_subject_name", "X509_get_issuer_name", "EVP_sha256", "d2i_X509", "d2i_AutoPrivateKey", "BIO_new_mem_buf", "PKCS7_sign", "d2i_PKCS7", "PKCS7_get0_signers", "OPENSSL_sk_value", "X509_get0_notBefore", "X509_get0_notAfter", "X509_NAME_oneline"):
            getattr(lib, name).restype = ctypes.c_void_p
        lib.ASN1_INTEGER_get.restype = ctypes.c_long
        return lib
    except (ImportError, OSError, AttributeError):
        raise PdfError("unsupported_signature", "the library for signatures isn't there") from None


def _ptr(v: int | None) -> ctypes.c_void_p:
    if not v:
        raise PdfError("malformed", "a key, certificate or signature")
    return ctypes.c_void_p(v)


def _from(read, der: bytes) -> ctypes.c_void_p:
    buf = ctypes.create_string_buffer(der, len(der))
    at = ctypes.c_void_p(ctypes.addressof(buf))
    return _ptr(read(None, ctypes.byref(at), ctypes.c_long(len(der))))


def _to(write, thing: ctypes.c_void_p) -> bytes:
    n = write(thing, None)
    if n <= 0:
        raise PdfError("malformed", "a key, certificate or signature")
    buf = ctypes.create_string_buffer(n)
    at = ctypes.c_void_p(ctypes.addressof(buf))
    write(thing, ctypes.byref(at))
    return buf.raw


def identity(name: str, days: int = 365, begins: int = 0, serial: int = 1) -> tuple[bytes, bytes]:
    """(key, certificate) in DER of a new signer whose certificate it has signed itself; valid from begins
    seconds from now."""
    lib = _lib()
    key = _ptr(lib.EVP_PKEY_Q_keygen(None, None, ctypes.c_char_p(b"EC"), ctypes.c_char_p(b"P-256")))
    x = _ptr(lib.X509_new())
    lib.X509_set_version(x, ctypes.c_long(2))
    lib.ASN1_INTEGER_set(_ptr(lib.X509_get_serialNumber(x)), ctypes.c_long(serial))
    lib.X509_gmtime_adj(_ptr(lib.X509_getm_notBefore(x)), ctypes.c_long(begins))
    lib.X509_gmtime_adj(_ptr(lib.X509_getm_notAfter(x)), ctypes.c_long(begins + 86_400 * days))
    lib.X509_set_pubkey(x, key)
    subject = _ptr(lib.X509_get_subject_name(x))
    said = name.encode()
    lib.X509_NAME_add_entry_by_txt(subject, b"CN", 0x1000, said, len(said), -1, 0)
    lib.X509_set_issuer_name(x, subject)
    if not lib.X509_sign(x, key, _ptr(lib.EVP_sha256())):
        raise PdfError("unsupported_signature", "the certificate can't be signed")
    out = _to(lib.i2d_PrivateKey, key), _to(lib.i2d_X509, x)
    lib.X509_free(x)
    lib.EVP_PKEY_free(key)
    return out


def _described(lib, x: ctypes.c_void_p) -> dict:
    def when(t) -> datetime | None:
        tm = ctypes.create_string_buffer(128)  # a struct tm: nine ints, then what systems add
        if not lib.ASN1_TIME_to_tm(_ptr(t), tm):
            return None
        sec, minute, hour, day, month, year = struct.unpack_from("6i", tm.raw)
        return datetime(year + 1900, month + 1, day, hour, minute, sec, tzinfo=UTC)

    def text(n) -> str:
        buf = ctypes.create_string_buffer(1024)
        lib.X509_NAME_oneline(n, buf, 1024)
        return re.sub(r"\\x([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), buf.value.decode("ascii", "replace")).encode("latin-1", "replace").decode("utf-8", "replace").lstrip("/")

    subject, issuer = _ptr(lib.X509_get_subject_name(x)), _ptr(lib.X509_get_issuer_name(x))
    return {"subject": text(subject), "issuer": text(issuer), "serial": int(lib.ASN1_INTEGER_get(_ptr(lib.X509_get_serialNumber(x)))), "not_before": when(lib.X509_get0_notBefore(x)), "not_after": when(lib.X509_get0_notAfter(x)), "self_signed": lib.X509_NAME_cmp(subject, issuer) == 0}


def certificate(der: bytes) -> dict:
    """subject, issuer, serial, not_before, not_after and self_signed of a certificate."""
    lib = _lib()
    x = _from(lib.d2i_X509, der)
    out = _described(lib, x)
    lib.X509_free(x)
    return out


def detached(data: bytes, key: bytes, cert: bytes) -> bytes:
    """A PKCS#7 signature of data, without it."""
    lib = _lib()
    pkey, x = _from(lib.d2i_AutoPrivateKey, key), _from(lib.d2i_X509, cert)
    bio = _ptr(lib.BIO_new_mem_buf(ctypes.c_char_p(data), len(data)))
    p7 = _ptr(lib.PKCS7_sign(x, pkey, None, bio, BINARY | DETACHED))
    out = _to(lib.i2d_PKCS7, p7)
    for free, v in ((lib.PKCS7_free, p7), (lib.BIO_free, bio), (lib.X509_free, x), (lib.EVP_PKEY_free, pkey)):
        free(v)
    return out


def checked(data: bytes, signature: bytes) -> tuple[bool, dict | None]:
    """(whether data is what was signed, the signer's certificate). The chain of trust isn't judged."""
    lib = _lib()
    try:
        p7 = _from(lib.d2i_PKCS7, signature)
    except PdfError:
        return False, None
    bio = _ptr(lib.BIO_new_mem_buf(ctypes.c_char_p(data), len(data)))
    ok = lib.PKCS7_verify(p7, None, None, bio, None, BINARY | NO_CHAIN) == 1
    signers = lib.PKCS7_get0_signers(p7, None, 0)
    first = lib.OPENSSL_sk_value(ctypes.c_void_p(signers), 0) if signers else None
    cert = _described(lib, ctypes.c_void_p(first)) if first else None
    lib.BIO_free(bio)
    lib.PKCS7_free(p7)
    return ok, cert


def sign(content: bytes, key: bytes, cert: bytes, name: str | None = None, reason: str | None = None, location: str | None = None, at: float | None = None, field: str = "Signature1") -> bytes:
    """The file, written anew with a signature over all of it. Signatures that it had no longer hold."""
    pdf, out = Pdf(content), pdfedit.Out()
    stamp = time.strftime("D:%Y%m%d%H%M%SZ", time.gmtime(time.time() if at is None else at)).encode()
    told = {k: pdfedit.text_string(v) for k, v in (("Name", name), ("Reason", reason), ("Location", location)) if v}
    value = out.new({"Type": Name("Sig"), "Filter": Name("Adobe.PPKLite"), "SubFilter": Name("adbe.pkcs7.detached"), "M": stamp, "ByteRange": Op("[0 " + "0" * 10 + " " + "0" * 10 + " " + "0" * 10 + "]"), "Contents": bytes(ROOM)} | told)
    widget = out.new({"Type": Name("Annot"), "Subtype": Name("Widget"), "FT": Name("Sig"), "T": pdfedit.text_string(field), "V": value, "Rect": [0, 0, 0, 0], "F": 132})
    old = pdf.get(pdf.get(pdf.trailer, "Root"), "AcroForm")
    old = old if isinstance(old, dict) else {}
    pages = pdfedit.pages_of(pdf)
    form = out.copy(pdf, {k: v for k, v in old.items() if k not in ("Fields", "SigFlags")}) | {"SigFlags": 3}
    made = bytearray(pdfedit.assemble(pages, out, catalog=lambda: {"AcroForm": form | {"Fields": [*out.copy(pdf, pdf.get(old, "Fields") or []), widget]}}))
    hole = b"<" + b"00" * ROOM + b">"
    start = made.index(hole)
    end = start + len(hole)
    at_range = made.index(b"[0 " + b"0" * 10 + b" ")
    made[at_range : at_range + 36] = b"[0 %010d %010d %010d]" % (start, end, len(made) - end)
    found = detached(bytes(made[:start] + made[end:]), key, cert)
    if len(found) > ROOM:
        raise PdfError("too_large", "the signature")
    made[start + 1 : start + 1 + 2 * len(found)] = found.hex().encode()
    return bytes(made)


def signatures(content: bytes, password: str | None = None) -> list[dict]:
    """The signatures of a file: field, name, reason, location, date, whether its ranges cover the whole file, the
    bytes signed are unchanged, and its certificate is self-signed; the certificate; time stamp and revocation data."""
    pdf = Pdf(content, password)
    root = pdf.get(pdf.trailer, "Root")
    form = pdf.get(root, "AcroForm") if isinstance(root, dict) else None
    store = pdf.get(root, "DSS") if isinstance(root, dict) else None
    out, seen = [], set()
    todo = list(pdf.get(form, "Fields") or []) if isinstance(form, dict) else []
    while todo:
        f = pdf.resolve(todo.pop(0))
        if not isinstance(f, dict) or id(f) in seen:
            continue
        seen.add(id(f))
        todo += pdf.get(f, "Kids") or []
        v = pdf.get(f, "V")
        if pdf.get(f, "FT") != "Sig" or not isinstance(v, dict):
            continue
        spans = [x for x in pdf.get(v, "ByteRange") or [] if isinstance(x, int)]
        raw = pdf.get(v, "Contents")
        ranges = list(zip(spans[::2], spans[1::2]))
        whole = len(ranges) == 2 and ranges[0][0] == 0 and ranges[0][1] <= ranges[1][0] and sum(ranges[1]) == len(content)
        ok, cert = checked(b"".join(content[a : a + n] for a, n in ranges), raw) if ranges and isinstance(raw, bytes) else (False, None)
        out.append(
            {
                "field": pdf_text(pdf.get(f, "T")), "name": pdf_text(pdf.get(v, "Name")), "reason": pdf_text(pdf.get(v, "Reason")), "location": pdf_text(pdf.get(v, "Location")), "date": pdf_text(pdf.get(v, "M")),
                "covers_whole_file": whole, "integrity_ok": ok, "has_timestamp": isinstance(raw, bytes) and TIMESTAMP in raw, "has_crl": bool(pdf.get(store, "CRLs")) if isinstance(store, dict) else False, "has_ocsp": bool(pdf.get(store, "OCSPs")) if isinstance(store, dict) else False,
                **{k: (cert or {}).get(k) for k in ("subject", "issuer", "serial", "not_before", "not_after", "self_signed")},
            }
        )
    return out


def digest(content: bytes, ranges: list[int]) -> str:
    """SHA-256 of the ranges (from, length, ...) of a file."""
    return hashlib.sha256(b"".join(content[a : a + n] for a, n in zip(ranges[::2], ranges[1::2]))).hexdigest()
