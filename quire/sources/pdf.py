"""PDF files: objects, text with places, rule lines, and a plain writer; RC4 and AES-128 with a password."""

from __future__ import annotations

import hashlib
import re
import zlib
from math import ceil

from quire.functions.kept import Kept
from quire.sources import crypt

LIMIT = 500 << 20
_DELIM = b"()<>[]{}/%"
_SPACE = b"\0\t\n\f\r "
_REGULAR = rb"[^\0\t\n\f\r ()<>\[\]{}/%]"
_BLANK = rb"(?:[\0\t\n\f\r ]++|%[^\r\n]*+)*+"
_SKIPPED = re.compile(_BLANK)
#: A token after blanks and comments: a whole number, another word, a name, or a delimiter.
_TOKEN = re.compile(_BLANK + rb"(?:([+-]?[0-9]++)(?!" + _REGULAR + rb")|(" + _REGULAR + rb"++)|/(" + _REGULAR + rb"*+)|(<<|>>|.))", re.S)
_REAL = re.compile(rb"[+-]?([0-9]+\.[0-9]*|\.[0-9]+)")
_PLAIN = re.compile(rb"[^()\\]*")
_NUMBER = rb"[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)"
#: The commonest operations of a content stream as a whole: numbers and an operator, a font and its size, a plain string to show.
_COMMON = re.compile(
    rb"[\0\t\n\f\r ]*+(?:((?:" + _NUMBER + rb"[\0\t\n\f\r ]++)*+)(?!(?:true|false|null|ID|BI|R)(?!" + _REGULAR + rb"))([A-Za-z][A-Za-z*]*+)|/([A-Za-z0-9]++)[ \n]++(" + _NUMBER + rb")[ \n]++Tf|\(([^()\\]*+)\)[ \n]*+Tj)(?!" + _REGULAR + rb")"
)
#: Heads of objects as they were read, and how far: files of one program have most of theirs in common.
_HEADS = Kept(None, 4096)
HEAD_BYTES = 4096


class PdfError(ValueError):
    """code: not_a_pdf, password_required, wrong_password, unsupported_encryption, too_large or malformed."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


class Name(str):
    pass


class Ref(tuple):
    pass


class Op(str):
    """A keyword of a content stream."""


class Stream:
    def __init__(self, info: dict, raw: bytes):
        self.info, self.raw = info, raw


class Lexer:
    """Values of PDF syntax, one after another; keywords come as Op."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _SKIPPED.match(self.data, self.at).end()

    def next(self):
        """The next value; None at the end."""
        d = self.data
        m = _TOKEN.match(d, self.at)
        if m is None:
            self.at = len(d)
            return None
        self.at, kind = m.end(), m.lastindex
        word = m[kind]
        if kind == 1:
            return int(word)
        if kind == 2:
            if _REAL.fullmatch(word):
                return float(word)
            return True if word == b"true" else False if word == b"false" else Op(word.decode("latin-1"))
        if kind == 3:
            return Name((re.sub(rb"#([0-9a-fA-F]{2})", lambda x: bytes([int(x[1], 16)]), word) if b"#" in word else word).decode("latin-1"))
        if word == b"(":
            self.at -= 1
            return self._literal()
        if word == b"<<":
            return self._dict()
        if word == b"<":
            end = d.find(b">", self.at)
            end = len(d) if end < 0 else end
            hexed = re.sub(rb"[^0-9a-fA-F]", b"", d[self.at : end])
            self.at = end + 1
            return bytes.fromhex((hexed + b"0" * (len(hexed) % 2)).decode())
        if word == b"[":
            out = []
            while True:
                v = self.next()
                if v is None or (isinstance(v, Op) and v == "]"):
                    return out
                self._ref(out, v)
        return Op(word.decode()) if word in (b"]", b"{", b"}", b")", b">>") else Op("?")

    @staticmethod
    def _ref(out: list, v) -> None:
        if not isinstance(v, Op):
            out.append(v)
        elif v == "R" and len(out) > 1 and isinstance(out[-1], int) and isinstance(out[-2], int):
            gen, num = out.pop(), out.pop()
            out.append(Ref((num, gen)))
        else:
            out.append(None if v == "null" else v)

    def _dict(self) -> dict:
        out: list = []
        while True:
            v = self.next()
            if v is None or (isinstance(v, Op) and v == ">>"):
                break
            self._ref(out, v)
        return {k: v for k, v in zip(out[::2], out[1::2]) if isinstance(k, str)}

    def _literal(self) -> bytes:
        d, depth, out = self.data, 0, bytearray()
        self.at += 1
        m = _PLAIN.match(d, self.at)
        if d[m.end() : m.end() + 1] == b")":  # most have neither brackets nor escapes
            self.at = m.end() + 1
            return m[0]
        plain = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
        while self.at < len(d):
            c = d[self.at]
            self.at += 1
            if c == 0x5C and self.at < len(d):
                e = d[self.at]
                self.at += 1
                if e in plain:
                    out.append(plain[e])
                elif 0x30 <= e <= 0x37:
                    m = re.compile(rb"[0-7]{1,3}").match(d, self.at - 1)
                    self.at = m.end()
                    out.append(int(m[0], 8) & 255)
                elif e == 13:
                    self.at += d[self.at : self.at + 1] == b"\n"
                elif e != 10:
                    out.append(e)
                continue
            if c == 0x28:
                depth += 1
            elif c == 0x29:
                if not depth:
                    break
                depth -= 1
            out.append(c)
        return bytes(out)


def _fresh(v):
    """A value whose lists and dicts are of its own."""
    if type(v) is dict:
        return {k: _fresh(x) if type(x) in (dict, list) else x for k, x in v.items()}
    return [_fresh(x) if type(x) in (dict, list) else x for x in v] if type(v) is list else v


def _head(data: bytes, at: int, end: int) -> tuple:
    """The value at a place, and where it ends. What lies before end tells which it is, if it ends before that."""
    if end - at > HEAD_BYTES:
        lex = Lexer(data, at)
        return lex.next(), lex.at
    key = data[at:end]
    if (found := _HEADS.get(key)) is None:
        lex = Lexer(data, at)
        found = lex.next(), lex.at - at
        if lex.at >= end:
            return found[0], lex.at
        _HEADS.keep(key, found)
    return _fresh(found[0]), at + found[1]


def inflate(data: bytes) -> bytes:
    z = zlib.decompressobj()
    try:
        out = z.decompress(data, LIMIT)
    except zlib.error:
        out = b""
        z = zlib.decompressobj()
        for i in range(0, len(data), 256):  # what can still be read of a damaged stream
            try:
                out += z.decompress(data[i : i + 256], LIMIT)
            except zlib.error:
                break
    if len(out) >= LIMIT:
        raise PdfError("too_large", "a stream")
    return out


def unpredict(data: bytes, parms: dict) -> bytes:
    kind, colors, bits, cols = parms.get("Predictor", 1), parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    if kind < 10:
        return data
    bpp, width = max(1, colors * bits // 8), (colors * bits * cols + 7) // 8
    out, before = bytearray(), bytearray(width)
    for i in range(0, len(data), width + 1):
        tag, row = data[i], bytearray(data[i + 1 : i + 1 + width])
        for j in range(len(row)):
            a = row[j - bpp] if j >= bpp else 0
            b, c = before[j], before[j - bpp] if j >= bpp else 0
            if tag == 1:
                row[j] = (row[j] + a) & 255
            elif tag == 2:
                row[j] = (row[j] + b) & 255
            elif tag == 3:
                row[j] = (row[j] + (a + b) // 2) & 255
            elif tag == 4:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[j] = (row[j] + near) & 255
        out += row
        before = row + bytearray(width - len(row))
    return bytes(out)


_OBJECT = re.compile(rb"(?<![0-9])([0-9]+)[ \r\n\t]+([0-9]+)[ \r\n\t]+obj\b")
_TRAILER = re.compile(rb"trailer\s*<<")
_XREF = re.compile(rb"/Type\s*/XRef")
_ENDS = re.compile(rb"stream|endobj")
_ENDSTREAM = re.compile(rb"\s*endstream")


class Pdf:
    """A file's objects. They are found by scanning for their heads, so a damaged cross-reference doesn't
    matter; of several with one number the last counts. Object streams are unpacked."""

    def __init__(self, data: bytes, password: str | None = None):
        self.key: bytes | None = None
        self.aes = False
        if b"%PDF" not in data[:1024]:
            raise PdfError("not_a_pdf")
        self.data, self.places, self.cache, self.trailer = data, {}, {}, {}
        self.packed: dict[int, tuple[int, int]] = {}
        for m in _OBJECT.finditer(data):
            self.places[int(m[1])] = m.end()
        for m in _TRAILER.finditer(data):
            end = data.find(b"startxref", m.end(), m.end() + HEAD_BYTES)
            found = _head(data, m.end() - 2, end if end >= 0 else m.end() + HEAD_BYTES)[0]
            self.trailer |= found if isinstance(found, dict) else {}
        for m in _XREF.finditer(data):  # a cross-reference stream is never encrypted
            at = data.rfind(b" obj", 0, m.start())
            found = Lexer(data, at + 4).next() if at >= 0 else None
            if isinstance(found, dict):
                self.trailer |= {k: v for k, v in found.items() if k in ("Root", "Info", "Encrypt", "ID")}
        self._unlock(password)
        for num in list(self.places):
            s = self.object(num)
            if isinstance(s, Stream) and s.info.get("Type") == "ObjStm":
                body = self.decoded(s)
                lex = Lexer(body)
                heads = [lex.next() for _ in range(2 * int(self.get(s.info, "N") or 0))]
                for k, (n, at) in enumerate(zip(heads[::2], heads[1::2])):
                    if isinstance(n, int) and n not in self.places:
                        self.cache[n] = Lexer(body, int(self.get(s.info, "First") or 0) + at).next()
    def _unlock(self, password: str | None) -> None:
        e = self.get(self.trailer, "Encrypt")
        if not isinstance(e, dict):
            return
        r, v = self.get(e, "R"), self.get(e, "V")
        method = self.get(self.get(self.get(e, "CF") or {}, str(self.get(e, "StmF") or "StdCF")) or {}, "CFM")
        if self.get(e, "Filter") != "Standard" or v not in (1, 2, 4, 5) or r not in (2, 3, 4, 5, 6) or (v == 4 and method not in ("V2", "AESV2")) or (v == 5 and method != "AESV3"):
            raise PdfError("unsupported_encryption")
        ids = self.get(self.trailer, "ID") or [b""]
        length = 16 if v == 4 else int(self.get(e, "Length") or 40) // 8
        if v == 5:
            key = crypt.unlock_256((password or "").encode(), *(self.get(e, k) for k in ("O", "U", "OE", "UE")), r)
        else:
            key = crypt.unlock((password or "").encode("cp1252", "replace"), self.get(e, "O"), self.get(e, "U"), int(self.get(e, "P")), self.resolve(ids[0]), r, length, self.get(e, "EncryptMetadata") is not False)
        if key is None:
            raise PdfError("password_required" if password is None else "wrong_password")
        own = self.trailer.get("Encrypt")
        self.cache.clear()
        self.key, self.aes, self.plain = key, method in ("AESV2", "AESV3"), own[0] if isinstance(own, Ref) else None

    def _reveal(self, v, num: int):
        """A value with its strings decrypted."""
        if isinstance(v, bytes):
            return crypt.reveal(self.key, num, v, self.aes)
        if isinstance(v, Ref):
            return v
        if isinstance(v, list):
            return [self._reveal(x, num) for x in v]
        if isinstance(v, dict):
            return {k: self._reveal(x, num) for k, x in v.items()}
        return v

    def object(self, num: int):
        if num not in self.cache and num in self.places:
            self.cache[num] = None
            place = self.places[num]
            m = _ENDS.search(self.data, place, place + HEAD_BYTES + 10)
            v, at = _head(self.data, place, m.start() if m else place + HEAD_BYTES + 1)
            if isinstance(v, dict):
                at = _SKIPPED.match(self.data, at).end()
                if self.data[at : at + 6] == b"stream":
                    start = at + 6
                    start += 2 if self.data[start : start + 2] == b"\r\n" else 1
                    n = self.resolve(v.get("Length"))
                    end = start + n if isinstance(n, int) and _ENDSTREAM.match(self.data[start + n : start + n + 20]) else self.data.find(b"endstream", start)
                    v = Stream(v, self.data[start : end if end >= 0 else len(self.data)])
            if self.key is not None and num != self.plain:
                if isinstance(v, Stream):
                    if v.info.get("Type") != "XRef":
                        v = Stream(self._reveal(v.info, num), crypt.reveal(self.key, num, v.raw, self.aes))
                else:
                    v = self._reveal(v, num)
            self.cache[num] = v
        return self.cache.get(num)

    def resolve(self, v):
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            v = self.object(v[0])
        return None

    def get(self, d, key: str):
        return self.resolve(d.get(key)) if isinstance(d, dict) else None

    def decoded(self, s: Stream) -> bytes:
        filters, parms = self.get(s.info, "Filter"), self.get(s.info, "DecodeParms")
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        parms = parms if isinstance(parms, list) else [parms] * len(filters)
        out = s.raw
        for f, p in zip(filters, [*parms, *[None] * len(filters)]):
            f, p = self.resolve(f), self.resolve(p) or {}
            if f in ("FlateDecode", "Fl"):
                out = unpredict(inflate(out), p)
            elif f in ("ASCIIHexDecode", "AHx"):
                out = bytes.fromhex(re.sub(rb"[^0-9a-fA-F]", b"", out.split(b">")[0]).decode())
        return out

    def inherited(self, page: dict, key: str):
        seen = 0
        while isinstance(page, dict) and seen < 64:
            if (v := self.get(page, key)) is not None:
                return v
            page, seen = self.get(page, "Parent"), seen + 1
        return None

    def pages(self) -> list[dict]:
        root = self.get(self.trailer, "Root")
        if not isinstance(root, dict):
            root = next((o for n in self.places if isinstance(o := self.object(n), dict) and o.get("Type") == "Catalog"), {})
        out, todo, seen = [], [root.get("Pages")], set()
        while todo:
            r = todo.pop()
            if isinstance(r, Ref):
                if r in seen:
                    continue
                seen.add(r)
            node = self.resolve(r)
            if isinstance(node, dict):
                kids = self.get(node, "Kids")
                if isinstance(kids, list):
                    todo += kids[::-1]
                else:
                    out.append(node)
        return out

    def page_numbers(self) -> dict[int, int]:
        return {id(p): i for i, p in enumerate(self.pages(), 1)}

    def content(self, page: dict) -> bytes:
        c = self.get(page, "Contents")
        parts = [self.resolve(x) for x in c] if isinstance(c, list) else [c]
        return b"\n".join(self.decoded(p) for p in parts if isinstance(p, Stream))

    def box(self, page: dict) -> list[float]:
        b = self.inherited(page, "MediaBox")
        b = [self.resolve(x) for x in b] if isinstance(b, list) else []
        if len(b) < 4 or not all(isinstance(x, (int, float)) for x in b):
            raise PdfError("malformed", "MediaBox")
        return [float(x) for x in b[:4]]


_BLANKS = bytes.maketrans(b"\0", b" ")


def operations(content: bytes, images: bool = False) -> list[tuple[str, list]]:
    """(operator, operands) of a content stream. Inline images are passed over, or with images come as BI with their source."""
    lex, args, out, begin = Lexer(content), [], [], 0
    while True:
        while not args and (m := _COMMON.match(content, lex.at)):
            lex.at, kind = m.end(), m.lastindex
            if kind == 2:
                out.append((m[2].decode(), [float(x) if b"." in x else int(x) for x in m[1].translate(_BLANKS).split()] if m[1] else []))
            elif kind == 4:
                out.append(("Tf", [Name(m[3].decode()), float(m[4]) if b"." in m[4] else int(m[4])]))
            else:
                out.append(("Tj", [m[5]]))
        if (v := lex.next()) is None:
            return out
        if not isinstance(v, Op):
            args.append(v)
        elif v == "null":
            args.append(None)
        elif v == "ID":
            m = re.compile(rb"\sEI(?=\s|$)").search(content, lex.at)
            lex.at = m.end() if m else len(content)
            args = []
            if images:
                out[-1] = ("BI", [content[begin : lex.at]])
        else:
            begin = lex.at - 2 if v == "BI" else begin
            out.append((str(v), args))
            args = []


def pdf_text(raw) -> str | None:
    """A text string: UTF-16 or UTF-8 by their marks, else Windows-1252."""
    if not isinstance(raw, bytes):
        return None
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("cp1252", "replace")


def cmap(data: bytes) -> dict[bytes, str]:
    """Codes and what they stand for, of bfchar and bfrange sections. Small maps, which many files share, are kept."""
    return _small_cmap[data] if len(data) <= HEAD_BYTES else _cmap(data)


def _cmap(data: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    word = lambda b: b.decode("utf-16-be", "replace")
    for kind, body in re.findall(rb"beginbf(char|range)(.*?)endbf", data, re.S):
        lex, vals = Lexer(body), []
        while (v := lex.next()) is not None:
            vals.append(v)
        if kind == b"char":
            out |= {a: word(b) for a, b in zip(vals[::2], vals[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
            continue
        for lo, hi, to in zip(vals[::3], vals[1::3], vals[2::3]):
            if not (isinstance(lo, bytes) and isinstance(hi, bytes)):
                continue
            first, last = int.from_bytes(lo, "big"), int.from_bytes(hi, "big")
            for k in range(min(last - first + 1, 65_536)):
                if isinstance(to, list):
                    t = word(to[k]) if k < len(to) and isinstance(to[k], bytes) else ""
                else:
                    t = word((int.from_bytes(to, "big") + k).to_bytes(len(to), "big"))
                out[(first + k).to_bytes(len(lo), "big")] = t
    return out


_small_cmap = Kept(_cmap, 64)


class Font:
    def __init__(self, pdf: Pdf, f: dict):
        self.name = str(pdf.get(f, "BaseFont") or "")
        self.wide = pdf.get(f, "Subtype") == "Type0"
        to = pdf.get(f, "ToUnicode")
        self.map = cmap(pdf.decoded(to)) if isinstance(to, Stream) else {}
        self.widths: dict[int, float] = {}
        self.default = 600.0
        if self.wide:
            kid = pdf.resolve((pdf.get(f, "DescendantFonts") or [None])[0]) or {}
            self.default = float(pdf.get(kid, "DW") or 1000)
            w = [pdf.resolve(x) for x in pdf.get(kid, "W") or []]
            i = 0
            while i + 1 < len(w):
                if isinstance(w[i + 1], list):
                    self.widths |= {w[i] + k: float(pdf.resolve(x)) for k, x in enumerate(w[i + 1])}
                    i += 2
                else:
                    self.widths |= {k: float(w[i + 2]) for k in range(w[i], w[i + 1] + 1)} if i + 2 < len(w) else {}
                    i += 3
        else:
            first = pdf.get(f, "FirstChar") or 0
            self.widths = {first + k: float(x) for k, v in enumerate(pdf.get(f, "Widths") or []) if isinstance(x := pdf.resolve(v), (int, float))}
        enc = pdf.get(f, "Encoding")
        self.diff: dict[int, str] = {}
        if isinstance(enc, dict):
            at = 0
            for x in pdf.get(enc, "Differences") or []:
                if isinstance(x, int):
                    at = x
                else:
                    self.diff[at] = _GLYPHS.get(str(x), str(x) if len(x) == 1 else chr(int(x[3:7], 16)) if re.fullmatch("uni[0-9A-F]{4}", str(x)) else "")
                    at += 1

    def decode(self, raw: bytes) -> tuple[str, float]:
        """Text, and its width at size 1."""
        n = 2 if self.wide else 1
        text, width = [], 0.0
        if not (self.wide or self.map or self.diff):
            of, default = self.widths.get, self.default
            for num in raw if self.widths else ():
                width += of(num, default)
            return raw.decode("cp1252", "replace"), (width if self.widths else default * len(raw)) / 1000
        for i in range(0, len(raw), n):
            code = raw[i : i + n]
            num = int.from_bytes(code, "big")
            width += self.widths.get(num, self.default)
            if code in self.map:
                text.append(self.map[code])
            elif self.wide:
                text.append(code.decode("utf-16-be", "replace") if len(code) == 2 else "")
            else:
                text.append(self.diff[num] if num in self.diff else code.decode("cp1252", "replace"))
        return "".join(text), width / 1000


_GLYPHS = {"space": " ", "hyphen": "-", "period": ".", "comma": ",", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "bullet": "•", "endash": "–", "emdash": "—", "fi": "fi", "fl": "fl", "colon": ":", "parenleft": "(", "parenright": ")"}


def _mul(m, n):
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def spans_and_lines(pdf: Pdf, page: dict) -> tuple[list[dict], list[tuple[float, float, float, float]]]:
    """The spans of text of a page with their places, and the segments of painted paths (in their own space).

    A span is as wide as its glyphs, scaled (Tz); the next one begins after the space between
    characters (Tc) and words (Tw) too.
    """
    res = pdf.inherited(page, "Resources") or {}
    fonts = {k: Font(pdf, f) for k, v in (pdf.get(res, "Font") or {}).items() if isinstance(f := pdf.resolve(v), dict)}
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, stack, tm, tlm, size, font, leading = unit, [], unit, unit, 0.0, None, 0.0
    between, after_blank, wide = 0.0, 0.0, 1.0
    spans: list[dict] = []
    segments, path, now, begin = [], [], (0.0, 0.0), (0.0, 0.0)

    def show(raw) -> None:
        nonlocal tm
        if not isinstance(raw, bytes):
            return
        text, width = font.decode(raw) if font else (raw.decode("cp1252", "replace"), 0.6 * len(raw))
        m = _mul(tm, ctm)
        scale = (m[2] ** 2 + m[3] ** 2) ** 0.5 or 1.0
        if text:
            spans.append({"text": text, "x": m[4], "y": m[5], "width": width * size * wide * ((m[0] ** 2 + m[1] ** 2) ** 0.5 or 1.0), "font_size": size * scale, "font_name": font.name if font else ""})
        codes = len(raw) // 2 if font and font.wide else len(raw)
        blanks = 0 if font and font.wide else raw.count(b" ")
        step = width * size + between * codes + after_blank * blanks
        if text:
            spans[-1]["step"] = step / size if size else 0.0
        tm = _mul((1, 0, 0, 1, step * wide, 0), tm)

    def newline(x: float, y: float) -> None:
        nonlocal tm, tlm
        tlm = tm = _mul((1, 0, 0, 1, x, y), tlm)

    for op, a in operations(pdf.content(page)):
        try:
            if op == "q":
                stack.append((ctm, font, size, leading, between, after_blank, wide))
            elif op == "Q" and stack:
                ctm, font, size, leading, between, after_blank, wide = stack.pop()
            elif op == "cm":
                ctm = _mul(tuple(map(float, a[-6:])), ctm)
            elif op == "BT":
                tm = tlm = unit
            elif op == "Tf":
                font, size = fonts.get(a[-2]), float(a[-1])
            elif op == "Tc":
                between = float(a[-1])
            elif op == "Tw":
                after_blank = float(a[-1])
            elif op == "Tz":
                wide = float(a[-1]) / 100
            elif op == "TL":
                leading = float(a[-1])
            elif op == "Td":
                newline(a[-2], a[-1])
            elif op == "TD":
                leading = -float(a[-1])
                newline(a[-2], a[-1])
            elif op == "Tm":
                tm = tlm = tuple(map(float, a[-6:]))
            elif op == "T*":
                newline(0, -leading)
            elif op == "Tj":
                show(a[-1])
            elif op in ("'", '"'):
                if op == '"':
                    after_blank, between = float(a[-3]), float(a[-2])
                newline(0, -leading)
                show(a[-1])
            elif op == "TJ":
                for x in a[-1]:
                    if isinstance(x, bytes):
                        show(x)
                    elif isinstance(x, (int, float)):
                        tm = _mul((1, 0, 0, 1, -x / 1000 * size * wide, 0), tm)
            elif op == "m":
                now = begin = (float(a[-2]), float(a[-1]))
            elif op == "l":
                path.append((*now, float(a[-2]), float(a[-1])))
                now = (float(a[-2]), float(a[-1]))
            elif op == "re":
                x, y, w, h = map(float, a[-4:])
                path += [(x, y, x + w, y), (x + w, y, x + w, y + h), (x + w, y + h, x, y + h), (x, y + h, x, y)]
            elif op == "h":
                if max(abs(now[0] - begin[0]), abs(now[1] - begin[1])) > 0.01:
                    path.append((*now, *begin))
                now = begin
            elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"):
                segments += path
                path = []
            elif op == "n":
                path = []
        except (IndexError, TypeError, ValueError):
            continue
    return spans, segments


def _dest_page(pdf: Pdf, numbers: dict[int, int], dest) -> int | None:
    dest = pdf.resolve(dest)
    if isinstance(dest, dict):
        dest = pdf.get(dest, "D")
    if isinstance(dest, list) and dest:
        p = pdf.resolve(dest[0])
        return p + 1 if isinstance(p, int) else numbers.get(id(p))
    return None


def outline(pdf: Pdf) -> list[dict]:
    root = pdf.get(pdf.trailer, "Root")
    numbers, out, seen = pdf.page_numbers(), [], set()

    def walk(ref, level: int) -> None:
        while isinstance(item := pdf.resolve(ref), dict) and id(item) not in seen and level < 64:
            seen.add(id(item))
            dest = item.get("Dest") if "Dest" in item else pdf.get(pdf.get(item, "A") or {}, "D")
            out.append({"title": pdf_text(pdf.get(item, "Title")) or "", "page": _dest_page(pdf, numbers, dest) or 1, "level": level})
            walk(item.get("First"), level + 1)
            ref = item.get("Next")

    walk((pdf.get(root, "Outlines") or {}).get("First") if isinstance(root, dict) else None, 1)
    return out


def annotations(pdf: Pdf, page: dict, nr: int, numbers: dict[int, int]) -> list[dict]:
    out = []
    for i, r in enumerate(pdf.get(page, "Annots") or []):
        a = pdf.resolve(r)
        if not isinstance(a, dict):
            continue
        act = pdf.get(a, "A") or {}
        uri = pdf_text(pdf.get(act, "URI")) or (pdf_text(pdf.get(act, "F")) if pdf.get(act, "S") == "GoToR" else None)
        target = _dest_page(pdf, numbers, act["D"] if "D" in act else a.get("Dest")) if act or "Dest" in a else None
        rect = [float(x) for v in pdf.get(a, "Rect") or [] if isinstance(x := pdf.resolve(v), (int, float))]
        out.append({"page": nr, "annot_idx": i, "type": str(pdf.get(a, "Subtype") or "").lower(), "rect": rect, "contents": pdf_text(pdf.get(a, "Contents")), "author": pdf_text(pdf.get(a, "T")), "uri": uri, "target_page": target})
    return out


def form_nodes(pdf: Pdf) -> list[dict]:
    """The nodes of the form's tree, for forms.qualified(): id, parent, t, ft, ff, value."""
    root = pdf.get(pdf.trailer, "Root")
    form = pdf.get(root, "AcroForm") if isinstance(root, dict) else None
    out, todo, seen = [], [(r, None) for r in (pdf.get(form, "Fields") or [])], set()
    while todo:
        r, parent = todo.pop(0)
        f = pdf.resolve(r)
        if not isinstance(f, dict) or id(f) in seen:
            continue
        seen.add(id(f))
        me, v = len(out), pdf.get(f, "V")
        kids = pdf.get(f, "Kids") or []
        fields = [k for k in kids if isinstance(x := pdf.resolve(k), dict) and "T" in x and pdf.get(x, "Subtype") != "Widget"]
        out.append({"id": me, "parent": parent, "t": pdf_text(pdf.get(f, "T")) or "", "ft": pdf.get(f, "FT"), "ff": pdf.get(f, "Ff"), "value": pdf_text(v) if isinstance(v, bytes) else str(v) if v is not None else None})
        todo += [(k, me) for k in fields]
    return out


INFO = {"Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "creator", "Producer": "producer", "CreationDate": "creation_date", "ModDate": "modification_date"}


def read(content: bytes, password: str | None = None) -> dict:
    """Pages, spans, segments, metadata, outline, annotations, images and form of a file."""
    pdf = Pdf(content, password)
    info = pdf.get(pdf.trailer, "Info") or {}
    version = re.search(rb"%PDF-([0-9.]+)", content[:1024])
    meta = {f: t for k, f in INFO.items() if (t := pdf_text(pdf.get(info, k)))} | ({"pdf_version": version[1].decode()} if version else {})
    root = pdf.get(pdf.trailer, "Root")
    xmp = pdf.get(root, "Metadata") if isinstance(root, dict) else None
    if isinstance(xmp, Stream):
        meta["xmp"] = pdf.decoded(xmp).decode("utf-8", "replace")
    pages, spans, segments, notes, images = [], [], [], [], []
    numbers = pdf.page_numbers()
    for nr, page in enumerate(pdf.pages(), 1):
        b = pdf.box(page)
        pages.append({"page": nr, "width": b[2] - b[0], "height": b[3] - b[1], "rotation": int(pdf.inherited(page, "Rotate") or 0)})
        s, g = spans_and_lines(pdf, page)
        spans += [x | {"page": nr, "span_idx": i} for i, x in enumerate(s)]
        segments += [{"page": nr, "ax": x[0], "ay": x[1], "bx": x[2], "by": x[3]} for x in g]
        notes += annotations(pdf, page, nr, numbers)
        for v in (pdf.get(pdf.inherited(page, "Resources") or {}, "XObject") or {}).values():
            o = pdf.resolve(v)
            if isinstance(o, Stream) and pdf.get(o.info, "Subtype") == "Image":
                f = pdf.get(o.info, "Filter")
                space = pdf.get(o.info, "ColorSpace")
                images.append({"page": nr, "width": int(pdf.get(o.info, "Width") or 0), "height": int(pdf.get(o.info, "Height") or 0), "bits": pdf.get(o.info, "BitsPerComponent"), "color_space": str(space) if isinstance(space, str) else None, "filters": [str(x) for x in f] if isinstance(f, list) else [str(f)] if f else [], "data": o.raw})
    return {"page_count": len(pages), "metadata": meta, "pages": pages, "spans": spans, "segments": segments, "bookmarks": outline(pdf), "annotations": notes, "images": images, "fields": form_nodes(pdf)}


# --- writing ---------------------------------------------------------------


def _string(s: str) -> bytes:
    raw = s.encode("cp1252", "replace")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def write(pages: list[dict], metadata: dict[str, str] | None = None, compress: bool = True, encrypt: dict | None = None) -> bytes:
    """A file of pages {width, height, spans [{text, x, y, font_size, bold}], segments [(ax, ay, bx, by)]}.

    encrypt: {user, owner, algorithm (rc4, aes128 or aes256), permissions (the signed number)}.
    """
    objects: list[tuple[bytes, bytes | None]] = [(b"<< /Type /Catalog /Pages 2 0 R >>", None), (b"", None), (b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", None), (b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding /WinAnsiEncoding >>", None)]
    key, aes, trailer = None, False, b""
    if encrypt is not None:
        how = encrypt.get("algorithm", "aes128")
        aes = how != "rc4"
        file_id, p = hashlib.md5(repr((metadata, len(pages))).encode()).digest(), int(encrypt.get("permissions", -4))
        user, owner = (str(encrypt.get(k) or "") for k in ("user", "owner"))
        if how == "aes256":
            key, sealed = crypt.entries_256(user.encode(), (owner or user).encode(), p)
            kind = b"/V 5 /R 6 /Length 256 /CF << /StdCF << /CFM /AESV3 /AuthEvent /DocOpen /Length 32 >> >> /StmF /StdCF /StrF /StdCF"
        else:
            user, owner = (x.encode("cp1252", "replace") for x in (user, owner))
            revision = 4 if aes else 3
            o = crypt.owner_entry(owner, user, revision, 16)
            key = crypt.file_key(user, o, p, file_id, revision, 16)
            sealed = {"O": o, "U": crypt.user_entry(key, file_id, revision)}
            kind = b"/V 4 /R 4 /Length 128 /CF << /StdCF << /CFM /AESV2 /AuthEvent /DocOpen /Length 16 >> >> /StmF /StdCF /StrF /StdCF" if aes else b"/V 2 /R 3 /Length 128"
    kids = []
    for p_ in pages:
        body = [b"%g %g m %g %g l S" % s for s in p_.get("segments", [])]
        for s in p_.get("spans", []):
            body.append(b"BT /%s %g Tf 1 0 0 1 %g %g Tm %s Tj ET" % (b"F2" if s.get("bold") else b"F1", s.get("font_size", 12), s["x"], s["y"], _string(s["text"])))
        raw, head = b"\n".join(body), b""
        if compress:
            raw, head = zlib.compress(raw), b" /Filter /FlateDecode"
        objects.append((head, raw))
        objects.append((b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Contents %d 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (p_.get("width", 595), p_.get("height", 842), len(objects)), None))
        kids.append(len(objects))
    objects[1] = (b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids)), None)
    known = {f: k for k, f in INFO.items()}
    info = len(objects) + 1
    said = lambda v: _string(v) if key is None else b"<%s>" % crypt.seal(key, info, v.encode("cp1252", "replace"), aes).hex().encode()
    objects.append((b"<< " + b" ".join(b"/%s %s" % (known[f].encode(), said(v)) for f, v in (metadata or {}).items() if f in known and v) + b" >>", None))
    if key is not None:
        objects.append((b"<< /Filter /Standard %s %s /P %d >>" % (kind, b" ".join(b"/%s <%s>" % (k.encode(), v.hex().encode()) for k, v in sealed.items()), p), None))
        trailer = b" /Encrypt %d 0 R /ID [<%s> <%s>]" % (len(objects), file_id.hex().encode(), file_id.hex().encode())
    out, places = bytearray(b"%PDF-1.7\n"), []
    for i, (head, raw) in enumerate(objects, 1):
        places.append(len(out))
        if raw is not None:
            raw = raw if key is None else crypt.seal(key, i, raw, aes)
            head = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(raw), head, raw)
        out += b"%d 0 obj\n%s\nendobj\n" % (i, head)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % at for at in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R /Info %d 0 R%s >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, info, trailer, start)
    return bytes(out)


def paginate(lines: list[tuple[str, float, bool]], per_page: int = 50, leading: float = 14.0, margin: float = 72.0, width: float = 595.0, height: float = 842.0) -> list[dict]:
    """Pages of lines (text, size, bold), from the top margin down."""
    out = []
    for k in range(max(1, ceil(len(lines) / per_page))):
        part = lines[k * per_page : (k + 1) * per_page]
        out.append({"width": width, "height": height, "spans": [{"text": t, "x": margin, "y": height - margin - i * leading, "font_size": s, "bold": b} for i, (t, s, b) in enumerate(part) if t]})
    return out
