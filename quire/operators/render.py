"""Pages as pictures. Text is drawn by a small built-in font, within the width that the file's own font gives it, and
rule lines as lines; pictures, curves, colours and the shapes of the file's fonts aren't drawn."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.kept import Kept
from quire.sources import pdf

#: 5 columns of 8 dots for each sign from blank to ~, the lowest bit on top.
GLYPHS = (
    "000000000000005f00000007000700147f147f14242a7f2a12231308646236495620500008070300001c2241000041221c002a1c7f1c2a08083e08080080703000080808080800006060002010080402"
    "3e5149453e00427f400072494949462141494d331814127f1027454545393c4a49493141211109073649494936464949291e000014000000403400000008142241141414141400412214080201590906"
    "3e415d594e7c1211127c7f494949363e414141227f4141413e7f494949417f090909013e414151737f0808087f00417f41002040413f017f081422417f404040407f021c027f7f0408107f3e4141413e"
    "7f090909063e4151215e7f09192946264949493203017f01033f4040403f1f2040201f3f4038403f631408146303047804036159494d43007f4141410204081020004141417f04020102044040404040"
    "000307080020545478407f284444383844444428384444287f385454541800087e090218a4a49c787f0804047800447d40002040403d007f1028440000417f40007c047804787c080404783844444438"
    "fc1824241818242418fc7c08040408485454542404043f44243c4040207c1c2040201c3c4030403c44281028444c9090907c4464544c440008364100000077000000413608000201020402"
)


def image_size(width: Column, height: Column, dpi: float = 150.0, to_width: int | None = None, to_height: int | None = None) -> tuple[Column, Column]:
    """Pixels of a page: by dpi, or scaled to a width or height, or to fit both with its shape kept."""
    if to_width is None and to_height is None:
        scale = F.lit(dpi / 72.0)
    elif to_height is None:
        scale = to_width / width
    elif to_width is None:
        scale = to_height / height
    else:
        scale = F.least(to_width / width, to_height / height)
    return F.round(width * scale).cast("int"), F.round(height * scale).cast("int")


def glyph(sign: str) -> np.ndarray:
    """8 x 5 dots; signs that the font hasn't are a box."""
    i = ord(sign) - 32
    columns = bytes.fromhex(GLYPHS[10 * i : 10 * i + 10]) if 0 <= i < 95 else b"\x7f\x41\x41\x41\x7f"
    return np.array([[c >> r & 1 for c in columns] for r in range(8)], bool)


def shape(sign: str, gw: int, gh: int) -> np.ndarray:
    """The dots of a sign, gh high and gw wide."""
    return glyph(sign)[(np.arange(gh) * 8 // gh)[:, None], (np.arange(gw) * 5 // gw)[None, :]]


_shapes = Kept(lambda key: shape(*key), 4096)


def drawn(page: dict, spans: list[dict], segments: list[dict], dpi: float = 150.0) -> np.ndarray:
    """A page (width, height, rotation) in shades of grey, 0 being black."""
    scale = dpi / 72.0
    w, h = (max(1, int(page[k] * scale + 0.5)) for k in ("width", "height"))
    out = np.full((h, w), 255, np.uint8)
    for g in segments:
        n = int(max(abs(g["bx"] - g["ax"]), abs(g["by"] - g["ay"])) * scale) + 2
        x = np.rint(np.linspace(g["ax"], g["bx"], n) * scale).astype(int)
        y = h - 1 - np.rint(np.linspace(g["ay"], g["by"], n) * scale).astype(int)
        ok = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        out[y[ok], x[ok]] = 0
    for s in spans:
        step, tall = s["width"] * scale / max(1, len(s["text"])), s["font_size"] * scale
        gw, gh = max(1, int(step * 0.85)), max(1, int(tall))
        top = int(h - s["y"] * scale - tall * 0.8)
        for k, sign in enumerate(s["text"]):
            if sign == " ":
                continue
            left = int(s["x"] * scale + k * step)
            dots = _shapes[sign, gw, gh] if gw * gh <= 4096 else shape(sign, gw, gh)
            y0, y1, x0, x1 = max(top, 0), min(top + gh, h), max(left, 0), min(left + gw, w)
            if y0 < y1 and x0 < x1:
                out[y0:y1, x0:x1][dots[y0 - top : y1 - top, x0 - left : x1 - left]] = 0
    return np.rot90(out, -(page.get("rotation") or 0) // 90)


def pictures(content: bytes, dpi: float = 150.0, pages: list[int] | None = None, password: str | None = None) -> list[tuple[int, np.ndarray]]:
    """(number, picture) of the pages of a PDF file, or of those named."""
    doc = pdf.read(content, password)
    return [(p["page"], drawn(p, *([x for x in doc[k] if x["page"] == p["page"]] for k in ("spans", "segments")), dpi)) for p in doc["pages"] if pages is None or p["page"] in pages]


def blank(w: int, n: int) -> tuple[bytes, int]:
    """n white rows deflated, to stand anywhere in a stream, and their checksum."""
    raw = (b"\0" + b"\xff" * w) * n
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(raw) + z.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw)


_blanks = Kept(lambda key: blank(*key), 256)


def deflated(picture: np.ndarray) -> bytes:
    """The rows of a picture as PNG has them. Runs of white rows, most of a page of text, are taken as they were
    deflated before: none refers to what comes before it."""
    h, w = picture.shape
    ink = (picture != 255).any(axis=1)
    cuts = [0, *(np.flatnonzero(ink[1:] != ink[:-1]) + 1).tolist(), h]
    z, out, a, b = zlib.compressobj(6, zlib.DEFLATED, -15), [b"\x78\x9c"], 1, 0
    for lo, hi in zip(cuts, cuts[1:]):
        n = (hi - lo) * (w + 1)
        if ink[lo]:
            raw = np.concatenate([np.zeros((hi - lo, 1), np.uint8), picture[lo:hi]], 1).tobytes()
            body, add = z.compress(raw) + z.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw)
        else:
            body, add = _blanks[w, hi - lo]
        out.append(body)
        a, b = (a + (add & 0xFFFF) - 1) % 65521, (b + (add >> 16) + n * (a - 1)) % 65521
    return b"".join([*out, z.flush(), struct.pack(">I", b << 16 | a)])


def png(picture: np.ndarray) -> bytes:
    """A picture in shades of grey as a PNG file."""
    h, w = picture.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", deflated(picture)) + chunk(b"IEND", b"")


def rendered(files: DataFrame, dpi: float = 150.0, pages: list[int] | None = None, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, page, width, height, png) of the pages of PDF files, or of those named; a file that can't be read has none."""

    def run(found: pd.Series) -> pd.Series:
        out = []
        for c in found:
            try:
                out.append([{"page": n, "width": x.shape[1], "height": x.shape[0], "png": png(x)} for n, x in pictures(bytes(c), dpi, pages)])
            except Exception:
                out.append([])
        return pd.Series(out)

    udf = F.pandas_udf(run, "array<struct<page:int,width:int,height:int,png:binary>>").asNondeterministic()
    return files.select(key, F.explode(udf(content)).alias("p")).select(key, "p.*")


def compared(a: DataFrame, b: DataFrame, dpi: float = 72.0, threshold: int = 10, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, page, changed, total, similarity) of the pages that both sides have: pixels that differ by more than threshold.

    Pictures of different sizes are laid over each other at the top left; what one has more of is changed.
    """

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            try:
                one, two = dict(pictures(bytes(x), dpi)), dict(pictures(bytes(y), dpi))
            except Exception:
                out.append([])
                continue
            rows = []
            for n in sorted(one.keys() & two.keys()):
                p, q = one[n].astype(np.int16), two[n].astype(np.int16)
                h, w = min(p.shape[0], q.shape[0]), min(p.shape[1], q.shape[1])
                total = max(p.shape[0], q.shape[0]) * max(p.shape[1], q.shape[1])
                changed = int((np.abs(p[:h, :w] - q[:h, :w]) > threshold).sum()) + total - h * w
                rows.append({"page": n, "changed": changed, "total": total, "similarity": 1.0 - changed / total})
            out.append(rows)
        return pd.Series(out)

    both = a.select(key, F.col(content).alias("_a")).join(b.select(key, F.col(content).alias("_b")), key)
    udf = F.pandas_udf(run, "array<struct<page:int,changed:int,total:int,similarity:double>>").asNondeterministic()
    return both.select(key, F.explode(udf("_a", "_b")).alias("p")).select(key, "p.*")
