"""Language-model scoring by context-tree weighting over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from math import log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import sharedfile
from quire.llm.common import cut, fresh, new_folder

#: Bytes of context at most; a key of 64 bits has room for DEEPEST.
DEPTH, DEEPEST = 5, 6
#: Contexts and bytes in a file of the model.
FILE = 2_000_000


def keys_of(texts: list[str], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts' bytes, one after the other: (context and byte) as one number, and where each
    text begins. The latest byte of a context is the most significant; before a text are zeros."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    pad = b"\0" * depth
    b = np.frombuffer(pad + pad.join(raw) + pad, np.uint8).astype(np.int64)
    n = len(b) - depth
    k = b[depth:].copy()
    for j in range(1, depth + 1):
        k |= b[depth - j : depth - j + n] << (8 * (depth - j + 1))
    starts = np.cumsum(sizes + depth) - sizes - depth
    real = np.ones(n, bool)
    for i in range(depth):
        at = starts + sizes + i
        real[at[at < n]] = False
    return k[real], np.cumsum(sizes) - sizes


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0, by Stirling's series at x + 8."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift += np.log(y)
        y += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - log(pi)


#: Depth down to which trees are computed in groups; above it there are few nodes.
TOP = 2
#: Contexts and bytes that are in one group, on average.
GROUP = 200_000


def mixed(kt: np.ndarray, pe: np.ndarray, kids: np.ndarray, deeper: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The probability of a bit at a node: its own estimate and the one from deeper, by the weights of both.

    pe and kids are the logs of the estimated and of the children's probability of all that was counted
    there; where own is 1 the bit itself is among that, and is taken out first (kt and deeper are without it).
    """
    pe, kids = pe - own * np.log(kt), kids - own * np.log(deeper)
    stop = np.exp(pe - np.logaddexp(pe, kids))
    return stop * kt + (1 - stop) * deeper


def kt_of(n0: np.ndarray, n1: np.ndarray, bit: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov probability of a bit after these counts, of which own are the bit's own."""
    return (np.where(bit == 1, n1, n0) - own + 0.5) / (n0 + n1 - own + 1.0)


def subtree(keys: np.ndarray, n: np.ndarray, depth: int, top: int, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trees from depth top down, for the 255 inner nodes of the byte's binary code.

    The keys are all those of some contexts of depth top. Gives for each key the weighted
    probability of its 8 bits from depth top down (with own, after all that was counted but one
    occurrence of the key); and for each node of depth top the number of the node above (its context
    and code), and the log of the weighted probability of all that was counted there, and both counts.
    """
    probs = np.ones((len(keys), 8))
    above, sums = [], []
    byte, ctx = keys & 255, keys >> 8
    mine = (n > 0).astype(np.float64) if own else np.zeros(len(keys))
    for k in range(8):
        code = (1 << k) | (byte >> (8 - k))
        bit = (byte >> (7 - k)) & 1
        child, c0, c1, lpw, q = None, n * (bit == 0), n * (bit == 1), None, None
        path = np.arange(len(keys))
        for d in range(depth, top - 1, -1):
            # the nodes of depth d that these keys pass, and where each of the level below belongs
            at = (ctx << 8) | code if child is None else ((child >> 16) << 8) | (child & 255)
            uniq, inv = np.unique(at, return_inverse=True)
            m = len(uniq)
            n0, n1 = np.bincount(inv, c0, m), np.bincount(inv, c1, m)
            pe = kt_log(n0, n1)
            path = inv[path]
            kt = kt_of(n0[path], n1[path], bit, mine)
            if child is None:
                pw, q = pe, kt
            else:
                kids = np.bincount(inv, lpw, m)
                pw = np.logaddexp(pe, kids) - log(2)
                q = mixed(kt, pe[path], kids[path], q, mine)
            child, c0, c1, lpw = uniq, n0, n1, pw
        probs[:, k] = q
        above.append(((child >> 16) << 8) | (child & 255))
        sums.append(np.stack([lpw, c0, c1], 1))
    return probs, np.concatenate(above), np.concatenate(sums)


def upper(nodes: dict[int, tuple[float, float, float]], top: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the depths top - 1 to 0: by context and code (256 x 256 at depth 1, 1 x 256 at depth 0) the
    counts of both bits, and the logs of the estimated and of the children's probability."""
    out = []
    size = 256 ** (top - 1)
    kids, n0, n1 = (np.zeros((size, 256)) for _ in range(3))
    for at, (l, a, b) in nodes.items():
        kids[at >> 8, at & 255], n0[at >> 8, at & 255], n1[at >> 8, at & 255] = l, a, b
    while True:
        pe = kt_log(n0, n1)
        out.append((n0, n1, pe, kids))
        if size == 1:
            return out
        size //= 256
        pw = np.logaddexp(pe, kids) - log(2)
        kids, n0, n1 = (x.reshape(size, 256, 256).sum(1) for x in (pw, n0, n1))


def gather(texts: DataFrame, depth: int, weight: int) -> DataFrame:
    """(key, n): weight times how often the texts have each context and byte."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k = np.concatenate([a for a, _ in held])
            uniq, inv = np.unique(k, return_inverse=True)
            return uniq, np.bincount(inv, np.concatenate([b for _, b in held]), len(uniq)).astype(np.int64)

        for pdf in batches:
            texts, size = [], 0
            for t in [*pdf.text, None]:
                if t:
                    texts.append(t)
                    size += len(t)
                if texts and (t is None or size > 2_000_000):
                    held.append(np.unique(keys_of(texts, depth)[0], return_counts=True))
                    rows += len(held[-1][0])
                    texts, size = [], 0
            if rows > 2_000_000:
                held = [merged()]
                rows = len(held[0][0])
                if rows > 1_000_000:
                    yield pd.DataFrame({"key": held[0][0], "n": held[0][1] * weight})
                    held, rows = [], 0
        if held:
            k, n = merged()
            yield pd.DataFrame({"key": k, "n": n * weight})

    return texts.mapInPandas(count, "key bigint, n bigint")


class Model:
    """Where the shards of a fitted model lie: sorted keys, and the bits that each byte costs."""

    def __init__(self, shards: list[tuple[int, int, str, str]], depth: int):
        self.shards, self.depth = sorted(shards), depth

    def open(self):
        """The least key of each file, and a function that opens one, once it is needed."""
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def shard(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in held:
                held[i] = tuple(map(sharedfile.get, self.shards[i][2:]))
            return held[i]

        return np.array([s[0] for s in self.shards], np.int64), shard


def fit(corpus: DataFrame, scored: DataFrame | None = None, text: str = "text", depth: int = DEPTH, own: bool = False, group_size: int = GROUP, file_size: int = FILE) -> Model:
    """The context trees of all the texts of corpus.

    For each byte and context that corpus has (and scored, whose texts aren't counted but may be
    scored by the model) it holds the code length of the byte: along the byte's 8 binary
    decisions, the Krichevsky-Trofimov estimates of depths 0 to depth, mixed by the weights that
    the corpus gives them. With own, these are the estimates and weights of the corpus without one
    occurrence of the byte there: what a byte of corpus costs after all others. Counts are added up
    over the whole corpus; trees are computed in groups of contexts by their latest two bytes, and
    joined above from 256 x 255 sums. The model goes to the shared folder in files by range of key;
    its size is that of the different contexts, not of the corpus. group_size is the average of keys
    in a group, file_size the bound of keys in a file, about; neither changes a score.

    Null and empty texts count nothing; an empty corpus gives a model that scores each decision of
    scored as even. depth is 1 to DEEPEST.
    """
    if not 1 <= depth <= DEEPEST:
        raise ValueError(f"depth is from 1 to {DEEPEST}")
    spark = corpus.sparkSession
    found = gather(corpus.select(F.col(text).alias("text")), depth, 1)
    if scored is not None:
        found = found.unionByName(gather(scored.select(F.col(text).alias("text")), depth, 0))
    counts = cut(found.groupBy("key").agg(F.sum("n").alias("n")))
    total, top = counts.count(), min(TOP, depth)
    group = F.pmod(F.xxhash64(F.shiftright("key", 8 * (depth - top + 1))), F.lit(max(1, -(-total // group_size))))

    def trees(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        keys = pdf["key"].to_numpy(np.int64)
        probs, above, sums = subtree(keys, pdf["n"].to_numpy(np.float64), depth, top, own)
        named, inv = np.unique(above, return_inverse=True)
        added = np.zeros((len(named), 8))
        for j in range(3):
            added[:, j] = np.bincount(inv, sums[:, j], len(named))
        q = np.concatenate([probs, added])
        return pd.DataFrame({"key": np.concatenate([keys, -1 - named]), "own": np.concatenate([(pdf["n"].to_numpy() > 0) & own, np.zeros(len(named), bool)])} | {f"q{k}": q[:, k] for k in range(8)})

    fitted = cut(counts.groupBy(group.alias("g")).applyInPandas(trees, "key bigint, own boolean, " + ", ".join(f"q{k} double" for k in range(8))))
    added = fitted.filter("key < 0").groupBy("key").agg(*[F.sum(f"q{j}").alias(f"s{j}") for j in range(3)])
    levels = upper({-1 - r.key: (r.s0, r.s1, r.s2) for r in added.collect()}, top)  # 256 x 255 rows at most
    folder = new_folder(spark, "ctw")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ks, cs = [], []
        for pdf in batches:
            if len(pdf):
                keys = pdf["key"].to_numpy(np.int64)
                mine = pdf["own"].to_numpy(np.float64)
                byte = keys & 255
                bits = np.zeros(len(keys))
                for k in range(8):
                    code, bit, p = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1, pdf[f"q{k}"].to_numpy()
                    for d, (n0, n1, pe, kids) in zip(range(top - 1, -1, -1), levels):
                        at = (keys >> (8 * (depth - d + 1)), code)
                        p = mixed(kt_of(n0[at], n1[at], bit, mine), pe[at], kids[at], p, mine)
                    bits -= np.log2(p)
                ks.append(keys)
                cs.append(bits)
        if ks:
            keys, bits = np.concatenate(ks), np.concatenate(cs)
            name = f"{keys[0]:016x}"
            yield pd.DataFrame([(int(keys[0]), len(keys), sharedfile.put(folder, f"k{name}", keys), sharedfile.put(folder, f"c{name}", bits.astype(np.float32)))], columns=["lo", "n", "k", "c"])

    parts = max(1, -(-total // file_size))
    shards = fitted.filter("key >= 0").repartitionByRange(parts, "key").sortWithinPartitions("key")
    rows = shards.mapInPandas(write, "lo bigint, n bigint, k string, c string").collect()
    return Model([(r.lo, r.n, r.k, r.c) for r in rows], depth)


def score(docs: DataFrame, model: Model | None = None, text: str = "text", depth: int = DEPTH, **how) -> DataFrame:
    """docs with n_bytes, bits and bits_per_byte of each whole text under the model.

    Without a model, docs itself is counted, and each byte is scored by all of docs but that one
    occurrence of it: what only one text has, it can't predict for itself, while what a second copy or
    the rest of the text has, it can. how: group_size and file_size of fit().

    A null or empty text has 0 bytes, 0 bits and a null bits_per_byte, and teaches the model
    nothing. Repeated rows count as often as they are there and get equal scores. A text with a byte and
    context that the model wasn't fitted for (see scored in fit()) is an error. An empty table gives an empty table. Where docs has
    columns of these names, the new ones have underscores before them; no column is lost.
    """
    model = fit(docs, text=text, depth=depth, own=True, **how) if model is None else model
    names = fresh(docs, "n_bytes", "bits", "bits_per_byte")
    (f,) = fresh(docs, "_f")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        los, shards = model.open()

        def bits_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            keys, starts = keys_of(texts, model.depth)
            each, back = np.unique(keys, return_inverse=True)  # in order, so that look-ups go through the files once
            cost = np.empty(len(each), np.float64)
            ends = np.append(np.searchsorted(each, los[1:]), len(each))
            lo = 0
            for i, hi in enumerate(ends.tolist()):
                if hi > lo:
                    there, bits = shards(i)
                    at = np.minimum(np.searchsorted(there, each[lo:hi]), len(there) - 1)
                    if (there[at] != each[lo:hi]).any():
                        raise ValueError("the model wasn't fitted for the texts that are scored")
                    cost[lo:hi] = bits[at]
                lo = hi
            sizes = np.diff(np.append(starts, len(keys)))
            return sizes, np.add.reduceat(cost[back], starts)

        for batch in batches:
            n, bits = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            texts, where, size = [], [], 0
            for i, t in enumerate([*batch, None]):
                if t:
                    texts.append(t)
                    where.append(i)
                    size += len(t)
                if texts and (i == len(batch) or size > 1_000_000):
                    n[where], bits[where] = bits_of(texts)
                    texts, where, size = [], [], 0
            yield pd.DataFrame({"n_bytes": n, "bits": bits})

    udf = F.pandas_udf(run, "n_bytes bigint, bits double")
    out = docs.withColumn(f, udf(F.col(text)))
    per = F.when(F.col(f"{f}.n_bytes") > 0, F.col(f"{f}.bits") / F.col(f"{f}.n_bytes"))
    return out.select(*docs.columns, F.col(f"{f}.n_bytes").alias(names[0]), F.col(f"{f}.bits").alias(names[1]), per.alias(names[2]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs).select("doc_id", "n_bytes", F.round("bits_per_byte", 6).alias("bits_per_byte"))
