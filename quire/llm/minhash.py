"""Near-dedup by bottom-k sketches of one hash function."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, fresh
from quire.llm.components import components

#: Words in a shingle.
WORDS = 3
#: Hash values that a sketch keeps.
K = 64
#: Pairs of this exact Jaccard similarity or more are near copies.
THRESHOLD = 0.5
#: The estimate that a pair needs to be verified: 1.6 standard errors under the threshold.
ESTIMATE = 0.4
#: Shingles in the different texts of a component that one task verifies; larger components are verified in rounds.
TASK_SHINGLES = 2_000_000
#: Rounds in which the nodes of an inverted list are compared with one of them only.
ROUNDS = 2

_WORD = re.compile(r"\w+")
_M = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, w: str) -> int:
        h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) < 1_000_000:
            self[w] = h
        return h


def shingles(text: str | None, memo: dict, words: int = WORDS) -> np.ndarray:
    """The different shingle hashes of a text, of 63 bits, sorted; one of all its words if these are few."""
    found = _WORD.findall(text.lower()) if text else []
    if not found:
        return np.empty(0, np.int64)
    h = np.array([memo[w] for w in found], dtype=np.uint64)
    n = max(1, len(h) - words + 1)
    x = np.zeros(n, np.uint64)
    for i in range(min(words, len(h))):
        x = (x ^ h[i : i + n]) * _M[0]
        x ^= x >> np.uint64(29)
        x = x * _M[1] + np.uint64(i + 1)
    return np.unique((x ^ (x >> np.uint64(32))) >> np.uint64(1)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def estimate_of(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The similarity of two sets, from the k least values of both together."""
    a, b = a[:k], b[:k]
    u = np.union1d(a, b)[:k]
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), u).sum()) / len(u) if len(u) else 0.0


def texts_of(docs: DataFrame, text: str, doc_id: str | None) -> DataFrame:
    """(node, check, rid, text): two hashes of the text, of 64 bits each, and one of the document's id."""
    rid = F.lit(0).cast("bigint") if doc_id is None else F.xxhash64(doc_id)
    return docs.select(F.xxhash64(text).alias("node"), F.xxhash64(F.lit(1), text).alias("check"), rid.alias("rid"), F.col(text).alias("text")).filter("text IS NOT NULL")


def sketches(texts: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """(node, check, rid, n, s) for each different node of texts (node, check, rid, text): its k smallest
    shingle hashes, the number of its shingles, and which of its rows stands for it. Texts without
    words have none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = _Hashes()
        for batch in batches:
            rows = []
            for t in batch:
                x = shingles(t, memo, words)
                rows.append((x[:k], len(x)))
            yield pd.DataFrame(rows, columns=["s", "n"])

    udf = F.pandas_udf(run, "s array<bigint>, n int").asNondeterministic()  # the filter below would run it again
    found = texts.withColumn("f", udf("text")).select("node", F.struct("check", "rid", "f.n", "f.s").alias("f")).filter("f.n > 0")
    return found.groupBy("node").agg(F.min("f").alias("f")).select("node", "f.*")


def inverted(sk: DataFrame, k: int = K, estimate: float = ESTIMATE) -> DataFrame:
    """(node, n, v, leads): the inverted lists of the retained values v that can make a pair of nodes.

    A pair whose estimate is e shares at least e times the larger sketch of values. So it also
    shares one of the rarest len - ceil(e * len) + 1 values of each of the two: only these are
    kept. Of two full sketches, m = ceil(e * k) values in common lie among the k least of both
    together, so their ranks at the mth add up to k + m at most, and one of the two has it among its
    least (k + m) / 2 values: a pair is found by a value that is among the rarest (k + m) / 2 - m + 1
    of these (leads), of one of the two. No list is cut and no pair that can reach the estimate is
    missed, while what very many documents have (a shared passage) drops out of the lists of all those
    that have rarer values too, and leads in none of which it isn't the larger part.
    """
    m = int(np.ceil(k * estimate - 1e-9))
    low = (k + m) // 2
    often = sk.select(F.explode("s").alias("v")).groupBy("v").agg(F.count("*").alias("f")).filter("f > 1")
    # n, z and the rank i of a value in one number: these rows are all the values of all the sketches
    bits, low_bits = k.bit_length(), F.lit((1 << k.bit_length()) - 1)
    packed = F.shiftleft(F.shiftleft(F.col("n").cast("bigint"), bits) + F.size("s"), bits)
    each = sk.select("node", packed.alias("nz"), F.posexplode("s").alias("i", "v")).select("node", F.col("nz").bitwiseOR(F.col("i").cast("bigint")).alias("x"), "v")
    found = each.join(often, "v").select("node", F.shiftright("x", bits).alias("nz"), F.struct("f", "v", F.col("x").cast("int").bitwiseAND(low_bits).alias("i")).alias("e"))
    per = found.groupBy("node", "nz").agg(F.array_sort(F.collect_list("e")).alias("l"))
    per = per.select("node", F.shiftright("nz", bits).cast("int").alias("n"), F.col("nz").cast("int").bitwiseAND(low_bits).alias("z"), "l")
    spare = F.size("l") - F.ceil(F.col("z") * estimate - 1e-9) + 1
    first = F.filter("l", lambda x: x["i"] < low)
    lead = F.when(F.col("z") == k, F.slice(first, 1, F.greatest(F.lit(0), F.size(first) - m + 1))).otherwise(F.slice("l", 1, spare.cast("int")))
    kept = per.filter(spare > 0).withColumn("lead", F.transform(lead, lambda x: x["v"]))
    rows = kept.select("node", "n", "lead", F.explode(F.slice("l", 1, spare.cast("int"))).alias("e"))
    return rows.select("node", "n", F.col("e.v").alias("v"), F.array_contains("lead", F.col("e.v")).alias("leads"))


def _active(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(node, n, v, leads, comp): the lists that can still link nodes of different components."""
    lists = lists.select("node", "n", "v", "leads")
    named = lists.withColumn("comp", F.col("node")) if labels is None else lists.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    open_ = named.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("leads").alias("some")).filter("lo < hi AND some")
    return cut(named.join(open_.select("v"), "v").select("node", "n", "v", "leads", "comp"))


def _stars(active: DataFrame, nth: int) -> DataFrame:
    """(a, b): the nodes of each list and class of size, each with one leading node of another component.

    Classes go by powers of 2, shifted by half of one in every round.
    """
    turn = F.lit((0x5851F42D4C957F2D * nth) & ((1 << 63) - 1))  # another order of the nodes in each round
    sized = active.withColumn("cls", F.floor(F.log2("n") + nth / 2))
    one = sized.filter("leads").groupBy("v", "cls").agg(F.min(F.struct(F.col("node").bitwiseXOR(turn).alias("x"), F.col("comp").alias("c"))).alias("p"))
    pairs = sized.join(one, ["v", "cls"]).filter("comp <> p.c").withColumn("a", F.col("p.x").bitwiseXOR(turn))
    return pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _rest(active: DataFrame) -> DataFrame:
    """(a, b): all pairs of a list that are of different components, with a leading node."""
    left = active.filter("leads").select(F.col("node").alias("a"), F.col("comp").alias("ca"), "v")
    right = active.select(F.col("node").alias("b"), F.col("comp").alias("cb"), "v")
    return left.join(right, "v").filter("ca <> cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(lists: DataFrame, compare: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> DataFrame | None:
    """(node, component) for the nodes that compare() links; None where it links none.

    compare() gives those of its pairs (a, b) that are links. The components are those of all pairs
    of a list that it would link, but not all pairs are made: first each node of a list is compared
    with one other of the list, in some rounds with different ones; then all pairs of a list that are still of
    different components are, but for those compared before. A list of copies costs as many pairs as it has nodes.
    """
    labels, before = None, None
    for nth in range(rounds + 1):
        lists = _active(lists, labels)
        if lists.isEmpty():
            break
        pairs = cut(_stars(lists, nth) if nth < rounds else _rest(lists))
        if before is not None:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        before = pairs if before is None else before.unionByName(pairs)
        found = compare(pairs)
        labels = cut(components(found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b"))
    return labels


def estimated(pairs: DataFrame, sk: DataFrame, k: int = K, estimate: float = ESTIMATE, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): the pairs whose estimate from the sketch of the union is enough, and whose sizes allow the threshold."""
    one = pairs.join(sk.select(F.col("node").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na")), "a")
    two = one.join(sk.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb")), "b")
    two = two.filter((F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9))
    union = two.withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
    e = F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")) / F.size("u")
    return union.filter(e >= estimate).select("a", "b")


def grouped(sets: list[np.ndarray], k: int = K, threshold: float = THRESHOLD, estimate: float = ESTIMATE) -> np.ndarray:
    """For each set the least index of its group: groups are linked by pairs of exact similarity threshold
    and estimate. A set is compared with all those that aren't of its group yet; those of the largest
    group needn't be."""
    n = len(sets)
    label = np.arange(n)
    if n == 2:
        if jaccard(*sets) >= threshold and estimate_of(*sets, k) >= estimate:
            label[1] = 0
        return label
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    todo = np.ones(n, bool)
    while True:
        left = np.flatnonzero(todo & (label != np.bincount(label).argmax()))
        if not len(left):
            return label
        p = left[0]
        todo[p] = False
        at = np.minimum(np.searchsorted(sets[p], flat), sizes[p] - 1)
        both = np.bincount(owner[sets[p][at] == flat], minlength=n)
        for j in np.flatnonzero((both >= threshold * (sizes + sizes[p] - both)) & (label != label[p])):
            if label[j] != label[p] and estimate_of(sets[p], sets[j], k) >= estimate:
                a, b = sorted((label[p], label[j]))
                label[label == b] = a


def groups(docs: DataFrame, text: str = "text", doc_id: str | None = None, words: int = WORDS, k: int = K, threshold: float = THRESHOLD, estimate: float = ESTIMATE, task_shingles: int = TASK_SHINGLES, rounds: int = ROUNDS) -> DataFrame:
    """(node, check, grp) for the texts that have near copies; node and check are a text's hashes, 128 bits together.

    Groups are the components of pairs whose exact Jaccard similarity is at least threshold, and
    whose estimate is at least estimate. Components of the estimates come first; a component of these
    is verified in one task, where one pass over the different texts of it compares a text with all others.
    Components of more than task_shingles shingles are verified by linked() instead, with the same result.
    """
    texts = texts_of(docs, text, doc_id)
    sk = cut(sketches(texts, words, k))
    lists = cut(inverted(sk, k, estimate))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # the sketches that are compared, laid out by node once for all rounds; a part that is lost is made again
    ready = sk.join(lists.select("node").distinct(), "node", "left_semi").select("node", "n", "s").repartition(parts, "node").persist(StorageLevel.DISK_ONLY)
    try:
        return _verified(docs, texts, sk, lists, ready, parts, words, k, threshold, estimate, task_shingles, rounds)
    finally:
        ready.unpersist()


def _verified(docs: DataFrame, texts: DataFrame, sk: DataFrame, lists: DataFrame, ready: DataFrame, parts: int, words: int, k: int, threshold: float, estimate: float, task_shingles: int, rounds: int) -> DataFrame:
    near = linked(lists, lambda pairs: estimated(pairs, ready, k, estimate, threshold), rounds)
    if near is None:
        return docs.sparkSession.createDataFrame([], "node bigint, check bigint, grp bigint")
    named = near.join(sk.select("node", "check", "rid", "n"), "node")
    sized = cut(named.join(named.groupBy("component").agg(F.sum(F.col("n").cast("bigint")).alias("size")), "component"))
    # one row a text: the one of the least check and id, so that copies are spread over the tasks of the join
    whole = texts.join(sized, ["node", "check", "rid"]).select("component", "node", "check", "rid", "size", "n", "text").dropDuplicates(["node", "check", "rid"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = _Hashes()
        now, held, out = None, [], []

        def close() -> None:
            if len(held) > 1:
                label = grouped([x for _, _, x in held], k, threshold, estimate)
                many = np.bincount(label, minlength=len(label))
                out.extend((held[i][0], held[i][1], held[g][0]) for i, g in enumerate(label.tolist()) if many[g] > 1)
            held.clear()

        for pdf in batches:
            for comp, node, check, t in zip(pdf["component"].tolist(), pdf["node"].tolist(), pdf["check"].tolist(), pdf["text"]):
                if comp != now:
                    close()
                    now = comp
                held.append((node, check, shingles(t, memo, words)))
            if out:
                yield pd.DataFrame(out, columns=["node", "check", "grp"])
                out.clear()
        close()
        yield pd.DataFrame(out, columns=["node", "check", "grp"]).astype("int64")

    small = F.expr(f"size <= {task_shingles}")
    order = whole.filter(small).select("component", "node", "check", "text").repartition(parts, "component").sortWithinPartitions("component", "node")
    inside = order.mapInPandas(verify, "node bigint, check bigint, grp bigint")
    if sized.filter(~small).isEmpty():
        return inside
    large = cut(whole.filter(~small).select("node", "check", "text"))

    def compare(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            memo = _Hashes()
            for pdf in batches:
                ok = []
                for x, y in zip(pdf["ta"], pdf["tb"]):
                    x, y = shingles(x, memo, words), shingles(y, memo, words)
                    ok.append(jaccard(x, y) >= threshold and estimate_of(x, y, k) >= estimate)
                yield pdf.loc[ok, ["a", "b"]]

        both = estimated(pairs, ready, k, estimate, threshold).join(large.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return both.join(large.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").mapInPandas(run, "a bigint, b bigint")

    rest = linked(lists.join(large.select("node"), "node", "left_semi"), compare, rounds)
    if rest is None:
        return inside
    return inside.unionByName(rest.join(large.select("node", "check"), "node").select("node", "check", F.col("component").alias("grp")))


def kept(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """(doc_id, node, check, rows, keep_id, keep_node): each different pair of id and text, how many rows
    have it, and what is kept of its group."""
    found = cut(groups(docs, text, doc_id, **how))
    each = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("node"), F.xxhash64(F.lit(1), F.col(text)).alias("check"), F.col(text).isNotNull().alias("some")).filter("some")
    each = each.groupBy("doc_id", "node", "check").agg(F.count("*").alias("rows"))
    # a text without near copies is a group of its own, by both hashes
    named = cut(each.join(found, ["node", "check"], "left").withColumn("own", F.when(F.col("grp").isNull(), F.col("check")).otherwise(0)).withColumn("grp", F.coalesce("grp", "node")))
    first = named.groupBy("grp", "own").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))).alias("f"))
    return named.join(first, ["grp", "own"]).select("doc_id", "node", "check", "rows", F.col("f.doc_id").alias("keep_id"), F.col("f.node").alias("keep_node"))


def duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """(doc_id, kept_doc_id) for each row that is a copy, or a near copy, of a document kept.

    Texts are near copies when the Jaccard similarity of their shingles of words is at least the
    threshold; groups are linked transitively. Of a group, the document of the smallest doc_id
    stays (a null id is last; among equal ids, the smallest hash of the text).

    * Texts that are the same are always copies, also when empty or without words; texts that
      differ and have no words are no near copies. Null texts are copies of nothing.
    * Repeated rows are copies: all but one are listed, under the id that is kept.
    * Very short texts have one shingle of all their words; very long ones are read whole.
    * An empty table gives an empty table. Other columns aren't read.
    """
    rows = kept(docs, text, doc_id, **how)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("node") == F.col("keep_node"))
    gone = F.col("rows") - stays.cast("int")
    listed = rows.withColumn("i", gone).filter("i > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("i"))))
    return listed.select("doc_id", F.col("keep_id").alias("kept_doc_id"))


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """docs with one document of each group, as duplicates() has them; null texts all stay.

    Of rows alike in id and text one stays, the first in the order of the other columns. All
    columns are passed on, whatever their names.
    """
    key, nth = fresh(docs, "_key", "_nth")
    hashed = lambda d, n: F.xxhash64(F.coalesce(d.cast("string"), F.lit("\0")), n)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("node") == F.col("keep_node"))
    keys = kept(docs, text, doc_id, **how).filter(stays).select(hashed(F.col("doc_id"), F.col("node")).alias(key)).distinct()
    rows = docs.withColumn(key, F.when(F.col(text).isNotNull(), hashed(F.col(doc_id), F.xxhash64(text))))
    texts = rows.filter(F.col(text).isNotNull()).join(keys, key, "left_semi")
    rest = [c for c in docs.columns if c not in (text, doc_id)]
    order = [F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in rest])))] if rest else [F.lit(0)]
    once = texts.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(nth) == 1)
    return once.select(*docs.columns).unionByName(docs.filter(F.col(text).isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: By all texts that share a shingle; without the estimate that pairs need before they are verified.
SQL = rf"""
WITH RECURSIVE texts AS (
  SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text
), words AS (
  SELECT id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM texts
), shingles AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + {WORDS - 1}], ' ') FOR i IN range(1, len(w) - {WORDS - 2})] END) AS s FROM words WHERE len(w) > 0
), sizes AS (
  SELECT id, count(*) AS n FROM shingles GROUP BY id
), pairs AS (
  SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.id < y.id GROUP BY x.id, y.id) p
  JOIN sizes sa ON sa.id = a JOIN sizes sb ON sb.id = b WHERE p.n >= {THRESHOLD} * (sa.n + sb.n - p.n)
), links AS (
  SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), reach AS (
  SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
), kept AS (
  SELECT t.text, least(t.id, (SELECT min(other) FROM reach WHERE reach.id = t.id)) AS keep FROM texts t
)
SELECT doc_id, keep AS kept_doc_id FROM documents JOIN kept USING (text) WHERE doc_id <> keep
"""
