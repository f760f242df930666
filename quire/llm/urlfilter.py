"""URL filters by a sorted array of 64-bit digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import sharedfile
from quire.llm.common import cut, fresh, new_folder

#: Entries in a shard of the array, on average.
SHARD = 4_000_000
#: The production list: domains of known spam, adult, gambling, pharmacy and tracking sites.
DOMAINS = tuple(
    f"{site}.example.{end}" for site in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org")
)

_SPLIT = r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//)?(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, without www. and port."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _SPLIT, 1)), r"^www\.", "")


def canonical(url: Column) -> Column:
    """Host and path, without scheme, user, port, query, fragment and the path's last slashes."""
    return F.concat(host_of(url), F.regexp_replace(F.regexp_extract(F.trim(url), _SPLIT, 2), "/+$", ""))


def digests(entries: list[bytes]) -> np.ndarray:
    """xxhash64 of each, as signed numbers in the order of the unsigned ones."""
    raw = np.fromiter((xxhash.xxh64_intdigest(e) for e in entries), np.uint64, len(entries))
    return (raw ^ np.uint64(1 << 63)).view(np.int64)


class DigestArray:
    """Sorted digests and, in the same order, the strings they stand for; by range of digest."""

    def __init__(self, shards: list[tuple[int, str, str, str]]):
        self.shards = sorted(shards)

    def open(self):
        return np.array([s[0] for s in self.shards], np.int64), [tuple(map(sharedfile.get, s[1:])) for s in self.shards]

    @staticmethod
    def probe(opened, entries: list[bytes]) -> np.ndarray:
        """Which entries are there: binary search for all at once, then the strings are compared."""
        los, shards = opened
        found = np.zeros(len(entries), bool)
        if not len(los) or not entries:
            return found
        keys = digests(entries)
        where = np.searchsorted(los, keys, side="right") - 1
        for s in np.unique(where[where >= 0]):
            d, offsets, blob = shards[s]
            mine = np.flatnonzero(where == s)
            at = np.searchsorted(d, keys[mine], side="left")
            hit = (at < len(d)) & (d[np.minimum(at, len(d) - 1)] == keys[mine])
            for i, j in zip(mine[hit].tolist(), at[hit].tolist()):
                while j < len(d) and d[j] == keys[i]:
                    if blob[offsets[j] : offsets[j + 1]].tobytes() == entries[i]:
                        found[i] = True
                        break
                    j += 1
        return found


def build(entries: DataFrame, entry: str = "entry", shard: int = SHARD) -> DigestArray:
    """The array of all different entries that aren't null or empty, in the shared folder."""
    folder = new_folder(entries.sparkSession, "digests")

    def digest(batch: pd.Series) -> pd.Series:
        return pd.Series(digests([x.encode() for x in batch]))

    rows = entries.select(F.col(entry).alias("entry")).filter("entry <> ''").distinct()
    rows = cut(rows.withColumn("d", F.pandas_udf(digest, "bigint")("entry")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            pdf = pd.concat(held)
            d, raw = pdf["d"].to_numpy(np.int64), [x.encode() for x in pdf["entry"]]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
            parts = ("d", d), ("o", offsets), ("s", np.frombuffer(b"".join(raw), np.uint8))
            at = [sharedfile.put(folder, f"{name}{int(d[0]) + (1 << 63):016x}", a) for name, a in parts]
            yield pd.DataFrame([(int(d[0]), *at)], columns=["lo", "d", "o", "s"])

    n = max(1, -(-rows.count() // shard))
    made = rows.repartitionByRange(n, "d").sortWithinPartitions("d", "entry").mapInPandas(write, "lo bigint, d string, o string, s string")
    return DigestArray([tuple(r) for r in made.collect()])


def match(pages: DataFrame, blocked: DigestArray, url: str = "url") -> DataFrame:
    """pages with matched: the entry that blocks the URL, or null.

    Entries are canonical URLs or hosts; a host blocks its subdomains too. The most specific entry
    is given: the URL itself, then the host, then its parents of two labels or more.

    * A null, blank or hostless URL matches nothing. Letters of the host are compared in lower
      case, those of the path as they are.
    * Very long URLs are hashed and compared whole. Equal digests of different strings are told
      apart by the strings.
    * Rows, repeated ones too, are kept one by one with all columns; if there is a column matched,
      the new one is _matched. An empty table or list gives no match.
    """
    (name,) = fresh(pages, "matched")
    host, whole = fresh(pages, "_host", "_whole")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        opened = blocked.open()
        for hosts, wholes in batches:
            probes: list[str] = []
            owner: list[int] = []
            for i, (h, w) in enumerate(zip(hosts, wholes)):
                if not h:
                    continue
                labels = h.split(".")
                tries = [w, h] if w != h else [h]
                tries += [".".join(labels[k:]) for k in range(1, len(labels) - 1)]
                probes += tries
                owner += [i] * len(tries)
            found = DigestArray.probe(opened, [p.encode() for p in probes])
            out: list[str | None] = [None] * len(hosts)
            for k in np.flatnonzero(found)[::-1].tolist():  # the first of a page's is written last
                out[owner[k]] = probes[k]
            yield pd.Series(out, dtype=object)

    udf = F.pandas_udf(run, "string")
    with_keys = pages.withColumns({host: host_of(F.col(url)), whole: canonical(F.col(url))})
    return with_keys.withColumn(name, udf(host, whole)).select(*pages.columns, name)


def url_filter(pages: DataFrame, blocked: DigestArray, url: str = "url") -> DataFrame:
    """The pages that no entry blocks; cases as in match()."""
    (name,) = fresh(pages, "matched")
    return match(pages, blocked, url).filter(F.col(name).isNull()).select(*pages.columns)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    blocked = build(spark.createDataFrame([(d,) for d in DOMAINS], "entry string"))
    return match(pages.select("page_id", "url"), blocked).withColumn("blocked", F.col("matched").isNotNull())


_LIST = ", ".join(f"('{d}')" for d in DOMAINS)
SQL = rf"""
WITH parts AS (
  SELECT page_id, url, regexp_replace(lower(regexp_extract(trim(url), '{_SPLIT}', 1)), '^www\.', '') AS host,
         regexp_replace(regexp_extract(trim(url), '{_SPLIT}', 2), '/+$', '') AS path
  FROM pages
), entries AS (
  SELECT * FROM (VALUES {_LIST}) AS v(entry)
), probes AS (
  SELECT page_id, url, 0 AS k, host || path AS probe FROM parts
  UNION ALL
  SELECT page_id, url, 1 + i, array_to_string(string_split(host, '.')[1 + i:], '.')
  FROM (SELECT page_id, url, host, unnest(range(greatest(1, len(string_split(host, '.')) - 1))) AS i FROM parts WHERE host <> '')
), best AS (
  SELECT page_id, url, arg_min(probe, k) AS matched FROM probes WHERE probe IN (SELECT entry FROM entries) GROUP BY page_id, url
)
SELECT p.page_id, p.url, b.matched, b.matched IS NOT NULL AS blocked
FROM pages p LEFT JOIN best b ON p.page_id = b.page_id AND p.url = b.url
"""
