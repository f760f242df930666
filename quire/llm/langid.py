"""Language ID by word-first backoff."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import fresh, shared

#: The bound on different labelled texts that the model is fitted on, for each language.
SAMPLE = 400
#: Longest n-gram that an unseen word falls back to.
MAX_N = 5
#: A word counts as known when the sample has it at least so often.
MIN_COUNT = 2
#: A document is accepted when the best language leads by so many nats a word, and ...
MIN_MARGIN = 0.02
#: ... so large a share of its characters other than blanks are letters.
MIN_LETTERS = 0.2

#: Nats that a change of language within a text costs, and the doubt that the claim is wrong: odds of 1000 to 1.
CHANGE = log(1000)
#: A claim is refuted when more than this share of the words is in runs of other languages, and ...
MOST = 0.5
#: ... another language leads over the whole text by so many nats a word; at 0 the words alone decide.
REFUTES = 0.0

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Backoff:
    """Per-language log frequencies of words, and of the n-grams of words for those not known.

    An unseen word, between two marks, is read from left to right: the longest n-gram known at the
    place scores with its log frequency per language and is passed over; a character not known at
    all scores nothing.
    """

    def __init__(self, counts: dict[str, Counter], max_n: int = MAX_N, min_count: int = MIN_COUNT):
        self.langs = sorted(counts)
        self.max_n = max_n
        words = sorted({w for c in counts.values() for w in c})
        table = np.array([[counts[g][w] for g in self.langs] for w in words], dtype=np.float64).reshape(len(words), len(self.langs))
        known = table.sum(1) >= min_count
        self.words = {w: i for i, w in enumerate(np.array(words, dtype=object)[known])}
        self.word_logs = self._logs(table[known], table.sum(0))
        grams: Counter = Counter()
        for g in self.langs:
            for w, n in counts[g].items():
                m = f"\x02{w}\x03"
                for k in range(1, max_n + 1):
                    for i in range(len(m) - k + 1):
                        grams[m[i : i + k], g] += n
        names = sorted({m for m, _ in grams})
        gt = np.array([[grams.get((m, g), 0) for g in self.langs] for m in names], dtype=np.float64).reshape(len(names), len(self.langs))
        sizes = np.array([len(m) for m in names], dtype=np.int64)
        logs = np.zeros_like(gt)
        for k in range(1, max_n + 1):
            at = sizes == k
            logs[at] = self._logs(gt[at], gt[at].sum(0))
        keep = gt.sum(1) >= min_count
        self.grams = {m: i for i, m in enumerate(np.array(names, dtype=object)[keep])}
        self.gram_logs = logs[keep]

    @staticmethod
    def _logs(table: np.ndarray, totals: np.ndarray) -> np.ndarray:
        return np.log((table + 0.5) / (totals + 0.5 * max(1, len(table))))

    def word(self, w: str) -> np.ndarray:
        if (i := self.words.get(w)) is not None:
            return self.word_logs[i]
        m, i, used, grams = f"\x02{w}\x03", 0, [], self.grams
        while i < len(m):
            for k in range(min(self.max_n, len(m) - i), 0, -1):
                if (j := grams.get(m[i : i + k])) is not None:
                    used.append(j)
                    i += k
                    break
            else:
                i += 1
        return self.gram_logs[used].sum(0) if used else np.zeros(len(self.langs))


def sample_of(docs: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """At most sample different labelled texts of each language, those of the least hashes; all where there are fewer."""
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    hashed = labelled.withColumn("h", F.xxhash64("text", "lang"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = hashed.select("lang", "h").distinct().withColumn("r", first).filter(F.col("r") <= sample)
    taken = F.lit(False)
    for r in least.groupBy("lang").agg(F.max("h").alias("h")).collect():
        taken = F.when(F.col("lang") == r.lang, F.col("h") <= r.h).otherwise(taken)
    return hashed.filter(taken).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE) -> Backoff:
    """A model of the languages that label rows of docs; see sample_of() for the bound."""

    def count(batches):
        for pdf in batches:
            total: dict[str, Counter] = {}
            for g, t in zip(pdf.lang, pdf.text):
                total.setdefault(g, Counter()).update(words_of(t))
            rows = [(g, w, n) for g, c in total.items() for w, n in c.items()]
            yield pd.DataFrame(rows, columns=["lang", "word", "n"])

    counts: dict[str, Counter] = {}
    found = sample_of(docs, lang, text, sample).mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for r in found.toLocalIterator():
        counts.setdefault(r.lang, Counter())[r.word] = r.n
    return Backoff(counts)


def against(scores: np.ndarray, claim: int, change: float = CHANGE) -> float:
    """The share of words, one a row of scores, in runs of other languages than the claimed column.

    The runs are those of the likeliest path: it starts in the claim, each change of language costs
    change nats, and of equal paths the one that stays or ends in the claim is taken.
    """
    n, k = scores.shape
    best, stay = np.full(k, -change), np.arange(k)
    best[claim] = 0
    came = np.empty((n, k), np.int32)
    for i in range(n):
        top = int(np.argmax(best))
        moved = best < best[top] - change
        came[i] = np.where(moved, top, stay)
        best = np.where(moved, best[top] - change, best) + scores[i]
    at = claim if best[claim] >= best.max() else int(np.argmax(best))
    other = 0
    for i in range(n - 1, -1, -1):
        other += at != claim
        at = int(came[i, at])
    return other / n


def identify(docs: DataFrame, model: Backoff, text: str = "text", min_margin: float = MIN_MARGIN, min_letters: float = MIN_LETTERS) -> DataFrame:
    """docs with language, margin (nats a word before the second language) and accepted.

    The whole text is scored. language is UNKNOWN, the margin 0 and accepted false when a text is
    null, empty or without letters, and when the model knows no language; with one language known
    the margin is that language's lead over nothing, infinite. Ties go to the language first by
    name. Rows, repeated ones and null ids too, are kept one by one; where docs has columns of
    these names, the new ones have underscores before them. An empty table gives an empty table.
    """
    names = fresh(docs, "language", "margin", "accepted")
    (found,) = fresh(docs, "_found")
    out = docs.withColumn(found, _scored(docs, model, F.col(text), F.lit(None).cast("string"), min_margin, min_letters))
    return out.select(*docs.columns, *[F.col(f"{found}.{c}").alias(n) for c, n in zip(("language", "margin", "accepted"), names)])


def _scored(docs: DataFrame, model: Backoff, text: Column, claim: Column, min_margin: float, min_letters: float) -> Column:
    """language, margin and accepted of identify(), and against() of a claim that isn't the language
    found; 0 where it is, is null or isn't known to the model."""
    share = shared(docs.sparkSession, model)  # bounded by the sample, not by docs
    none = (UNKNOWN, 0.0, False, 0.0)

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = share()
        memo: dict[str, int] = {}
        table, used = np.zeros((1 << 12, len(model.langs))), 0

        def row(t, claim) -> tuple:
            nonlocal table, used
            if t is None or not model.langs:
                return none
            words = words_of(t)
            tally = Counter(words)
            if not tally:
                return none
            if len(memo) > 400_000:
                memo.clear()
                used = 0
            for w in [w for w in tally if w not in memo]:
                if used == len(table):
                    table = np.concatenate([table, np.zeros_like(table)])
                table[used] = model.word(w)
                memo[w] = used
                used += 1
            ids = np.fromiter(map(memo.__getitem__, tally), np.int64, len(tally))
            n = np.fromiter(tally.values(), np.float64, len(tally))
            total = n @ table[ids]
            best = int(np.argmax(total))
            margin = float((total[best] - np.delete(total, best).max()) / n.sum()) if len(total) > 1 else float("inf")
            letters = sum(len(w) * c for w, c in tally.items()) / max(1, len("".join(t.split())))
            other = 0.0
            if claim in known and claim != model.langs[best]:
                other = against(table[np.fromiter(map(memo.__getitem__, words), np.int64, len(words))], known[claim])
            return model.langs[best], margin, bool(margin >= min_margin and letters >= min_letters), other

        known = {g: i for i, g in enumerate(model.langs)}
        for texts, claims in batches:
            rows = [row(t, c) for t, c in zip(texts, claims)]
            yield pd.DataFrame(rows, columns=["language", "margin", "accepted", "against"])

    return F.pandas_udf(score, "language string, margin double, accepted boolean, against double")(text, claim)


def language_filter(
    docs: DataFrame, model: Backoff | None = None, lang: str = "lang", refutes: float = REFUTES, most: float = MOST, text: str = "text",
    min_margin: float = MIN_MARGIN, min_letters: float = MIN_LETTERS,
) -> DataFrame:
    """The documents whose language is found, and doesn't refute the one they claim.

    A claim is refuted when another language is found, leads by refutes or more, and more than the
    share most of the words is in runs of other languages; see against(). So a document that holds
    a passage of another language is kept under its claim, and so is a short text without the evidence
    to outweigh the claim; one mostly of another language goes. A null claim agrees with any
    language; so does one of a language that the model doesn't know. Cases are those of identify();
    columns stay as they are.
    """
    model = train(docs) if model is None else model
    (found,) = fresh(docs, "_found")
    out = docs.withColumn(found, _scored(docs, model, F.col(text), F.col(lang), min_margin, min_letters))
    refuted = (F.col(f"{found}.margin") >= refutes) & (F.col(f"{found}.against") > most)
    return out.filter(F.col(f"{found}.accepted") & ~refuted).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    found = identify(docs.select("doc_id", "text", "lang"), model)
    return found.select("doc_id", "lang", "language", F.round("margin", 6).alias("margin"), "accepted")
