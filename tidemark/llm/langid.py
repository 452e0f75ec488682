"""Language identification by interpolated Kneser-Ney character models.

Words are runs of letters in lower case, padded with ORDER - 1 spaces before and one behind. Counting
the n-grams of a bounded sample (SAMPLE_DOCS whole texts per language, chosen by a hash of the id) is a
Spark aggregation; the discounted probabilities and the back-off weights of all languages are
kept per order in one sorted array of 64-bit n-gram hashes, searched by bisection, with the languages that have
each n-gram. Every language is learned; beyond 100 of them they share the sample. A text's cross-entropy
in a language is its words' negative log probability over the number of characters predicted; the
language with the lowest wins. Its score is a softmax whose temperature was fitted on whole texts that weren't
counted; `rejected` says that the cross-entropy is beyond what the language's texts of these had (with few of them:
beyond both these and the texts of all languages). Languages of under LEAST_ROWS rows are counted whole in the end; their
texts for the fit are scored by a model that was counted without them. If no text can be left out, the temperature
is 1 and nothing is rejected.

Null texts and texts without a letter: `und`, score 0, not scored. Ties: the first language by name. Without labelled
rows nothing is learned and every text is `und`. Repeated rows each return a row. An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_text_batches, table

ORDER = 5
PAD = " " * (ORDER - 1)
#: Whole texts per language that are counted, about, and of all languages together (one of each at least).
SAMPLE_DOCS, SAMPLE_ALL = 1500, 150_000
#: Whole texts per language that temperature and rejection are fitted on, one for ten of the sample; rows from which
#: a language's aren't counted, and texts from which its limit is its own.
FIT_DOCS, LEAST_ROWS, OWN_LIMIT = 150, 30, 100
TEMPERATURES = np.geomspace(0.02, 2, 24)
WORD = re.compile(r"[^\W\d_]+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
OUT = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"


def _hashes(points: np.ndarray) -> list[np.ndarray]:
    """For k of 1 to ORDER, the hashes of the k-grams that end at each place (those before the start: wrapped)."""
    out, h = [], np.zeros(len(points), dtype=np.uint64)
    c = points.astype(np.uint64) + np.uint64(1)
    for k in range(ORDER):
        h = h + np.roll(c, k) * _MULTIPLIERS[k]
        out.append((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
    return out


def _points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(f"{PAD}{w} " for w in words).encode("utf-32-le"), dtype=np.uint32)


def _gram_hashes(grams: pd.Series) -> np.ndarray:
    """Hashes of n-grams of one length."""
    k = len(grams.iat[0])
    p = np.frombuffer("".join(grams).encode("utf-32-le"), dtype=np.uint32)
    return _hashes(p)[k - 1][k - 1 :: k]


class Rows:
    """Rows of values of languages, the most of them missing; the row after the last has none."""

    def __init__(self, row: np.ndarray, lang: np.ndarray, value: np.ndarray, rows: int, langs: int, missing: float):
        order = np.argsort(row, kind="stable")
        self.lang, self.value = lang[order].astype(np.int32), value[order].astype(np.float32)
        self.ends = np.append(np.cumsum(np.bincount(row, minlength=rows)), len(row))
        self.langs, self.missing = langs, np.float32(missing)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        start = np.where(at, self.ends[at - 1], 0)
        n = self.ends[at] - start
        out = np.full(len(at) * self.langs, self.missing, dtype=np.float32)
        entry = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[np.repeat(np.arange(len(at)) * self.langs, n) + self.lang[entry]] = self.value[entry]
        return out.reshape(len(at), self.langs)


class Model:
    """For each order: sorted hashes of n-grams with discounted probabilities, and of contexts with back-off weights."""

    def __init__(self, counts: pd.DataFrame):
        """counts: lang, gram (ORDER characters), n."""
        self.langs = sorted(counts["lang"].unique())
        self.tables: list[tuple[np.ndarray, Rows, np.ndarray, Rows]] = []
        grams, self.uniform = counts, np.float32(1 / 256)
        for k in range(ORDER, 0, -1):
            found, weights = [], []
            for i, (_, g) in enumerate(grams.groupby("lang", sort=True)):
                n = g["n"].to_numpy(float)
                ones, twos = (n == 1).sum(), (n == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                context = g["gram"].str[:-1]
                total = g.groupby(context)["n"].agg(["sum", "size"])
                of = total["sum"].reindex(context).to_numpy(float)
                found.append(pd.DataFrame({"gram": g["gram"].to_numpy(), "lang": i, "v": (n - d) / of}))
                weights.append(pd.DataFrame({"gram": total.index, "lang": i, "v": (d * total["size"] / total["sum"]).to_numpy()}))
            self.tables.append((*self._sorted(pd.concat(found), 0.0), *self._sorted(pd.concat(weights), 1.0)))
            # The order below counts distinct characters before, or plain occurrences at a word's start.
            below = grams.assign(gram=grams["gram"].str[1:])
            below["m"] = np.where(below["gram"].str.startswith(" ") & (below["gram"].str.len() > 1), below["n"], 1)
            grams = below.groupby(["lang", "gram"], as_index=False)["m"].sum().rename(columns={"m": "n"}) if k > 1 else grams
        self.tables.reverse()
        self.temperature, self.limit = 1.0, np.full(len(self.langs), np.inf)

    def _sorted(self, rows: pd.DataFrame, missing: float) -> tuple[np.ndarray, Rows]:
        grams = pd.Index(rows["gram"].unique())
        h = np.zeros(1, dtype=np.uint64) if grams[0] == "" else _gram_hashes(pd.Series(grams))
        order = np.argsort(h)
        place = np.argsort(order)[grams.get_indexer(rows["gram"])]
        return h[order], Rows(place, rows["lang"].to_numpy(), rows["v"].to_numpy(), len(grams), len(self.langs), missing)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, len(keys))

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities, a row per word and a column per language."""
        points = _points(words)
        hashes = _hashes(points)
        length = np.array([len(w) + ORDER for w in words])
        ends = np.cumsum(length)
        predicted = np.ones(len(points), dtype=bool)
        for k in range(ORDER - 1):
            predicted[ends - length + k] = False
        p = np.full((int(predicted.sum()), len(self.langs)), self.uniform, dtype=np.float32)
        for k, (keys, values, contexts, weights) in enumerate(self.tables):
            own = self._find(keys, hashes[k][predicted])
            before = self._find(contexts, np.roll(hashes[k - 1], 1)[predicted]) if k else np.zeros(len(p), dtype=np.int64)
            p = values[own] + weights[before] * p
        steps = length - (ORDER - 1)
        return np.add.reduceat(np.log(p), np.concatenate([[0], np.cumsum(steps)[:-1]]), axis=0)


class Scorer:
    """score(texts) with words' log probabilities kept from batch to batch."""

    def __init__(self, model: Model, most: int = 300_000):
        n = max(1, len(model.langs))
        self.model, self.most, self.chunk = model, min(most, 20_000_000 // n), max(100, min(50_000, 200_000 // n))
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.langs)), dtype=np.float32)

    def totals(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, int] | None]:
        """Log probabilities by language and characters predicted of each text; None without a letter."""
        cut = [WORD.findall(t.lower()) if t else [] for t in texts]
        cut = [w if any(c.isalpha() for x in w for c in x) else [] for w in cut]
        if not self.model.langs:
            yield from [None] * len(texts)
            return
        if len(self.seen) > self.most:
            self._clear()
        new = list({x for w in cut for x in w if x not in self.seen})
        parts = [self.rows]
        for at in range(0, len(new), self.chunk):
            some = new[at : at + self.chunk]
            self.seen.update(zip(some, range(len(self.seen), len(self.seen) + len(some))))
            parts.append(self.model.words(some))
        self.rows = np.concatenate(parts) if new else self.rows
        for w in cut:
            if not w:
                yield None
                continue
            codes = np.fromiter(map(self.seen.__getitem__, w), dtype=np.int64, count=len(w))
            yield self.rows[codes].sum(axis=0, dtype=np.float64), sum(map(len, w)) + len(w)

    def score(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        out = []
        for got in self.totals(texts):
            if got is None:
                out.append(("und", 0.0, None, True))
                continue
            total, chars = got
            best = int(np.argmax(total))
            e = np.exp(self.model.temperature * (total - total[best]))
            ce = -total[best] / chars
            out.append((self.model.langs[best], float(1 / e.sum()), float(ce), bool(ce > self.model.limit[best])))
        return out


def train(labelled: DataFrame) -> Model:
    """labelled: doc_id, text, lang. A bounded sample is counted in Spark; n-gram counts of that come to the driver."""
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return _empty()
    most = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // len(sizes)))
    fit_most = max(1, min(FIT_DOCS, SAMPLE_ALL // 10 // len(sizes)))
    share = lambda m, n: min(1_000_000, -(-m * 1_000_000 // n))
    drawn = [(r["lang"], r["count"] < LEAST_ROWS, share(most, r["count"]), share(10 * fit_most, r["count"])) for r in sizes]
    of = labelled.sparkSession.createDataFrame(drawn, "lang string, rare boolean, counted int, fitted int")
    labelled = labelled.join(F.broadcast(of), "lang")
    at = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(n))
    left = at("calibrate", 10) == 0
    final = _counted(labelled.where((at("count", 1_000_000) < F.col("counted")) & (~left | F.col("rare"))))
    without = _counted(labelled.where((at("count", 1_000_000) < F.col("counted")) & ~left)) if any(rare for _, rare, _, _ in drawn) else final
    if final is None or without is None:
        return final or _empty()
    _calibrate(final, without, labelled.where(left & (at("snippets", 1_000_000) < F.col("fitted"))))
    return final


def _empty() -> Model:
    empty = Model.__new__(Model)
    empty.langs, empty.tables, empty.temperature, empty.limit = [], [], 1.0, np.zeros(0)
    return empty


def _counted(rows: DataFrame) -> Model | None:
    """The model of all rows; None if they have no letter."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("w")
    w = rows.select("lang", word).groupBy("lang", "w").count()
    w = w.select("lang", "count", F.concat(F.lit(PAD), "w", F.lit(" ")).alias("w"))
    grams = w.select("lang", "count", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - ORDER + 1), lambda i: F.substring("w", i, F.lit(ORDER)))).alias("gram"))
    counts = grams.groupBy("lang", "gram").agg(F.sum("count").alias("n")).toPandas()
    counts = counts[counts["gram"].str.len() == ORDER]
    return Model(counts) if len(counts) else None


def _calibrate(model: Model, by: Model, held: DataFrame) -> None:
    """Temperature and limits of model, from whole texts (text, lang) that `by` has not counted."""
    shared = held.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        at = {x: i for i, x in enumerate(scorer.model.langs)}
        for b in batches:
            out = []
            for lang, got in zip(b.column(1).to_pylist(), scorer.totals(b.column(0).to_pylist())):
                if got is not None and lang in at:
                    z = got[0] - got[0].max()
                    out.append((lang, -got[0].max() / got[1], [float(np.log(np.exp(t * z).sum()) - t * z[at[lang]]) for t in TEMPERATURES]))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.float64(), pa.list_(pa.float64())])], names=["lang", "ce", "loss"])

    got = in_text_batches(held.select("text", "lang")).mapInArrow(run, "lang string, ce double, loss array<double>").toArrow().to_pandas()
    if not len(got):
        return
    model.temperature = float(TEMPERATURES[int(np.argmin(np.mean(np.stack(got["loss"]), axis=0)))])
    pooled, own = np.quantile(got["ce"], 0.995), dict(tuple(got.groupby("lang")["ce"]))
    for i, lang in enumerate(model.langs):
        ce = own.get(lang, [])
        model.limit[i] = np.quantile(ce, 0.995) if len(ce) >= OWN_LIMIT else max([pooled, *ce])


def held_out(of: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == rest, F.lit(False))



def predict(documents: DataFrame, model: Model, held: Column) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                got = list(zip(*scorer.score(some.column(2).to_pylist())))
                types = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *[pa.array(c, t) for c, t in zip(got, types)]], names=[c.split()[0] for c in OUT.split(", ")])

    return in_text_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, OUT)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, held = table(spark, sf_dir, "documents"), held_out(4, 2)
    return predict(d, train(d.where(~held)), held)
