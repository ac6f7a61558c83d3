"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are joined as log likelihoods: the text (letter trigrams, naive Bayes), the language that the
markup declares, the address suffix, and the host. Suffix and host act as one prior, smoothed down a hierarchy: all
rows, then suffix, domain and host, each level's counts adding to PULL rows' worth of the level above. Counts are
sums of the rows' own text posteriors, made by grouped aggregation over all rows; a row is left out of the
counts it is judged by. A text counts as TEXT_WEIGHT trigrams at most, since its trigrams aren't independent.

The trigram model knows every language that MIN_LABELS rows or more of the whole table are labelled with. It is fitted on
a bounded sample of each: TRAIN_ROWS rows in all, dealt out evenly (what a small language leaves goes to the others),
LEAST_ROWS of a language if it has them, in order of a hash of id and text, equal rows once, TRAIN_CHARS characters of
each. Scores, counts and decisions cover all rows and whole texts.

A row is rejected if it has no letters, if no language reaches MIN_PROBABILITY, or if its text lies below the floor of
the language it would get, in its mean log probability by trigram: FLOOR_SHARE of the way
(FLOOR_GAP at least) from what the language's sample shows, each half scored by a model of the other, down to what the
sample's letters show in random order, and lower by the standard error of a mean of so few trigrams. Probabilities among the model's languages alone can't tell that a text is in none
of them. The rule is one for all sizes; texts that are far from all that was labelled go, even if a reader would know their language.

Defined cases: a null or empty text has no letters and is rejected, with a null language; a null host has the
prior of all rows; a declared language that the model doesn't know is no evidence; without any labelled row nothing
can be told, and every row comes back kept, with a null language; ids pass through and may be null or repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, small_batches, text_or_empty

TRAIN_ROWS, LEAST_ROWS, TRAIN_CHARS, MIN_LABELS = 4_000, 100, 3_000, 5
TEXT_WEIGHT, PULL, MIN_PROBABILITY = 200, 5.0, 0.5
FLOOR_SHARE, FLOOR_GAP = 0.6, 1.5
HASH_BITS = 17

# Letters in lower case, every other ASCII character as a space; bytes of other scripts stay.
_LETTERS = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
_MARKUP = re.compile(rb"<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", re.I | re.S)


def trigrams(text: bytes) -> np.ndarray:
    """The hashed trigrams of a text's letters, words separated by one space."""
    raw = np.frombuffer(b" " + b" ".join(text.translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return (code * np.uint32(2654435761) >> np.uint32(32 - HASH_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # by trigram: its log probability in each language
    floor: np.ndarray  # by language: the least mean log probability of a long text that may be in it
    spread: np.ndarray  # by language: the standard deviation of a trigram's log probability
    weight: int = TEXT_WEIGHT  # a text's evidence counts as that of so many trigrams at most, which depend on one another

    def score(self, text: bytes) -> tuple[np.ndarray, int]:
        """The text's log likelihoods and its number of trigrams."""
        t = trigrams(text)
        return self.table.take(t, axis=0).sum(axis=0, dtype=np.float64), len(t)

    def plausible(self, s: np.ndarray, size: int) -> np.ndarray:
        """By language, whether a text with these log likelihoods may be in it."""
        return s >= self.floor * size - self.spread * size**0.5


def _counts(texts: list[bytes]) -> np.ndarray:
    out = np.zeros(1 << HASH_BITS)
    for text in texts:
        out += np.bincount(trigrams(text), minlength=1 << HASH_BITS)
    return out


def _logs(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts + 0.5).sum())


def _floor(texts: list[bytes], halves: list[np.ndarray], logs: np.ndarray) -> tuple[float, float]:
    """The floor and spread of a language from its sample; one without letters has no floor that a text could reach."""
    if not (n := sum(halves).sum()):
        return np.inf, 0.0
    own, square = (sum((halves[i] * _logs(halves[1 - i]) ** e).sum() for i in (0, 1)) / n for e in (1, 2))
    letters = np.frombuffer(b" ".join(b" ".join(t.translate(_LETTERS).split()) for t in texts), np.uint8)
    noise = _counts([np.random.default_rng(0).permutation(letters).tobytes()])
    return own - max(FLOOR_SHARE * (own - (noise * logs).sum() / noise.sum()), FLOOR_GAP), max(0.0, square - own**2) ** 0.5


def fit(rows: list[tuple[str, bytes]]) -> Model:
    """A naive Bayes model of (language, text) rows."""
    kinds = sorted({k for k, _ in rows})
    table, floor, spread = np.empty((1 << HASH_BITS, len(kinds)), np.float32), np.empty(len(kinds)), np.empty(len(kinds))
    for i, k in enumerate(kinds):
        texts = [t for x, t in rows if x == k]
        halves = [_counts(texts[::2]), _counts(texts[1::2])]
        table[:, i] = logs = _logs(sum(halves))
        floor[i], spread[i] = _floor(texts, halves, logs)
    return Model(tuple(kinds), table, floor, spread)


def shares(sizes: dict[str, int]) -> dict[str, int]:
    """How many of each language's rows the sample takes: TRAIN_ROWS in all, the smallest languages dealt out first."""
    out, left = {}, TRAIN_ROWS
    for i, k in enumerate(sorted(sizes, key=sizes.get)):
        out[k] = min(sizes[k], max(LEAST_ROWS, left // (len(sizes) - i)))
        left -= out[k]
    return out


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """The model of a bounded sample of each language's rows (see above).

    Rows are chosen by hashes under a bound for their language, with some to spare, so that no task sends many more
    texts to the driver than the sample holds.
    """
    some = labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    some = some.select(F.col(label_col).cast("string").alias("k"), F.col(text_col).cast("string").alias("t"), F.xxhash64(id_col, text_col).alias("o"))
    counted = some.groupBy("k").agg(F.count("*").alias("n"), F.approx_count_distinct("o").alias("d")).filter(F.col("n") >= MIN_LABELS).collect()
    sizes = {r["k"]: r["d"] for r in counted}
    if not sizes:
        return fit([])
    take = shares(sizes)
    bound = {k: (1 << 63) - 1 if sizes[k] <= 2 * n else int(1.5 * n / sizes[k] * (1 << 64)) - (1 << 63) for k, n in take.items()}
    bounds = F.create_map(*(F.lit(x) for k, o in bound.items() for x in (k, o)))
    near = some.filter(F.col("o") <= F.element_at(bounds, F.col("k"))).groupBy("k", "o").agg(F.min(F.substring("t", 1, TRAIN_CHARS)).alias("t"))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in near.collect():
        found.setdefault(r["k"], []).append((r["o"], r["t"]))
    return fit([(k, t.encode()) for k, rows in sorted(found.items()) for _, t in sorted(rows)[: max(take[k], LEAST_ROWS)]])


def _score(model: Model, strip: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.languages)
        for b in batches:
            evidence, own, found, plausible = [], [], [], []
            for text in pc.cast(b["text"], pa.binary()).to_pylist():
                s, size = model.score(_MARKUP.sub(b" ", text) if strip else text)
                plausible.append(model.plausible(s, size))
                s = s * min(1.0, model.weight / max(size, 1))
                s -= s.max(initial=-np.inf) if n else 0.0
                p = np.exp(s)
                evidence.append(s)
                own.append(p / p.sum() if size else np.full(n, 1 / max(n, 1)))
                found.append(size)
            offsets = pa.array(np.arange(b.num_rows + 1) * n, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else [], k)) for x, k in ((evidence, pa.float64()), (own, pa.float64()), (plausible, pa.bool_()))]
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.record_batch([*(b[c] for c in rest), *lists, pa.array(found, pa.int64())], names=[*rest, "evidence", "own", "plausible", "n"])

    return run


def scored(rows: DataFrame, model: Model, strip: bool = False) -> DataFrame:
    """Frames of (…, text, markup, host) with the text replaced by its scores."""
    small_batches(rows.sparkSession)
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(_score(model, strip), f"{rest}, evidence array<double>, own array<double>, plausible array<boolean>, n long")


def fuse(rows: DataFrame, model: Model) -> DataFrame:
    """Scored rows with language, probability and kept."""
    langs = model.languages
    rest = [c for c in rows.columns if c not in ("evidence", "own", "plausible", "n", "markup", "host")]
    if not langs:
        return rows.select(*rest, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), F.lit(True).alias("kept"))
    ks = range(len(langs))
    rows = rows.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+|[^.]+)$", 1)).withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1))
    declared = F.array_position(F.array(*map(F.lit, langs)), F.lower("markup"))  # 0: not a language of the model
    letters = F.col("n") > 0
    hosts = durable(rows.filter(letters & F.col("host").isNotNull()).groupBy("host", "domain", "suffix").agg(*(F.sum(F.col("own")[k]).alias(f"host_{k}") for k in ks)), "host-counts")
    level = lambda name: hosts.groupBy(name).agg(*(F.sum(f"host_{k}").alias(f"{name}_{k}") for k in ks))
    priors = hosts.join(level("domain"), "domain").join(level("suffix"), "suffix").drop("domain", "suffix")
    # One row of totals for the driver: the rows' languages, and how far declarations agree with the texts.
    said = letters & (declared > 0)
    totals = rows.agg(*(F.sum(F.when(letters, F.col("own")[k])).alias(f"all_{k}") for k in ks), F.sum(F.when(said, F.get("own", declared.cast("int") - 1))).alias("agree"), F.count_if(said).alias("said")).first()
    whole = [totals[f"all_{k}"] or 0.0 for k in ks]
    trust = min(0.99, max(0.5, ((totals["agree"] or 0.0) + 9) / (totals["said"] + 10)))

    def prior(k: int) -> Column:
        own = F.when(letters, F.col("own")[k]).otherwise(0.0)
        out = (F.lit(whole[k]) - own + 1.0) / F.lit(sum(whole) + len(langs))
        for name in ("suffix", "domain", "host"):
            n = sum((F.coalesce(f"{name}_{j}", F.lit(0.0)) for j in ks), F.lit(0.0))
            out = (F.greatest(F.coalesce(f"{name}_{k}", own) - own, F.lit(0.0)) + PULL * out) / (F.greatest(n - letters.cast("double"), F.lit(0.0)) + PULL)
        return out

    def markup(k: int) -> Column:
        other = (1 - trust) / max(1, len(langs) - 1)
        return F.when(declared == k + 1, F.log(F.lit(trust))).when(declared > 0, F.log(F.lit(max(other, 1e-9)))).otherwise(0.0)

    # Rows without a host find nothing; they are spread over keys that no host has, so that they don't share a task.
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("rid", *(c for c in ("doc_id", "page_id", "id") if c in rows.columns)), F.lit(4096)).cast("string")) if "rid" in rows.columns else F.col("host")
    joined = rows.withColumn("at", F.coalesce("host", spread)).join(priors.withColumnRenamed("host", "at"), "at", "left").drop("at")
    joined = joined.withColumn("score", F.array(*(F.col("evidence")[k] + markup(k) + F.log(prior(k)) for k in ks)))
    joined = joined.withColumn("best", (F.array_position("score", F.array_max("score")) - 1).cast("int"))
    joined = joined.withColumn("probability", 1 / F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("score"))))
    kept = letters & (F.col("probability") >= MIN_PROBABILITY) & F.get("plausible", F.col("best"))
    return joined.select(*rest, F.when(letters, F.get(F.array(*map(F.lit, langs)), F.col("best"))).alias("language"), "probability", kept.alias("kept"))


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents as rows to score: their source stands for a host, and nothing declares a language."""
    text = text_or_empty("text")
    host = F.when(F.col("source").isNotNull(), F.lower(F.col("source").cast("string")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.xxhash64(text).alias("rid"), F.lit(None).cast("string").alias("markup"), host.alias("host"), text.alias("text"))


def of_pages(pages: DataFrame) -> DataFrame:
    text = text_or_empty("html")
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    declared = F.regexp_extract("html", r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1)
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.xxhash64(text).alias("rid"), F.nullif(declared, F.lit("")).alias("markup"), F.nullif(host, F.lit("")).alias("host"), text.alias("text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page with its language; documents carry doc_id, pages page_id."""
    docs = documents(spark, sf_dir)
    model = train(docs)
    rows = scored(of_documents(docs), model).unionByName(scored(of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), model, strip=True))
    return fuse(durable(rows, "scores"), model).drop("rid")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is known, with all their columns."""
    model = train(docs)
    known = fuse(durable(scored(of_documents(docs), model), "scores"), model).filter("kept").select(F.col("doc_id").alias("id"), "rid")
    same = docs["doc_id"].eqNullSafe(known["id"]) & (F.xxhash64(text_or_empty("text")) == known["rid"])
    return docs.join(known, same, "left_semi")
