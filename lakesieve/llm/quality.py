"""Quality rules: gradient-boosted trees over document statistics, flattened into node arrays, with monotonic constraints."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.llm.boosting import Forest, train
from lakesieve.llm.common import frugal, pick, read

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: At most so many labelled documents train the trees: those whose ids have the smallest hashes.
SAMPLE = 20_000
#: Documents are rejected below this probability of good quality.
ACCEPT = 0.5

#: Each statistic that the trees see, with the sign of the score's change with it (0: free).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "duplicate_lines": -1, "repeated_words": -1, "capitals": -1, "digits": -1, "marks": 0,
    "distinct_words": 0, "top_word": -1, "words_a_line": 0, "stops": 0, "symbol_words": -1, "neighbours": -1,
}
MONOTONE = np.array(list(FEATURES.values()))
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_DIGITS = re.compile(r"[0-9]+")


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in windows found twice or more in the text, the first find included."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(number) == len(words):
        return 0
    windows = list(zip(*(ids[i:] for i in range(window)), strict=False))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    many = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(many)[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of the base rules, and the features, of a whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes part at the six white-space characters only
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = len(lines) - len(set(lines))
    again = repeated_words(words)
    kinds = Counter(words)
    some, long = max(n, 1), max(chars, 1)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    features = (
        np.log1p(n), chars / some, symbols / long, repeats / max(len(lines), 1), again / some, upper / some,
        sum(map(len, _DIGITS.findall(text))) / long, (text.count("!") + text.count("?")) / some, len(kinds) / some, max(kinds.values(), default=0) / some,
        n / max(len(lines), 1), (text.count(".") + text.count(",")) / some, sum(w[-1:] in b"#*$%&|<>" for w in words) / some, sum(map(bytes.__eq__, words, words[1:])) / some,
    )
    return (n, chars, symbols, repeats, again), features


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch({"quality": b.column(1), "x": pa.array([list(map(float, statistics(t.as_py())[1])) for t in b.column(0)], pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees for the probability that quality is 1, from at most `sample` labelled documents. Labels without id or quality
    take no part; of several for one id the lowest counts. Without labels the forest is a constant that accepts."""
    known = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")
    rows = texts.mapInArrow(frugal(_described), "quality int, x array<double>").collect()  # at most a row for each chosen label and copy of its id
    rows.sort(key=lambda r: (r["quality"], r["x"]))
    if not rows:
        return train(np.zeros((0, len(FEATURES))), np.ones(0), MONOTONE)
    return train(np.array([r["x"] for r in rows]), np.array([r["quality"] for r in rows], float), MONOTONE)


def judge(docs: DataFrame, forest: Forest, accept: float = ACCEPT) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    score, and row_hash, the text's hash.

    base_failed: under 10 words, or over a fifth of the words lie in repeated windows of five; those and documents that the
    trees score below `accept` are not kept. Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            found = [statistics(t.as_py()) for t in b.column(1)]
            base = np.array([f[0] for f in found], np.int64)
            score = np.concatenate([forest.probability(x) for x in np.array_split(np.array([f[1] for f in found], float), 1 + len(found) // 4096)])
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            out = {"doc_id": b.column(0), **{c: pa.array(base[:, i]) for i, c in enumerate(_BASE)}}
            yield pa.record_batch(out | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= accept)), "score": pa.array(score), "row_hash": b.column(2)})

    schema = f"doc_id long, {', '.join(f'{c} long' for c in _BASE)}, base_failed boolean, kept boolean, score double, row_hash long"
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("row_hash"))
    return rows.mapInArrow(frugal(run), schema)


def kept_rows(docs: DataFrame, forest: Forest, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs that are kept, all columns as they were."""
    column, names = docs.columns.index("text"), docs.columns

    @F.pandas_udf("boolean")
    def passes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            found = [statistics(x) for x in t]
            base = np.array([f[0] for f in found], np.int64).reshape(-1, len(_BASE))
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            yield pd.Series(~failed & (forest.probability(np.array([f[1] for f in found], float).reshape(-1, len(FEATURES))) >= accept))

    rows = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    return rows.where(passes(F.col(f"_c{column}"))).toDF(*names)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read(spark, sf_dir, "labels"))).drop("row_hash")
