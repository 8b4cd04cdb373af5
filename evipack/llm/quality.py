"""Quality rules with an isolation forest on the rules' statistics.

Statistics of whole texts are counted where the rows lie. Short and repetitive texts fail the base rules. The
forest isolates points by random splits; the path lengths of a document, averaged over the trees, say how odd it
is. The threshold is calibrated on labelled rows of both kinds: it weighs the good ones lost against the bad ones missed.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evipack.llm.scratch import written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Labelled rows that the forest is fitted on and its threshold calibrated on, at most: those first by hash.
SAMPLE_ROWS = 20_000
TREES, TREE_ROWS, DEPTH, SEED = 300, 512, 24, 42
#: How much a share of the good rows that is lost weighs against the same share of bad rows that is missed.
GOOD_WEIGHT = 100.0
SYMBOLS = re.compile(r"[#*$%&|<>]")
BLANK = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim", "n_letters", "n_lines")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def statistics(text: str) -> tuple[int, ...]:
    """COUNTS of one text. Words are `[^\\x20\\x09-\\x0D]+`."""
    words = [w for w in text.translate(BLANK).split(" ") if w]
    seen, dup_lines = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    first, covered = {}, set()
    for i in range(len(words) - 2):
        window = (words[i], words[i + 1], words[i + 2])
        at = first.setdefault(window, i)
        if at != i:
            covered.update((at, at + 1, at + 2, i, i + 1, i + 2))
    joined = "".join(words)
    letters = len(joined) - len(joined.translate(_NO_ASCII_LETTERS))
    lower = len(joined) - len(joined.translate(_NO_LOWER))
    return len(words), len(joined), len(SYMBOLS.findall(joined)), dup_lines, len(covered), letters - lower, joined.count("!"), letters, text.count("\n") + 1


_NO_ASCII_LETTERS = {ord(c): None for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_NO_LOWER = {ord(c): None for c in "abcdefghijklmnopqrstuvwxyz"}


def _statistics(batches):
    for batch in batches:
        found = [statistics(t.as_py() or "") for t in batch.column(1)]
        columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *COUNTS])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS for each row of `docs` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_statistics, SCHEMA)


def features(stats: pd.DataFrame) -> np.ndarray:
    """All rule statistics without scale: symbols, exclamation marks and repeated words a word, share of capitals among
    letters and of repeated lines among lines, each under a square root, and logarithms of word length and words."""
    n, letters = np.maximum(stats["n_words"], 1), np.maximum(stats["n_letters"], 1)
    shares = [stats["n_symbols"] / n, stats["n_exclaim"] / n, stats["n_upper"] / letters, stats["n_dup_lines"] / stats["n_lines"], stats["n_repeat_words"] / n]
    return np.column_stack([*np.sqrt(shares), np.log(np.maximum(stats["word_chars"], 1) / n), np.log(n)]).astype(np.float64)


#: Box of the features that splits are drawn over at least, so that defects without a labelled row are isolated as well.
BOX = np.array([[0, 0, 0, 0, 0, 0, np.log(MIN_WORDS)], [1, 1, 1, 1, np.sqrt(MAX_REPEAT_PERCENT / 100), np.log(1000), np.log(1_000_000)]])


def _usual_path(n) -> np.ndarray:
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as flat arrays: feature (-1 in a leaf), cut, left child (the right one follows it), path length of a leaf.

    Splits are drawn over a box, halved on the way down, that spans `points` and `box`. Fitted on good rows with the
    bad ones in the box, the space without good rows is cut off after few splits, even where bad rows form clusters.
    """

    def __init__(self, points: np.ndarray, box: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.rows = min(rows, len(points))
        self.deepest = DEPTH
        both = np.vstack([points, box])
        low, high = both.min(axis=0), both.max(axis=0)
        self.trees = [self._grown(points[draw.permutation(len(points))[: self.rows]], low, high, draw) for _ in range(trees)]

    def _grown(self, points: np.ndarray, low, high, draw) -> tuple[np.ndarray, ...]:
        feature, cut, left, path = [-1], [0.0], [0], [0.0]
        todo = [(0, np.arange(len(points)), low, high, 0)]
        while todo:
            node, own, low, high, depth = todo.pop()
            wide = np.flatnonzero(high > low)
            if depth >= self.deepest or len(own) < 2 or not len(wide):
                path[node] = depth + float(_usual_path(len(own)))
                continue
            k = int(draw.choice(wide))
            at = draw.uniform(low[k], high[k])
            less = points[own, k] < at
            feature[node], cut[node], left[node] = k, at, len(feature)
            for side, down, up in ((own[less], low, np.where(np.arange(len(high)) == k, at, high)), (own[~less], np.where(np.arange(len(low)) == k, at, low), high)):
                feature.append(-1), cut.append(0.0), left.append(0), path.append(0.0)
                todo.append((len(feature) - 1, side, down, up, depth + 1))
        return np.array(feature), np.array(cut), np.array(left), np.array(path)

    def score(self, points: np.ndarray) -> np.ndarray:
        """0 to 1; the higher, the sooner random splits isolate the point."""
        total = np.zeros(len(points))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(points), np.int64)
            for _ in range(self.deepest):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                right = points[np.arange(len(points)), np.maximum(feature[at], 0)] >= cut[at]
                at = np.where(inner, left[at] + right, at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(_usual_path(self.rows)), 1e-9))


def threshold(scores: np.ndarray, quality: np.ndarray, good_weight: float = GOOD_WEIGHT) -> float:
    """The score above which rows are rejected: the one of least cost, which is the share of bad rows that it keeps plus
    `good_weight` times the share of good rows that it loses; of equal ones the lowest, which rejects the most."""
    good, bad = np.sort(scores[quality == 1]), np.sort(scores[quality == 0])
    if not len(good):
        return float("inf")
    cuts = np.unique(scores)
    lost = (len(good) - np.searchsorted(good, cuts, "right")) / len(good)
    missed = np.searchsorted(bad, cuts, "right") / max(len(bad), 1)
    return float(cuts[np.argmin(np.round(missed + good_weight * lost, 12))])


def chosen_labels(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, quality) of at most `sample_rows` labelled ids, those first by hash. An id with both labels is bad."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "quality-labels")


def fit(stats: DataFrame, chosen: DataFrame, good_weight: float = GOOD_WEIGHT):
    """(forest, threshold) from the `chosen` rows that pass the base rules; None without any good one. Rows repeated with
    one doc_id count once, so no more rows than `chosen` has reach the driver."""
    passed = stats.where(~base_failed()).join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids
    once = passed.groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("s")).select("doc_id", "quality", "s.*")
    rows = once.toPandas().sort_values("doc_id")
    if not (rows["quality"] == 1).any():
        return None
    points = features(rows)
    forest = IsolationForest(points[rows["quality"].to_numpy() == 1], np.vstack([points, BOX]))
    return forest, threshold(forest.score(points), rows["quality"].to_numpy(), good_weight)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, good_weight: float = GOOD_WEIGHT) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, anomaly, kept.

    `labels` has doc_id and quality (1 good, 0 bad). kept is false where the base rules fail or the anomaly score lies
    above the calibrated threshold; without labelled good rows the base rules alone decide. A null text has no words
    and fails. An empty table gives an empty result.
    """
    stats = written(rule_statistics(docs), "quality-statistics")
    model = fit(stats, chosen_labels(labels, sample_rows), good_weight)
    if model is None:
        scored = stats.withColumn("anomaly", F.lit(0.0))
        limit = float("inf")
    else:
        forest, limit = model

        def run(frames):
            for frame in frames:
                yield frame.assign(anomaly=forest.score(features(frame)))

        scored = stats.mapInPandas(run, f"{SCHEMA}, anomaly double")
    kept = ~base_failed() & (F.col("anomaly") <= limit)
    return scored.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), "anomaly", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, good_weight: float = GOOD_WEIGHT) -> DataFrame:
    """The rows of `docs` that quality_rules keeps, with all columns. Texts do not shuffle: the forest is fitted on the
    statistics of the chosen labelled rows, then each row's verdict is formed where it lies."""
    chosen = chosen_labels(labels, sample_rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")  # at most sample_rows ids
    forest, limit = fit(rule_statistics(labelled), chosen, good_weight) or (None, float("inf"))

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        own = pd.DataFrame([statistics(t or "") for t in text], columns=list(COUNTS))
        kept = (own["n_words"] >= MIN_WORDS) & (100 * own["n_repeat_words"] <= MAX_REPEAT_PERCENT * own["n_words"])
        return kept if forest is None else kept & (forest.score(features(own)) <= limit)

    return docs.where(good(F.col("text").cast("string")))
