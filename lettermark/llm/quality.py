"""Quality classifier: tree paths as rules over text statistics, lasso-logistic weights, compiled to column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermark.llm.arrow import LOWER, NOT_SPACE, hash_spans, runs, slices, text_bytes
from lettermark.session import cut_lineage

#: The statistics of a text, in the order of `statistics_of`.
STATISTICS = [
    "words", "lines", "bytes_a_word", "upper", "digit", "mark", "doubled_mark", "wide", "bar", "bracket", "stop", "quote",
    "word_ends_with_mark", "upper_words", "words_a_line", "distinct_words", "repeated_lines", "longest_word", "blank",
]


def _classes() -> dict[str, np.ndarray]:
    own = {}
    for name, members in {
        "upper": range(65, 91), "digit": range(48, 58), "wide": range(128, 256), "bar": b"|\t;=_", "bracket": b"<>{}[]()\\/",
        "stop": b".!?", "quote": b"\"'", "space": b" \t\n\r\x0b\x0c",
        "mark": [c for c in range(33, 127) if not chr(c).isalnum()],
    }.items():
        own[name] = np.zeros(256, dtype=bool)
        own[name][list(members)] = True
    own["letter"] = own["upper"].copy()
    own["letter"][range(97, 123)] = True
    own["letter"] |= own["wide"]
    return own


CLASSES = _classes()


def statistics_of(column) -> np.ndarray:
    """One row of `STATISTICS` a text; all are finite, and those of an empty text are 0."""
    offsets, data = text_bytes(column)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for a, b in slices(offsets, 1 << 18):
        raw, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n = np.diff(at)

        def each(mask, at=at):
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[at[1:]] - total[at[:-1]]

        def spans(starts, values=None, at=at):
            cut = np.searchsorted(starts, at)
            if values is None:
                return np.diff(cut)
            total = np.concatenate(([0], np.cumsum(values)))
            return total[cut[1:]] - total[cut[:-1]]

        share = {k: each(v[raw]) / np.maximum(n, 1) for k, v in CLASSES.items()}
        mark = CLASSES["mark"][raw]
        double = np.zeros(len(raw), dtype=bool)
        double[1:] = mark[1:] & mark[:-1]
        starts, ends = runs(NOT_SPACE[raw], at)
        words = spans(starts)
        capitals = np.concatenate(([0], np.cumsum(CLASSES["upper"][raw])))
        letters = np.concatenate(([0], np.cumsum(CLASSES["letter"][raw])))
        shouted = (capitals[ends] - capitals[starts] > 1) & (2 * (capitals[ends] - capitals[starts]) > letters[ends] - letters[starts])
        line_starts, line_ends = runs(raw != 10, at)
        row = np.searchsorted(at, starts, "right") - 1
        longest = np.zeros(b - a)
        np.maximum.at(longest, row, ends - starts)
        distinct = _distinct(hash_spans(LOWER[raw], starts, ends), row, b - a)
        line_row = np.searchsorted(at, line_starts, "right") - 1
        lines = spans(line_starts)
        fresh_lines = _distinct(hash_spans(raw, line_starts, line_ends), line_row, b - a)
        per = np.maximum(words, 1)
        out[a:b] = np.stack([
            np.log1p(words), np.log1p(lines), spans(starts, ends - starts) / per, share["upper"], share["digit"], share["mark"],
            each(double) / np.maximum(n, 1), share["wide"], share["bar"], share["bracket"], share["stop"], share["quote"],
            spans(starts, mark[ends - 1]) / per, spans(starts, shouted) / per, words / np.maximum(lines, 1), distinct / per,
            1 - fresh_lines / np.maximum(lines, 1), np.log1p(longest), share["space"],
        ], 1)
        out[a:b][n == 0] = 0
    return out


def _distinct(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes of each row; `row` ascends."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n)


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and the statistics of `text`."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def measure(batches):
        for batch in batches:
            values = statistics_of(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in values.T)], names=[*keep, *STATISTICS])

    return docs.select(*keep, "text").mapInArrow(measure, f"{schema}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass
class Rules:
    """Conjunctions of (statistic, whether above, bound) with a weight each, and the intercept."""

    paths: list[tuple[tuple[int, bool, float], ...]]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        total = F.lit(self.intercept)
        for path, weight in zip(self.paths, self.weights, strict=True):
            holds = F.lit(True)
            for k, above, bound in path:
                holds = holds & (F.col(STATISTICS[k]) > bound if above else F.col(STATISTICS[k]) <= bound)
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), len(self.paths)))
        for c, path in zip(out.T, self.paths, strict=True):
            for k, above, bound in path:
                c *= x[:, k] > bound if above else x[:, k] <= bound
        return out


def tree_paths(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int = 32, least: int = 20, seed: int = 11) -> list[tuple[tuple[int, bool, float], ...]]:
    """Paths from the root to every inner and outer node of boosted regression trees on quantile bins."""
    random = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    margin, found = np.zeros(len(y)), set()

    def grow(rows, path, residual):
        if path:
            found.add(tuple(sorted(path)))
        if len(path) == depth or len(rows) < 2 * least:
            return [(rows, residual[rows].mean() if len(rows) else 0.0)]
        best = None
        for k in random.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]:
            size = np.bincount(binned[rows, k], minlength=len(edges[k]) + 1)
            total = np.bincount(binned[rows, k], residual[rows], len(edges[k]) + 1)
            n, t = np.cumsum(size)[:-1], np.cumsum(total)[:-1]
            fits = (n >= least) & (len(rows) - n >= least)
            if fits.any():
                gain = np.where(fits, t**2 / np.maximum(n, 1) + (total.sum() - t) ** 2 / np.maximum(len(rows) - n, 1), -1)
                b = int(gain.argmax())
                if best is None or gain[b] > best[0]:
                    best = (gain[b], int(k), b)
        if best is None:
            return [(rows, residual[rows].mean())]
        _, k, b = best
        low, bound = binned[rows, k] <= b, float(edges[k][b])
        return grow(rows[low], [*path, (k, False, bound)], residual) + grow(rows[~low], [*path, (k, True, bound)], residual)

    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-margin))
        for rows, value in grow(np.arange(len(y)), [], residual):
            margin[rows] += 2 * value
    return sorted(found)


def lasso_logistic(h: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalised mean log-loss by accelerated proximal steps."""
    center = h.mean(0)
    z = np.column_stack((h - center, np.ones(len(h))))
    step = 4 * len(y) / np.linalg.norm(z, 2) ** 2
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(rounds):
        u = v - step * z.T @ (1 / (1 + np.exp(-np.clip(z @ v, -40, 40))) - y) / len(y)
        u[:-1] = np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = u + (t - 1) / after * (u - w), u, after
    return w[:-1], float(w[-1] - center @ w[:-1])


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002) -> Rules:
    """Rules and weights; with one label only, or no rows, the share of label 1 (at first one half) without rules."""
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Rules([], [], float(np.log(share / (1 - share))))
    rules = Rules(tree_paths(x, y, trees, depth), [], 0.0)
    held = rules.holds(x)
    _, one = np.unique(held, axis=1, return_index=True)  # rules that hold for the same rows are one
    rules.paths = [rules.paths[k] for k in sorted(one)]
    weights, intercept = lasso_logistic(held[:, sorted(one)], y, penalty)
    some = np.flatnonzero(weights)
    return Rules([rules.paths[k] for k in some], [float(weights[k]) for k in some], intercept)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; NULL ids have that of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def learn_rules(measured: DataFrame, labels: DataFrame, sample: int = 20_000) -> Rules:
    """Rules from at most `sample` labelled rows, the first by the md5 of their id, of the folds that are not held out.

    Labels that are NULL or belong to no row are not used; conflicting labels of an id all count.
    """
    learn = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id")) != 1)
    learn = learn.select("doc_id", F.col("quality").cast("double").alias("label_"))
    order = F.md5(F.col("doc_id").cast("string"))
    rows = measured.join(learn, "doc_id").orderBy(order, "label_", *STATISTICS).limit(sample).select("label_", *STATISTICS)
    values = rows.toPandas().to_numpy(dtype=float).reshape(-1, 1 + len(STATISTICS))
    return fit_rules(values[:, 1:], values[:, 0])


def score_quality(measured: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """`measured` (doc_id, statistics, ...) with held_out, score and predicted; see `learn_rules`.

    Every row is scored by one expression, empty and NULL texts like any other. Empty tables give no rows.
    """
    rules = learn_rules(measured, labels, sample)
    scored = measured.withColumn("held_out", fold(F.col("doc_id")) == 1).withColumn("score", rules.score())
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """The rows of `docs` that the rules accept, with all their columns; `docs` has doc_id and text.

    The statistics are written once for learning; for the filter they are measured again beside the texts, which
    therefore need no join.
    """
    rules = learn_rules(cut_lineage(text_statistics(docs, "doc_id")), labels, sample)
    names = {c: f"c{i}_" for i, c in enumerate(docs.columns)}  # no column may clash with a statistic
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], "text")
    kept = text_statistics(plain, *names.values()).where(rules.score() >= 0.5)
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def held_out_accuracy(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, share predicted right and share of label 1 over the labelled rows that were held out."""
    both = scored.where("held_out").join(labels.select("doc_id", "quality"), "doc_id").where("quality IS NOT NULL")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("right"), F.avg("quality").alias("ones"))
