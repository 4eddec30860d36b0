"""Quality rules: counts of each text, fixed base rules, and robust multivariate outliers.

Each document has a vector of transformed statistics. For every pair of
language and source the minimum-covariance-determinant estimate is looked for:
of all subsets that hold the share ``SUPPORT`` of the documents, the one whose
covariance has the least determinant. Several deterministic starts (spreads of the
coordinates, the covariance of their hyperbolic tangents, that of the directions
from the medians) are led down by concentration steps, each of which takes the
documents with the least Mahalanobis distance and computes their mean and
covariance anew. After ``FIRST_STEPS`` each group goes on from the start with the
least determinant, until none falls any more. A step is one plan over a narrow stored table; groups
of any size are summed by parts, and nothing of a document but its vector is read
again. A document beyond the cutoff of the chi-squared distribution is rejected.

The statistics vary from text to text in clean text too, so their covariance is
estimated, not assumed. Shares by word are taken as if the text went on for
``SMOOTH_WORDS`` words at the table's medians, so short texts do not vary more
than long ones; duplicate lines are log odds, which keep their reach at any
length. The logarithm of the number of words is a coordinate of the estimate, and
the verdict is on the others given it, so no text is rejected for its length; nor
is any for having fewer duplicate lines than its length lets expect.

A group's covariance is regularised: it is blended with a fixed one as if that
stood for ``PRIOR_ROWS`` documents, so steps still lower the determinant. The
fixed one is the estimate of the distances of all documents to the medians of
their groups, to which the spreads in ``FEATURES`` are added with the weight of
one document, so tiny tables and constant coordinates give finite distances.

Defined results: null text has no words and fails the base rules; null
languages and sources are groups of their own; repeated rows are judged alike,
and rows at equal distances are in the subset together; very long texts are
counted whole; other columns are not looked at; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import BROADCAST_ROWS, dealt_join
from folioscan.llm.textscan import IS_FIRST, IS_SPACE, Texts, Words, in_arrow, per_text, slices, texts_of, windows_of, words_of
from folioscan.workspace import persist_table

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SUPPORT = 0.75
#: Steps from every start, steps at most from the best of them, and the fall of the logarithm of a determinant that counts as none.
FIRST_STEPS, STEPS, SETTLED = 3, 40, 1e-4
PRIOR_ROWS = 40
SMOOTH_WORDS = 100
NEAR_WORDS = 100
CUTOFF_TAIL = 1e-6

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the coordinates are made of besides: lines with words, marks (ASCII that is no letter, digit or space), words that stand among the ``NEAR_WORDS`` before them.
BASES = ["n_lines", "n_marks", "n_near_words"]
#: Coordinates and the spread that each is given with the weight of one document.
FEATURES = {"length": 1.0, "word_length": 0.12, "marks": 0.25, "dup_lines": 0.35, "near_words": 0.35}
GIVEN, ONE_SIDED = list(FEATURES).index("length"), list(FEATURES).index("dup_lines")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _lines(data: bytes) -> tuple[int, int]:
    """Lines with words, and how many of them stood before."""
    lines = [x for x in data.split(b"\n") if x.strip()]  # bytes.strip() takes just this white space
    return len(lines), len(lines) - len(set(lines))


def _near_words(words: Words, starts: np.ndarray) -> np.ndarray:
    """For each word of a run of texts, whether its text has it among the ``NEAR_WORDS`` words before.

    Before a text's first word stands its last, so that a text's length has no part in it.
    """
    near = np.zeros(len(words.hash), bool)
    if not len(near):
        return near
    key = words.hash ^ (words.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    last = np.append(first[1:], len(key)) - 1
    gap = np.diff(order, prepend=0)
    gap[first] = order[first] + np.diff(starts)[words.text[order[first]]] - order[last]
    alone = first[first == last]
    gap[alone] = NEAR_WORDS + 1
    near[order[gap <= NEAR_WORDS]] = True
    return near


def _repeat_words(text: np.ndarray, hashes: np.ndarray, first: np.ndarray, n_words: int) -> np.ndarray:
    """For each word of a run of texts, whether it lies in a window that its text has twice."""
    key = hashes ^ (text[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(n_words + 1, np.int32)
    at = first[twice]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEAT_WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def counts_of(texts: Texts, a: int, b: int) -> dict[str, np.ndarray]:
    """The counts of the texts a to b."""
    lo, hi = int(texts.offsets[a]), int(texts.offsets[b])
    offsets = texts.offsets[a : b + 1] - lo
    data = texts.data[lo:hi]
    words = words_of(texts, a, b)
    starts = words.starts(b - a)
    hashes, first = windows_of(words, REPEAT_WINDOW)
    repeated = np.zeros(len(words.hash) + 1, np.int64)
    if len(first):
        np.cumsum(_repeat_words(words.text, hashes, first, len(words.hash)), out=repeated[1:])
    near = np.zeros(len(words.hash) + 1, np.int64)
    np.cumsum(_near_words(words, starts), out=near[1:])
    lines = np.array([_lines(data[x:y].tobytes()) for x, y in zip(offsets[:-1], offsets[1:], strict=True)], np.int64).reshape(-1, 2)
    return {
        "n_words": np.diff(starts),
        "word_chars": per_text(IS_FIRST[data] & ~IS_SPACE[data], offsets),
        "n_symbols": per_text(_IS_SYMBOL[data], offsets),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": repeated[starts[1:]] - repeated[starts[:-1]],
        "n_lines": lines[:, 0],
        "n_marks": per_text(_IS_MARK[data], offsets),
        "n_near_words": near[starts[1:]] - near[starts[:-1]],
    }


def with_vector(rows: DataFrame) -> DataFrame:
    """``rows`` (stored; at least a word each) with the statistic vector ``x``."""
    shares = [F.col(c) / F.col("n_words") for c in ("word_chars", "n_marks", "n_near_words")]
    typical = rows.agg(*[F.percentile_approx(c, 0.5, 10_000) for c in shares]).first()  # one row
    usual = [F.lit(float(m or 0.0)) for m in typical]
    # The half keeps the logarithm finite where a table's median is nought.
    smooth = [F.log((F.col(c) + SMOOTH_WORDS * m + 0.5) / (F.col("n_words") + SMOOTH_WORDS)) for c, m in zip(("word_chars", "n_marks", "n_near_words"), usual, strict=True)]
    odds = F.log((F.col("n_dup_lines") + 0.5) / (F.col("n_lines") - F.col("n_dup_lines") + 0.5))
    return rows.withColumn("x", F.array(F.log(F.col("n_words").cast("double")), smooth[0], smooth[1], odds, smooth[2]))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row for each document: id, lang, source, the counts, and ``BASES``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", "lang string, source string", *(f"{c} long" for c in COUNTS + BASES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(texts):
                c = counts_of(texts, a, b)
                head = [batch.column(k).slice(a, b - a) for k in ("id", "lang", "source")]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(c[k].astype(np.int64)) for k in COUNTS + BASES)], ["id", "lang", "source", *COUNTS, *BASES])

    return in_arrow(rows, run, schema)


def _gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    n = a
    while abs(term) > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: int, share: float) -> float:
    lo, hi = 1e-9, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_p(p / 2, mid / 2) < share else (lo, mid)
    return hi


P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _consistency() -> float:
    """What a covariance of the inner share is multiplied by, to be that of a normal distribution."""
    return SUPPORT / _gamma_p((P + 2) / 2, chi2_quantile(P, SUPPORT) / 2)


def _x() -> list[Column]:
    return [F.col("x")[i] for i in range(P)]


def _square(values) -> np.ndarray:
    """A symmetric matrix from its values by PAIRS."""
    m = np.zeros((P, P))
    for (i, j), v in zip(PAIRS, values, strict=True):
        m[i, j] = m[j, i] = v
    return m


def _sums(y: list) -> list:
    """Aggregates n, s (sums) and q (sums of products by PAIRS) of the coordinates ``y``."""
    return [F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in y]).alias("s"), F.array(*[F.sum(y[i] * y[j]) for i, j in PAIRS]).alias("q")]


def _covariance(n: float, s, q) -> tuple[np.ndarray, np.ndarray]:
    mean = np.asarray(s, float) / n
    return mean, _square(np.asarray(q, float) / n) - np.outer(mean, mean)


def _d2(centre: Column, inverse: Column) -> Column:
    d = [x - centre[i] for i, x in enumerate(_x())]
    terms = [d[i] * d[j] * inverse[i * P + j] * (1 if i == j else 2) for i, j in PAIRS]
    return sum(terms[1:], terms[0])


def _common_covariance(centred: DataFrame) -> np.ndarray:
    """The estimate for all documents as one group, ``x`` being taken from the medians of their groups; rows of single numbers reach the driver."""
    assumed = np.array(list(FEATURES.values()))
    spreads = centred.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias(f"p{i}") for i, x in enumerate(_x())]).first()
    n = spreads["n"]
    if not n:
        return np.diag(assumed**2)
    ridge = np.diag(assumed**2) / (n + 1)
    covariance, mean, before = np.diag([((spreads[f"p{i}"][1] - spreads[f"p{i}"][0]) / 1.349) ** 2 for i in range(P)]) + ridge, np.zeros(P), math.inf
    for _ in range(STEPS):
        at = F.array(*[F.lit(float(v)) for v in mean])
        distance = centred.select("x", _d2(at, F.array(*[F.lit(float(v)) for v in np.linalg.inv(covariance).ravel()])).alias("d2"))
        reach = distance.agg(F.percentile_approx("d2", SUPPORT, 10_000)).first()[0]
        r = distance.where(F.col("d2") <= F.lit(reach)).agg(*_sums(_x())).first()
        mean, inner = _covariance(r["n"], r["s"], r["q"])
        covariance = _consistency() * inner * n / (n + 1) + ridge
        now = np.linalg.slogdet(covariance)[1]
        if now > before - 1e-4:
            break
        before = now
    return covariance


class Estimates:
    """Concentration steps of all groups and starts; rows: with ``group`` and ``x``, which alone are stored and read in each step."""

    def __init__(self, rows: DataFrame):
        self.rows = rows = persist_table(rows.select("group", "x"), "mcd-vectors")
        middle = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias(f"p{i}") for i, x in enumerate(_x())])
        assumed = list(FEATURES.values())
        spread = [F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, assumed[i] / F.sqrt("n")) for i in range(P)]
        middle = persist_table(middle.select("group", F.array(*[F.col(f"p{i}")[1] for i in range(P)]).alias("median"), F.array(*spread).alias("spread")), "mcd-medians")
        self.few = middle.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        near = self.meet(rows, middle, "group")
        self.common = _common_covariance(near.select(F.transform(F.arrays_zip("x", "median"), lambda v: v["x"] - v["median"]).alias("x")))
        self.table = persist_table(self._starts(near), "mcd-start")

    def meet(self, rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
        """Join with a table of a row for each group, or a few."""
        return rows.join(F.broadcast(table), list(keys)) if self.few else dealt_join(rows, table, list(keys), ["x"])

    def _starts(self, near: DataFrame) -> DataFrame:
        """(group, start, centre, inverse, logdet) for each start."""
        scaled = near.select("group", "median", "spread", F.transform(F.sequence(F.lit(0), F.lit(P - 1)), lambda i: (F.get("x", i) - F.get("median", i)) / F.get("spread", i)).alias("u"))
        length = F.sqrt(F.aggregate("u", F.lit(0.0), lambda t, v: t + v * v))
        bent = scaled.withColumn("x", F.transform("u", lambda v: F.tanh(v)))
        signs = scaled.withColumn("x", F.transform("u", lambda v: F.when(length > 0, v / length).otherwise(0.0)))
        both = bent.withColumn("start", F.lit(1)).unionByName(signs.withColumn("start", F.lit(2)))
        moments = both.groupBy("group", "start").agg(F.min("median").alias("median"), F.min("spread").alias("spread"), *_sums(_x()))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for r in f.itertuples(index=False):
                    spread = np.asarray(r.spread)
                    shapes = [_square(np.asarray(r.q) / r.n)]
                    if r.start == 1:
                        shapes.append(np.diag(np.ones(P)))  # the spreads alone, once a group
                    for k, shape in enumerate(shapes):
                        shape = shape / max(np.trace(shape), 1e-9) * P + 1e-6 * np.eye(P)
                        inverse = np.linalg.inv(shape * np.outer(spread, spread))
                        out.append((r.group, 0 if k else r.start, list(r.median), inverse.ravel().tolist(), None))
                yield pd.DataFrame(out, columns=["group", "start", "centre", "inverse", "logdet"])

        return moments.mapInPandas(run, "group string, start int, centre array<double>, inverse array<double>, logdet double")

    def step(self) -> None:
        """One concentration step."""
        placed = self.meet(self.rows, self.table, "group").select("group", "start", "x", "logdet", _d2(F.col("centre"), F.col("inverse")).alias("d2"))
        reach = placed.groupBy("group", "start").agg(F.percentile_approx("d2", SUPPORT, 10_000).alias("reach"))
        moments = self.meet(placed, reach, "group", "start").where("d2 <= reach").groupBy("group", "start").agg(F.max("logdet").alias("before"), *_sums(_x()))
        common, factor = self.common, _consistency()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for r in f.itertuples(index=False):
                    mean, inner = _covariance(r.n, r.s, r.q)
                    covariance = regularised(inner, r.n, common, factor)
                    out.append((r.group, r.start, mean.tolist(), np.linalg.inv(covariance).ravel().tolist(), float(np.linalg.slogdet(covariance)[1]), r.before))
                yield pd.DataFrame(out, columns=["group", "start", "centre", "inverse", "logdet", "before"])

        self.table = persist_table(moments.mapInPandas(run, "group string, start int, centre array<double>, inverse array<double>, logdet double, before double"), "mcd-step")

    def settle(self) -> DataFrame:
        """A few steps from every start, then steps from the best one until no determinant falls any more: (group, centre, inverse, logdet)."""
        best = F.min(F.struct("logdet", "start", "centre", "inverse", "before")).alias("b")
        for k in range(STEPS):
            self.step()
            if k + 1 == FIRST_STEPS:
                self.table = persist_table(self.table.groupBy("group").agg(best).select("group", "b.*"), "mcd-best")
            elif k >= FIRST_STEPS and not self.table.where(F.col("logdet") < F.col("before") - SETTLED).take(1):
                break
        return self.table.select("group", "centre", "inverse", "logdet")


def regularised(inner: np.ndarray, n: int, common: np.ndarray, factor: float) -> np.ndarray:
    return (n * factor * inner + PRIOR_ROWS * common) / (n + PRIOR_ROWS)


def robust_distance(rows: DataFrame, given: int | None = None, one_sided: int | None = None) -> DataFrame:
    """``rows`` (stored; lang, source, x) with ``d2``, the squared robust distance to the centre of its group.

    ``given``: the coordinate given which the others are judged. ``one_sided``: one that only counts above what is expected.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    grouped = rows.withColumn("group", F.concat(part("lang"), F.lit("\0"), part("source")))
    found = Estimates(grouped)
    estimates = found.settle()
    if given is not None:
        estimates = persist_table(estimates.mapInPandas(lambda frames: (_given(f, given) for f in frames), estimates.schema), "mcd-given")
    joined = found.meet(grouped, estimates, "group")
    centre, inverse = F.col("centre"), F.col("inverse")
    d2 = _d2(centre, inverse)
    if one_sided is not None:
        beyond = sum(((x - centre[j]) * inverse[one_sided * P + j] for j, x in enumerate(_x())), F.lit(0.0))
        d2 = d2 - F.when(beyond < 0, beyond * beyond / inverse[one_sided * P + one_sided]).otherwise(0.0)
    return joined.withColumn("d2", d2).select(*rows.columns, "d2")


def _given(frame: pd.DataFrame, given: int) -> pd.DataFrame:
    """Estimates whose inverses are those of the other coordinates once ``given`` is known."""
    out = []
    for inverse in frame["inverse"]:
        m = np.array(inverse, float).reshape(P, P)
        m[given, given] -= 1 / np.linalg.inv(m)[given, given]
        out.append(m.ravel().tolist())
    return frame.assign(inverse=out)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row for each document: id, the counts, base_failed, d2, kept.

    The estimates are taken from the documents that pass the base rules.
    """
    rows = persist_table(measure(docs, id_col, text_col, lang_col, source_col), "text-counts")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    placed = robust_distance(with_vector(rows.where("NOT base_failed")), given=GIVEN, one_sided=ONE_SIDED)
    judged = placed.withColumn("kept", F.col("d2") <= chi2_quantile(P - 1, 1 - CUTOFF_TAIL))
    names = ["id", *COUNTS, "base_failed", "d2", "kept"]
    lost = rows.where("base_failed").withColumns({"d2": F.lit(None).cast("double"), "kept": F.lit(False)})
    return judged.select(names).unionByName(lost.select(names))
