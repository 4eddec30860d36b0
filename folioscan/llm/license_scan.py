"""Licence notices in paragraphs, found by a trained classifier and confirmed by templates.

A paragraph is a run of lines without a blank one; notices that are broken over
several lines, and whole licence texts, are one. It is looked at in overlapping
windows of ``WINDOW`` words, so several notices in one paragraph are all found. A
window's features are the runs of one to three words that templates hold; a
multinomial logistic regression with an L1 penalty gives it to a licence family or
to none. It is trained on the driver from the templates, whole and in random
parts among other words, against a bounded sample of the corpus' own windows that
resemble no template; a held-out part sets the temperature of its probabilities,
and so what counts as unknown. A prediction stands if its probability is at least
``LEAST_PROBABILITY`` and the window and one of the family's templates share
enough of their words' runs. What that template explains is then taken away and
the rest is looked at once more, for the second of two licences side by side.

Scoring is DataFrame operations alone. Most windows cannot reach any family:
``anchors`` are words without which the best possible score stays below the
threshold, so only texts and windows that hold one are taken apart. That is a
bound of the model, not a sample; the trained weights give it.

Defined results: null and empty texts have no paragraphs and no licences; empty
lines are no paragraphs; of families that are equally likely the first by name
holds; repeated rows are judged alike, rows with equal ids each for itself; very
long texts and lines are looked at whole, window by window; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import text_of
from folioscan.llm.licence_texts import TEMPLATES
from folioscan.llm.textscan import release

#: Words that tell nothing by themselves.
COMMON = frozenset(
    "0 1 2 3 4 5 6 7 8 9 a all an and any are as at be been but by can do each either even every following for from had has have he if in including into is it its "
    "kind may must no not of on one only or other out part people so such than that the their them there these they this those to under up was we were what when which who will with without would you your".split()
)
UNKNOWN = "unknown"
WORDS = r"[a-z0-9]+(?:[.+\-][a-z0-9]+)*"
PARAGRAPHS = r"\n[ \t\r]*\n"
GRAMS = 3
#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 40, 20
#: The sample of the corpus to learn the unknown from: texts, and windows of up to so many bytes.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_BYTES = 300, 800, 2000
VARIANTS = 24
LEAST_PROBABILITY = 0.6
LEAST_SHARE = 0.6
PENALTY = 2e-4
STEPS = 300
SEED = 11


def words_of(text: str) -> list[str]:
    return re.findall(WORDS, text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}


@dataclass
class Model:
    families: list[str]  # the last is UNKNOWN
    weights: dict[str, list[float]]  # divided by the temperature
    bias: list[float]
    anchors: list[str]

    def probabilities_of(self, grams: set[str]) -> dict[str, float]:
        """The plain meaning of what ``scan`` computes for a window."""
        z = np.array(self.bias)
        for g in sorted(grams):
            z = z + np.array(self.weights.get(g, [0.0] * len(z)))
        p = np.exp(z - z.max())
        return dict(zip(self.families, (p / p.sum()).tolist(), strict=True))


def windows_of(words: list[str]) -> list[list[str]]:
    """All windows of a paragraph; the last may be short."""
    return [words[i : i + WINDOW] for i in range(0, max(1, len(words) - (WINDOW - STRIDE)), STRIDE)]


class _Sparse:
    """A matrix of zeros and ones by the places of its ones."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.shape = (len(rows), width)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        self.by_column = np.argsort(self.column, kind="stable")
        self.rows, self.row_starts = np.unique(self.row, return_index=True)
        self.columns, self.column_starts = np.unique(self.column[self.by_column], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], w.shape[1]), w.dtype)
        if len(self.rows):
            out[self.rows] = np.add.reduceat(w[self.column], self.row_starts)
        return out

    def transposed(self, d: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[1], d.shape[1]), d.dtype)
        if len(self.columns):
            out[self.columns] = np.add.reduceat(d[self.row[self.by_column]], self.column_starts)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def best_template(grams: set[str], family: str) -> tuple[float, set[str]]:
    """How much of a template, or of the window if that is the shorter, the other has; and that template."""
    return max(((len(grams & t) / max(1, min(len(grams), len(t))), sorted(t)) for t in (grams_of(words_of(x)) for x in TEMPLATES[family])), default=(0.0, []))


def train(paragraphs: list[str], families: dict[str, list[str]] = TEMPLATES) -> Model:
    """paragraphs: of the corpus; those that resemble a template are left out of the unknown."""
    rng = np.random.default_rng(SEED)
    names = [*sorted(families), UNKNOWN]
    other = np.array([w for p in paragraphs for w in words_of(p)] or ["the", "of", "and"])
    templates = [grams_of(words_of(t)) for ts in families.values() for t in ts]
    vocabulary = sorted({g for t in templates for g in t if not set(g.split()) <= COMMON})
    place = {g: i for i, g in enumerate(vocabulary)}
    coded = lambda grams: np.array(sorted(place[g] for g in grams if g in place), np.int32)  # noqa: E731  so that no row keeps its strings
    rows: list[tuple[np.ndarray, int]] = []
    for k, name in enumerate(names[:-1]):
        for t in families[name]:
            words = words_of(t)
            rows.append((coded(grams_of(words[:WINDOW])), k))
            for _ in range(VARIANTS + 2 * len(words)):
                n = max(min(len(words), 4), int(min(len(words), WINDOW) * rng.uniform(0.45, 1)))
                a = int(rng.integers(0, len(words) - n + 1))
                around = [str(x) for x in rng.choice(other, int(rng.integers(0, 12 if rng.random() < 0.6 else WINDOW)))][: WINDOW - n]
                cut = int(rng.integers(0, len(around) + 1))
                rows.append((coded(grams_of([*around[:cut], *words[a : a + n], *around[cut:]])), k))
    everything = [w for ts in families.values() for t in ts for w in words_of(t)]
    loose = np.array([*everything, *other[: len(everything)].tolist()])
    none = len(names) - 1
    for g in (grams_of(w) for p in paragraphs for w in windows_of(words_of(p))):
        if not any(len(g & t) >= 0.5 * min(len(g), len(t)) for t in templates):
            rows.append((coded(g), none))
    for _ in range(len(rows) // 4):  # words of templates out of order tell nothing
        rows.append((coded(grams_of([str(x) for x in rng.choice(loose, int(rng.integers(1, 12)))])), none))
    y = np.array([k for _, k in rows])
    held = rng.random(len(rows)) < 0.25
    learn, check = (_Sparse([g for (g, _), h in zip(rows, held, strict=True) if h == side], len(vocabulary)) for side in (False, True))
    w, b = np.zeros((len(vocabulary), len(names)), np.float32), np.zeros(len(names), np.float32)
    weight = (1 / np.bincount(y[~held], minlength=len(names)).clip(1))[y[~held]]
    weight = (weight / weight.sum()).astype(np.float32)
    target = np.eye(len(names), dtype=np.float32)[y[~held]]
    for step in range(STEPS):  # proximal gradient: small weights become zero
        d = (_softmax(learn.times(w) + b) - target) * weight[:, None]
        rate = np.float32(4.0 / (1 + step / 200))
        w -= rate * learn.transposed(d)
        b -= rate * d.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * np.float32(PENALTY), 0)
    z = check.times(w) + b
    best = min((-np.log(_softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean(), t) for t in np.geomspace(0.2, 3, 40))
    w, b = (np.round(v.astype(np.float64) / best[1], 4) for v in (w, b))  # short literals
    del rows, learn, check
    release()
    kept = np.flatnonzero(np.abs(w).sum(1) > 0)
    # A family must reach the least probability against unknown alone; features in order of what they can add at most.
    need = np.log(LEAST_PROBABILITY / (1 - LEAST_PROBABILITY)) - (b[:-1] - b[none])
    gain = np.maximum(w[:, :-1] - w[:, [none]], 0)
    order = kept[np.argsort(gain[kept].max(1), kind="stable")]
    total, weak = np.zeros(len(names) - 1), set()
    for i in order:
        if ((total + gain[i]) < need - 1e-6).all():
            total = total + gain[i]
            weak.add(int(i))
    anchors = sorted({vocabulary[i] for i in kept if int(i) not in weak})
    # A run is only there if its words are, so its longest telling word stands for it.
    single = {a for a in anchors if " " not in a}
    anchors = sorted(single | {max((w for w in a.split() if w not in COMMON), key=lambda w: (len(w), w)) for a in anchors if not single & set(a.split())})
    return Model(names, {vocabulary[i]: w[i].tolist() for i in kept}, b.tolist(), anchors)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Up to SAMPLE_WINDOWS windows of the SAMPLE_DOCS documents with the least hash, from all over their texts; for training alone."""
    turn = F.xxhash64(F.col(id_col).cast("string"), text_of(text_col))
    share = min(1.0, 8 * SAMPLE_DOCS / max(1, docs.count()))  # so few come near the driver that their order is cheap
    some = docs.where(F.pmod(turn, F.lit(1 << 30)) <= int(share * (1 << 30))).select(text_of(text_col).alias("text"), turn.alias("turn")).orderBy("turn").limit(SAMPLE_DOCS)
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))
    rows = some.select(words.alias("words")).select("words", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words")), F.lit(WINDOW))).alias("at"))
    lines = rows.select(F.array_join(F.slice("words", F.col("at"), F.lit(WINDOW)), " ").alias("line")).where((F.col("line") != "") & (F.octet_length("line") <= SAMPLE_BYTES)).distinct()
    return sorted(r["line"] for r in lines.orderBy(F.md5(F.col("line").cast("binary"))).limit(SAMPLE_WINDOWS).collect())


def _runs(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _grams(words: Column) -> Column:
    return F.array_distinct(F.concat(*[_runs(words, n) for n in range(1, GRAMS + 1)]))


def _near(c: Column, model: Model) -> Column:
    """Whether an anchor stands in the text, as a word or a part of one with a dot, plus or hyphen.

    What stands before the word is looked at first and words are told apart by
    their first letter, so most characters of a text cost one comparison.
    """
    by_letter: dict[str, list[str]] = {}
    for a in model.anchors:
        by_letter.setdefault(a[0], []).append(re.escape(a[1:]))
    words = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_letter.items())) or "(?!)"
    return F.concat(F.lit(" "), F.lower(c)).rlike(rf"[^a-z0-9](?:{words})(?![a-z0-9])")


def _literal(value) -> str:
    """A SQL literal; strings hold words, numbers and spaces alone."""
    if isinstance(value, dict):
        return "map(" + ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in value.items()) + ")"
    if isinstance(value, list):
        return "array(" + ", ".join(map(_literal, value)) + ")"
    return f"'{value}'" if isinstance(value, str) else f"{value!r}D"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def notices(words: Column, model: Model) -> Column:
    """Array of structs (family, probability): the families that are found in a window of words, one or two."""
    table = F.expr(_literal(model.weights))
    families = F.array(*[F.lit(f) for f in model.families])
    templates = F.expr(_literal({f: [sorted(grams_of(words_of(t))) for t in ts] for f, ts in TEMPLATES.items()}))
    add = lambda z, g: F.zip_with(z, F.try_element_at(table, g), lambda x, y: x + y)

    def logits(grams: Column) -> Column:
        return F.aggregate(F.array_intersect(grams, F.map_keys(table)), F.array(*[F.lit(x) for x in model.bias]), add)

    def named(grams: Column, z: Column) -> Column:
        top = F.array_max(z)
        family = F.element_at(families, F.array_position(z, top).cast("int"))
        chance = 1 / F.aggregate(z, F.lit(0.0), lambda t, x: t + F.exp(x - top))
        shares = F.transform(F.try_element_at(templates, family), lambda t: F.struct((F.size(F.array_intersect(grams, t)) / F.greatest(F.lit(1), F.least(F.size(grams), F.size(t)))).alias("share"), t.alias("template")))
        return F.struct(family.alias("family"), chance.alias("probability"), F.array_max(shares).alias("best"))

    def once(grams: Column, body) -> Column:
        return _let(logits(grams), lambda z: _let(named(grams, z), body))

    sure = lambda n: (n["family"] != UNKNOWN) & (n["probability"] >= LEAST_PROBABILITY) & (n["best"]["share"] >= LEAST_SHARE)
    told = lambda n: F.struct(n["family"].alias("family"), n["probability"].alias("probability"))
    none = F.array().cast("array<struct<family: string, probability: double>>")

    def second(first: Column, grams: Column) -> Column:
        return once(F.array_except(grams, first["best"]["template"]), lambda n: F.when(sure(n), F.array(told(first), told(n))).otherwise(F.array(told(first))))

    return _let(_grams(words), lambda g: once(g, lambda n: F.when(sure(n), second(n, g)).otherwise(none)))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_paragraphs, n_notices (paragraphs with a licence), licences (its families in order, once each), best (the greatest probability of a notice).

    All of it happens within a row: nothing is moved or grouped.
    """

    def windows(words: Column) -> Column:
        """Those windows of a paragraph that hold an anchor."""
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (WINDOW - STRIDE)), F.lit(STRIDE))
        return F.filter(F.transform(starts, lambda i: F.slice(words, i, WINDOW)), lambda w: _near(F.array_join(w, " "), model))

    def found(paragraph: Column) -> Column:
        words = F.regexp_extract_all(F.lower(paragraph), F.lit(WORDS), F.lit(0))
        return _let(words, lambda w: F.flatten(F.transform(windows(w), lambda x: notices(x, model))))

    paragraphs = F.filter(F.split("text", PARAGRAPHS), lambda x: F.trim(F.translate(x, "\n\r\t", "   ")) != "")
    near = F.when(_near(F.col("text"), model), F.filter("paragraphs", lambda x: _near(x, model))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("paragraphs", paragraphs)
    rows = rows.select("id", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.filter(F.transform(near, found), lambda x: F.size(x) > 0).alias("found"))
    rows = rows.withColumns({"n_notices": F.size("found").cast("long"), "found": F.flatten("found")})
    families = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))
    return rows.select("id", "n_paragraphs", "n_notices", F.array_join(families, ",").alias("licences"), F.array_max(F.transform("found", lambda x: x["probability"])).alias("best"))


def confirmed(paragraph: str, model: Model) -> list[str]:
    """The families that ``scan`` finds in a paragraph, in plain Python."""
    out = set()
    for words in windows_of(words_of(paragraph)):
        grams = grams_of(words)
        for _ in range(2):
            p = model.probabilities_of(grams)
            family = max(p, key=p.get)
            share, template = best_template(grams, family) if family != UNKNOWN else (0.0, [])
            if family == UNKNOWN or p[family] < LEAST_PROBABILITY or share < LEAST_SHARE:
                break
            out.add(family)
            grams = grams - set(template)
    return sorted(out)
