"""Licence notices: the plan against plain Python, and the classifier against notices that it has not seen."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import license_scan as ls

MIT = " ".join(ls.TEMPLATES["mit"][2:])
GPL = " ".join(ls.TEMPLATES["gpl-3.0"][1:3])
TEXTS = [
    None, "", "\n\n", "Licensed under the Apache License, Version 2.0.", "x y\nReleased under the MIT License.\nThe license of the of.", "All rights reserved.",
    "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "the general public of the version", "license", "MIT", "apache",
    "Licensed under the GNU\nGeneral Public License,\nversion 3.\n\nThat was all.\n \n\t\nReleased under the MIT License. And also licensed under the Apache License, Version 2.0.",
    "\n".join(MIT.split()) + "\n\n" + "prose of the sea and the town " * 30 + GPL + " more of the sea and the town" * 20 + " Licensed under CC BY 4.0.", "<b>MIT-licensed</b> mit.license, apache+mit",
    "The poet's licence was reserved for all the rights.", "w " * 30_000 + "\nLicensed under CC BY 4.0.",
]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return ls.train(ls.sample(docs))


def plain(text, model):
    """Paragraphs, and the families of each that has any."""
    paragraphs = [p for p in re.split(ls.PARAGRAPHS, text or "") if p.strip(" \n\r\t")]
    return paragraphs, [f for f in (ls.confirmed(p, model) for p in paragraphs) if f]


def test_plan_equals_plain_python(spark, model):
    df = spark.createDataFrame([(i, t, "n", 3) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "n", 3)], "doc_id long, text string, found string, n_notices int")
    for r in ls.scan(df, model).collect():
        paragraphs, found = plain(TEXTS[r["id"]], model)
        assert (r["n_paragraphs"], r["n_notices"], r["licences"]) == (len(paragraphs), len(found), ",".join(sorted({f for x in found for f in x}))), TEXTS[r["id"]]
        assert (r["best"] is None) == (not found)
    assert ls.scan(df.limit(0), model).collect() == []


def test_families(model):
    seen = {
        "Licensed under the Apache License, Version 2.0.": ["apache-2.0"], "Released under the MIT License.": ["mit"], "Licensed under CC BY-NC 4.0.": ["cc-by-nc-4.0"], "All rights reserved.": ["proprietary"],
        "This work is licensed under the GNU General Public License, version 3.": ["gpl-3.0"], "(c) 2011 the authors. Licensed under the MIT License.": ["mit"],
        "This tool is distributed under the Apache License 2.0": ["apache-2.0"], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": ["mit"],
        "Licensed under the GNU\nGeneral Public License, version 3.": ["gpl-3.0"], "Released under the MIT License, or licensed under the Apache License, Version 2.0, as you like.": ["apache-2.0", "mit"],
        "It was long ago. " * 40 + "All rights reserved. " + "It was long ago. " * 40 + "Licensed under CC BY 4.0.": ["cc-by-4.0", "proprietary"],
    }
    assert {k: ls.confirmed(k, model) for k in seen} == seen
    for text in ("They reserved all the seats.", "The public was free to go, and the version was general.", "He is licensed to drive under the bridge.", "mit der Lizenz"):
        assert ls.confirmed(text, model) == [], text


@pytest.mark.parametrize("family", sorted(ls.TEMPLATES))
def test_whole_texts_over_many_lines(model, family):
    """A family's own texts, broken every few words, in capitals here and there, are found, and hardly another family."""
    for text in ls.TEMPLATES[family]:
        words = text.split()
        broken = "\n".join(" ".join(w.upper() if k % 3 == 0 else w for k, w in enumerate(words[i : i + 7])) for i in range(0, len(words), 7))
        got = ls.confirmed(broken, model)
        assert family in got and len(got) <= 2, (text, got)


def test_probabilities_are_calibrated(spark, model):
    """On windows that were not learned from: of those given a probability of about p, a share of about p is of that family."""
    rng = np.random.default_rng(99)
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy(F.md5(F.col("doc_id").cast("string"))).limit(400).collect()]
    named = re.compile(r"licen[sc]e|rights reserved|licensed", re.I)
    clean = [w for t in docs if t and not named.search(t) for w in ls.windows_of(ls.words_of(t))]
    prose = [w for ws in clean for w in ws]
    cases = [(w, ls.UNKNOWN) for w in clean[:700]]
    for family, texts in ls.TEMPLATES.items():
        for words in map(ls.words_of, texts):
            for _ in range(10):
                n = max(3, int(min(len(words), ls.WINDOW) * rng.uniform(0.3, 1)))
                a = int(rng.integers(0, len(words) - n + 1))
                around = [str(x) for x in rng.choice(prose, int(rng.integers(0, ls.WINDOW - n + 1)))]
                cut = int(rng.integers(0, len(around) + 1))
                cases.append(([*around[:cut], *words[a : a + n], *around[cut:]], family))
    chance, right = [], []
    for words, family in cases:
        p = model.probabilities_of(ls.grams_of(words))
        best = max(p, key=p.get)
        chance.append(p[best])
        right.append(best == family)
    chance, right = np.array(chance), np.array(right)
    bins = np.minimum((chance * 10).astype(int), 9)
    error = sum(abs(chance[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist()))
    assert error < 0.08 and right.mean() > 0.85
    assert right[: len(clean[:700])].mean() > 0.99  # prose is unknown


def test_anchors_lose_nothing(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: ",".join(sorted({f for x in plain(r["text"], model)[1] for f in x})) for r in docs}
    got = {r["id"]: r["licences"] for r in ls.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), model).collect()}
    assert got == want
    named = {"apache license, version": "apache-2.0", "mit license": "mit", "cc by-nc": "cc-by-nc-4.0", "all rights reserved": "proprietary", "gnu general": "gpl-3.0"}
    for r in docs:
        assert want[r["doc_id"]] == ",".join(sorted({f for k, f in named.items() if k in r["text"].lower()})), r["doc_id"]


def test_sample_is_bounded_and_from_all_over(spark, monkeypatch):
    monkeypatch.setattr(ls, "SAMPLE_DOCS", 5)
    df = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(200))) for i in range(100)] + [(None, None), (None, ""), (7, "x" * 5000)], "doc_id long, text string")
    got = ls.sample(df)
    assert 5 <= len(got) <= 25 and all(len(ls.words_of(x)) <= ls.WINDOW for x in got) and any("w199" in x for x in got)
    assert ls.sample(df.limit(0)) == []
