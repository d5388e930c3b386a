from __future__ import annotations

import os
import random

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, long and repeated texts, repeated rows, and extra columns that clash with inner names."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "el", "su"]) for _ in range(rng.randrange(1, 4)))
    text = [" ".join(word() for _ in range(rng.randrange(5, 80))) for _ in range(25)]
    text += [None, "", "   \n\t ", "a", "x " * 30000, "\n".join(["same line here"] * 40), text[0], text[0] + " more", "é漢字 🎉 " * 50, "\x00\x01 <s>[INST]</s>"]
    rows = [(i, t, "en" if i % 2 else None, "src", 1.0, 2, 3, 4) for i, t in enumerate(text)]
    rows += [(None, text[1], "en", None, None, 1, 2, 3), rows[2], rows[2]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, fp int, doc int, ranges int")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(30)] + [(None, 1, 1), (3, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def big_dir():
    return os.environ.get("TEST_BIG_DIR", "/root/testdata/sf0.01")
