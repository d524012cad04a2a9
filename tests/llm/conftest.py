import random
import re
from pathlib import Path

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A small corpus with nulls, blanks, copies, near copies, a long text and repeated rows."""
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "ko", "ri", "zu", "mé", "tha") for b in ("n", "lo", "st", "ter", "ing", "ß")]
    rows = []
    for k in range(60):
        text = " ".join(rnd.choice(words).capitalize() if rnd.random() < 0.2 else rnd.choice(words) for _ in range(rnd.randint(1, 90)))
        rows.append((k, text, "en", f"src{k % 4}", len(text)))
    long = " ".join(rnd.choice(words) for _ in range(4000))
    rows += [(60, long, "en", "src0", len(long)), (61, long + " tail", "en", "src0", None), (62, None, None, None, None), (63, "", "en", None, 0), (64, " \n\t ", "en", "src1", 4)]
    rows += [(65 + k, rows[7][1], "en", "src0", None) for k in range(25)]
    rows += [(3, rows[3][1], "en", "src3", None), (90, "x  y <|endoftext|> z \U0001f600 ２", "en", "é", None), (None, "no id here", "en", "src2", None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def clashing(docs):
    """The corpus with a further column for every name that stands anywhere in the operators."""
    from pyspark.sql import functions as F
    from vacantia import llm

    names = {n.lower() for p in Path(llm.__file__).parent.glob("*.py") for n in re.findall(r"\"([A-Za-z_]\w*)\"", p.read_text())} | {"_bench_text_", "_row", "copies"}
    assert {"_bench_spans", "_toxic_score", "size", "doc", "row", "_bench_text"} <= names
    return docs.select("*", *[F.lit("x").alias(n) for n in sorted(names - {*docs.columns})])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
