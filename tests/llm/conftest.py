from __future__ import annotations

import pyarrow.parquet as pq
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SMALL = "/root/testdata/sf0.01"

ODD_TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "ÀB İstanbul STRASSE straße ΣΑΣ",
    "a\x00b  wide space\x1funit",
    "x " * 4 + "x",
    "same words here again and " * 6,
    "long " * 3000 + "".join(chr(97 + i % 26) for i in range(5000)),
    "𝔘𝔫𝔦 code 😀 password=hunter22 tail",
]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    rows = [(i, text, "en", f"s{i % 3}", 1) for i, text in enumerate(ODD_TEXTS)]
    rows += [(100, "a null source and a null language", None, None, None), (None, "no id at all here", "en", "s0", 3)]
    return rows + rows[6:8] + [(None, None, None, None, None)]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def small_rows():
    return pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
