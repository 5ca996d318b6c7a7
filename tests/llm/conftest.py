import sys
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(DATA).is_dir():
        pytest.skip("test tables aren't here")
    return DATA


@pytest.fixture(scope="session")
def odd_texts():
    return [
        None,
        "",
        " ",
        "one",
        "two words",
        "  a  b ",
        "a\n\nb  c\t d e f",
        "Same text here again",
        "Same text here again",
        "same TEXT here again",
        "<|endoftext|>x<|endoftext|> y",
        "don't  DON'T 'S i's, x!. .,",
        "日本語 テスト, ✨✨. é H̱ İ İ.",
        "x　y  z\u0085w\x1cv",
        "long " * 30_000,
        "z" * 50_000,
        "12 345 !!",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Texts at the edges, ids that are null or repeat, and columns named like results."""
    rows = [(k if k != 5 else None, t, "en" if k % 2 else None, "fp", 0.5, 1) for k, t in enumerate(odd_texts)]
    rows.append((8, odd_texts[8], "en", "x", None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string, score double, predicted int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
