import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_words string, _text string, toxicity int, record int"


@pytest.fixture(scope="session", autouse=True)
def package(spark):
    from pulseline.llm.common import ship_package

    ship_package(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names clash with those that operators use."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", len(t or ""), "x", "y", "z", 1, 2) for i, t in rows], DOC_SCHEMA
        )

    return make


PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of silver mist and old songs drift "
    "through the valley where nobody has walked since the last harvest moon rose above the quiet mill"
)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, one long text."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    return [(1, PROSE), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (None, "no id here"), (5, PROSE), (5, PROSE), (6, long), (7, "one"), (8, "naïve ßtraße ‚quoted’ 漢字 🙂 \x01 end")]
