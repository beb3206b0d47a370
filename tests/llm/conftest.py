import pytest

ODD = ["", None, "a", "  two  spaces ", "tab\there\n new\r\nline", " lead", "trail ", " nbsp   em", "x" * 3000, "don't  we'll I'M 12 345", "\x1c \x1f a b", "héllo wörld ñ", "日本語 テキスト 😀 ok", "a b c d e f g", "<|endoftext|> as text", "A B c", "The and attion " * 400, "!!! ??? ...", "12 34", "\n\n\n", "a b c d e f g"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, null and repeated ids, and further columns with clashing names."""
    rows = [(i * 3, t, "src%d" % (i % 3) if i % 4 else None, "en", "x", 1.5) for i, t in enumerate(ODD)]
    rows += [(3, None, "src1", None, None, None), (3, None, "src1", None, None, None), (None, "no id", None, "en", "y", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, ids string, score double").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
