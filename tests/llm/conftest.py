import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that operators must bear: nulls, empty and blank texts, repeats, near copies, a very long text, clashing columns."""
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words[:120])
    long = " ".join(words[(i * 7 + i // 90) % 400] + ("." if i % 13 == 0 else "") for i in range(30_000))
    lines = "\n".join(f"this is line number {i} of a shared page, long enough" for i in range(12))
    rows = [
        (0, base), (1, base), (2, base.replace("w7 ", "w7x ")), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, "x"), (8, "Und Und " * 60),
        (9, lines), (10, "intro of another page with some text\n" + lines + "\nlast words, which differ from the rest"), (11, lines.replace("number 5", "number five")),
        (12, " ".join(words[200:320]) + " " + " ".join(words[:60])), (13, "ÀÉ naïve café — 日本語 text, don't stop\n\nnow\r\nhere  twice"), (13, "the same id again with other text"), (13, "the same id again with other text"),
        (None, base), (14, long[:5000] + " " + base), (15, "a b c d e f g h i j k l"), (16, "q a b c d e f g h i j r"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clash = {c: "clash" for c in ("tk", "fp", "gone", "hits", "kept", "low", "n_lines", "line", "rep", "trusted_id", "_id")}
    from pyspark.sql import functions as F

    return frame.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")} | {k: F.lit(v) for k, v in clash.items()})


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 0), (6, 1, 0), (9, 1, 1), (8, 0, 0), (None, 1, 0), (0, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
