import zlib

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, did string, th int, h string, size string, first int, shard string, row string, part string"


def words(n, start=0, tag="w"):
    return " ".join(f"{tag}{(i * 7919 + start) % 100003}" for i in range(n))


def rows():
    """Nulls in every column, empty, blank, very long and repeated texts, copies, near copies, and clashing names."""
    base = words(120, 5)
    out = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, base + " tail of it", "en", "a"), (4, None, "en", "a"), (5, "", None, None), (6, " \t\n ", "fr", "a"),
        (None, "no id here " + words(60, 900), "en", "a"), (8, words(60_000, 11), "de", "b"), (9, words(30, 77), "de", None), (9, words(30, 77), "de", None),
        (10, "one two three", "en", "c"), (11, "ONE two three", "en", "c"), (12, "é" * 300, "fr", "c"), (13, "a" * 700, "fr", "c"), (14, "x\nsame line here\nother line there\nx\nsame line here\nother line there", "en", "c"),
        (15, "Licensed under the Apache License, Version 2.0.\n" + words(40, 3), "en", "d"), (16, words(40, 31), "en", "d"),
    ]
    near = words(200, 40).split()
    for k in range(8):
        t = list(near)
        t[20 * k + 3] = f"edit{k}"
        out.append((20 + k, " ".join(t), "en", "hot"))
    return [(i, t, lang, src, len(t) if t is not None else None, "x", 1, "h", "s", 1, "sh", "r", "p") for i, t, lang, src in out]


BENCH = [(1, words(20, 5).upper()), (2, "one two"), (3, None), (None, words(12, 11)), (3, words(9, 77)), (5, "!!!"), (6, words(8, 40))]


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(rows(), COLUMNS).repartition(3).write.parquet(f"file://{d}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"file://{d}/benchmark.parquet")
    return f"file://{d}"


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], COLUMNS).write.parquet(f"file://{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{d}/benchmark.parquet")
    return f"file://{d}"


@pytest.fixture(scope="session")
def docs():
    return [(r[0], r[1]) for r in rows()]


def crc(i):
    return zlib.crc32(str(i).encode())
