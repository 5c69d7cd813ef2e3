"""Documents with the hard cases that every operator has to stand: nulls, empty and long texts, ties, repeats, odd columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, norm string, _athenor_row int, `size.digits` int"


def hard_rows():
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(1, "a b c d e f"), (2, "a b  c d\te f"), (2, "a b  c d\te f"), (3, None), (4, ""), (5, "   "), (6, long), (7, long + " tail"), (None, "a b c d e f"), (8, None), (9, "é\x0b\x1cß 日本 ́x 😀\n\n ok"), (10, "x" * 5_000)]
    return [(i, t, None, None, None, 7, "clash", 8, 9) for i, t in rows]


def hard(spark, parts=3):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(parts).sortWithinPartitions("doc_id", "text")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def written(spark, df, tmp_path, name="docs"):
    """The same rows as a table, which lists its rows in one order whenever it is read."""
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def clashing(rows):
    """What every row of ``hard`` has in its further columns."""
    return {tuple(r)[2:] for r in rows} <= {(None, None, None, 7, "clash", 8, 9)}
