"""Line tables for tests."""


def lines_df(spark, texts, part=0, file=""):
    """A line table from a list of physical lines (one file)."""
    rows = [(part, file, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "part long, file string, line_no long, line string")
