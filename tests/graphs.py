"""Small graphs with answers worked out by hand."""

F1 = [(5, 6, 104), (3, 4, 71), (2, 4, 106), (1, 2, 116), (5, 8, 82), (1, 3, 128), (1, 4, 75), (6, 8, 109), (2, 3, 42), (8, 4, 78), (8, 6, 12), (5, 4, 44), (5, 3, 115)]
F2 = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (4, 3, 1), (2, 4, 2), (3, 4, 3), (4, 4, 1), (2, 5, 2), (3, 6, 3), (4, 7, 1), (5, 5, 2), (5, 6, 3), (6, 5, 1), (6, 7, 2), (7, 1, 3), (7, 2, 1), (7, 7, 2)]
F2_QUERIES = [["t4", "t3"], ["t3", "t4"], ["t2", "t3", "t4"]]
F3 = [(0, 1), (0, 2), (0, 5), (1, 3), (2, 3), (2, 5), (4, 5), (5, 2), (5, 6), (5, 8), (7, 8), (7, 9), (7, 10), (8, 6), (8, 9), (9, 10), (9, 11), (10, 5), (10, 6), (10, 12)]
F3_LABELS = ["O", "RS", "RS", "P", "O", "PM", "P", "O", "RS", "PM", "RS", "P", "P"]
Q1 = (["O", "RS", "PM", "P"], [(0, 1), (0, 2), (1, 2), (1, 3), (2, 1), (2, 3)])
Q2 = (["O", "RS", "PM", "P"], [(0, 1), (0, 2), (1, 2), (1, 3)])
Q3 = (["A", "B", "C", "D"], [(0, 1), (0, 2), (1, 3), (2, 3), (3, 1), (3, 0)])


def f1(spark, extra=()):
    """With a loop and a later repeat that change nothing."""
    rows = [*F1, (3, 3, 1), (5, 6, 9), *extra]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "src long, dst long, weight long, ord long")


def column(df, value, key="id"):
    return {r[key]: r[value] for r in df.collect()}
