#: Nulls, empty and blank texts, ties, repeated rows and ids, a long text; what every operator must stand.
ODD = [
    (3, None), (4, ""), (5, " \n\t"), (6, "same text here again"), (6, "same text here again"), (6, "other text"),
    (None, "no id at all"), (None, None), (7, "é ñ 漢字 😀 x" * 3), (8, "long word " * 30000), (9, "y" * 70000),
]
