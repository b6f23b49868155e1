"""Small tables with the odd cases that every operator has to stand."""

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    "The cat sat on the mat, and the cat sat still.", "The cat sat on the mat, and the cat sat still.", "", None, " \t\n ", "one", "one two", LONG,
    "Ünïcode ÉCOLE İstanbul ß ½ 日本 😀", "a  b   c\n\n d \n e", "<|endoftext|> is text <|startoftext|>", "THE CAT SAT ON THE MAT, AND THE CAT SAT STILL.",
    "x\x1cy\x85z\xa0w", "don't we'll 'tis 12345 6,789.00", "tab\tand\rreturn\r\nline", "trailing space ",
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, length long, ids string"


def documents(spark, texts=None, copies=1, nameless=0):
    """Rows with clashing extra columns, and a null source, lang and n_chars here and there; ``nameless`` rows with a null id come last."""
    texts = TEXTS if texts is None else texts
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 3}" if i % 4 else None, None if t is None else len(t), 0.5, i, "z") for k in range(copies) for i, t in enumerate(texts)]
    rows += [(None, "a text without an id", "en", "src1", 20, 0.5, 0, "z")] * nameless
    return spark.createDataFrame(rows, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def write(df, folder, name="documents"):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
