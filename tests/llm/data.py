"""Small tables for tests of the training text operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=None):
    """(doc_id, text) pairs as a documents table; ``extra`` names a column that may clash."""
    full = [(i, t, None, "src", None if t is None else len(t)) for i, t in rows]
    schema = DOCS
    if extra:
        full = [(*r, 7) for r in full]
        schema += f", `{extra}` int"
    return spark.createDataFrame(full, schema)


def prose(seed, words, vocabulary=400, line=12):
    """Lines of invented words."""
    draw = random.Random(seed)
    names = [f"w{draw.randrange(vocabulary)}x" for _ in range(words)]
    return "\n".join(" ".join(names[k:k + line]) for k in range(0, words, line))


def edited(text, seed, edits):
    """``text`` with some words replaced."""
    draw = random.Random(seed)
    lines = [line.split(" ") for line in text.split("\n")]
    places = [(i, j) for i, line in enumerate(lines) for j in range(len(line))]
    for i, j in draw.sample(places, edits):
        lines[i][j] = f"e{draw.randrange(10 ** 6)}"
    return "\n".join(" ".join(line) for line in lines)


def odd_rows():
    """Nulls, empty and blank texts, a long one, ties and repeated rows."""
    long = prose(99, 9000)
    return [(None, "one null id here with some words in it"), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long),
            (6, "a b c"), (7, "a b c"), (8, prose(8, 60)), (8, prose(8, 60)), (9, "ünïcödé Ω 漢字   x"), (None, None)]
