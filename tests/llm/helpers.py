"""Small tables with the awkward cases every operator has to stand."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(6000))
PARA = " ".join(f"shared{i}" for i in range(60))

# doc_id, text, lang, source, n_chars and columns whose names the operators use inside
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1),
    (2, "the quick brown fox  jumps\tover the lazy dog", "en", "b", 1),
    (3, "The quick brown fox jumps over the lazy dog", "en", "b", 1),
    (4, "", "en", "a", 0),
    (5, None, None, None, None),
    (6, " \n\t ", "en", "c", 4),
    (7, "one", "en", "c", 3),
    (8, "one two", "en", "d", 7),
    (9, LONG, "en", "a", len(LONG)),
    (10, LONG + " tail", "en", "a", len(LONG)),
    (11, "first line\n" + PARA + "\nlast line", "en", "d", 1),
    (12, PARA + "\nother end", "de", "é", 1),
    (12, PARA + "\nother end", "de", "é", 1),
    (None, "one", "en", "z", 3),
    (None, None, "en", None, 0),
    ((1 << 60) + 1, "big id", "en", "z", 6),  # no float holds it
    (13, "a b c\nd e f\ng h i\nj k l", "en", "z", 1),
    (14, "x y\na b c\n\nd e f\ng h i\nend", "en", "z", 1),
    (15, "x\nx\nx\nx\nx\nx\nx", "en", "z", 1),
]

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "size bigint, k string, fp bigint, kept boolean, id bigint, hit int, copy int, d string")


def awkward(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "k", 2, True, 3, 4, 5, "d") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]
