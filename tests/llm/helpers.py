"""Small tables with what operators must live through."""

import zlib

WORDS = "the of and in is was for by with from river stone green light paper ocean winter summer".split()


def prose(n, seed=0):
    return " ".join(WORDS[(seed * 7 + i * i + i) % len(WORDS)] for i in range(n))


#: doc_id, text, lang, source, n_chars, and columns whose names the operators use themselves.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, score string, norm int, held_out string, __hits int, __key int, __mark int, n_words int"
EXTRA = (1, "x", 2, "y", 3, 4, 5, 6)


def awkward(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows, one id with two texts."""
    rows = [
        (1, prose(60), "en", "a", 10),
        (2, prose(60).upper(), "en", "a", 10),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (None, prose(40, 3), "en", None, 5),
        (5, prose(80, 5), "en", "b", 9),
        (5, prose(80, 5), "en", "b", 9),
        (6, prose(50, 9), "de", None, 9),
        (6, prose(50, 11), None, "b", 9),
        (7, prose(60_000, 2), "en", "a", 9),
        (8, "  \n\n \t", "en", "a", 9),
        (9, "x", None, None, None),
        (None, None, None, None, None),
    ]
    return spark.createDataFrame([r + EXTRA for r in rows], COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
