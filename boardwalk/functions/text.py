"""Text expressions: trimming, literal substring tests, word tokens and word-edge marking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character str.strip() removes; plain trim() knows only the blank.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# A word character: letters, numbers and underscore, but no combining marks.
# The plain ranges come first because they are the cheap test.
WORD = r"[a-z0-9A-Z_\p{L}\p{N}]"
NOT_WORD = r"[^a-z0-9A-Z_\p{L}\p{N}]"
EDGE = "\u0001"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def word_list(words: list[str]) -> Column:
    """A fixed list as an array literal."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"array({quoted})")


def contains_any(text: Column, needles: list[str]) -> Column:
    """Literal substring test against a list known when the plan is built."""
    return text.rlike("|".join(rf"\Q{n}\E" for n in needles)) if needles else F.lit(False)


def first_hit(text: Column, needles: list[str]) -> Column:
    """Position of the first needle contained in text, null when none is."""
    hits = F.transform(word_list(needles), lambda n: F.contains(text, n))
    return F.nullif(F.array_position(hits, True), F.lit(0)).cast("int") - 1


def hits_any(text: Column, needles: Column) -> Column:
    """Literal substring test against an array column; empty needles never hit, null is no hit."""
    return F.coalesce(
        F.exists(needles, lambda n: (n != "") & F.contains(text, n)), F.lit(False)
    )


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))


def mark_edges(text: Column) -> Column:
    """Put a marker at every word edge of the text: before and after each run of word characters.

    A keyword occurs between two word edges exactly when its own marked form, with a marker at
    both ends, is a substring of the marked text: edges inside the keyword depend only on its
    own characters. One pass per text then replaces one regular expression per keyword.
    A marker already in the text becomes another control character first.
    """
    return F.regexp_replace(F.translate(text, EDGE, "\u0002"), f"({WORD}+)", f"{EDGE}$1{EDGE}")


def mark_keyword(keyword: Column) -> Column:
    """Marked form of a lower-cased keyword: both ends carry an edge. The empty keyword becomes
    a lone marker, so it hits every text that has a word character at all."""
    inner = F.regexp_replace(mark_edges(keyword), f"^{EDGE}|{EDGE}$", "")
    return F.when(keyword == "", F.lit(EDGE)).otherwise(F.concat(F.lit(EDGE), inner, F.lit(EDGE)))


def word_tokens(text: Column) -> Column:
    """Distinct maximal runs of word characters."""
    return F.array_distinct(F.filter(F.split(text, f"{NOT_WORD}+"), lambda w: w != ""))


def anchor_token(keyword: Column) -> Column:
    """Longest word run of a keyword, null when it has none. Each run of a keyword is a whole
    token of any text the keyword hits, so an equality join on the anchor loses nothing."""
    runs = word_tokens(keyword)
    best = F.aggregate(
        runs,
        F.lit("").cast("string"),
        lambda acc, w: F.when(F.length(w) > F.length(acc), w).otherwise(acc),
    )
    return F.nullif(best, F.lit(""))
