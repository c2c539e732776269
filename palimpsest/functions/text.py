"""Text terms in built-in expressions.

A text is split at Unicode white space; of each piece the alphanumeric characters stay, with A-Z folded to lower case
(no other letters); empty pieces go. So `well-known` is one term, and a piece of punctuation doesn't part its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Unicode's White_Space, and what is neither alphanumeric nor white space; one rule for texts and for arguments.
SPACE, JUNK = r"\p{IsWhite_Space}", r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}]"


def padded(text: Column) -> Column:
    """The terms parted by one space, with one more at each end.

    What is neither alphanumeric nor white space goes first, then runs of white space become one space: the same terms as
    piece by piece, in two passes without an array.
    """
    kept = F.regexp_replace(text, f"{JUNK}+", "")
    spaced = F.trim(F.regexp_replace(kept, f"{SPACE}+", " "))
    return F.concat(F.lit(" "), F.translate(spaced, UPPER, LOWER), F.lit(" "))


def tokens(text: Column) -> Column:
    """The terms as an array."""
    return F.filter(F.split(F.trim(padded(text)), " "), lambda w: w != "")


def found(text: Column, terms: Column) -> Column:
    """Whether the text has the terms, parted by single spaces, side by side; nothing has none.

    One search of the text as it is, which builds no other text: before each character of a term there may be what doesn't
    count, and between terms white space. The expression is made of the argument alone, so Spark folds it to a constant.
    """
    letters = F.regexp_replace(terms, "([^ ])", f"{JUNK}*+".replace("\\", "\\\\") + "$1")
    gaps = F.replace(letters, F.lit(" "), F.lit(f"{JUNK}*+{SPACE}[{JUNK}{SPACE}]*+"))
    expression = F.concat(F.lit(f"(?i)(?:^|{SPACE})"), gaps, F.lit(f"{JUNK}*+(?:{SPACE}|$)"))
    return (terms != "") & F.regexp_like(text, expression)


def contains(text: Column, word: str) -> Column:
    """The text has the argument, whose spaces go as well, as a term; nothing has the empty term."""
    return found(text, F.replace(padded(F.lit(word)), F.lit(" "), F.lit("")))


def matches(text: Column, phrase: str) -> Column:
    """The text has the phrase's terms in order, side by side; nothing has the empty phrase."""
    return found(text, F.trim(padded(F.lit(phrase))))
