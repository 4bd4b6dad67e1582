"""Line-first cleaning: lines are judged one by one, failing ones go, and a text that loses too much of itself goes too.

Only built-in functions; no shuffle at all, so every task works within its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagfield.llm.common import BLANKS, let, words

#: Characters that count as symbols, and phrases of boilerplate lines (lower case).
SYMBOLS = "#*$%&|<>"
BOILERPLATE = [
    "all rights reserved",
    "licensed under",
    "released under the",
    "this work is licensed",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "we use cookies",
    "accept cookies",
    "enable javascript",
    "lorem ipsum",
    "click here",
    "share on",
    "sign up for",
]

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SHOUT_PERCENT = 30
MAX_BARS_PERCENT = 20
MAX_PHRASE_PERCENT = 20
SHORT_WORDS = 3
MAX_LOST_PERCENT = 50


def _marked(ws: Column) -> Column:
    """Words that end in two or more of the marks that sentences do not double."""
    return F.size(F.filter(ws, lambda w: w.rlike(r"[#*$%&|<>!?]{2}$")))


def _bars(ws: Column) -> Column:
    """Words that are only separators of a navigation line."""
    return F.size(F.filter(ws, lambda w: w.isin("|", ">", "<", "»", "«", "·", "•", "/", "::")))


def line_facts(line: Column) -> Column:
    """``line``, whether it ``fails`` a rule by itself, and whether it is ``short``.

    * punctuation: over 30% of its words end in doubled marks (``word!!``, ``word###``), or it has no letter or digit
    * navigation: over 20% of its words are separators
    * boilerplate: phrases of ``BOILERPLATE``, each counted once, are over 20% of its characters
    A short line has up to three words and does not end a sentence; a heading is one, and so is an entry of a menu.
    A line without a word is neither; it carries no text to lose.
    """

    def judge(ws):
        n = F.size(ws)
        low = F.lower(line)
        phrases = F.aggregate(
            F.array(*map(F.lit, BOILERPLATE)),
            F.lit(0),
            lambda sum_, p: sum_ + F.when(F.contains(low, p), F.char_length(p)).otherwise(0),
        )
        fails = (n > 0) & (
            (100 * _marked(ws) > MAX_SHOUT_PERCENT * n)
            | ~line.rlike(r"[\p{L}\p{N}]")
            | (100 * _bars(ws) > MAX_BARS_PERCENT * n)
            | (100 * phrases > MAX_PHRASE_PERCENT * F.char_length(line))
        )
        short = (n > 0) & (n <= SHORT_WORDS) & ~line.rlike(r"[.!?:;,\"')\]…]\s*$")
        return F.struct(line.alias("line"), fails.alias("fails"), short.alias("short"))

    return let(words(line), judge)


def _in_run(facts: Column, i: Column) -> Column:
    """True for a short line among three or more short lines one after another: a menu, not a heading."""
    near = {k: F.coalesce(F.get(facts, i + k)["short"], F.lit(False)) for k in (-2, -1, 1, 2)}
    return (near[-2] & near[-1]) | (near[-1] & near[1]) | (near[1] & near[2])


def sound_lines(text: Column) -> Column:
    """The lines of a text that neither fail by themselves nor are short ones in a run."""

    def kept(facts):
        stay = F.filter(facts, lambda f, i: ~(f["fails"] | (f["short"] & _in_run(facts, i))))
        return F.transform(stay, lambda f: f["line"])

    return let(F.transform(F.split(text, "\n"), line_facts), kept)


def repeated_words(ws: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array ``ws``.

    Windows are compared by 64-bit hash.  Texts without any repeated window, told by the number of distinct hashes,
    skip the sort.  A sort brings equal windows together; their places are then swept once in order.
    """

    def of_windows(h):
        def swept(pairs):
            again = F.filter(pairs, lambda p, i: _same(pairs, p, i))
            return F.sort_array(F.transform(again, lambda p: p["i"]))

        def cover(starts):
            # a window adds three words less those that the window before it has covered
            return F.aggregate(
                F.transform(
                    starts,
                    lambda s, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), s - F.get(starts, i - 1))),
                ),
                F.lit(0),
                lambda a, x: a + x,
            )

        pairs = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, swept), cover))

    def of_words(w):
        n = F.size(w)
        windows = F.transform(
            F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )
        return let(windows, of_windows)

    return let(ws, of_words).cast("long")


def _same(pairs, p, i):
    before, after = F.get(pairs, i - 1), F.get(pairs, i + 1)
    return F.coalesce(before["h"] == p["h"], F.lit(False)) | F.coalesce(after["h"] == p["h"], F.lit(False))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of a text: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    null counts as the empty text, which has no words and fails.  Columns of ``df`` stay; equal names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    ws = words(F.col(text))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns(
        {
            "n_words": F.size(ws).cast("long"),
            "word_chars": F.char_length(F.regexp_replace(whole, BLANKS, "")).cast("long"),
            "n_symbols": (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(ws),
        }
    )
    return df.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``clean_text`` (failing lines gone), ``n_lines``, ``n_lines_removed``, ``chars_removed``, ``lost_too_much``.

    ``chars_removed`` counts characters of words.  A text loses too much when over half of them go.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    solid = lambda c: F.char_length(F.regexp_replace(c, BLANKS, ""))
    df = df.withColumn("__kept__", sound_lines(whole)).withColumns(
        {
            "clean_text": F.array_join("__kept__", "\n"),
            "n_lines": F.size(F.split(whole, "\n")).cast("long"),
            "__left__": F.size("__kept__").cast("long"),
        }
    )
    df = df.withColumns(
        {
            "n_lines_removed": F.col("n_lines") - F.col("__left__"),
            "chars_removed": (solid(whole) - solid(F.col("clean_text"))).cast("long"),
        }
    )
    return df.withColumn(
        "lost_too_much", 100 * F.col("chars_removed") > MAX_LOST_PERCENT * solid(whole)
    ).drop("__kept__", "__left__")


def quality_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Both together, with ``kept``: false if the base measures fail, else the verdict of the lines.

    null and empty texts are rejected; copies and ties get equal verdicts; an empty table gives an empty one; further
    columns pass through, and columns that are named like a result are replaced.
    """
    df = clean_lines(measure(df, text), text)
    return df.withColumn("kept", ~F.col("base_failed") & ~F.col("lost_too_much"))
