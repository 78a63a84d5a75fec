"""Quality rules: line-first cleaning, then rejection of documents that lost too much text.

Everything is a built-in expression inside one projection: no shuffle, no Python, one document per row, so a hot
source or a group of copies costs nothing beyond its own rows.

Defined results: null text counts as empty; an empty text has no words, fails the base rules and isn't kept; very long
texts are handled whole, in time near-linear in their length; repeated rows and ties are judged row by row; an empty
table gives an empty result; input columns named like an output column are replaced by it, other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"

# Phrases that mark a line as site boilerplate.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "log in to",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share on facebook",
    "share on twitter",
    "sign up for",
    "skip to content",
    "subscribe to our",
    "terms of service",
    "terms of use",
)

#: A window of this many words, found twice, marks its words as repeated.
WINDOW = 5
#: A document must keep this percentage of its characters after line cleaning.
MIN_KEPT_PERCENT = 50
#: A line fails beyond this percentage of symbol characters.
MAX_SYMBOL_PERCENT = 10
#: relative_line_fails: separators fail a line with fewer words than this for each of them.
WORDS_PER_SEPARATOR = 8
#: relative_line_fails: boilerplate phrases fail a line from this percentage of its characters.
BOILERPLATE_PERCENT = 10
#: A line without closing punctuation needs this many words, or it counts as a heading or a menu entry.
MIN_OPEN_LINE_WORDS = 4


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text without nulls."""
    return F.array_remove(F.split(text, SPACES), "")


def line_fails(line: Column) -> Column:
    """True where a line breaks the navigation, boilerplate, symbol, shouting or punctuation rule; lines without a word pass.

    Three separators or one phrase fail a line of any length, as in the query's SQL.
    """
    return _fails(line, _navigation(line), _boilerplate(line))


def relative_line_fails(line: Column) -> Column:
    """line_fails, but separators and phrases count by their share of the line, and guillemets in pairs are quotations."""
    unquoted = F.regexp_replace(line, "«[^«»]*»|»[^«»]*«|‹[^‹›]*›|›[^‹›]*‹", "")
    separators = F.length(F.regexp_replace(unquoted, "[^|»›·•]", ""))
    phrases = F.length(line) - F.length(F.regexp_replace(line, "(?i)" + "|".join(BOILERPLATE), ""))
    own_words = F.size(words(F.regexp_replace(line, "[|»›·•]", " ")))
    # the plain rules come first: few lines need the shares
    menu = _navigation(line) & (separators >= 3) & (separators * WORDS_PER_SEPARATOR > own_words)
    return _fails(line, menu, _boilerplate(line) & (phrases * 100 >= F.length(line) * BOILERPLATE_PERCENT))


def _navigation(line: Column) -> Column:
    return line.rlike(r"^(?:[^|»›·•]*[|»›·•]){3}")


def _boilerplate(line: Column) -> Column:
    return line.rlike("(?i)" + "|".join(BOILERPLATE))


def _fails(line: Column, navigation: Column, boilerplate: Column) -> Column:
    length = F.length(line)
    symbols = length - F.length(F.regexp_replace(line, r"[#*$%&|<>{}~^\\]", ""))
    shouts = length - F.length(F.regexp_replace(line, "!!", ""))
    return F.when(~line.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).otherwise(
        navigation
        | boilerplate
        | (symbols * 100 > length * MAX_SYMBOL_PERCENT)
        | (shouts * 100 > length * MAX_SYMBOL_PERCENT)
        | (
            ~line.rlike(r"[\p{P}][\x20\x09-\x0D]*$")
            & (F.size(words(line)) < MIN_OPEN_LINE_WORDS)
        )
    )


# Word positions under a window that occurs again: windows sorted as strings, equal neighbours marked, their positions
# merged. Bound by transform(array(x), s -> ...) so that the sorted array is built once.
_REPEATED = f"""
transform(
  array(sort_array(transform(sequence(0, size(_w) - {WINDOW}),
                             i -> struct(array_join(slice(_w, i + 1, {WINDOW}), ' ') AS w, i AS p)))),
  s -> aggregate(
    sort_array(transform(
      filter(sequence(0, size(s) - 1),
             j -> coalesce(get(s, j - 1).w = s[j].w, false) OR coalesce(get(s, j + 1).w = s[j].w, false)),
      j -> s[j].p)),
    struct(0 AS n, -{WINDOW} AS last),
    (a, p) -> struct(a.n + least({WINDOW}, p - a.last) AS n, p AS last),
    a -> a.n))[0]
"""


def judge(df: DataFrame, text: str = "text", fails: Callable[[Column], Column] = line_fails) -> DataFrame:
    """df plus cleaned_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    Hashes of the word windows decide cheaply whether any window can repeat (equal windows have equal hashes); only
    such documents are then counted with the windows themselves, so a hash collision changes nothing.
    """
    mine = ["cleaned_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    others = [c for c in df.columns if c not in mine]
    body = F.coalesce(F.col(text), F.lit(""))
    # the input's columns travel packed, so that none can clash with those of the steps
    row = F.struct(*others) if others else F.struct(F.lit(None).alias("_"))
    step = df.select(row.alias("_w_row"), body.alias("_w_text")).withColumn("_w", words(F.col("_w_text")))
    step = step.withColumn("_w_lines", F.split("_w_text", "\n"))
    step = step.withColumn(
        "_w_win",
        F.expr(
            f"CASE WHEN size(_w) >= {WINDOW} THEN transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64("
            + ", ".join(f"_w[i + {k}]" for k in range(WINDOW))
            + ")) ELSE array() END"
        ),
    )
    worded = F.filter("_w_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn("_w_worded", worded).withColumn(
        "cleaned_text", F.array_join(F.filter("_w_lines", lambda x: ~fails(x)), "\n")
    )
    step = step.select(
        "_w_row",
        "cleaned_text",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_w_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_w_text") - F.length(F.regexp_replace("_w_text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_w_worded") - F.size(F.array_distinct("_w_worded"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(array_distinct(_w_win)) = size(_w_win) THEN 0 ELSE {_REPEATED} END")
        .cast("long")
        .alias("n_repeat_words"),
        F.length("_w_text").alias("_w_length"),
    )
    step = step.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    kept = ~F.col("base_failed") & (F.length("cleaned_text") * 100 >= F.col("_w_length") * MIN_KEPT_PERCENT)
    return step.withColumn("kept", kept).select(*[F.col("_w_row").getField(c).alias(c) for c in others], *mine)


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """df without the documents that aren't kept, each text without its failing lines (relative rules); all columns of df.

    The verdict is taken on a packed row: as a condition on columns, the optimizer would push it down and evaluate
    every rule twice.
    """
    judged = judge(df.select(F.col(text), F.struct(*df.columns).alias("_row")), text, relative_line_fails)
    packed = F.array(F.struct("kept", "cleaned_text", "_row"))
    r = judged.select(F.explode(F.filter(packed, lambda r: r["kept"])).alias("r")).select("r.cleaned_text", "r._row")
    return r.select(*[F.col("cleaned_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in df.columns])
