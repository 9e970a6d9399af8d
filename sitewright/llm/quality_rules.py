"""Quality rules: a threshold table compiled into one projection; built-in functions only.

Nulls and empty texts have no words: every count is 0, ``base_failed`` is true and ``kept`` false.  Repeated
rows are judged one by one, an empty table gives an empty result, other columns are left out.  The text is
scanned in its own row: no shuffle, no user function, and no limit on its length.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

# Frequent function words of English, French, German and Spanish, lower case.
STOP_WORDS = (
    "the of and to in a is that it for on with as are this be by was from or at an not "
    "le la les de des du un une et que qui dans pour par sur est au avec en "
    "der die das und ein eine einen von zu im den mit auf ist für nicht dem "
    "el los las del y se por con para su al lo como más"
).split()

# (measure, lowest, highest); None is no bound.  A document is kept if every measure is inside.
THRESHOLDS = (
    ("mean_word_chars", 2.0, 16.0),
    ("symbol_ratio", None, 0.10),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.50),
)


def _window_hashes(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""

    def of_sorted(s: Column) -> Column:
        again = F.filter(
            F.transform(
                s,
                lambda x, k: F.when(
                    (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return let(F.sort_array(again), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)


def measure(df: DataFrame) -> DataFrame:
    """doc_id with the counts that the rules use."""
    rows = pick(df, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    w, t = F.col("words"), F.col("text")
    rows = rows.withColumn("words", F.array_remove(F.split(t, SPACE), ""))
    rows = rows.withColumn("lines", F.when(F.instr(t, "\n") > 0, F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    rows = rows.withColumn("wins", F.when(F.size(w) > WINDOW, _window_hashes(w)))
    distinct = F.size(F.array_distinct("wins"))
    return rows.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.col("lines").isNotNull(), F.size("lines") - F.size(F.array_distinct("lines"))).otherwise(0).cast("long").alias("n_dup_lines"),
        F.when(F.col("wins").isNull() | (distinct == F.size("wins")), 0).otherwise(_covered(F.col("wins"))).cast("long").alias("n_repeat_words"),
        F.when(F.col("lines").isNotNull(), F.size("lines")).otherwise(1).cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop"),
    )


def verdict(measured: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The threshold table as one boolean expression."""
    ratios = {
        "mean_word_chars": F.try_divide(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": F.try_divide(F.col("n_symbols"), F.col("word_chars")),
        "stop_ratio": F.try_divide(F.col("n_stop"), F.col("n_words")),
        "dup_line_ratio": F.try_divide(F.col("n_dup_lines"), F.col("n_lines")),
    }
    inside = F.lit(True)
    for name, low, high in thresholds:
        value = F.coalesce(ratios[name], F.lit(0.0))
        inside = inside & (F.lit(True) if low is None else value >= low) & (F.lit(True) if high is None else value <= high)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("kept", ~base & inside)


def quality_rules(df: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    return verdict(measure(df), thresholds)
