"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import numbered, text_of

BLANK = r"[\x20\x09-\x0D]"
#: Very frequent words of the corpus languages.
STOP_WORDS = ("the of and to in is that it was for on are with as at be this have from or "
              "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
              "le la les de des et en un une du que est pour qui dans par sur au ce pas "
              "el los las y a del se por con no su para lo una al es").split()  # fmt: skip

#: (rule, numerator, denominator, lower bound or None, upper bound or None, words needed before it applies).
#: Names are measures of signals(); a rule fails outside its bounds.
THRESHOLDS: list[tuple[str, str, str, float | None, float | None, int]] = [
    ("word_length", "word_chars", "n_words", 2.0, 18.0, 0),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.2, 0),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5, 0),
    ("capitals", "n_capitals", "word_chars", None, 0.5, 0),
    ("pipes_per_word", "n_pipes", "n_words", None, 0.25, 0),
    ("stop_words", "n_stop_words", "n_words", 0.01, None, 100),
]



MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_pipes", "n_stop_words")


def signals(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds MEASURES as columns named _q_n_words and so on; docs may have no columns with that beginning.

    Words are runs without blanks (space, tab to carriage return). Null texts have no words. A repeated five-word
    window is one whose 64-bit hash occurs twice; only texts that have one sort their windows to mark the words.
    Arrays that are used more than once are columns of their own, which the optimiser leaves in place.
    """
    has_word = lambda s: s.rlike(r"[^\x20\x09-\x0D]")
    src = docs.withColumn("_q_t", text_of(text_col))
    src = src.withColumns({"_q_w": F.filter(F.split("_q_t", f"{BLANK}+"), lambda w: w != ""), "_q_lines": F.filter(F.split("_q_t", "\n"), has_word)})
    n, w = F.size("_q_w"), F.col("_q_w")
    src = src.withColumn("_q_h", F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5))))).otherwise(F.array().cast("array<bigint>")))
    src = src.withColumn("_q_twice", F.size("_q_h") > F.size(F.array_distinct("_q_h")))
    src = src.withColumn("_q_p", F.when(F.col("_q_twice"), F.sort_array(F.transform("_q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p = F.col("_q_p")
    hash_at = lambda i: F.get(p, i)["h"]
    marked = F.transform(p, lambda x, i: F.when(((i > 0) & (hash_at(i - 1) == x["h"])) | ((i + 1 < F.size(p)) & (hash_at(i + 1) == x["h"])), x["i"]))
    src = src.withColumn("_q_at", F.when(F.col("_q_twice"), F.sort_array(F.array_compact(marked))))
    at = F.col("_q_at")
    # each marked window adds its words beyond the previous window's end
    added = F.transform(at, lambda x, i: F.when(i == 0, F.lit(5)).otherwise(F.least(F.lit(5), x - F.get(at, i - 1))))
    covered = F.coalesce(F.aggregate(added, F.lit(0), lambda a, x: a + x), F.lit(0))
    without = lambda pattern: F.length("_q_t") - F.length(F.regexp_replace("_q_t", pattern, ""))
    found = {
        "n_words": n,
        "word_chars": F.length(F.regexp_replace("_q_t", f"{BLANK}+", "")),
        "n_symbols": without(r"[#*$%&|<>]"),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": covered,
        "n_lines": F.size("_q_lines"),
        "n_capitals": without(r"\p{Lu}"),
        "n_pipes": without(r"\|"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))),
    }
    return src.withColumns({f"_q_{k}": v.cast("long") for k, v in found.items()}).drop("_q_t", "_q_w", "_q_lines", "_q_h", "_q_twice", "_q_p", "_q_at")


def verdicts(thresholds: list[tuple] | None = None) -> tuple[Column, Column]:
    """(base_failed, kept) over the columns of signals()."""
    c = lambda name: F.col(f"_q_{name}")
    failed = (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))
    kept = ~failed
    for _, top, bottom, low, high, least in THRESHOLDS if thresholds is None else thresholds:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (c(top) >= low * c(bottom))
        if high is not None:
            inside = inside & (c(top) <= high * c(bottom))
        kept = kept & ((c("n_words") < least) | inside)
    return failed, kept


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", thresholds: list[tuple] | None = None) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed and kept.

    Null and empty texts have no words and fail. Repeated rows give repeated results; other columns are ignored.
    """
    rows = signals(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    failed, kept = verdicts(thresholds=thresholds)
    return rows.select("doc_id", *(F.col(f"_q_{m}").alias(m) for m in MEASURES), failed.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, *, text_col: str = "text", thresholds: list[tuple] | None = None) -> DataFrame:
    """The documents that pass every rule, columns unchanged, whatever their names."""
    plain, (text,) = numbered(docs, text_col)
    # a filter on a generated column stays above the measures; pushed below, it would repeat all their expressions
    kept = F.explode(F.array(verdicts(thresholds=thresholds)[1]))
    good = signals(plain, text_col=text).withColumn("_q_kept", kept).filter("_q_kept")
    return good.select(*plain.columns).toDF(*docs.columns)
