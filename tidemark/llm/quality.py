"""Quality rules with host verdicts.

Each text gets counts and the rules that it fails. The failures are summed by host (``source``), each host's failure rate
is shrunk towards the corpus by a beta prior whose strength is fitted to the spread of the hosts' own rates, and hosts whose
shrunk rate is too high lose all documents that fail any softer rule as well.
"""
from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, space_words
from tidemark.sources.tables import materialize

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Softer rules: they count towards a host's rate and decide only in hosts that are rejected.
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINE_SHARE = 0.3
MAX_MEAN_WORD = 20
#: A host is rejected if its shrunk rate of failing documents is above this.
MAX_HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_NO_WORD = BLANKS


def repeated_words(words: list, window: int = 5) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrences included."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    times = Counter(grams)
    n = end = 0
    for i, g in enumerate(grams):
        if times[g] > 1:
            n += i + window - max(i, end)
            end = i + window
    return n


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = space_words(text)
    lines = [x for x in text.split("\n") if x.strip(_NO_WORD)]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts of each row; null texts count as empty."""
    def start():
        return lambda doc_id, source, text: (doc_id, source, *text_counts(text))
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text"),
                    f"doc_id long, source string, {', '.join(f'{c} long' for c in COUNTS)}", start)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def soft_failed() -> Column:
    return ((F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words")) | (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines"))
            | (F.col("word_chars") > MAX_MEAN_WORD * F.col("n_words")))


def host_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: its documents, failures, shrunk rate and verdict; null is a host of its own.

    The prior is Beta(m s, (1 - m) s): m is the corpus's failure rate and s comes from the method of moments over hosts of
    at least two documents, between 2 and 1000. One host alone, or hosts of equal rates, give the strongest prior.
    """
    hosts = judged.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    # spread of the rates beyond what drawing n_docs documents gives by itself
    several = F.col("n_docs") >= 2
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.coalesce(F.var_samp(F.when(several, rate)), F.lit(0.0)).alias("spread"),
        F.coalesce(F.avg(F.when(several, 1 / F.col("n_docs"))), F.lit(0.0)).alias("per_doc"))
    m = F.col("mean")
    between = F.col("spread") - m * (1 - m) * F.col("per_doc")
    strength = F.when(between <= 0, 1000.0).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(2.0), m * (1 - m) / between - 1)))
    packed = prior.select(F.struct(m.alias("mean"), strength.alias("strength"))).scalar()
    hosts = hosts.withColumn("_p", packed)
    shrunk = (F.col("n_failed") + F.col("_p.mean") * F.col("_p.strength")) / (F.col("n_docs") + F.col("_p.strength"))
    return hosts.select("source", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_rejected"))


def quality(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Counts, failures and verdict of each row.

    A document that fails a base rule goes; one that fails only softer rules goes if its host is rejected. Null texts are empty and
    fail; null hosts count as one host; repeated rows count each; an empty table gives no rows; other columns are not read.
    The counts are written once and read for the host sums and for the verdicts.
    """
    counts = materialize(document_counts(docs), "quality")
    judged = counts.withColumn("base_failed", base_failed()).withColumn("failed", F.col("base_failed") | soft_failed())
    hosts = host_verdicts(judged, max_rate).withColumnRenamed("source", "_host")
    return (judged.join(hosts, judged["source"].eqNullSafe(hosts["_host"]), "left")
            .withColumn("kept", ~F.col("base_failed") & ~(F.col("failed") & F.col("host_rejected"))).drop("_host"))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
