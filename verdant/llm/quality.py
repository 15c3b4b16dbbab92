"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; a policy is a versioned mask over these bits, so that a verdict, a new policy or an ablation
needs no second look at the texts.

Repeated windows are found inside one row: each 3-word window becomes one long, its hash in the high
bits and its position in the low bits. Sorting the longs puts equal windows beside each other, where
neighbours are compared word by word. That is n log n for a text of n words and moves no data. Where two
unlike windows share their hash bits, that text's windows are sorted by their words themselves.

Cases: a NULL text counts as empty and fails ``few_words``; repeated rows and NULL ids are kept as
they are; ids and other columns of the input are passed on under the names asked for; an empty table
gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails``, an expression over the measurements, is true. Bits never change their meaning."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {"v1": BASE, "v2": (*BASE, "symbols", "repeated_lines", "word_length")}


def mask_of(names: tuple[str, ...]) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def _position_bits(words: Column) -> Column:
    """Bits that hold a position; the rest of a long are the hash's."""
    return F.ceil(F.log2(F.size(words) + F.lit(1))).cast("int")


def _window_keys(words: Column) -> Column:
    """Every window as a long, equal hashes beside each other and in order of their places."""
    n, low = F.size(words), _position_bits(words)

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + d) for d in range(WINDOW)])

    keys = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.call_function("shiftleft", window(i), low).bitwiseOR(i.cast("long")))
    return F.when(n >= WINDOW, F.sort_array(keys)).otherwise(F.array().cast("array<bigint>"))


def _starts_by_words(words: Column) -> Column:
    """Starts of the windows that occur twice or more, by sorting the windows' words; for the few texts whose hashes collide."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.struct(F.slice(words, i + 1, WINDOW).alias("w"), i.cast("long").alias("i")))

    def repeated(ordered: Column) -> Column:
        near = lambda x, j: F.coalesce(F.get(ordered, j)["w"] == x["w"], F.lit(False))
        return F.transform(F.filter(ordered, lambda x, j: near(x, j - 1) | near(x, j + 1)), lambda x: x["i"])

    return F.get(F.transform(F.array(F.array_sort(windows)), repeated), 0)


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words per row."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(BLANKS))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    names = [f"k{i}" for i in range(len(keep))]
    cut = docs.select(
        *kept,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN)).alias("words"),
        F.length(F.regexp_replace(t, BLANK_RUN, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    sorted_windows = cut.select(
        *names,
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "words",
        _position_bits(F.col("words")).alias("low"),
        _window_keys(F.col("words")).alias("windows"),
    )
    low, words, windows = F.col("low"), F.col("words"), F.col("windows")
    place = F.call_function("shiftleft", F.lit(1).cast("long"), low) - 1

    def alike(x: Column, y: Column) -> Column:
        """Equal hashes; NULL, beyond either end, is not equal."""
        return F.coalesce(F.call_function("shiftright", x, low) == F.call_function("shiftright", y, low), F.lit(False))

    def unlike(x: Column, y: Column) -> Column:
        """Are the words at the two places different?"""
        here, there = x.bitwiseAND(place).cast("int"), y.bitwiseAND(place).cast("int")
        different = F.lit(False)
        for d in range(WINDOW):
            different = different | (F.get(words, here + d) != F.get(words, there + d))
        return different

    repeated = F.filter(windows, lambda x, i: alike(x, F.get(windows, i - 1)) | alike(x, F.get(windows, i + 1)))
    paired = sorted_windows.withColumn("windows", repeated)
    collided = F.exists(F.transform(windows, lambda x, i: alike(x, F.get(windows, i - 1)) & unlike(x, F.get(windows, i - 1))), lambda c: c)
    by_hash = F.transform(windows, lambda x: x.bitwiseAND(place))
    starts = paired.withColumn("starts", F.sort_array(F.when(collided, _starts_by_words(words)).otherwise(by_hash)))
    at = F.col("starts")
    covered = F.transform(at, lambda x, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW).cast("long"))))
    return starts.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)],
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements with ``failed``: the bits of all rules, whatever any policy makes of them."""
    failed = F.lit(0).cast("long")
    for rule in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text, keep).withColumn("failed", failed)


def passes(failed: Column, policy: str = "v2") -> Column:
    """True where no rule of the policy failed."""
    return failed.bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def ablation(book: DataFrame, policy: str = "v2") -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without): per rule of the policy, from one count per bit pattern.

    ``n_only`` documents fail this rule of the policy and no other: leaving it out would bring them back.
    """
    names, mask = POLICIES[policy], mask_of(POLICIES[policy])
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask_of((n,))).cast("long").alias("bit")) for n in names])
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    return each.groupBy("r.rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def accepted(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents the policy keeps, with all their columns, whatever their names."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    # The partition's number, always 0 or more, is no plain expression: a filter that needs it stays above the
    # measurements, which would otherwise be worked out inside it once per use.
    book = ledger(packed, "text", ("row",)).withColumn("partition", F.spark_partition_id())
    return book.filter(passes(F.col("failed"), policy) & (F.col("partition") >= 0)).select("row.*")
