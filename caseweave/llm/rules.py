"""Quality rules as a ledger: every rule is evaluated once into a bit, and policies are masks over the bits.

``measure`` takes the measurements of whole texts, ``ledger`` adds one bit per failed rule, ``judge`` applies a version of
the policy, and ``ablations`` counts, from the number of texts per bit pattern, what each rule alone decides.

Null, empty and blank texts have no words and fail the first rule. Repeated rows are judged each by itself. An empty table
gives an empty result. Input columns of the names made here are replaced; others stay.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.batches import with_columns

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]

#: The rules in the order of their bits: name -> the SQL condition under which a text fails.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "5 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines > 4 and 100 * n_dup_lines > 40 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 25 * n_words",
    "mostly_capitals": "100 * n_capitals > 50 * word_chars",
}
#: Versions of the policy: the rules that reject a text.
POLICIES = {1: ("few_words", "repeated_words"), 2: tuple(RULES)}
BASE = POLICIES[1]


def mask(rules) -> int:
    """The bits of the named rules."""
    return sum(1 << k for k, name in enumerate(RULES) if name in set(rules))


def measurements(text: str | None, window: int = 5) -> tuple[int, ...]:
    """The values of MEASURES for a whole text; words are what stands between ASCII blanks."""
    data = (text or "").encode()
    words = data.split()
    blanks = len(data) - len(data.translate(None, BLANKS))
    lines = [line for line in data.split(b"\n") if line.translate(None, BLANKS)]
    windows = list(zip(*(words[k:] for k in range(window))))
    repeated = set()
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        for k, w in enumerate(windows):
            if times[w] > 1:
                repeated.update(range(k, k + window))
    count = lambda chars: len(data) - len(data.translate(None, chars))
    return len(words), len(text or "") - blanks, count(SYMBOLS), len(lines) - len(set(lines)), len(repeated), len(lines), count(CAPITALS)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns MEASURES (long)."""
    return with_columns(docs, text, dict.fromkeys(MEASURES, T.LongType()), lambda texts: [list(x) for x in zip(*map(measurements, texts))])


def ledger(measured: DataFrame) -> DataFrame:
    """``measured`` with ``failed`` (int): bit k is set if the text fails rule k."""
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, condition in enumerate(RULES.values())]
    whole = bits[0]
    for bit in bits[1:]:
        whole = whole.bitwiseOR(bit)
    return measured.withColumn("failed", whole)


def fails(rules) -> Column:
    """Whether a row of the ledger fails one of the named rules."""
    return F.col("failed").bitwiseAND(F.lit(mask(rules))) != 0


def judge(entered: DataFrame, version: int = 2) -> DataFrame:
    """``entered`` with ``base_failed`` and ``kept`` under a version of the policy; the base rules always reject."""
    return entered.withColumns({"base_failed": fails(BASE), "kept": ~fails({*BASE, *POLICIES[version]})})


def ablations(entered: DataFrame, version: int = 2) -> DataFrame:
    """(rule, failing, alone): texts that fail a rule of the policy, and texts that only this rule rejects.

    The ledger is counted per bit pattern first, so the rest works on at most one row per pattern.
    """
    rules = {*BASE, *POLICIES[version]}
    patterns = entered.groupBy(F.col("failed").bitwiseAND(F.lit(mask(rules))).alias("bits")).count()
    names = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask([name])).alias("bit")) for name in RULES if name in rules])
    spread = patterns.select("bits", "count", F.explode(names).alias("r"))
    hit, only = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).alias
    return spread.groupBy("r.rule").agg(total(hit)("failing"), total(only)("alone"))
