"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps its measurements and one long whose bit
``b`` is set when rule ``b`` failed. A policy is a version and a mask: a document passes when no
masked bit is set, so a new policy, or an ablation of one, costs a bitwise AND and never a second
look at the text. Main path: built-in column functions only.

Nulls and edges: a null or empty text has no words, so it fails ``few_words`` and every ratio counts
as 0. Repeated rows are rated each on its own. An empty table gives an empty ledger. The ledger's
columns are those named here plus the caller's key; other input columns are not looked at, so clashing
names cannot matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import SPACE, WORD

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``failed``: SQL over the measurements; null counts as not failed."""

    name: str
    failed: str


#: A rule's place is its bit; append only.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("symbols", "4 * n_symbols > word_chars"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 40 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        at = {r.name: 1 << i for i, r in enumerate(rules)}
        return sum(at[x] for x in dict.fromkeys(self.rules))


BASE = Policy("base", ("few_words", "repeated_windows"))
FULL = Policy("v1", tuple(r.name for r in RULES))


def _repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Words inside 5-word windows that occur twice or more in the text.

    Hashes only find the texts with some repetition; there windows are sorted by hash and by their
    own words, and neighbours compared as words, so a hash collision cannot count.
    """
    w, span = F.col(words), F.size(words) - (WINDOW - 1)
    pair = lambda x, y: F.zip_with(x, y, lambda a, b: F.xxhash64(a, b))
    at = lambda c, i: F.slice(c, i + 1, F.size(c))
    df = df.withColumn("_h1", F.when(span > 1, F.transform(w, lambda x: F.xxhash64(x))))
    df = df.withColumn("_h2", pair(F.col("_h1"), at("_h1", 1)))
    df = df.withColumn("_h4", pair(F.col("_h2"), at("_h2", 2)))
    df = df.withColumn("_hash", pair(F.slice("_h4", 1, span), F.slice("_h1", WINDOW, span)))
    repeated = F.size(F.array_distinct("_hash")) < F.size("_hash")
    window = lambda i: F.concat_ws(" ", F.slice(w, i + 1, WINDOW))
    placed = F.transform("_hash", lambda h, i: F.struct(h.alias("h"), window(i).alias("g"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(repeated, F.sort_array(placed)))
    twins = F.zip_with(
        F.slice("_sorted", 1, F.size("_sorted") - 1),
        F.slice("_sorted", 2, F.size("_sorted") - 1),
        lambda a, b: F.when((a["h"] == b["h"]) & (a["g"] == b["g"]), F.array(a["i"], b["i"])),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    add = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
    total = F.aggregate(starts, first, add, lambda acc: acc["n"])
    return df.withColumn(out, F.coalesce(total, F.lit(0).cast("long")))


def measure(docs: DataFrame, key: str | None = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the measurements of each whole text; without a key, the whole row as ``_row``."""
    t, long = F.coalesce(F.col(text), F.lit("")), lambda c: c.cast("long")
    ident = F.col(key) if key else F.struct(*[F.col(c) for c in docs.columns])
    df = docs.select(ident.alias("_key"), t.alias("_text"))
    df = df.select(
        "_key",
        F.regexp_extract_all("_text", F.lit(WORD), 0).alias("_words"),
        long(F.regexp_count("_text", F.lit(SYMBOLS))).alias("n_symbols"),
        F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")).alias("_lines"),
    )
    df = df.withColumns({"n_words": long(F.size("_words")), "word_chars": long(F.length(F.array_join("_words", ""))), "n_lines": long(F.size("_lines")), "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines")))})
    return _repeat_words(df, "_words", "n_repeat_words").select(F.col("_key").alias(key or "_row"), *MEASURES)


def ledger(docs: DataFrame, key: str | None = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key`` (or ``_row``), the measurements and ``failed_bits``."""
    bits = [F.when(F.expr(r.failed), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rules)]
    return measure(docs, key, text).withColumn("failed_bits", reduce(Column.bitwiseOR, bits))


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def accepted(docs: DataFrame, policy: Policy = FULL, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the policy lets pass, rated and filtered in one pass."""
    rated = ledger(docs, None, text, rules)
    # a filter pushed under the ledger would evaluate each measurement once for every mention of it;
    # it stays above a projection that holds a column without a fixed value
    rated = rated.select("_row", "failed_bits", F.monotonically_increasing_id().alias("_still"))
    kept = rated.where(passes(policy, rules) & (F.col("_still") >= 0))
    return kept.select(*[F.col(f"_row.{c}").alias(c) for c in docs.columns])


def ablation(rated: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a rule of the policy: documents that fail it, that fail it alone, and that the policy
    would keep without it; with what OR and AND of the failing documents' bits hold in common.

    One aggregation over distinct bit patterns (at most 2^rules of them).
    """
    mask = policy.mask(rules)
    seen = rated.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if mask >> i & 1]))
    each = seen.select("bits", "n", rows.alias("r")).select("bits", "n", "r.*")
    hit, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))
    return each.groupBy("rule", "bit").agg(
        total(hit).alias("n_failed"),
        total(hit & (rest == 0)).alias("n_failed_alone"),
        total(rest == 0).alias("n_kept_without"),
        F.bit_or(F.when(hit, F.col("bits"))).alias("any_bits"),
        F.bit_and(F.when(hit, F.col("bits"))).alias("all_bits"),
    )
