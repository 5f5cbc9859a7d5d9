r"""Quality rules as a bitmask ledger (operator 2, DataFrame functions alone).

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule. A policy is a version name and a mask of the rules it enforces; applying one is a
bitwise AND over the ledger, without the texts. Ablations (what a policy would keep without one
of its rules) come from counts per bit pattern, of which there are few.

Repeats inside a document are found inside its row: the three-word windows' hashes are sorted
with their positions, so that equal windows are neighbours. No shuffle takes place.

Defined results: null text has no words, lines or symbols; ratios are products of integers, so a
text without words fails only min_words; rows are independent, so repeated rows, ties and other
columns change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
#: The rules; a rule's bit is its place here. Append only.
RULES = ("min_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "short_words", "exclamations")
BASE = ("min_words", "repeated_words")
#: Policies by version.
POLICIES = {"base-1": BASE, "strict-1": (*BASE, "symbols", "duplicate_lines"), "strict-2": RULES}
PRODUCTION = "strict-2"


def mask(rules) -> int:
    return sum(1 << RULES.index(r) for r in set(rules))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, characters: str) -> Column:
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(left)).cast("long")


def repeated(words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def positions(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda j, k: F.get(s, j)["h"] == F.get(s, k)["h"]
        hit = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & F.coalesce(same(j, j - 1), F.lit(False))) | ((j < last) & F.coalesce(same(j, j + 1), F.lit(False))))
        return F.sort_array(F.transform(hit, lambda j: F.get(s, j)["i"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at"))
    # each window adds the words that the window before it did not cover
    covered = lambda p: F.aggregate(p, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), lambda s: covered(positions(s))))


def measures(text: Column) -> Column:
    """A struct of all measurements of a text that is not null."""
    words = F.filter(F.split(text, f"{common.WS_CLASS}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    pair = F.struct(by_words.alias("w"), by_lines.alias("l"))
    part = lambda p, k: p[k[0]][k[1:]].alias(k[1:])
    return let(pair, lambda p: F.struct(part(p, "wn_words"), part(p, "wword_chars"), count_of(text, SYMBOLS).alias("n_symbols"), part(p, "ln_dup_lines"), part(p, "wn_repeat_words"), part(p, "ln_lines"), count_of(text, "!").alias("n_exclamations")))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations")


def failed(m: Column) -> Column:
    """The bits of the rules that a struct of measurements fails."""
    total = {k: m[k] for k in NAMES}
    conditions = {
        "min_words": total["n_words"] < 50,
        "repeated_words": 100 * total["n_repeat_words"] > 50 * total["n_words"],
        "symbols": 100 * total["n_symbols"] > 10 * total["n_words"],
        "duplicate_lines": 100 * total["n_dup_lines"] > 30 * total["n_lines"],
        "long_words": total["word_chars"] > 14 * total["n_words"],
        "short_words": total["word_chars"] < 2 * total["n_words"],
        "exclamations": 100 * total["n_exclamations"] > 10 * total["n_words"],
    }
    bits = F.lit(0).cast("long")
    for i, name in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(conditions[name], F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements, failed (bit i: rule i failed)."""
    entry = let(measures(F.coalesce("text", F.lit(""))), lambda m: F.struct(m.alias("m"), failed(m).alias("failed")))
    return common.id_text(docs).select("doc_id", entry.alias("e")).select("doc_id", "e.m.*", "e.failed")


def keep(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The rows of docs, with all their columns, that a policy keeps."""
    bits = let(measures(F.coalesce(F.col("text").cast("string"), F.lit(""))), failed)
    return docs.where(bits.bitwiseAND(F.lit(mask((*BASE, *POLICIES[policy]))).cast("long")) == 0)


def apply(led: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    hit = lambda rules: F.col("failed").bitwiseAND(F.lit(mask(rules)).cast("long")) != 0
    return led.withColumn("base_failed", hit(BASE)).withColumn("kept", ~hit((*BASE, *POLICIES[policy])))


def ablations(led: DataFrame) -> DataFrame:
    """policy, without (a rule, or null for the whole policy), n_kept, n_docs."""
    patterns = led.groupBy("failed").agg(F.count("*").alias("n"))  # 2 ** rules rows at most
    plans = [(p, None, mask(rules)) for p, rules in POLICIES.items()] + [(p, r, mask(rules) & ~mask([r])) for p, rules in POLICIES.items() for r in rules]
    kinds = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).cast("string").alias("without"), F.lit(m).cast("long").alias("mask")) for p, r, m in plans)))
    spread = patterns.select("failed", "n", kinds.alias("k")).select("failed", "n", "k.*")
    return spread.groupBy("policy", "without").agg(F.sum(F.when(F.col("failed").bitwiseAND(F.col("mask")) == 0, F.col("n")).otherwise(0)).alias("n_kept"), F.sum("n").alias("n_docs"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    out = apply(ledger(common.table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) o(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(ls)::BIGINT AS n_lines, (length(x) - length(replace(x, '!', '')))::BIGINT AS n_exclamations
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * n_words)::BIGINT
        + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (word_chars > 14 * n_words)::BIGINT + 32 * (word_chars < 2 * n_words)::BIGINT
        + 64 * (100 * n_exclamations > 10 * n_words)::BIGINT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
