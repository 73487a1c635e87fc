"""Quality rules as a ledger of failure bits.

Every document is measured once and every rule is evaluated once. The ledger keeps the measurements and one bit for
each failed rule. A policy is a versioned set of rules, that is, a mask: a document is kept if no bit of the mask is
set. Other policies, and what a policy would do without one of its rules, follow from the ledger by bit operations, with
no second look at a text.

Words are runs of anything but ASCII white space. Rules compare integers and are written in SQL, so that other engines
can check them.

Defined results: a null or empty text has no words and fails ``few_words``; texts are measured whole; each row is judged
on its own, so that repeated rows get equal verdicts; an empty table gives an empty ledger; other columns pass through
``ledger`` unless they carry a name of the ledger, which then wins, and through ``keep_good`` always.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumipair.llm.common import documents, each_slice, ship

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_digits",
]


@dataclass(frozen=True)
class Rule:
    """A rule is broken where ``fails``, an SQL predicate over the measurements, holds."""

    name: str
    fails: str


# The place of a rule is its bit; rules are only ever added at the end.
RULES = [
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("exclamations", "100 * n_exclaim > 30 * n_words"),
    Rule("upper_case", "100 * n_upper > 40 * word_chars"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("digits", "100 * n_digits > 40 * word_chars"),
]
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "exclamations"],
    "v2": [rule.name for rule in RULES],
}
PRODUCTION = "v2"


def mask(policy: str | list[str]) -> int:
    return sum(BIT[name] for name in (POLICIES[policy] if isinstance(policy, str) else policy))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that occur at least twice in the text.

    Windows are numbered exactly, by doubling: equal numbers of two neighbouring halves make equal numbers of the whole.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    half = 1
    while half < WINDOW:
        pairs = ids[:-half] * (int(ids.max()) + 1) + ids[half:]
        half *= 2
        if half < WINDOW:
            ids = np.unique(pairs, return_inverse=True)[1]
    _, which, times = np.unique(pairs, return_inverse=True, return_counts=True)
    begins = np.flatnonzero(times[which] > 1)
    if not len(begins):
        return 0
    inside = np.zeros(len(words) + 1, np.int64)
    inside[begins] += 1
    inside[begins + WINDOW] -= 1
    return int((np.cumsum(inside) > 0).sum())


def measure_text(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    letters = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), int(letters[65:91].sum()), int(letters[33]), int(letters[48:58].sum()),
    )


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measure(texts: pa.Array) -> pa.Array:
    def measured(part: list[bytes]) -> pa.Array:
        found = np.array([measure_text(t.decode()) for t in part], np.int64).reshape(-1, len(MEASURES))
        return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(MEASURES))], names=list(MEASURES))

    return each_slice(texts, measured)


def _failures() -> str:
    return " + ".join(f"case when {rule.fails} then {BIT[rule.name]} else 0 end" for rule in RULES)


def ledger(docs: DataFrame) -> DataFrame:
    """The documents without their text, with their measurements and ``failures``."""
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "failures", *MEASURES)]
    measured = docs.select(*[docs[c] for c in others], _measure(docs["text"]).alias("__measured"))
    return measured.select(*others, "__measured.*").withColumn("failures", F.expr(_failures()).cast("long"))


def decide(entries: DataFrame, policy: str | list[str] = PRODUCTION) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy; the base rules always apply."""
    base = mask("base")
    return entries.withColumns({
        "base_failed": F.col("failures").bitwiseAND(F.lit(base)) != 0,
        "kept": F.col("failures").bitwiseAND(F.lit(base | mask(policy))) == 0,
    })


def ablation(entries: DataFrame, policy: str | list[str] = PRODUCTION) -> DataFrame:
    """What each rule does in a policy: rule, n_failed, n_failed_alone (documents kept without the rule).

    Documents are first counted by their failure bits, of which there are at most 2 ** rules combinations.
    """
    chosen = mask(policy)
    by_bits = entries.groupBy(F.col("failures").bitwiseAND(F.lit(chosen)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).cast("long").alias("bit")) for r in RULES if BIT[r.name] & chosen])
    return by_bits.withColumn("r", F.explode(rules)).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
    )


def keep_good(docs: DataFrame, policy: str | list[str] = PRODUCTION) -> DataFrame:
    """The documents a policy keeps, with their own columns; a row travels as one column, so that no join is needed."""
    rows = docs.select(docs["text"], F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    return decide(ledger(rows), policy).filter("kept").select("__row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(documents(spark, sf_dir).select("doc_id", "text"))
    return decide(entries).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures"
    )


OP6_SQL = rf"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
cut as (
  select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from texts),
windows as (
  select doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') as w
  from (select doc_id, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) as i from cut)),
repeats as (
  select doc_id, count(distinct i + k) as n
  from (select doc_id, i, count(*) over (partition by doc_id, w) as times from windows), (select unnest(range({WINDOW})) as k)
  where times > 1 group by doc_id),
measured as (
  select cut.doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(repeats.n, 0) as n_repeat_words, len(lines) as n_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper,
         length(t) - length(replace(t, '!', '')) as n_exclaim,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) as n_digits
  from cut left join repeats on cut.doc_id = repeats.doc_id),
judged as (select *, {_failures()} as failures from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failures & {mask("base")} <> 0 as base_failed, failures & {mask("base") | mask(PRODUCTION)} = 0 as kept,
       cast(failures as bigint) as failures
from judged
"""
