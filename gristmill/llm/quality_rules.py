"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one bit per failed rule; a policy is only a named mask over those bits. A verdict
under another policy, or the effect of leaving a rule out, needs no second look
at the texts: it is arithmetic on the stored masks.

Defined results: a null text has no words and fails `few_words`; rows with a
null or repeated doc_id are measured each for itself; extra columns stay; an
empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .columns import others, private, public

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_alpha_words")

#: Rules in bit order: what fails, as SQL over the measurements. New rules go to the end, so that stored masks stay valid.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("upper_case", "2 * n_upper > n_letters"),
    ("not_words", "10 * n_alpha_words < 7 * n_words"),
)
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules that count.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines", "upper_case"),
    "v2": tuple(name for name, _ in RULES),
}


def bits(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(name) for name in rules)


def _repeats(t: K.Texts, starts, ends, firsts) -> np.ndarray:
    """Words of each text inside 3-word windows that the text has at least twice."""
    hit = np.zeros(len(starts) + 1, np.int32)
    at = np.flatnonzero(K.starts_of_grams(firsts, 3))
    if len(at):
        grams = K.grams(t.exact_hashes(starts, ends), 3)[at]
        key = K.mix(grams + K.owner(firsts)[at].astype(K.U) * K.U(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(hit, at[twice], 1)
        np.add.at(hit, at[twice] + 3, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
    return inside[firsts[1:]] - inside[firsts[:-1]]


def _duplicate_lines(t: K.Texts, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text its lines, and those with a word that equal an earlier one."""
    a, b, firsts = t.lines()
    worded = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    of = K.owner(firsts)
    key = K.mix(t.exact_hashes(a, b) + of.astype(K.U) * K.U(0x9E3779B97F4A7C15))[worded]
    order = np.argsort(key, kind="stable")
    repeated = order[1:][key[order][1:] == key[order][:-1]]
    return np.diff(firsts), np.bincount(of[worded][repeated], minlength=t.n)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    members = {
        "n_symbols": np.isin(K.BYTES, list(b"#*$%&|<>")),
        "n_upper": K.UPPER,
        "n_letters": K.UPPER | K.LOWER,
    }
    for batch in batches:
        at = batch.schema.get_field_index("text")
        out = {name: [np.zeros(0, np.int64)] for name in MEASURES}
        for t in K.texts(batch.column(at)):
            starts, ends, firsts = t.spans(K.NOT_SPACE)
            lead = np.concatenate([[0], np.cumsum(t.count(K.LEAD, starts, ends))])
            out["n_words"].append(np.diff(firsts))
            out["word_chars"].append(lead[firsts[1:]] - lead[firsts[:-1]])
            for name, table in members.items():
                out[name].append(t.count(table, t.offsets[:-1], t.offsets[1:]))
            alpha = np.concatenate([[0], np.cumsum(t.count(K.UPPER | K.LOWER | (K.BYTES >= 0x80), starts, ends) > 0)])
            out["n_alpha_words"].append(alpha[firsts[1:]] - alpha[firsts[:-1]])
            n_lines, n_dup = _duplicate_lines(t, starts)
            out["n_lines"].append(n_lines)
            out["n_dup_lines"].append(n_dup)
            out["n_repeat_words"].append(_repeats(t, starts, ends, firsts))
        rest = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in rest), *(pa.array(np.concatenate(out[name]).astype(np.int64)) for name in MEASURES)],
            [*(batch.schema.names[i] for i in rest), *MEASURES],
        )


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns in `keep` (default: all but the text and names of measurements) with measurements and `failed_bits`."""
    keep = tuple(others(docs, text, *MEASURES, "failed_bits")) if keep is None else keep
    narrow = private(docs, list(keep), text=F.col(f"`{text}`"))
    schema = type(narrow.schema)(narrow.schema.fields[:-1])
    for name in MEASURES:
        schema = schema.add(name, "long")
    mask = sum((F.when(F.expr(rule), 1 << i).otherwise(0) for i, (_, rule) in enumerate(RULES)), F.lit(0))
    measured = narrow.mapInArrow(_measure_batches, schema).withColumn("failed_bits", mask.cast("int"))
    return measured.select(*public(list(keep)), *MEASURES, "failed_bits")


def passes(policy: str, failed_bits: str | Column = "failed_bits") -> Column:
    """True where none of the policy's rules failed."""
    column = F.col(failed_bits) if isinstance(failed_bits, str) else failed_bits
    return column.bitwiseAND(F.lit(bits(POLICIES[policy]))) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows failing it, rows failing it alone, rows kept if it is left out.

    Works on distinct masks, of which there are at most 2 to the number of rules.
    """
    mask = bits(POLICIES[policy])
    counts = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).alias("bit")) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    rows = counts.select("m", "n", F.explode(F.array(*rules)).alias("r"))
    has = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    others = F.col("m").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        total(has)("n_failed"), total(has & (others == 0))("n_failed_alone"), total(others == 0)("n_kept_without")
    )
