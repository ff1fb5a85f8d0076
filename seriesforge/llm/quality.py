"""Quality rules on whole texts: counts, and how much of a text repeats itself.

Rolling 64-bit hashes of word windows come from one prefix sum per block of texts, so any window
length costs one subtraction per window. A window counts as repeated when its words occur twice or
more in the same text; characters of words inside repeated windows, and characters of lines seen
before in the text, are measured against all characters of words.

Null and empty texts have no words: they fail the base rule. Equal rows are measured alike. Texts are
never cut. Other columns are kept by `measure`; a column that has the name of a measure is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesforge.llm import text as tx
from seriesforge.llm.arrow import with_column

BASE_WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")


@dataclass(frozen=True)
class Rules:
    """Shares of word characters that may lie inside repeated windows of n words, or in repeated lines."""

    min_words: int = 20
    base_repeat_percent: int = 30
    window_shares: tuple[tuple[int, float], ...] = ((5, 0.40), (10, 0.30), (20, 0.30))
    line_share: float = 0.30


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _prefix(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags)))


def _covered(first: np.ndarray, keys: np.ndarray, length: int, n_words: int) -> np.ndarray:
    """Words inside a window of `length` words that its text has twice or more."""
    begins, owner = tx.window_starts(first, length)
    if not len(begins):
        return np.zeros(n_words, bool)
    hashes = tx.range_hashes(keys, begins, begins + length)
    twice = begins[tx.repeated(tx.mix(hashes ^ tx.mix(owner.astype(np.uint64))))]
    change = np.bincount(twice, minlength=n_words + length + 1) - np.bincount(twice + length, minlength=n_words + length + 1)
    return np.cumsum(change)[:n_words] > 0


def measures(texts: pa.Array, windows: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of each text; `window_chars_<n>` are characters of words inside repeated n-word windows."""
    data, at = tx.utf8(texts)
    n = len(at) - 1
    starts, ends, first = tx.words(data, at)
    leads = _prefix((data & 0xC0) != 0x80)
    lengths = leads[ends] - leads[starts]
    chars = _prefix(lengths)
    out = {"n_words": np.diff(first), "word_chars": np.diff(chars[first]), "n_symbols": np.diff(_prefix(_SYMBOL[data])[at])}

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.concatenate((at[:-1], breaks + 1))
    line_docs = np.concatenate((np.arange(n), np.searchsorted(at, breaks, "right") - 1))
    order = np.lexsort((line_starts, line_docs))
    line_starts, line_docs = line_starts[order], line_docs[order]
    last = np.append(line_docs[1:] != line_docs[:-1], True)[: len(line_docs)]
    line_ends = np.where(last, at[line_docs + 1], np.append(line_starts[1:], 0) - 1)
    word_at = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    worded = word_at[1] > word_at[0]
    line_starts, line_ends, line_docs = line_starts[worded], line_ends[worded], line_docs[worded]
    line_chars = chars[word_at[1][worded]] - chars[word_at[0][worded]]
    keys = tx.mix(tx.range_hashes(data, line_starts, line_ends) ^ tx.mix(line_docs.astype(np.uint64)))
    seen = np.ones(len(keys), bool)
    seen[np.unique(keys, return_index=True)[1]] = False  # return_index gives the first of equal lines
    out["n_dup_lines"] = np.bincount(line_docs[seen], minlength=n)
    out["dup_line_chars"] = np.bincount(line_docs[seen], line_chars[seen], minlength=n).astype(np.int64)

    word_keys = tx.range_hashes(data, starts, ends)
    for length in sorted({BASE_WINDOW, *windows}):
        inside = _covered(first, word_keys, length, len(starts))
        out[f"window_chars_{length}"] = np.diff(_prefix(lengths * inside)[first])
        if length == BASE_WINDOW:
            out["n_repeat_words"] = np.diff(_prefix(inside)[first])
    return out


def measure(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """`docs` with the counts of every text, `base_failed` and the verdict `kept`."""
    windows = tuple(length for length, _ in rules.window_shares)
    names = [*MEASURES, *(f"window_chars_{length}" for length in windows)]

    def compute(texts: pa.Array) -> pa.Array:
        found = measures(texts, windows)
        return pa.StructArray.from_arrays([pa.array(found[name].astype(np.int64)) for name in names], names)

    kind = T.StructType([T.StructField(name, T.LongType()) for name in names])
    clash = [*names, "base_failed", "kept"]
    spare = "_quality"
    while spare in docs.columns:
        spare += "_"
    wide = with_column(docs.drop(*[c for c in clash if c != text]), text, spare, kind, compute)
    wide = wide.select(*[f"`{c}`" for c in wide.columns if c != spare], *[F.col(spare)[name].alias(name) for name in names])
    wide = wide.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.base_repeat_percent * F.col("n_words")))
    return wide.withColumn("kept", ~F.col("base_failed") & _within(rules))


def _within(rules: Rules) -> Column:
    fine = F.col("dup_line_chars") <= rules.line_share * F.col("word_chars")
    for length, share in rules.window_shares:
        fine &= F.col(f"window_chars_{length}") <= share * F.col("word_chars")
    return fine


def keep_good(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs` that pass, with their own columns only."""
    added = [*MEASURES, "base_failed", "kept", *(f"window_chars_{length}" for length, _ in rules.window_shares)]
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(docs.columns)])
    judged = measure(hidden, f"_own_{docs.columns.index(text)}", rules).where("kept").drop(*added)
    return judged.select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)])
