"""Quality rules by repetition coverage: how much of a text lies inside repeated n-grams and lines.

Rolling hashes of several n-gram lengths are computed in numpy for every whole text; a window that occurs twice or more
marks its words, and the characters of marked words are held against all characters of words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .wordscan import roll, texts, words

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_STRIP = b" \t\n\x0b\x0c\r"
WINDOW = 8

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, dup_line_share double, top_ngram_share double, dup_ngram_share double"
)


@dataclass(frozen=True)
class Limits:
    """Largest share of characters allowed, by n-gram length; and in repeated lines."""

    # The limits on single n-grams and lines are those published for the MassiveText corpus. Those on all repeated n-grams
    # are wider (there 0.15 to 0.10): one line said twice in a short text is no reason to drop it.
    top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    duplicate: dict[int, float] = field(default_factory=lambda: dict.fromkeys(range(5, 11), 0.30))
    line_chars: float = 0.20


def _covered(repeated: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside windows of n words that ``repeated`` marks by their first word."""
    edge = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(repeated)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def _repeated(grams: np.ndarray) -> np.ndarray | None:
    """Which windows occur twice or more; None if none does."""
    s = np.sort(grams)
    twice = s[1:][s[1:] == s[:-1]]
    return np.isin(grams, twice) if len(twice) else None


def measure(data: bytes | None, limits: Limits) -> tuple:
    """All measures of one text, in the order of :data:`SCHEMA` without doc_id."""
    data = data or b""
    hashes, chars = words(data)
    n, total = len(hashes), int(chars.sum())
    n_symbols = sum(int(np.count_nonzero(_IS_SYMBOL[np.frombuffer(data, np.uint8, min(1 << 20, len(data) - i), i)])) for i in range(0, len(data), 1 << 20))
    seen, n_dup_lines, line_chars = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip(_STRIP):
            if line in seen:
                n_dup_lines += 1
                line_chars += len(line.translate(None, _STRIP).decode("utf-8", "replace"))
            else:
                seen.add(line)
    top = dup = 0.0
    over, repeat_words, grams, none_left = False, 0, hashes, False
    for k in range(2, max(*limits.top, *limits.duplicate, WINDOW) + 1):
        grams = roll(grams, hashes, k)
        if none_left or not len(grams):
            break
        if k in limits.top:
            values, first, counts = np.unique(grams, return_index=True, return_counts=True)
            most = int(counts.max())
            if most == 1:
                break  # longer windows don't repeat either
            sums = np.concatenate([[0], np.cumsum(chars)])
            at = first[counts == most]
            share = most * int((sums[at + k] - sums[at]).max()) / total
            top, over = max(top, share), over or share > limits.top[k]
        if k in limits.duplicate or k == WINDOW:
            marks = _repeated(grams)
            if marks is None:
                none_left = True
                continue
            covered = _covered(marks, k, n)
            if k == WINDOW:
                repeat_words = int(covered.sum())
            if k in limits.duplicate:
                share = int(chars[covered].sum()) / total
                dup, over = max(dup, share), over or share > limits.duplicate[k]
    lines = line_chars / total if total else 0.0
    over = over or lines > limits.line_chars
    failed = n < 20 or 100 * repeat_words > 30 * n
    return n, total, n_symbols, n_dup_lines, repeat_words, failed, not failed and not over, lines, top, dup


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """One row per row of ``docs``: base measures, the verdict ``kept``, and the shares it rests on.

    * A null or empty text has no words and no lines, and fails. Null ids stay null; repeated rows give repeated results.
    * The verdict: a text is dropped if it fails the base rule (under 20 words, or over 30 % of words inside repeated
      8-word windows), if the most frequent n-gram of 2 to 4 words, all repeated n-grams of 5 to 10 words, or repeated
      lines hold more of its characters than ``limits`` allow.
    * Narrow: rows stay where they are, nothing is shuffled. In memory are an Arrow batch of texts and, besides, the word
      hashes of one text at a time.
    """
    limits = limits or Limits()

    def make():
        def one(batch):
            rows = [measure(t, limits) for t in texts(batch.column(1))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

        return one

    return map_arrow(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), make, SCHEMA)
