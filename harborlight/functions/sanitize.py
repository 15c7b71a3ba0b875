"""Defusing untrusted advisory text before it is quoted to a model."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SOURCE_CHARS, MAX_TEXT_CHARS = 200_000, 8_000

# Fixed patterns: invisible characters, control characters, chat-template tokens, envelope tags, fences.
INVISIBLE = r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\u3164\ufeff\uffa0]"
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"
CONTROL_TOKEN = r"(?im)<\|[a-z0-9_\-]{0,32}\|>|\[/?INST\]|<</?SYS>>|</?s>|^[ \t]{0,8}(?:system|assistant|human|user)[ \t]{0,4}:"
ENVELOPE_TAG = r"(?i)</?[ \t]{0,4}(?:advisory|advisory_text|context|dossier|evidence|instruction|instructions|prompt|system|untrusted)\b[^>\n]{0,200}>"
FENCE = r"[`~]{3,}"
# Fixed patterns: text that addresses a model, by name.
INSTRUCTIONS = {
    "override": r"(?i)\b(?:ignore|disregard|forget|override|bypass)\b[^.\n]{0,40}\b(?:previous|prior|earlier|above|preceding|all|any)\b[^.\n]{0,40}\b(?:instruction|prompt|rule|direction|guideline|context|message)s?\b",
    "role-reassignment": r"(?i)\byou are (?:now|no longer|actually)\b|\b(?:act|behave) as\b[^.\n]{0,30}\b(?:assistant|model|ai|system)\b|\bpretend (?:to be|that you)\b",
    "injected-instructions": r"(?i)\bnew (?:instruction|rule|directive|task)s?\b[ \t]{0,4}:|\b(?:system|developer) (?:prompt|message|instruction)s?\b[ \t]{0,4}:",
    "verdict-steering": r"(?i)\b(?:mark|report|treat|classify|consider|rate)\b[^.\n]{0,30}\b(?:false positive|not exploitable|not vulnerable|not affected|benign|harmless)\b",
    "suppression": r"(?i)\bdo not\b[^.\n]{0,20}\b(?:report|flag|mention|include|escalate|alert|surface)\b|\bsuppress\b[^.\n]{0,30}\b(?:finding|vulnerability|alert|match|result)s?\b",
    "output-steering": r"(?i)\b(?:respond|reply|answer|output|return)\b[^.\n]{0,20}\bonly\b|\bset\b[^.\n]{0,20}\b(?:priority|severity|recommendation|confidence)\b[^.\n]{0,20}\bto\b",
}


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility forms folded, which no built-in function does."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def sanitized(rows: DataFrame, text_col: str, limit: int = MAX_TEXT_CHARS) -> DataFrame:
    """Adds ``safe_text``, ``control_tokens``, ``injections`` and ``truncated``. What is defused is marked, not deleted.

    ASCII texts skip the Python step, as nothing in them changes there. A null text is an empty one.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    cut = F.left(raw, F.lit(MAX_SOURCE_CHARS))
    ascii_only = F.octet_length(cut) == F.length(cut)
    t = rows.withColumn("__n", F.length(raw)).withColumn("__c", cut)
    t = t.withColumn("__t", F.when(ascii_only, F.col("__c")).otherwise(nfkc(F.when(~ascii_only, F.col("__c")))))
    t = t.withColumn("__t", F.regexp_replace(F.regexp_replace("__t", INVISIBLE, ""), CONTROL, " "))
    t = t.withColumn("__t", F.replace(F.replace("__t", F.lit("[["), F.lit("[ [")), F.lit("]]"), F.lit("] ]")))
    t = t.withColumn("control_tokens", F.lit(0)).withColumn("injections", F.lit(0))
    steps = [("control_tokens", CONTROL_TOKEN, "control-token"), ("control_tokens", ENVELOPE_TAG, "markup"), ("control_tokens", FENCE, "fence")]
    steps += [("injections", p, f"instruction-like:{n}") for n, p in INSTRUCTIONS.items()]
    for counter, pattern, name in steps:
        t = t.withColumn(counter, F.col(counter) + F.regexp_count("__t", F.lit(pattern))).withColumn("__t", F.regexp_replace("__t", pattern, f"[[neutralized: {name}]]"))
    t = t.withColumn("__t", F.regexp_replace(F.regexp_replace(F.regexp_replace("__t", r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))
    over = F.length("__t") - limit
    shortened = F.concat(F.regexp_replace(F.left("__t", F.lit(limit)), r"\s+$", ""), F.lit("\n[[truncated: "), over.cast("string"), F.lit(" characters omitted]]"))
    t = t.withColumn("truncated", (F.col("__n") > MAX_SOURCE_CHARS) | (over > 0)).withColumn("safe_text", F.when(over > 0, shortened).otherwise(F.col("__t")))
    return t.select(*rows.columns, "safe_text", "control_tokens", "injections", "truncated")


def one_line(safe_text: Column, limit: int = 200) -> Column:
    return F.left(F.btrim(F.regexp_replace(safe_text, r"\s+", " ")), F.lit(limit))
