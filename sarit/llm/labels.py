"""Language labels in their many spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and names of the four languages.
NAMES = {
    "hi": ["hi", "hin", "hindi", "हिन्दी", "हिंदी", "हिन्दि", "हिंदि"],
    "ne": ["ne", "nep", "npi", "nepali", "nepalese", "नेपाली", "नेपालि"],
    "mr": ["mr", "mar", "marathi", "मराठी", "मराठि"],
    "en": ["en", "eng", "english", "अंग्रेज़ी", "अंग्रेजी", "अङ्ग्रेजी", "अंग्रेज़ी", "इंग्रजी", "इङ्ग्लिस"],
}


def label_column(name: str) -> Column:
    """hi, ne, mr, en or null: the language that a label names, by its first subtag, whatever the case and blanks."""
    first = F.lower(F.regexp_extract(F.trim(F.regexp_replace(name, r"[\p{Cf}\p{Z}\s]+", " ")), r"^([\p{L}\p{M}]+)", 1))
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(first.isin(names), F.lit(code)).otherwise(out)
    return out
