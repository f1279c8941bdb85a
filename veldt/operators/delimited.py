"""Several values packed in one field into one row per value.

A field is cut into units: listed names, runs of ordinary characters, blanks and single signs. With ordinary characters
masked the units form the field's delimiter skeleton. There are far fewer skeletons than fields: each distinct one is
read once, by a small scanner that knows lists, quoting and escapes, and becomes a list of unit ranges. The rules are
joined back, and the values are taken from the units by position, inside the JVM.
"""

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.functions.text import BLANK, blank, strip
from veldt.session import col, cut, hint

#: Signs that separate values.
SEPARATORS = ",;|/、，；\t\n\r"
#: Other signs that may belong to a notation.
SIGNS = "\"'[]"
#: Listed names that hold a separator or sign, at most; only these must be known beforehand, others cannot be split.
MOST_NAMES = 20_000
#: Both as the body of a Java character class.
_ESCAPED = "".join("\\" + c if c in "[]|/" else c for c in SEPARATORS + SIGNS)


def unit_pattern(names: list[str]) -> str:
    """A Java pattern that matches one unit at a time; names that hold signs come first, the longest before others."""
    signs = _ESCAPED + r"\\"
    held = sorted({n.strip() for n in names if re.search(f"[{re.escape(SEPARATORS + SIGNS)}]", n)}, key=lambda n: (-len(n), n))
    before, after = rf"(?<![^{signs}{BLANK}])", rf"(?=[{BLANK}]*(?:[{signs}]|$))"
    listed = [before + "(?:" + "|".join(r"\Q" + n + r"\E" for n in held) + ")" + after] if held else []
    return "(?iuU)" + "|".join([*listed, rf"\\[\s\S]", rf"[{signs}]", rf"[{BLANK}&&[^{signs}]]+", rf"[^{signs}{BLANK}][^{signs}]*"])


def split_rule(skeleton: str) -> list[tuple[int, int, str]]:
    """The values of a skeleton as (first unit from 1, number of units, quoting: '', 'csv' or 'list').

    a: ordinary text or a listed name, b: blanks, e: an escaped character, otherwise the sign itself.
    """
    lo, hi = 0, len(skeleton)
    while lo < hi and skeleton[lo] == "b":
        lo += 1
    while hi > lo and skeleton[hi - 1] == "b":
        hi -= 1
    is_list = hi - lo >= 2 and skeleton[lo] == "[" and skeleton[hi - 1] == "]"
    if is_list:
        lo, hi = lo + 1, hi - 1
    out, i = [], lo
    while i < hi:
        while i < hi and skeleton[i] == "b":
            i += 1
        if i < hi and (skeleton[i] == '"' or is_list and skeleton[i] == "'"):
            j, end = i + 1, None
            while j < hi:
                if skeleton[j] == skeleton[i]:
                    if j + 1 < hi and skeleton[j + 1] == skeleton[i] and not is_list:
                        j += 2
                        continue
                    k = j + 1
                    while k < hi and skeleton[k] == "b":
                        k += 1
                    if k == hi or skeleton[k] in SEPARATORS:
                        end = k
                        break
                j += 1
            if end is not None:
                out.append((i + 2, j - i - 1, "list" if is_list else "csv"))
                i = end + 1
                continue
        j = i
        while j < hi and skeleton[j] not in SEPARATORS:
            j += 1
        if set(skeleton[i:j]) - {"b"}:
            out.append((i + 1, j - i, ""))
        i = j + 1
    return [r for r in out if r[1] > 0]


def _rules(batches):
    for pdf in batches:
        yield pd.DataFrame({"skeleton": pdf["skeleton"], "rule": pd.Series([[{"first": a, "n": b, "quoting": q} for a, b, q in split_rule(s)] for s in pdf["skeleton"]], pdf.index, object)})


def split_packed(df: DataFrame, key: str, field: str, names: DataFrame | None = None, names_col: str = "genre") -> DataFrame:
    """key, pos, value: one row for each non-blank value of the field, pos from 1 in the order of the field.

    Values are separated by any of SEPARATORS, may be quoted (in double quotes, doubled inside, outside of lists; in either
    quotes, with backslashes inside, in lists in brackets), and stand as written, without blanks around them and without the quoting. A listed name, in any case,
    is one value wherever it fills the place of a value. Null, empty and blank fields and blank keys give no row, nor do
    empty tables; repeated rows give one case; other columns are ignored.
    """
    listed = []
    if names is not None:
        held = names.select(col(names_col).cast("string").alias("name")).filter(F.col("name").rlike(f"[{_ESCAPED}]")).distinct()
        listed = [r[0] for r in held.limit(MOST_NAMES + 1).collect()]
        if len(listed) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} names hold a separator or sign")
    base = df.select(col(key).alias("k"), col(field).cast("string").alias("packed")).filter(~blank(F.col("k")) & ~blank(F.col("packed"))).distinct()
    units = F.expr("regexp_extract_all(packed, pattern, 0)")
    mask = F.transform("units", lambda u: F.when(u.startswith("\\"), F.lit("e")).when((F.length(u) == 1) & u.isin(*(SEPARATORS + SIGNS)), u).when(blank(u), F.lit("b")).otherwise(F.lit("a")))
    base = base.withColumn("pattern", F.lit(unit_pattern(listed))).withColumn("units", units).drop("pattern", "packed").withColumn("skeleton", F.array_join(mask, ""))
    rules = cut(base.select("skeleton").distinct().mapInPandas(_rules, "skeleton string, rule array<struct<first int, n int, quoting string>>"))

    def value(r):
        raw = F.array_join(F.slice("units", r["first"], r["n"]), "")
        return strip(F.when(r["quoting"] == "csv", F.replace(raw, F.lit('""'), F.lit('"'))).when(r["quoting"] == "list", F.regexp_replace(raw, r"\\([\s\S])", "$1")).otherwise(raw))

    # Quoted blanks are no values: they are dropped before the positions are given.
    values = F.filter(F.transform("rule", value), lambda v: ~blank(v))
    parts = base.join(hint(rules), "skeleton").select("k", F.posexplode(values).alias("at", "value"))
    return parts.select(F.col("k").alias(key), (F.col("at") + 1).cast("int").alias("pos"), "value")
