"""Tokenizers, normal forms and similarities as column expressions. Every tokenizer of the engine has its own rules."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the semantic and the title tokenizer skip.
STOPWORDS = (
    "und oder der die das den dem des mit für fuer bei zum zur auf aus vom ins als von ein eine einer einem eines nicht auch noch nur bis so "
    "and or the for with from to in on at by of as is are was were be been not but also"
).split()
SEMANTIC_ONLY = "im am an ist sind war wurde werden wie was wenn how".split()


def folded(text: Column) -> Column:
    """Lower case with umlauts spelled out and underscores as hyphens."""
    out = F.lower(text)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("_", "-")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def semantic_tokens(text: Column) -> Column:
    """Search terms, with repeats: hyphenated words count whole and in parts; three letters at least, no stopwords."""
    words = F.split(F.regexp_replace(folded(text), r"[^\p{L}\p{N}/\s-]", " "), r"[\s/]+")
    parts = F.flatten(F.transform(words, lambda w: F.when(F.contains(w, F.lit("-")), F.concat(F.array(w), F.split(w, "-"))).otherwise(F.array(w))))
    stop = F.array(*[F.lit(w) for w in (*STOPWORDS, *SEMANTIC_ONLY)])
    kept = F.filter(parts, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))
    return F.filter(F.transform(kept, lambda w: F.regexp_replace(w, "^-+|-+$", "")), lambda w: w != "")


def query_normal(text: str) -> str:
    """folded() of a text on the driver."""
    out = text.lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("_", "-")):
        out = out.replace(a, b)
    return out.strip()


def query_tokens(text: str) -> list[str]:
    """semantic_tokens() of a query on the driver."""
    words = regex.split(r"[\s/]+", regex.sub(r"[^\p{L}\p{N}/\s-]", " ", query_normal(text)))
    parts = [p for w in words for p in ([w, *w.split("-")] if "-" in w else [w])]
    return [t for t in (p.strip("-") for p in parts if len(p) >= 3 and p not in STOPWORDS and p not in SEMANTIC_ONLY) if t]


def title_tokens(text: Column) -> Column:
    """Distinct words of three letters or more without stopwords."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s-]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def content_text(text: Column) -> Column:
    """The text outside code in lower case, with nothing but words and white space between them."""
    from lorewell.functions.markdown import without_code

    return F.regexp_replace(F.lower(without_code(text)), r"[^\p{L}\p{N}\s-]+", " ")


def content_words(text: Column) -> Column:
    """Words of four letters or more outside code, with repeats."""
    return F.filter(F.split(content_text(text), r"\s+"), lambda w: F.length(w) >= 4)


def raw_tokens(text: Column) -> Column:
    """Runs of letters, digits, underscores and hyphens, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1))


def trigrams(text: Column) -> Column:
    n = F.length(text) - 2
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def blended_similarity(a: Column, b: Column) -> Column:
    return jaccard(a, b) * 0.58 + containment(a, b) * 0.42


def occurrences(text: Column, needle: Column) -> Column:
    """Occurrences that do not overlap."""
    return F.when(F.length(needle) > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")).otherwise(F.lit(0).cast("long"))


def osa_distance(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no substring edited twice."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def osa_similarity():
    """Pandas UDF: 1 - distance / longer length, 1 for two empty texts."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1.0 if not (x or y) else 1 - osa_distance(x or "", y or "") / max(len(x or ""), len(y or "")) for x, y in zip(a, b, strict=True)])

    return run


#: Our own secret patterns: name, pattern.
SECRETS = (
    ("private_key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("token", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,})"),
    ("assignment", r"(?i)\b(?:password|passwd|secret|api_?key|token)\s*[:=]\s*\S+"),
)


def redacted(text: Column) -> tuple[Column, Column]:
    """The text with secrets masked, and how many there were."""
    count = F.lit(0)
    for name, pattern in SECRETS:
        count = count + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, f"[REDACTED:{name}]")
    return text, count.cast("long")
