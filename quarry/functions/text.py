"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Scripts that are cut into pairs of characters, the other word characters, and the stop words.
CJK = "\\u4E00-\\u9FFF\\u3040-\\u30FF\\uAC00-\\uD7AF"
OTHER = "0-9A-Za-z_\\u00C0-\\u303F\\u3100-\\u4DFF\\uA000-\\uABFF\\uD7B0-\\uD7FF\\uE000-\\uFFFF"
STOP = ["a", "an", "the", "of", "to", "in", "on", "for", "and", "or", "is", "are", "was", "were", "be", "been", "it", "its", "as", "at", "by", "with", "from", "that", "this"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased words; a run of CJK characters gives its overlapping pairs, a single one itself."""
    runs = F.regexp_extract_all(F.lower(col(text)), F.lit(f"([{CJK}]+|[{OTHER}]+)"), F.lit(1))
    pairs = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
    mixed = F.flatten(F.transform(runs, lambda s: F.when(s.rlike(f"^[{CJK}]") & (F.length(s) > 1), pairs(s)).otherwise(F.array(s))))
    return F.when(col(text).rlike(f"[{CJK}]"), mixed).otherwise(runs)  # texts without such runs have nothing to cut further


def index_tokens(text: Column | str, stop: list[str] | None = STOP) -> Column:
    """tokens without stop words; None keeps all."""
    found = tokens(text)
    if not stop:
        return found
    return F.filter(found, lambda t: ~t.isin(*stop))


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), "\\s+", " "))


def snippet(text: Column | str, n: int = 240) -> Column:
    """Collapsed text cut to n characters, with an ellipsis only if something was cut."""
    t = collapse(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def normalized(text: Column | str) -> Column:
    return collapse(F.lower(col(text)))


def citations(answer: Column | str) -> Column:
    """Distinct passage numbers of [1], [2][3] and [1, 2] marks in order of first use."""
    marks = F.regexp_extract_all(col(answer), F.lit("\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]"), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(marks, lambda x: F.split(x, ","))), lambda x: F.trim(x).cast("int")))


def fenced(text: Column | str) -> Column:
    """Text without a surrounding code fence."""
    return F.trim(F.regexp_replace(col(text), "(?s)^\\s*```[a-zA-Z]*\\s*|\\s*```\\s*$", ""))


def model_json(text: Column | str) -> Column:
    """The JSON object of a model's answer: fence stripped, else the widest braces; null if neither parses."""
    plain = fenced(text)
    widest = F.regexp_extract(col(text), "(?s)\\{.*\\}", 0)
    return F.coalesce(F.try_parse_json(plain), F.try_parse_json(F.when(widest != "", widest)))


def json_text(text: Column | str) -> Column:
    """As model_json, as text: the part that parses, or null."""
    plain = fenced(text)
    widest = F.regexp_extract(col(text), "(?s)\\{.*\\}", 0)
    return F.when(F.try_parse_json(plain).isNotNull(), plain).when((widest != "") & F.try_parse_json(widest).isNotNull(), widest)


def json_path(text: Column | str, nested: str, flat: str, default: float) -> Column:
    """A number at the nested path, else at the flat one, else the default; 0 is a value like others."""
    at = lambda p: F.get_json_object(col(text), p).cast("double")
    return F.coalesce(at(nested), at(flat), F.lit(default))


def pairs(text: Column | str) -> Column:
    """Map of a 'key:value,key:value' list; the last value of a key counts, parts without a colon are left out."""
    parts = F.filter(F.transform(F.split(col(text), ","), lambda p: F.trim(p)), lambda p: p.contains(":"))
    entries = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def short_filename(name: Column | str) -> Column:
    """File name without its number prefix and extension."""
    return F.regexp_replace(F.regexp_replace(col(name), "^\\d+[-_]", ""), "\\.[A-Za-z0-9]+$", "")


def sub_queries(answer: Column | str, question: Column | str, most: int = 4) -> Column:
    """Questions of a JSON list: trimmed, blanks dropped, at most `most`; the question itself if nothing is left."""
    listed = F.from_json(fenced(answer), "array<string>")
    good = F.slice(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != ""), 1, most)
    return F.when(F.coalesce(F.size(good), F.lit(0)) > 0, good).otherwise(F.array(col(question)))


def rewritten(answer: Column | str, question: Column | str) -> Column:
    """First line of a rewrite without quotes; the question if it is blank."""
    first = F.trim(F.element_at(F.split(F.regexp_replace(F.trim(col(answer)), "^[\"']+|[\"']+$", ""), "\n"), 1))
    return F.coalesce(F.when(first != "", first), col(question))


def percent(x: Column | str, digits: int = 1) -> Column:
    return F.when(col(x).isNull(), F.lit("n/a")).otherwise(F.concat(F.round(col(x) * 100, digits).cast(f"decimal(20,{digits})").cast("string"), F.lit("%")))


def seconds(ms: Column | str) -> Column:
    return F.when(col(ms).isNull(), F.lit("n/a")).otherwise(F.concat(F.round(col(ms) / 1000, 1).cast("decimal(20,1)").cast("string"), F.lit(" s")))


def usd(x: Column | str) -> Column:
    return F.when(col(x).isNull(), F.lit("n/a")).otherwise(F.concat(F.lit("$"), F.round(col(x), 4).cast("decimal(20,4)").cast("string")))


def cost(tokens_in: Column | str, tokens_out: Column | str, price_in: Column | str, price_out: Column | str) -> Column:
    """USD of a call to six digits, rounded half up in whole units of 1e-10 USD; null where the model has no price."""
    units = lambda tokens, price: col(tokens).cast("long") * F.round(col(price) * 10_000).cast("long")
    return F.floor((units(tokens_in, price_in) + units(tokens_out, price_out) + 5000) / 10_000) / 1e6


@F.pandas_udf(StringType())
def slug(text: pd.Series) -> pd.Series:
    """ASCII letters and digits of the text in lower case, other runs as one dash, 48 characters."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        return "-".join("".join(c if c.isalnum() else " " for c in plain).split()).lower()[:48]

    return text.map(one)


def hash_id(*parts: Column | str) -> Column:
    """An id in the form of a uuid from the values of parts: equal values have equal ids on any cluster; nulls count as empty."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
