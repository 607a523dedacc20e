"""Text functions: normalisation, ids, chunking, front matter, pseudonyms."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the namespace of point ids.
ID_NAMESPACE = "93cef57c853153dea55fdbe2449c3d9d"

CHUNK_WORDS, CHUNK_OVERLAP = 1200, 100
MIN_SALT = 16


def collapse_py(value: str) -> str:
    """NFC, white space to single blanks, outer paired double quotes peeled."""
    whole = " ".join(unicodedata.normalize("NFC", value).split())
    core = whole.strip('" ')
    if not core:
        return '"' * (whole.count('"') % 2)
    begin = whole.index(core)
    left, right = whole[:begin].split('"'), whole[begin + len(core) :].split('"')
    pairs = min(len(left), len(right)) - 1
    if not pairs:
        return whole
    return '"'.join(left[pairs:]).lstrip() + core + '"'.join(right[: len(right) - pairs]).rstrip()


@F.pandas_udf(T.StringType())
def collapse(values: pd.Series) -> pd.Series:
    return values.map(collapse_py, na_action="ignore")


def fold_py(value: str) -> str:
    return " ".join((value.lower() if value.isascii() else unicodedata.normalize("NFC", value).casefold()).split())


@F.pandas_udf(T.StringType())
def fold(values: pd.Series) -> pd.Series:
    """NFC, white space collapsed, case folded: for comparing."""
    codes, distinct = pd.factorize(values)  # each distinct value of a batch once; null has code -1
    done = [fold_py(x) for x in distinct]
    return pd.Series([done[c] if c >= 0 else None for c in codes], index=values.index, dtype=object)


def normal_id(name: Column) -> Column:
    """NFC without outer white space and paired quotes: two Unicode forms of one name are one id; an empty name is an error."""
    plain = _id_form(name)
    return F.when(F.length(plain) > 0, plain).when(name.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("an id may not be empty")))


def id_form_py(value: str) -> str:
    plain = unicodedata.normalize("NFC", value).strip()
    while re.fullmatch(r'"(?s:.*)"', plain):
        plain = plain[1:-1].strip()
    return plain


@F.pandas_udf(T.StringType())
def _id_form(values: pd.Series) -> pd.Series:
    return values.map(id_form_py, na_action="ignore")


def point_id(name: Column) -> Column:
    """Name-based version 5 UUID of the normal form of an id, from built-in SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(ID_NAMESPACE)), F.encode(normal_id(name), "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab89ab89ab89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def prefixed_md5(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(F.trim(value)))


def pseudonym(salt: str, kind: Column, value: Column) -> Column:
    """16 hex digits of a salted hash; one salt a release."""
    if len(salt) < MIN_SALT:
        raise ValueError(f"a salt needs {MIN_SALT} characters")
    return F.substring(F.sha2(F.concat_ws("\0", F.lit(salt), kind, value), 256), 1, 16)


def chunks(rows: DataFrame, key: str, text: str, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_no, n_words, content): sliding windows of words."""
    words = F.array_remove(F.split(text, "\\s+"), "")
    step = size - overlap
    cut = rows.select(key, words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(step))
    each = cut.select(key, "words", F.posexplode(starts).alias("chunk_no", "at"))
    part = F.slice("words", F.col("at") + 1, F.lit(size))
    return each.select(key, "chunk_no", F.size(part).alias("n_words"), F.array_join(part, " ").alias("content"))


def front_matter(text: Column) -> Column:
    """struct(meta map, body): a block of `k: v` lines between `---` lines at the start, if it is closed."""
    block = "(?s)\\A[ \\t]*---[ \\t]*\\n(.*?)(?<=\\n)[ \\t]*---[ \\t]*(?:\\n|\\z)"
    inner = F.regexp_extract(text, block, 1)
    closed = F.regexp_like(text, F.lit(block))
    lines = F.filter(F.split(inner, "\n"), lambda x: x.contains(":"))
    unquoted = lambda v: F.regexp_replace(v, "^(['\"])(.*)\\1$", "$2")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(unquoted(F.trim(F.regexp_replace(x, "^[^:]*:", "")))).alias("v")))
    last = F.aggregate(pairs, F.expr("map()").cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    meta = F.when(closed, last).otherwise(F.expr("map()").cast("map<string,string>"))
    return F.struct(meta.alias("meta"), F.when(closed, F.regexp_replace(text, block, "")).otherwise(text).alias("body"))


@F.pandas_udf(T.StringType())
def plain(values: pd.Series) -> pd.Series:
    """NFC, white space collapsed."""
    return values.map(lambda x: " ".join(unicodedata.normalize("NFC", x).split()), na_action="ignore")


def grouping_key(name: Column, case: bool = True, domain: bool = True, joints: bool = True) -> Column:
    """Name without case, domain suffix, blanks, dashes and underscores, or with those rules that are off; only dotted machine names have a suffix."""
    base = fold(name) if case else plain(name)
    labels = F.split(base, "\\.")
    machine = (F.size(labels) > 1) & F.forall(labels, lambda x: x.rlike("^[A-Za-z0-9-]+$")) & F.element_at(labels, -1).rlike("^[A-Za-z]{2,}$")
    short = F.when(machine, F.element_at(labels, 1)).otherwise(base) if domain else base
    return F.regexp_replace(short, "[\\s_-]+", "") if joints else short
