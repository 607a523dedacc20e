"""De-identification of texts: credentials, e-mails, addresses, domains, telephone numbers, and given names.

A text is scanned once.  Kinds are looked for in the order of KINDS, each in what is not replaced by the kinds
before it (so a domain within an e-mail that stays is one by itself);
given names come last, longest first.  Values get aliases that are the same everywhere, numbered over the whole
corpus in order of value; a number that an earlier alias table or an alias found in the corpus holds is
skipped, so that two values never share one alias and a redacted corpus is left as it is.  Everything is spliced by
offsets, and only texts with something to replace take part in a join.

Given names are matched as word sequences: the words of a text that begin a name (a bounded bit map says
which may) are emitted with the words after them and joined with the dictionary by value, so the dictionary may
be large.  A name ends at word boundaries; white space within it counts as one blank.

Rules for odd input: a null text gives an empty one; texts are brought to NFC; equal texts are redacted alike,
whatever their key; an empty table gives no rows; a name without a word, or with two aliases, is an error.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.sources.held import held, small_batches

# Names of credentials, schemes that may stand before one, and what is left as it is.
CREDENTIAL_NAMES = ("password", "passwd", "pwd", "pass", "mật khẩu", "secret", "token", "authorization", "api key", "access key", "private key", "client secret")
SCHEMES = ("bearer", "basic")
KEPT_NETWORKS = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "203.0.113.0/24", "240.0.0.0/4", "1.0.0.1/32", "1.1.1.1/32", "8.8.4.4/32", "8.8.8.8/32")
KEPT_MAIL_HOSTS = ("example.com", "example.org", "example.invalid")
KEPT_PHONES = "0900000"
KEPT_DOMAINS = (
    "apache.org", "centos.org", "cloudflare.com", "debian.org", "docker.com", "domain.com", "example.com", "example.org", "github.com", "gmail.com", "google.com", "kernel.org", "letsencrypt.org",
    "microsoft.com", "mysql.com", "nginx.com", "python.org", "redhat.com", "ubuntu.com",
)
TOP_DOMAINS = (
    "ai", "app", "biz", "blog", "cloud", "co", "com", "dev", "digital", "edu", "gov", "info", "int", "io", "media", "mil", "net", "news", "online", "org", "shop", "site", "solutions", "store", "systems",
    "tech", "xyz",
)

CREDENTIAL_MARK = "<CREDENTIAL>"
LEAST_VALUE, LEAST_BARE = 4, 8
NUMBERED = ("email", "ip", "domain", "phone")
KINDS = ("credential", *NUMBERED)

_WORD = re.compile(r"\w+")
_B, _A = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
PATTERNS = {
    "email": re.compile(_B + r"[A-Za-z0-9_.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + _A),
    "ip": re.compile(_B + r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + _A),
    "domain": re.compile(_B + r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:[A-Za-z]{2}|" + "|".join(x for x in TOP_DOMAINS if len(x) > 2) + ")" + _A, re.IGNORECASE | re.ASCII),
    "phone": re.compile(_B + r"0[0-9]{9,10}" + _A),
}
#: Aliases as they stand in a text, and their numbers.
_ALIASES = {"email": re.compile(r"mail([0-9]+)@example\.invalid"), "domain": re.compile(r"customer([0-9]+)\.example"), "phone": re.compile(_B + r"0900000([0-9]{3,4})" + _A), "ip": PATTERNS["ip"]}
_LAST_SHORT = 254
_FAR = int(ipaddress.ip_address("240.0.0.0"))
#: Bits of the map of first words of given names.
MAP_BITS = 20

_SPAN = "struct<start: int, end: int, kind: string, value: string>"


# ---- reading credentials


def _named(text: str, at: int) -> bool:
    """Whether a credential's name ends right before text[at:], but for white space; its words may be joined by a blank, - or _ or nothing."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    tail = text[max(0, end - 24) : end].casefold()
    flat = re.sub(r"[\s_-]+", "", tail)
    return any(flat.endswith(name.replace(" ", "")) and _as_one(tail, name) for name in CREDENTIAL_NAMES)


def _as_one(tail: str, name: str) -> bool:
    """Whether tail ends with the words of name, at most one mark between them (any white space in a name that is not English)."""
    for i, word in enumerate(reversed(name.split())):
        if i:
            cut = tail.rstrip() if not name.isascii() else tail[:-1] if tail[-1:] in (" ", "_", "-") else tail
            tail = cut
        if not tail.endswith(word):
            return False
        tail = tail[: -len(word)]
    return True


def _read_value(text: str, at: int) -> int:
    """End of the credential that starts at text[at]; at itself if there is none.  Quotes belong to it; a scheme may stand before it."""
    if text[at : at + 1] in ("'", '"'):
        close = text.find(text[at], at + 1)
        line = text.find("\n", at + 1)
        return close + 1 if close - at > LEAST_VALUE and (line < 0 or close < line) else at
    end = _bare(text, at)
    if text[at:end].casefold() in SCHEMES:
        begin = _INK.search(text, end)
        after = _bare(text, begin.start()) if begin else end
        if begin and after - begin.start() >= LEAST_VALUE:
            return after
    return end if end - at >= LEAST_VALUE else at


def _bare(text: str, at: int) -> int:
    stop = _STOP.search(text, at)
    return stop.start() if stop else len(text)


_STOP, _INK = re.compile(r"[\s'\"]"), re.compile(r"\S")
_MAY = re.compile(r"pass|pwd|khẩu|secret|token|authorization|key|bearer|basic", re.IGNORECASE)
_SEPARATOR = re.compile(r"[:=]\s*")
_SCHEME = re.compile(rf"(?<!\w)(?:{'|'.join(SCHEMES)})\s+([A-Za-z0-9._~+/=-]{{{LEAST_BARE},}})", re.IGNORECASE)


def credentials(text: str) -> list[tuple[int, int]]:
    """Spans of credential values: after a name and a separator, or after a scheme by itself."""
    if not _MAY.search(text):
        return []
    found, done = [], 0
    for mark in _SEPARATOR.finditer(text):
        if mark.start() < done or not _named(text, mark.start()):
            continue
        end = _read_value(text, mark.end())
        if end > mark.end() and not text.startswith(CREDENTIAL_MARK, mark.end()):
            found.append((mark.end(), end))
            done = end
    for m in _SCHEME.finditer(text):
        if not any(s < m.end() and m.start() < e for s, e in found):
            found.append(m.span(1))
    return sorted(found)


# ---- scan


def _kept(kind: str, value: str) -> bool:
    """Whether a value is left as it is."""
    if kind == "email":
        return value.casefold().endswith(KEPT_MAIL_HOSTS)
    if kind == "domain":
        return value in KEPT_DOMAINS
    if kind == "phone":
        return value.startswith(KEPT_PHONES)
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255:
        return True
    number = int.from_bytes(bytes(parts))
    return any(low <= number <= high for low, high in _KEPT_RANGES)


_KEPT_RANGES = [(int(n.network_address), int(n.broadcast_address)) for n in map(ipaddress.ip_network, KEPT_NETWORKS)]


def _number(kind: str, m: re.Match) -> int | None:
    """Number of an alias found in a text; None if it is none."""
    if kind != "ip":
        return int(m[1])
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    number = int.from_bytes(bytes(parts))
    if parts[:3] == [203, 0, 113]:
        return parts[3]
    return number - _FAR + _LAST_SHORT + 1 if number >= _FAR else None


def find(text: str, starts: bytes | None, lengths: tuple[int, ...]) -> tuple[list[tuple[int, int, str, str]], list[tuple[str, int]]]:
    """((start, end, kind, value) of what is or may be replaced, (kind, number) of aliases already there)."""
    spans = [(s, e, "credential", "") for s, e in credentials(text)]
    left = _blank(text, [s[:2] for s in spans])
    for kind, pattern in PATTERNS.items():
        taken = []
        for m in pattern.finditer(left):
            value = m[0].casefold() if kind in ("email", "domain") else m[0]
            if not _kept(kind, value):
                taken.append(m.span())
                spans.append((*m.span(), kind, value))
        left = _blank(left, taken)
    there = [(kind, n) for kind, pattern in _ALIASES.items() for m in pattern.finditer(text) if (n := _number(kind, m)) is not None]
    if starts is not None:
        words = list(_WORD.finditer(left))
        for i, word in enumerate(words):
            if not _marked(starts, word[0]):
                continue
            for n in lengths:
                if i + n <= len(words):
                    s, e = word.start(), words[i + n - 1].end()
                    if "\0" not in left[s:e]:
                        spans.append((s, e, "name", " ".join(left[s:e].split())))
    return spans, sorted(set(there))


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    """text with ordered spans as zero characters, so that nothing is found in them and places stay."""
    if not spans:
        return text
    out, at = [], 0
    for s, e in spans:
        out += [text[at:s], "\0" * (e - s)]
        at = e
    return "".join(out) + text[at:]


def _bit(word: str) -> int:
    return zlib.crc32(word.encode()) & ((1 << MAP_BITS) - 1)


def _marked(bits: bytes, word: str) -> bool:
    at = _bit(word)
    return bool(bits[at >> 3] >> (at & 7) & 1)


def _scan(starts: bytes | None, lengths: tuple[int, ...]):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
    number = pa.list_(pa.struct([("kind", pa.string()), ("number", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [unicodedata.normalize("NFC", x.as_py() or "") for x in batch.column(1)]
            found = [find(t, starts, lengths) for t in texts]
            spans = pa.array([[dict(zip(("start", "end", "kind", "value"), s, strict=True)) for s in f[0]] for f in found], span)
            there = pa.array([[{"kind": k, "number": n} for k, n in f[1]] for f in found], number)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), spans, there], names=["key", "text", "spans", "there"])

    return run


# ---- aliases


def _ranks(rows: DataFrame, *order: str) -> DataFrame:
    """rows with rank: the place of each within its kind in the given order, from 1; sorted in ranges, with one small window over the ranges."""
    placed = rows.repartitionByRange("kind", *order).sortWithinPartitions("kind", *order)
    placed = held(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranked")
    sizes = placed.groupBy("kind", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("kind", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(base), ["kind", "part"]).withColumn("rank", F.col("base") + F.col("at") - F.col("first") + 1).drop("part", "at", "first", "base")  # base: one row a range and kind


def numbered(values: DataFrame, taken: DataFrame) -> DataFrame:
    """(kind, value, number): distinct values get their kind's free numbers in order of value; taken(kind, number) are not free.

    The j-th taken number t lies above t - j free ones, so a value's number is its rank among values by their own
    rank and taken numbers by t - j together.
    """
    of_values = _ranks(values.select("kind", "value").distinct(), "value").select("kind", F.col("rank").alias("pos"), F.lit(1).alias("turn"), "value")
    of_taken = _ranks(taken.select("kind", "number").where("number > 0").distinct(), "number").select("kind", (F.col("number") - F.col("rank") + 1).alias("pos"), F.lit(0).alias("turn"), F.lit(None).cast("string").alias("value"))
    merged = _ranks(of_values.union(of_taken), "pos", "turn")
    return merged.where("turn = 1").select("kind", "value", F.col("rank").alias("number"))


def alias_of(kind: Column, number: Column) -> Column:
    far = number - (_LAST_SHORT + 1)
    octet = lambda shift: F.shiftright(far, shift).bitwiseAND(F.lit(255).cast("long"))
    address = F.when(number <= _LAST_SHORT, F.format_string("203.0.113.%d", number)).otherwise(F.format_string("%d.%d.%d.%d", F.lit(240).cast("long") + octet(24), octet(16), octet(8), octet(0)))
    forms = {"email": F.format_string("mail%02d@example.invalid", number), "ip": address, "domain": F.format_string("customer%02d.example", number), "phone": F.format_string("0900000%03d", number)}
    out = F.lit(None).cast("string")
    for name, form in forms.items():
        out = F.when(kind == name, form).otherwise(out)
    return out


def check_aliases(known: DataFrame) -> DataFrame:
    """known(kind, value, alias), if it is one-to-one within each kind; else an error that names the aliases."""
    twice = known.groupBy("kind", "alias").agg(F.count_distinct("value").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"aliases of two values: {sorted((r['kind'], r['alias']) for r in twice)}")
    return known


def _known_numbers(known: DataFrame) -> DataFrame:
    rest = F.regexp_extract("alias", r"^(?:mail|customer|0900000)([0-9]+)(?:@example\.invalid|\.example|)$", 1)
    parts = F.split("alias", r"\.")
    octets = [F.try_element_at(parts, F.lit(k)).try_cast("long") for k in range(1, 5)]
    far = sum((o * (1 << (24 - 8 * k)) for k, o in enumerate(octets)), F.lit(0).cast("long")) - _FAR + _LAST_SHORT + 1
    address = F.when(F.col("alias").startswith("203.0.113."), octets[3]).otherwise(far)
    return known.select("kind", F.when(F.col("kind") == "ip", address).otherwise(rest.try_cast("long")).alias("number")).where("number is not null")


# ---- redaction


@F.pandas_udf(T.StringType())
def _name_form(values: pd.Series) -> pd.Series:
    """NFC, white space to single blanks, cut to its first and last word; empty without one."""

    def one(value: str) -> str:
        plain = " ".join(unicodedata.normalize("NFC", value).split())
        words = list(_WORD.finditer(plain))
        return plain[words[0].start() : words[-1].end()] if words else ""

    return values.map(one, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("words", T.IntegerType()), T.StructField("bit", T.IntegerType())]))
def _name_start(values: pd.Series) -> pd.DataFrame:
    words = values.map(_WORD.findall)
    return pd.DataFrame({"words": words.map(len), "bit": words.map(lambda w: _bit(w[0]))})


def dictionary(names: DataFrame) -> DataFrame:
    """(value, alias) of names(value, alias) in the form that texts are searched for."""
    formed = names.where("value is not null").select(_name_form("value").alias("value"), "alias").distinct()
    bad = formed.groupBy("value").agg(F.count("*").alias("n")).where("n > 1 or value = ''").limit(5).collect()
    if bad:
        raise ValueError(f"names without a word or with two aliases: {sorted(r['value'] for r in bad)}")
    return formed


def _starts(known: DataFrame) -> tuple[bytes | None, tuple[int, ...]]:
    """Bit map of first words and the word counts of names: at most 2**MAP_BITS bits and the distinct counts come to the driver."""
    each = known.select(_name_start("value").alias("s")).select("s.words", "s.bit")
    bits = bytearray(1 << (MAP_BITS - 3))
    for r in each.select("bit").distinct().collect():
        bits[r["bit"] >> 3] |= 1 << (r["bit"] & 7)
    lengths = tuple(sorted(r["words"] for r in each.select("words").distinct().collect()))
    return (bytes(bits), lengths) if lengths else (None, ())


def redact(rows: DataFrame, key: str, text: str, names: DataFrame | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((key, redacted, n_credential, n_email, n_ip, n_domain, n_phone, n_name), (kind, value, alias)).

    names(value, alias) are people and organisations; several may share an alias.  known(kind, value, alias) is
    the alias table of earlier runs: its values keep their aliases, and the table returned holds it and what is new.
    """
    spark = rows.sparkSession
    small_batches(spark)
    named = held(dictionary(names), "names") if names is not None else None
    starts, lengths = _starts(named) if named is not None else (None, ())
    kind = rows.schema[key].dataType.simpleString()
    schema = f"key {kind}, text string, spans array<{_SPAN}>, there array<struct<kind: string, number: bigint>>"
    scanned = held(rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_scan(starts, lengths), schema), "scanned")
    some = scanned.where(F.size("spans") > 0).withColumn("of", F.sha2("text", 256))
    each = held(some.select("of", F.explode("spans").alias("s")).select("of", "s.*").distinct(), "spans")
    known = check_aliases(known).select("kind", "value", "alias") if known is not None else spark.createDataFrame([], "kind string, value string, alias string")
    taken = scanned.select(F.explode("there").alias("t")).select("t.kind", "t.number").union(_known_numbers(known))
    fresh = each.where(F.col("kind").isin(*NUMBERED)).select("kind", "value").distinct().join(known, ["kind", "value"], "left_anti")
    aliases = held(known.union(numbered(fresh, taken).select("kind", "value", alias_of(F.col("kind"), F.col("number")).alias("alias"))), "aliases")
    replaced = each.where("kind = 'credential'").select("of", "start", "end", "kind", F.lit(CREDENTIAL_MARK).alias("alias"))
    replaced = replaced.union(each.join(aliases, ["kind", "value"]).select("of", "start", "end", "kind", "alias"))
    if named is not None:
        replaced = replaced.union(each.where("kind = 'name'").join(named, "value").select("of", "start", "end", "kind", "alias"))
    lists = replaced.groupBy("of").agg(F.collect_list(F.struct("start", "end", "kind", "alias")).alias("put"))  # bounded by the text
    columns = ", ".join(f"n_{k} long" for k in (*KINDS, "name"))
    spliced = some.join(lists, "of", "left").select("key", "text", "put").mapInArrow(_splice, f"key {kind}, redacted string, {columns}")
    plain = scanned.where(F.size("spans") == 0).select("key", F.col("text").alias("redacted"), *[F.lit(0).cast("long").alias(f"n_{k}") for k in (*KINDS, "name")])
    return spliced.union(plain).withColumnRenamed("key", key), aliases


def _splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = (*KINDS, "name")
    for batch in batches:
        texts, counts = [], [[] for _ in order]
        for text, put in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            chosen: list[dict] = []
            busy = bytearray(len(text))
            # names come last, longest first, and never reach into what is taken
            for p in sorted(put or (), key=lambda p: (p["kind"] == "name", p["start"] - p["end"], p["start"])):
                if not any(busy[p["start"] : p["end"]]):
                    busy[p["start"] : p["end"]] = b"\1" * (p["end"] - p["start"])
                    chosen.append(p)
            out, at = [], 0
            for p in sorted(chosen, key=lambda p: p["start"]):
                out += [text[at : p["start"]], p["alias"]]
                at = p["end"]
            texts.append("".join(out) + text[at:])
            for c, k in zip(counts, order, strict=True):
                c.append(sum(p["kind"] == k for p in chosen))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *[pa.array(c, pa.int64()) for c in counts]], names=["key", "redacted", *[f"n_{k}" for k in order]])
