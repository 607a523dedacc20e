"""Secret scan: fixed patterns, and further credentials found by how many owners hold a value.

Every text is scanned once for the patterns of BASE and for random-looking tokens.  The values of all
of these are hashed, and the hashes counted over the whole corpus by distinct owner and repository: a
value that COPIED or more owners hold is a widely copied example; one that a single owner holds, and at
most REPOSITORIES of its repositories, is that owner's own.  A token that looks live and is its owner's
own becomes a span of kind `live`, unless it lies in a span of BASE; spans of BASE always stay, and
n_live and n_copied say how many of all spans and tokens are owner-specific and live-looking, or copied.

Only rows with a span or token take part in the count and the join; the same owner's copies of a value are
counted once before the shuffle by value.

Rules for odd input: a null text is empty; rows of one doc_id are told apart by a hash of their text;
equal rows get equal results; a null owner counts as one owner of its own and so does a null
repository; other columns are ignored; an empty table gives no rows; long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.shared import small_batches, table, written

#: Kind, pattern and least length of the group that counts; fixed values.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
LIVE = "live"
#: Runs that may be a credential without a name before it.
TOKEN = r"[A-Za-z0-9_+=-]{20,}"
#: A live-looking value has so many distinct characters at least, and one of PLACEHOLDERS nowhere.
DISTINCT = 10
PLACEHOLDERS = ("example", "placeholder", "changeme", "dummy", "sample", "yourtoken", "yourkey", "xxxx", "0123456789", "1234567890", "abcdef0123")
COPIED = 3
REPOSITORIES = 3

_ORDER = {kind: i for i, (kind, *_) in enumerate(BASE)} | {LIVE: len(BASE)}
_FOUND = "array<struct<start: int, end: int, kind: int, base: boolean, live: boolean, value: binary>>"


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base patterns in a text, by start, then kind as listed."""
    found = []
    for kind, pattern, group, least in _COMPILED:
        found += [(*m.span(), kind, m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[0], _ORDER[s[2]]))


#: In Python, letters of either case mean ASCII ones only under re.ASCII; a run of hex digits too short to count need not be made.
_COMPILED = tuple((kind, re.compile(p if kind != "hex" else r"[0-9a-f]{32,}", re.ASCII | re.IGNORECASE if kind == "assign" else 0), group, least) for kind, p, group, least in BASE)
_TOKEN = re.compile(TOKEN)
_DIGIT, _UPPER, _LOWER = re.compile("[0-9]"), re.compile("[A-Z]"), re.compile("[a-z]")


def looks_live(value: str) -> bool:
    """Whether a value looks drawn at random: letters and digits, many distinct characters, no placeholder."""
    flat = value.lower()
    return bool(_DIGIT.search(value)) and len(set(value)) >= DISTINCT and not any(p in flat for p in PLACEHOLDERS)


def random_token(value: str) -> bool:
    """A token without a name before it must show digits, small and capital letters."""
    return bool(_DIGIT.search(value) and _UPPER.search(value) and _LOWER.search(value))


def spans_text(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("base", pa.bool_()), ("live", pa.bool_()), ("value", pa.binary())])
    for batch in batches:
        counts: list[list[int]] = [[] for _ in BASE]
        digests, founds = [], []
        for text in batch.column(4):
            text = text.as_py() or ""
            base = base_spans(text)
            rows = [{"start": s, "end": e, "kind": _ORDER[kind], "base": True, "live": looks_live(v), "value": xxhash.xxh3_128_digest(v)} for s, e, kind, v in base]
            for m in _TOKEN.finditer(text):
                s, e = m.span()
                if random_token(m[0]) and looks_live(m[0]) and not any(s < b[1] and b[0] < e for b in base):
                    rows.append({"start": s, "end": e, "kind": _ORDER[LIVE], "base": False, "live": True, "value": xxhash.xxh3_128_digest(m[0])})
            for i, (kind, *_) in enumerate(BASE):
                counts[i].append(sum(b[2] == kind for b in base))
            digests.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
            founds.append(rows)
        columns = [batch.column(i) for i in range(4)] + [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(founds, pa.list_(struct))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tk", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def scan(documents: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Per row its keys, base counts and digest, and found: all base spans and live-looking tokens with hashes of their values."""
    small_batches(documents.sparkSession)
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), text.alias("text"))
    return rows.mapInArrow(_scan, f"doc_id long, tk long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, found {_FOUND}")


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repositories) of every hash in found (value, owner, repository); a null owner or repository counts as one."""
    once = found.groupBy("value", F.struct("owner").alias("owner"), F.struct("repository").alias("repository")).agg(F.count("*").alias("n"))
    by_owner = once.groupBy("value", "owner").agg(F.count("*").alias("pairs"))
    by_repository = once.groupBy("value", "repository").agg(F.count("*").alias("pairs"))
    owners = by_owner.groupBy("value").agg(F.count("*").alias("owners"))
    return owners.join(by_repository.groupBy("value").agg(F.count("*").alias("repositories")), "value")


def secrets(documents: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied); spans: array of (start, end, kind)."""
    rows = written(scan(documents, owner, repository), "scanned")
    some = rows.where(F.size("found") > 0)
    each = some.select("doc_id", "tk", "owner", "repository", F.explode("found").alias("f")).select("doc_id", "tk", "owner", "repository", "f.*")
    counted = written(ownership(each.select("value", "owner", "repository")), "ownership")
    own = (F.col("owners") == 1) & (F.col("repositories") <= REPOSITORIES) & F.col("live")
    judged = each.select("doc_id", "tk", "value", "start", "end", "kind", "base", "live").distinct().join(counted, "value")
    span = F.struct("start", "kind", "end")
    verdicts = judged.groupBy(F.col("doc_id").alias("of_id"), F.col("tk").alias("of_tk")).agg(
        F.array_sort(F.collect_list(F.when(F.col("base") | own, span))).alias("held"), F.count_if(own).alias("n_live"), F.count_if(F.col("owners") >= COPIED).alias("n_copied")
    )
    kept = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    with_spans = some.join(verdicts, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("tk") == F.col("of_tk"))).select(*kept, F.transform("held", lambda s: F.struct(s["start"], s["end"], s["kind"])).alias("spans"), "n_live", "n_copied")
    none = rows.where(F.size("found") == 0).select(*kept, F.array().cast("array<struct<start: int, end: int, kind: int>>").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    return with_spans.union(none)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source names its repository; what stands before a slash in it is the owner."""
    found = secrets(table(spark, sf_dir, "documents"), F.substring_index("source", "/", 1), F.col("source"))
    kinds = F.array(*[F.lit(k) for k in _ORDER])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), "n_live", "n_copied")
