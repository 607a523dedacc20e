"""SimHash near-duplicates: popcount grid range-join, exact Hamming verification, components.

Rules for odd input: a null or word-less text has fingerprint zero and links like any other; a bit set in
exactly half of the shingles is 0; rows whose doc_id repeats each keep their row; a row with a null
doc_id links like any other, and its component is the smallest doc_id it reaches, null if none; an empty
table gives no rows; a very long text is hashed whole, in memory of its own size; columns besides doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.components import connected_components
from veilgraph.llm.shared import cut, small_batches, table
from veilgraph.llm.textbatch import slices

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: A grid cell whose candidate pairs exceed this is cut into blocks of BLOCK rows a side.
HOT_PAIRS = 2_000
BLOCK = 1_024

_LOW = 0x5555555555555555


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for rows, data, offsets in slices(batch, limit=1 << 18):
            hashes: list[int] = []
            counts = np.zeros(len(rows), dtype=np.int64)
            body = data.tobytes()
            for i in range(len(rows)):
                words = body[offsets[i] : offsets[i + 1]].lower().split()
                if not words:
                    continue
                if len(words) <= SHINGLE:
                    hashes.append(digest(b" ".join(words), SEED))
                    counts[i] = 1
                    continue
                flat = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                begins = np.concatenate(([0], ends[: -SHINGLE] + 1)).tolist()
                hashes += [digest(flat[s:e], SEED) for s, e in zip(begins, ends[SHINGLE - 1 :].tolist(), strict=True)]
                counts[i] = len(begins)
            prints = np.zeros(len(rows), dtype=np.uint64)
            if hashes:
                bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                full = np.flatnonzero(counts)
                starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
                ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
                wins = (2 * ones > counts[full][:, None]).astype(np.uint8)
                prints[full] = np.packbits(wins, axis=1, bitorder="little").view("<u8").ravel()
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "tk", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, tk, fp): majority bits over XXH64 of lower-cased word shingles; tk, a hash of the text, tells rows of one doc_id apart."""
    small_batches(documents.sparkSession)
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text")).mapInArrow(_fingerprints, "doc_id long, tk long, fp long")


def _cells(prints: DataFrame) -> DataFrame:
    """Grid cells of both halves of the segment-popcount vector.

    Segments are bit pairs.  Counts 0, 1, 2 are held as thermometer codes 00, 01, 11, so the
    Manhattan distance of two vectors is the popcount of their codes' xor; it never exceeds the
    Hamming distance.  Distance 3 or less leaves one half at 1 or less: each row lies in its own
    cell of a half (home) and looks into its own and every cell one count higher.
    """
    x = F.col("fp")
    pair = F.shiftrightunsigned(x, 1)
    code = x.bitwiseOR(pair).bitwiseAND(F.lit(_LOW)).bitwiseOR(F.shiftleft(x.bitwiseAND(pair).bitwiseAND(F.lit(_LOW)), 1))
    halves = F.array(F.struct(F.lit(0).alias("half"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")), F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("code", 32).alias("cell")))
    flat = prints.withColumn("code", code).select("rep", "fp", "code", F.explode(halves).alias("h")).select("rep", "fp", "code", "h.half", "h.cell")
    ups = [
        F.when(F.col("cell").bitwiseAND(F.lit(1 << (2 * j))) == 0, F.col("cell").bitwiseOR(F.lit(1 << (2 * j)))).otherwise(
            F.when(F.col("cell").bitwiseAND(F.lit(2 << (2 * j))) == 0, F.col("cell").bitwiseOR(F.lit(2 << (2 * j))))
        )
        for j in range(16)
    ]
    home = flat.withColumn("home", F.lit(True))
    look = flat.withColumn("cell", F.explode(F.array_compact(F.array(F.col("cell"), *ups)))).withColumn("home", F.lit(False))
    return home.union(look)


_POP = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def popcount(x: np.ndarray) -> np.ndarray:
    return _POP[x.view(np.uint16).reshape(*x.shape, 4)].sum(axis=-1)


def _block_links(group: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest of the links between one block of homes and one of lookers (or one block within itself)."""
    rows = group.drop_duplicates("rep").reset_index(drop=True)
    value, rep, home = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["rep"].to_numpy(), rows["rep"].isin(group.loc[group["home"], "rep"]).to_numpy()
    looks = rows["rep"].isin(group.loc[~group["home"], "rep"]).to_numpy()
    root = np.arange(len(rows))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    looking = np.flatnonzero(looks)
    for i in np.flatnonzero(home):
        near = looking[popcount(np.ascontiguousarray(value[looking] ^ value[i])) <= MAX_BITS]
        for j in near:
            p, q = find(i), find(j)
            if p != q:
                root[p] = q
                out.append((rep[i], rep[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between representatives of distinct fingerprints that connect everything within MAX_BITS.

    Ordinary cells join directly and are verified in the join condition.  A cell with more than
    HOT_PAIRS candidate pairs is cut into blocks; each pair of blocks is one bounded task group that
    returns a spanning forest of its links: as connected as all the links, without all pairs.
    """
    cells = _cells(prints)
    sizes = cells.groupBy("half", "cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("looks"))
    live = sizes.where("homes > 0 and looks > 1").withColumn("hot", F.col("homes") * F.col("looks") > HOT_PAIRS).withColumn("blocks", F.ceil(F.greatest("homes", "looks") / BLOCK).cast("int"))
    marked = cut(cells.join(live.select("half", "cell", "hot", "blocks"), ["half", "cell"]))
    usual = marked.where("not hot")
    left = usual.where("home").select("half", "cell", F.col("rep").alias("a"), F.col("fp").alias("fa"), F.col("code").alias("ca"))
    right = usual.where("not home").select("half", "cell", F.col("rep").alias("b"), F.col("fp").alias("fb"), F.col("code").alias("cb"))
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= MAX_BITS) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= MAX_BITS)
    direct = left.join(right, (left["half"] == right["half"]) & (left["cell"] == right["cell"]) & near).select("a", "b")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    hot = marked.where("hot").withColumn("own", block).withColumn("other", others)
    grouped = hot.withColumn("i", F.when(F.col("home"), F.col("own")).otherwise(F.col("other"))).withColumn("j", F.when(F.col("home"), F.col("other")).otherwise(F.col("own")))
    forest = grouped.select("half", "cell", "i", "j", "rep", "fp", "home").groupBy("half", "cell", "i", "j").applyInPandas(_block_links, "a long, b long")
    return direct.union(forest)


def _classes(prints: DataFrame) -> DataFrame:
    """(of_fp, least, component): distinct fingerprints, their smallest row (null ids last), and a label of their component."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tk")).alias("least")
    classes = cut(prints.groupBy("fp").agg(least).withColumn("rep", F.col("fp")))
    parts = connected_components(links(classes.select("rep", "fp")), "a", "b")
    return cut(classes.join(parts, classes["rep"] == parts["node"], "left").select(F.col("fp").alias("of_fp"), "least", F.coalesce("component", "rep").alias("component")))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of MAX_BITS or fewer differing bits; null where none has one."""
    prints = cut(fingerprints(documents))
    named = _classes(prints)
    labels = named.join(named.groupBy("component").agg(F.min("least.doc_id").alias("component_id")), "component").select("of_fp", "component_id")
    return prints.join(labels, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")


def later_copies(documents: DataFrame) -> DataFrame:
    """(doc_id, tk) of all rows but the smallest (doc_id, tk), null ids last, of each component of linked fingerprints."""
    prints = cut(fingerprints(documents))
    named = _classes(prints)
    stays = named.join(named.groupBy("component").agg(F.min("least").alias("stays")), "component").select("of_fp", "stays")
    joined = prints.join(stays, F.col("fp") == F.col("of_fp"))
    return joined.where(~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("tk") == F.col("stays.tk")))).select("doc_id", "tk").distinct()


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
