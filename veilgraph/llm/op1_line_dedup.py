"""Line dedup by pairwise patience alignment.

A line is its text without outer white space; blank lines never match and always stay.  Documents
with equal line sequences are one class: its first document is aligned for all, the later ones lose
every line.  Each first document is aligned by patience
diff with earlier ones; runs of aligned lines of at least MIN_CHARS characters are deleted from the
later document.  Partners are found through shared runs: such a block holds a shortest run of
consecutive lines that reaches MIN_CHARS, so a document is paired with the first holder of each of its
runs.  Where the alignments leave a line of a shared run standing (it crosses another block, or comes
twice in a document), the next holders of that run are tried, up to its first HOLDERS.  Beyond them holders
are taken by shape: the lines that a document shares with other holders of standing runs, in order, with
one gap for whatever is between.  Lines that nobody else has never match, so all holders of one shape
align alike, and only the first of each shape is tried, in rounds of more and more shapes until none is left.
So a document loses just what alignments with all earlier documents would delete, at any number of
holders, without all pairs of them.  Everything is judged on the input texts.

Rules for odd input: a null text stays null and has no lines; a null doc_id is kept whole; rows of
one doc_id with different texts are kept apart and ordered by a hash of the text, equal rows are
treated alike; a document whose lines all go keeps its blank lines only; lines of more than MIN_CHARS characters are
runs of their own; an empty table gives no rows; a very long text costs memory of its own lines for
each partner in turn; other columns ride along (one named n_lines or n_removed is replaced).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.llm.shared import small_batches, table, written

HOLDERS = 8
MIN_CHARS = 40

_TRIM = "^\\s+|\\s+$"


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: aligned positions (i, j) with a[i] == b[j], both ascending."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        one_a, one_b = Counter(a[i:m]), Counter(b[j:n])
        at = {v: k for k, v in enumerate(a[i:m], i) if one_a[v] == 1 and one_b.get(v) == 1}
        both = [(at[v], k) for k, v in enumerate(b[j:n], j) if v in at]
        chain = _rising(both)
        before = (i, j)
        for p, q in chain:
            out.append((p, q))
            todo.append((before[0], p, before[1], q))
            before = (p + 1, q + 1)
        if chain:
            todo.append((*before[:1], m, before[1], n))
    return sorted(out)


def _rising(both: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs rising in both places (pairs come rising in the second)."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(both)
    for k, (p, _) in enumerate(both):
        at = bisect_left(tops, p)
        if at == len(tops):
            tops.append(p)
            last.append(k)
        else:
            tops[at], last[at] = p, k
        back[k] = last[at - 1] if at else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(both[k])
        k = back[k]
    return out[::-1]


def common_lines(a: list[int], b: list[int], sizes: list[int], least: int = MIN_CHARS) -> list[int]:
    """Positions in b of the lines in aligned blocks of at least `least` characters."""
    gone, run, size, before = [], [], 0, (-2, -2)
    for pair in [*align(a, b), (-9, -9)]:
        if pair != (before[0] + 1, before[1] + 1):
            if size >= least:
                gone += run
            run, size = [], 0
        if pair[1] >= 0:
            run.append(pair[1])
            size += sizes[pair[1]]
        before = pair
    return gone


def _gaps(lines: list[int | None]) -> list:
    """Lines with each gap (null) as a token that nothing equals."""
    return [x if x is not None else (k,) for k, x in enumerate(lines)]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, later, sizes = (batch.column(k) for k in (1, 2, 3))
        gone = [common_lines(_gaps(first[k].as_py()), later[k].as_py(), sizes[k].as_py()) for k in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"])


def shortest_runs(sizes: list[int], least: int = MIN_CHARS) -> list[tuple[int, int]]:
    """Bounds (from, to) of the shortest runs that reach `least`, from each line on and up to each line."""
    out, size, end = set(), 0, 0
    for k in range(len(sizes)):
        while end < len(sizes) and size < least:
            size, end = size + sizes[end], end + 1
        if size < least:
            break
        out.add((k, end))
        size -= sizes[k]
    size, begin = 0, len(sizes)
    for k in range(len(sizes), 0, -1):
        while begin and size < least:
            begin -= 1
            size += sizes[begin]
        if size < least:
            break
        out.add((begin, k))
        size -= sizes[k - 1]
    return sorted(out)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, runs, begins, ends = [], [], [], []
        for k in range(len(batch)):
            h = batch.column(1)[k].as_py()
            for p, q in shortest_runs(batch.column(2)[k].as_py()):
                rows.append(k)
                runs.append(hash(tuple(h[p:q])))  # of whole numbers: alike in every process
                begins.append(p)
                ends.append(q)
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(runs, pa.int64()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "run", "p", "q"])


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.withColumn("__vg_id", F.col("doc_id").cast("long")).withColumn("__vg_tk", F.xxhash64(text)).withColumn("__vg_text", text)


def _line_rows(documents: DataFrame) -> DataFrame:
    """(key, at, h, size, whole): numbers, hashes and sizes of the lines with text of every document that has some."""
    stripped = F.transform(F.split("__vg_text", "\n"), lambda x: F.regexp_replace(x, _TRIM, ""))
    marked = F.transform("lines", lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), F.char_length(x).alias("size")))
    key = F.struct(F.col("__vg_id").alias("id"), F.col("__vg_tk").alias("tk")).alias("key")
    rows = _keyed(documents).where("__vg_id is not null and __vg_text is not null").select(key, stripped.alias("lines"))
    full = rows.select("key", F.filter(marked, lambda s: s["size"] > 0).alias("full")).where(F.size("full") > 0)
    return full.select("key", F.col("full.at").alias("at"), F.col("full.h").alias("h"), F.col("full.size").alias("size"), F.xxhash64("full.h", "full.size").alias("whole"))


def _merged(found: DataFrame) -> DataFrame:
    """(key, part): all line places that alignments delete; at most a document's own lines times its partners."""
    return found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("part"))


def _standing(runs: DataFrame, found: DataFrame) -> DataFrame:
    """Of runs, those with a line that no alignment deleted."""
    part = _merged(found).withColumnRenamed("key", "of")
    joined = runs.join(part, runs["key"] == part["of"], "left")
    left = F.array_except(F.sequence("p", F.col("q") - 1), "part")
    return joined.where(F.col("part").isNull() | (F.size(left) > 0)).drop("of", "part")


def _shapes(heads: DataFrame, held: DataFrame, still: DataFrame) -> DataFrame:
    """(run, a, shape, n): for each standing run the first holder a of every shape, numbered from 1 by a.

    The shape is the lines of a that another holder of a standing run has as well; runs of other lines
    are one null each.
    """
    own = written(held.join(still.select("run").distinct(), "run", "left_semi").select("run", "key").distinct(), "run-members")
    members = heads.join(own.select("key").distinct(), "key", "left_semi").select("key", F.posexplode("h").alias("pos", "line"))
    lines = written(members, "member-lines")
    common = written(lines.select("key", "line").distinct().groupBy("line").agg(F.count("*").alias("holders")).where("holders > 1").select(F.col("line").alias("common")), "common-lines")
    marked = lines.join(common, lines["line"] == common["common"], "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "common"))).alias("s"))
    first = F.filter("s", lambda x, i: (i == 0) | x["common"].isNotNull() | F.get(F.col("s"), i - 1)["common"].isNotNull())
    shaped = marked.select("key", F.transform(first, lambda x: x["common"]).alias("shape"))
    each = own.join(shaped, "key").groupBy("run", "shape").agg(F.min("key").alias("a"))
    return each.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy("a")))


def removed_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, tk, gone): line numbers (from 0, over all lines) to delete from each later document."""
    small_batches(documents.sparkSession)
    plain = written(_line_rows(documents), "lines")
    classes = written(plain.groupBy("whole", F.size("h").alias("n")).agg(F.min("key").alias("first")), "line-classes")
    marked = plain.withColumn("n", F.size("h")).join(classes, ["whole", "n"])
    long_enough = F.aggregate("size", F.lit(0), lambda a, x: a + x) >= MIN_CHARS
    later = marked.where((F.col("key") != F.col("first")) & long_enough).select("key", F.col("at").alias("gone"))
    heads = written(marked.where("key = first").select("key", "at", "h", "size"), "line-heads")
    if not heads.groupBy("key").count().where("count > 1").isEmpty():
        heads = written(heads.dropDuplicates(["key"]), "line-heads")  # rows that repeat as a whole
    runs = written(heads.select("key", "h", "size").mapInArrow(_runs, "key struct<id: long, tk: long>, run long, p int, q int"), "line-runs")
    # written, so that the join below has an exchange of its own on either side and a common run's can be split
    shared = written(runs.groupBy("run").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last"), "shared-runs")
    held = written(runs.join(shared, "run").select("run", "key", "p", "q", "first"), "held-runs")
    firsts = heads.select(F.col("key").alias("a"), F.col("h").alias("ha"))
    seconds = heads.select("key", F.col("h").alias("hb"), F.col("size").alias("sb"))

    def aligned(pairs: DataFrame, lines: str | None = None) -> DataFrame:
        """Aligns a with key, by the whole lines of a or by those that a column of pairs holds."""
        first = pairs.distinct().join(firsts, "a") if lines is None else pairs.select("key", F.col(lines).alias("ha")).distinct()
        both = first.join(seconds, "key").select("key", "ha", "hb", "sb")
        return written(both.mapInArrow(_aligned, "key struct<id: long, tk: long>, gone array<int>").where(F.size("gone") > 0), "aligned")

    after = held.where("key > first")
    found = aligned(after.select(F.col("first").alias("a"), "key"))
    open_runs = written(_standing(after.drop("first"), found), "open-runs")
    # the first HOLDERS of the runs that are open: the limit on the row number is applied before the shuffle
    holders = held.join(open_runs.select("run").distinct(), "run", "left_semi").select("run", F.col("key").alias("a")).distinct()
    earliest = written(holders.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy("a"))).where(F.col("n") <= HOLDERS), "run-holders")
    others = open_runs.join(earliest.where("n > 1"), "run").where("a < key").select("a", "key")
    found = found.union(aligned(others))
    last = earliest.where(F.col("n") == HOLDERS).select("run", F.col("a").alias("last"))
    still = written(_standing(open_runs, found).join(last, "run").where("key > last").drop("last"), "standing-runs")
    if not still.isEmpty():
        shapes = written(_shapes(heads, held, still), "run-shapes")
        low, high = 0, HOLDERS
        while True:
            batch = shapes.where((F.col("n") > low) & (F.col("n") <= high))
            tried = aligned(still.join(batch.select("run", "a", "shape"), "run").where("a < key").select("a", "key", "shape"), "shape")
            found = found.union(tried)
            still = written(_standing(still, found), "standing-runs")
            low, high = high, 8 * high
            if still.isEmpty() or shapes.where(F.col("n") > low).isEmpty():
                break
    numbered = _merged(found).join(heads.select("key", "at"), "key").select("key", F.transform("part", lambda k: F.get("at", k)).alias("gone"))
    return numbered.union(later).select(F.col("key.id").alias("doc_id"), F.col("key.tk").alias("tk"), "gone")


def drop_lines(documents: DataFrame) -> DataFrame:
    """The documents with text less the deleted lines; adds n_lines and n_removed."""
    found = removed_lines(documents).select(F.col("doc_id").alias("__vg_of"), F.col("tk").alias("__vg_oftk"), F.col("gone").alias("__vg_gone"))
    gone = found.dropDuplicates(["__vg_of", "__vg_oftk"])
    same = (F.col("__vg_id") == F.col("__vg_of")) & (F.col("__vg_tk") == F.col("__vg_oftk"))
    joined = _keyed(documents).join(gone, same, "left").withColumn("__vg_lines", F.split("__vg_text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__vg_lines") - 1), F.col("__vg_gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.get("__vg_lines", i)), "\n")
    kept = F.when(F.col("__vg_gone").isNull(), F.col("__vg_text")).otherwise(rest)
    n_lines = F.when(F.col("__vg_text").isNotNull(), F.size("__vg_lines")).otherwise(0).cast("long")
    counted = joined.withColumn("n_lines", n_lines).withColumn("n_removed", F.coalesce(F.size("__vg_gone"), F.lit(0)).cast("long"))
    return counted.withColumn("text", kept).drop("__vg_id", "__vg_tk", "__vg_text", "__vg_of", "__vg_oftk", "__vg_gone", "__vg_lines")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
