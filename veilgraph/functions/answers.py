"""Prompts and answers of a language model: templates, context blocks, strict parsing of JSON answers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of an answer, its bound of sources, and the labels and fences of context blocks.
REFUSED, ANSWER, SOURCES = "khong_co_dap_an", "cau_tra_loi", "nguon"
MAX_SOURCES = 1000
#: Lines that one record of a block may have.
LONGEST_CELL = 200
BLOCKS = ("-----Entities-----", "-----Relationships-----", "-----Sources-----")
FENCE, FENCE_END = "```csv", "```"


def prompt(template: str, **values: Column) -> Column:
    """The template with each {name} replaced once by its column, text inside values left alone; unknown or unused names are errors."""
    parts = re.split(r"\{(\w+)\}", template)
    named = set(parts[1::2])
    if named != set(values):
        raise ValueError(f"template and values differ in {sorted(named ^ set(values))}")
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def context_blocks(entities: Column, edges: Column, sources: Column) -> Column:
    """Three labelled and fenced CSV blocks; null is an empty block."""
    block = lambda label, body: F.concat(F.lit(f"{label}\n{FENCE}\n"), F.coalesce(body, F.lit("")), F.lit(f"\n{FENCE_END}\n"))
    return F.concat(*[block(label, body) for label, body in zip(BLOCKS, (entities, edges, sources), strict=True)])


def block_of(context: Column, which: int) -> Column:
    """Body of one of the three blocks, found by the labels: fences may also occur inside sources. Null where a label is missing."""
    label = BLOCKS[which]
    begin = F.locate(label, context)
    cut = F.substring(context, begin + len(label), F.char_length(context))
    if which + 1 < len(BLOCKS):
        cut = F.substring_index(cut, BLOCKS[which + 1], 1)
    inner = F.regexp_replace(F.regexp_replace(cut, "^\\s*" + FENCE + "\\n?", ""), "\\n?" + FENCE_END + "\\s*$", "")
    return F.when(begin > 0, inner)


def is_empty_context(context: Column) -> Column:
    """Whether all three blocks are blank; null where the context has not the three labels."""
    blank = lambda i: F.trim(block_of(context, i)) == ""
    return blank(0) & blank(1) & blank(2)


def parse_answers(rows: DataFrame, text: str) -> DataFrame:
    """Adds refused, answer, sources and code to rows; code is null for a good answer, else the first fault.

    NOT_JSON; NOT_OBJECT; MISSING_KEY; REFUSED_TYPE and ANSWER_TYPE (only a JSON boolean and a JSON string
    do); CONTRADICTION, not refused and blank; SOURCES_TYPE, no list of whole numbers; TOO_MANY sources.  A
    refusal has an empty answer whatever text came with it.  Sources keep their order without repeats and
    negative numbers; a missing list is empty.  A fence around the JSON is taken off.
    """
    body = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(F.col(text), F.lit(""))), "^```[^\\n]*\\n", ""), "\\n?```\\s*$", "")
    names = ("_json", "_refused", "_answer", "_sources", "_items")
    part = lambda key: F.try_variant_get("_json", f"$.{key}", "variant")
    kind = lambda c: F.schema_of_variant(c)
    read = rows.withColumn("_json", F.try_parse_json(body)).withColumns({"_refused": part(REFUSED), "_answer": part(ANSWER), "_sources": part(SOURCES)})
    read = read.withColumn("_items", F.try_variant_get("_json", f"$.{SOURCES}", "array<variant>"))
    refused = F.try_variant_get("_json", f"$.{REFUSED}", "boolean")
    answer = F.try_variant_get("_json", f"$.{ANSWER}", "string")
    whole = F.forall("_items", lambda x: kind(x) == "BIGINT")
    code = (
        F.when(F.col("_json").isNull(), "NOT_JSON")
        .when(~kind(F.col("_json")).startswith("OBJECT"), "NOT_OBJECT")
        .when(F.col("_refused").isNull() | F.col("_answer").isNull(), "MISSING_KEY")
        .when(kind(F.col("_refused")) != "BOOLEAN", "REFUSED_TYPE")
        .when(kind(F.col("_answer")) != "STRING", "ANSWER_TYPE")
        .when(~refused & (F.trim(answer) == ""), "CONTRADICTION")
        .when(F.col("_sources").isNotNull() & (F.col("_items").isNull() | ~whole), "SOURCES_TYPE")
        .when(F.size("_items") > MAX_SOURCES, "TOO_MANY")
    )
    numbers = F.try_variant_get("_json", f"$.{SOURCES}", "array<bigint>")
    kept = F.array_distinct(F.filter(F.coalesce(numbers, F.array().cast("array<bigint>")), lambda x: x >= 0))
    good = lambda c: F.when(F.col("code").isNull(), c)
    return read.withColumn("code", code).withColumns({"refused": good(refused), "answer": good(F.when(refused, "").otherwise(answer)), "sources": good(kept)}).drop(*names)


def csv_records(block: str) -> list[list[str]]:
    """Records of a CSV text: quotes may hold commas, line breaks and doubled quotes.

    A record goes on over lines while a quoted cell is open.  One that never closes ends at its own line:
    tables that were put together without quoting hold stray quotes, and they must not swallow what follows.
    """
    lines, out, at = block.split("\n"), [], 0
    while at < len(lines):
        end = at + 1
        cells, is_open = _cells(lines[at])
        while is_open and end < len(lines) and end - at < LONGEST_CELL:
            end += 1
            cells, is_open = _cells("\n".join(lines[at:end]))
        if is_open:
            end, cells = at + 1, _cells(lines[at])[0]
        if any(c for c in cells):
            out.append(cells)
        at = end
    return out


def _cells(record: str) -> tuple[list[str], bool]:
    """Trimmed cells of a record, and whether a quoted one is still open at its end."""
    cells, at, n = [], 0, len(record)
    while True:
        begin = at
        while begin < n and record[begin] in " \t":
            begin += 1
        if begin < n and record[begin] == '"':
            value, at, closed = [], begin + 1, False
            while at < n:
                quote = record.find('"', at)
                if quote < 0:
                    break
                value.append(record[at:quote])
                if record.startswith('""', quote):
                    value.append('"')
                    at = quote + 2
                    continue
                at, closed = quote + 1, True
                break
            if not closed:
                return [*cells, record[begin + 1 :].strip()], True
            comma = record.find(",", at)
            tail = record[at : comma if comma >= 0 else n]
            cells.append(("".join(value) + tail.rstrip()).strip())
        else:
            comma = record.find(",", at)
            cells.append(record[at : comma if comma >= 0 else n].strip())
        if comma < 0:
            return cells, False
        at = comma + 1


def block_rows(rows: DataFrame, key: str, block: str, column: str = "hyperedge") -> DataFrame:
    """(key, row_no, ordinal, value): rows of CSV blocks with a header, what each holds in a column, and the number in its id cell.

    ordinal is -1 where the id cell is no number; rows with nothing in the column are left out, and so are blocks
    without the column.  A null block has no rows; nothing is deduplicated.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, numbers, ordinals, values = [], [], [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                records = csv_records(body or "")
                if not records or column not in records[0]:
                    continue
                at, of_id = records[0].index(column), records[0].index("id") if "id" in records[0] else None
                for n, cells in enumerate(records[1:], 1):
                    if len(cells) > at and cells[at]:
                        mark = cells[of_id] if of_id is not None else ""
                        owners.append(i)
                        numbers.append(n)
                        ordinals.append(int(mark) if mark.isdecimal() and len(mark) < 10 else -1)
                        values.append(cells[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), pa.array(numbers, pa.int32()), pa.array(ordinals, pa.int32()), pa.array(values, pa.string())], names=[key, "row_no", "ordinal", "value"])

    return rows.select(key, F.col(block).cast("string")).mapInArrow(run, f"`{key}` {kind}, row_no int, ordinal int, value string")


def cited(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, value): distinct values whose ordinal an answer declares; rows(key, ordinal, value), answers(key, sources array)."""
    return answers.select("key", F.explode("sources").alias("ordinal")).where("ordinal >= 0").join(rows, ["key", "ordinal"]).select("key", "value").distinct()
