"""Guards and parsers that the SQL comparison does not reach."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilgraph.functions import answers, text
from veilgraph.operators import masking, vector
from veilgraph.sources import scan


def test_answers_are_strict(spark):
    good = '{"khong_co_dap_an": false, "cau_tra_loi": "x", "nguon": %s}'
    cases = {
        good % "[2, 0, 2]": (None, [2, 0]), good % "[]": (None, []), good % "null": ("SOURCES_TYPE", None), good % "[1.5]": ("SOURCES_TYPE", None),
        good % '["1"]': ("SOURCES_TYPE", None), good % str(list(range(1001))): ("TOO_MANY", None), '{"khong_co_dap_an": "true", "cau_tra_loi": "x"}': ("REFUSED_TYPE", None),
        "": ("NOT_JSON", None), "{": ("NOT_JSON", None), "7": ("NOT_OBJECT", None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "reply string")
    found = {r["reply"]: (r["code"], r["sources"]) for r in answers.parse_answers(rows, "reply").collect()}
    assert found == cases
    assert answers.parse_answers(spark.createDataFrame([(None,)], "reply string"), "reply").first()["code"] == "NOT_JSON"


def test_prompts_and_blocks(spark):
    row = spark.createDataFrame([("{b}", "```csv\nid\n```")], "a string, b string")
    assert row.select(answers.prompt("{a}-{b}", a=F.col("a"), b=F.lit("x")).alias("p")).first()["p"] == "{b}-x"
    with pytest.raises(ValueError):
        answers.prompt("{a}", b=F.col("a"))
    block = answers.block_of(answers.context_blocks(F.lit("e"), F.lit(None), F.col("b")), 2)
    assert row.select(block.alias("x")).first()["x"] == "```csv\nid\n```"


def test_guards(spark, tmp_path):
    (tmp_path / ".space").write_text("s0\n")
    scan.check_space(str(tmp_path), "s0")
    with pytest.raises(ValueError):
        scan.check_space(str(tmp_path), "s1")
    with pytest.raises(ValueError):
        scan.check_space(str(tmp_path / "none"), "s0")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "vec_id int, embedding array<double>")
    assert sorted(r["vec_id"] for r in vector.check_size(vectors, 2).collect()) == [2, 3]
    assert masking.check_masked(vectors, vectors.withColumn("more", F.lit(1))) is not None
    with pytest.raises(ValueError):
        masking.check_masked(vectors, vectors.drop("embedding"))


def test_id_form():
    assert text.id_form_py(' ""a" "b"" ') == 'a" "b'
    assert text.id_form_py('"') == '"' and text.id_form_py('""') == ""


@pytest.mark.parametrize("missing", ["xxhash", "veilgraph.llm", "corpus_pipeline"])
def test_the_rest_works_without(missing):
    """A library that cannot be imported takes away only what needs it."""
    code = f"""
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hide())
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
names = set(e.queries())
print(len(names) > 90, "pii_redact" in names, "op1_line_dedup" in names, "pipeline" in names, set(e.oracle_sql()) <= names)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parent.parent, timeout=300)
    has = missing == "corpus_pipeline"
    assert done.stdout.split() == ["True", "True", str(has), "False", "True"], done.stderr[-500:]
