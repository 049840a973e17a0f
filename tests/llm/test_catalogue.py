import subprocess
import sys
from pathlib import Path

import pytest

from tests.compare import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["p2_found", "p8_found"])
def test_query_and_its_sql(spark, name):
    import __spark_entry__ as e

    assert compare(spark, name, e.queries()[name], e.oracle_sql()[name], SMALL) == ""


def test_ids_of_every_document(spark):
    import __spark_entry__ as e

    rows = e.queries()["p7_ids"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    assert all(bool(r.ids) == bool(texts[r.doc_id]) for r in rows)


def test_missing_module_fails_loudly():
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True).returncode
