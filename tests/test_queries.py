"""Every query of the newer modules against its SQL."""

import uuid

import pytest
from oracle import same

from cohortspark.plans import blocks, fusion_queries, job_queries, live_queries, record_queries, registry, source_queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for m in (blocks, fusion_queries, job_queries, live_queries, record_queries, source_queries) for n in m.SQL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_name_based_ids(spark):
    got = registry.queries()["op_uuid5"](spark, SF).collect()
    space = uuid.UUID(blocks.NAMESPACE)
    assert got and all(r.id == str(uuid.uuid5(space, f"patient/{r.c_custkey}")) for r in got)


def test_the_entry_module_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
