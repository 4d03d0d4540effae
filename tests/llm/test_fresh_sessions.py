"""Each text query as the first of its application, from a folder that isn't the repository's."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
DATA = Path("/root/testdata/sf0.001")
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from __spark_entry__ import queries
from turnwise.session import local_session

for name in sys.argv[1:]:
    spark = local_session(4, app=name, memory="2g")
    print("rows", name, len(queries()[name](spark, {str(DATA)!r}).collect()), flush=True)
    spark.stop()
"""
NAMES = ("op9_toxicity", "op4_lm_scoring", "op11_centroid_clustering", "op10_html_extraction", "pipeline")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_queries_run_alone(tmp_path):
    script = tmp_path / "alone.py"
    script.write_text(SCRIPT)
    run = subprocess.run([sys.executable, str(script), *NAMES], cwd=tmp_path, capture_output=True, text=True, timeout=1500)
    found = [line.split()[1] for line in run.stdout.splitlines() if line.startswith("rows ")]
    assert found == list(NAMES), run.stderr[-3000:]
