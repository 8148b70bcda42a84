"""Workers import the library from what the session ships, not from the driver's folder."""

import os
import subprocess
import sys
import tempfile

from conftest import ROOT, SF_SMALL

CODE = """
import os, sys, tempfile
sys.path.insert(0, {root!r})
from shoppulse.plans.catalog import load_all
from shoppulse.session import get_session
from shoppulse.sources.quoted import quoted_records
spark = get_session("local[2]", 2)
registry = load_all()
for name in ("corr_pairs", "item_correlation", "pair_rules"):
    print(name, registry[name][0](spark, {sf!r}).count() > 0)
with open("r.csv", "w") as f:
    f.write('t\\n"a\\nb"\\nc\\n')
print("records", quoted_records(spark, os.path.abspath("r.csv")).count())
"""


def test_workers_in_another_folder():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, sf=SF_SMALL)], text=True, env=env,
                         cwd=tempfile.mkdtemp(prefix="shoppulse-test-"), capture_output=True, timeout=300)
    assert run.stdout.split() == ["corr_pairs", "True", "item_correlation", "True", "pair_rules", "True",
                                  "records", "2"], run.stderr[-2000:]
