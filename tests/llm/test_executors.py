"""Task functions must run where workers can't import the package."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

PROGRAM = """
import importlib, sys
sys.path.insert(0, {root!r})
from funnelwright.session import local_session
spark = local_session(2, shuffle_partitions=2, memory="2g")
spark.sparkContext.setLogLevel("OFF")
# Workers get no path to the package: only the driver has it.
def found(_):
    import importlib.util
    return [importlib.util.find_spec("funnelwright") is not None]
assert spark.sparkContext.parallelize([1], 1).mapPartitions(found).collect() == [False]
from funnelwright.llm import alignment, conversations, langid, simhash, suffix_dedup, toxicity
text = "one two three four five six seven eight " * 30
docs = spark.createDataFrame([(i, text + str(i), "en", "s", 0) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
assert langid.predict(docs, langid.profiles(docs)).count() == 4
assert simhash.near_groups(docs).count() == 4
assert suffix_dedup.remove_repeats(docs).count() == 4
assert alignment.linked(docs).count() == 4
assert toxicity.score(docs, toxicity.fit(toxicity.labelled(docs, labels, "true"))).count() == 4
rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
assert conversations.repair(conversations.damaged(rows)).digests().count() == 1
print("all ran")
"""


def test_workers_without_the_package(tmp_path):
    program = tmp_path / "elsewhere.py"
    program.write_text(PROGRAM.format(root=str(ROOT)))
    run = subprocess.run([sys.executable, str(program)], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "all ran" in run.stdout, run.stderr[-3000:]
