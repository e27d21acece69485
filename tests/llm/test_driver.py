"""Memory of the driver's JVM."""

import gc
import re
import time
from pathlib import Path

from spindrift.llm.common import staged


def test_freed_native_memory_goes_back(spark):
    """3,000 buffers of 64 KB are freed but for every fiftieth, so that the C library keeps what lies between."""
    jvm = spark.sparkContext._jvm
    path = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    anonymous = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", path.read_text())[1]) / 1024
    df = spark.range(10)
    staged(df, "first")
    held = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(3000)]
    few = held[::50]
    del held
    gc.collect()
    for _ in range(3):
        jvm.System.gc()
        time.sleep(0.5)
    before = anonymous()
    staged(df, "second")
    assert before - anonymous() > 100, len(few)


def test_no_checkpoint_folder_in_local_mode(tmp_path):
    """A plain local session, with no setting anywhere, stages in a folder of this machine."""
    import os
    import subprocess
    import sys

    repo = str(Path(__file__).resolve().parents[2])
    code = f"""
import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
from spindrift.llm import jaccard
from spindrift.llm.common import shared_dir
d = s.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "x y z")], "doc_id long, text string")
print(sorted(tuple(r) for r in jaccard.query(d).collect()), shared_dir(s) == shared_dir(s))
"""
    (tmp_path / "conf").mkdir()
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "TMPDIR": str(tmp_path)}, timeout=300)
    assert done.stdout.strip().endswith("[(1, 2, 1), (2, 2, 1), (3, 1, 3)] True"), done.stderr[-2000:]
