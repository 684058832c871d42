"""A command's output as a stream of lines."""

from __future__ import annotations

import subprocess
import threading

from pyspark.sql import DataFrame, SparkSession

CAPTURED = "doc_id long, line_no double, line string"


def capture(spark: SparkSession, argv: list[str], timeout: float | None = 600.0, allowed: set[str] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Lines of standard output and of standard error, read side by side, and the exit code; run on the driver.

    ``allowed``: programs that may be run; another one is an error. No shell is involved.
    """
    if not argv or allowed is not None and argv[0] not in allowed:
        raise ValueError(f"not allowed: {argv[:1]}")
    run = subprocess.Popen(argv, stdout=subprocess.PIPE, stderr=subprocess.PIPE, stdin=subprocess.DEVNULL, text=True, errors="replace")
    found: dict[str, str] = {}
    readers = [threading.Thread(target=lambda name=name, pipe=pipe: found.update({name: pipe.read()}), daemon=True) for name, pipe in (("out", run.stdout), ("err", run.stderr))]
    for r in readers:
        r.start()
    try:
        code = run.wait(timeout)
    except subprocess.TimeoutExpired:
        run.kill()
        run.wait()
        code = -9
    for r in readers:
        r.join()
    rows = lambda text: spark.createDataFrame([(0, float(i), x) for i, x in enumerate(text.removesuffix("\n").split("\n") if text else [])], CAPTURED)
    return rows(found["out"]), rows(found["err"]), code
