"""The built-in sample designs, and a job that writes designs as machine files, refusing invalid ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.kernels import shapes as S

from . import digitize as D

# The samples' colours and measures (millimetres).
RED, BLUE, GREEN, YELLOW = (220, 30, 30), (30, 60, 200), (30, 150, 70), (240, 200, 40)


def circle(x_mm: float, y_mm: float, r_mm: float, n: int = 72) -> np.ndarray:
    t = np.arange(n) / n * 2 * np.pi
    return S.rounded(complex(D.units(x_mm), D.units(y_mm)) + D.units(r_mm) * np.exp(1j * t))


def designs() -> dict[str, tuple[str, list[dict], D.Options]]:
    """id -> (name, regions, options)."""
    region = lambda color, outer, *holes: {"outer": outer, "holes": [h[::-1] for h in holes], "color": color}
    petals = [S.rounded(np.array([280 * np.exp(2j * np.pi * k / 5)]))[0] / 10 for k in range(5)]
    flower = [region(RED, circle(p.real, p.imag, 8)) for p in petals] + [region(YELLOW, circle(0, 0, 10))] + [region(GREEN, circle(30 * k, 40, 5)) for k in (-1, 0, 1)]
    return {
        "a-solid-circle": ("CIRCLE", [region(RED, circle(0, 0, 30))], D.Options(angle_deg=45.0)),
        "b-donut": ("DONUT", [region(BLUE, circle(0, 0, 32), circle(0, 0, 15)), region(YELLOW, circle(0, 0, 9))], D.Options(angle_deg=0.0)),
        "c-scatter": ("FLOWER", flower, D.Options(angle_deg=45.0)),
    }


def stitches(spark: SparkSession) -> DataFrame:
    """Stitches of the samples, a design for each, numbered in the order of their ids."""
    import pandas as pd

    names = sorted(designs())

    def run(batches):
        made = designs()
        for pdf in batches:
            parts = [D.stitch_rows(int(k), D.digitize(*made[names[k]][1:])) for k in pdf["design_id"]]
            yield pd.concat(parts) if parts else pd.DataFrame(columns=[c.split()[0] for c in D.STITCH_ROWS.split(", ")])

    return spark.range(len(names)).withColumnRenamed("id", "design_id").repartition(len(names), "design_id").mapInPandas(run, D.STITCH_ROWS).join(
        F.broadcast(spark.createDataFrame([(k, n, designs()[n][0]) for k, n in enumerate(names)], "design_id long, id string, name string")), "design_id"
    )


def written(stitches: DataFrame) -> DataFrame:
    """(design_id, dst, pes, svg, errors): the files of each design; a design that breaks a rule of the kind `error` has no files, and the
    rules' codes instead.  stitches: with r, g, b and connection."""
    from threadloom.operators import rules
    from threadloom.sources.files import file_contents

    named = stitches.withColumn("thread", F.concat_ws(",", "r", "g", "b"))
    issues = rules.issues(rules.counters(named)).where("severity = 'error'").groupBy("design_id").agg(F.array_sort(F.collect_list("code")).alias("errors"))
    files = file_contents(stitches)
    j = files.join(issues, "design_id", "left")
    ok = F.col("errors").isNull()
    kept = [F.when(ok, F.col(c)).alias(c) for c in files.columns if c != "design_id"]
    return j.select("design_id", *kept, F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))
