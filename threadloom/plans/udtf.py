"""Generators as table functions of SQL: SELECT * FROM regions, LATERAL stitches_of('tatami', outer, holes, map('angle_deg', 45.0))."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from threadloom.kernels import fills
from threadloom.kernels import shapes as S


@udtf(returnType="run_idx int, seq int, x int, y int")
class StitchesOf:
    def eval(self, generator: str, outer, holes, params):
        make = fills.REGISTRY.get(generator)
        if make is None or outer is None or len(outer) < 3:
            return
        ring = lambda r: S.ring([(p["x"], p["y"]) for p in r])
        runs = make(S.wound(ring(outer), True), [S.wound(ring(h), False) for h in holes or ()], dict(params or {}))
        for k, run in enumerate(runs):
            z = fills.finish(run)
            for n, (x, y) in enumerate(zip(z.real.astype(int).tolist(), z.imag.astype(int).tolist(), strict=True)):
                yield k, n, x, y


def register(spark: SparkSession, name: str = "stitches_of") -> None:
    spark.udtf.register(name, StitchesOf)
