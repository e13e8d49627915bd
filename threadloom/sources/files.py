"""Machine files, drawings and documents as tables, and plans as files' contents.

Files are read with Spark's own readers (binaryFile, whole texts), so any store works that Spark knows; each file is decoded by
itself, many at a time.  What is written are rows with the contents: how they get to a store is up to the writer of the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.kernels import codec, svg
from threadloom.operators.records import merged_settings
from threadloom.plans import sketch

RECORDS = "file string, rec bigint, kind string, dx int, dy int"
PES_RECORDS = "file string, rec bigint, kind string, dx int, dy int, label string, palette array<int>"
REGIONS = "file string, region_idx int, outer array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, r int, g int, b int"
CONTENTS = "design_id bigint, dst binary, pes binary, svg string"

#: Project documents: what is missing takes the defaults below.
PROJECT = (
    "version int, name string, createdAt string, updatedAt string, settings struct<colorCount:int,removeWhiteBackground:boolean,targetSizeMm:double,angleDeg:double,trimMode:string,underlay:array<string>,fabricId:string,targetStitches:int>"
)
PROJECT_DEFAULTS = {"colorCount": 6, "removeWhiteBackground": True, "targetSizeMm": 100.0, "angleDeg": 45.0, "trimMode": "auto", "fabricId": "standard", "targetStitches": 12_000}
PROJECT_VERSION = 3


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def _decoded(files: DataFrame, rows, schema: str) -> DataFrame:
    """The rows of each file, and an `error` that is null; of a file that can't be read one row, with the error and nothing else, so that
    one broken file doesn't end a job over millions."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for f, content in zip(pdf["file"], pdf["content"], strict=True):
                try:
                    out = [(f, *r, None) for r in rows(bytes(content) if not isinstance(content, str) else content)]
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is said in its row
                    out = [(f, *[None] * (len(names) - 1), f"{type(e).__name__}: {e}")]
                if out:
                    yield pd.DataFrame(out, columns=[*names, "error"], dtype=object)

    return files.mapInPandas(run, f"{schema}, error string")


def dst_records(files: DataFrame) -> DataFrame:
    """(file, content) to records."""
    return _decoded(files, lambda b: [(k, kind, dx, dy) for k, (dx, dy, kind) in enumerate(codec.read_dst(b)["records"])], RECORDS)


def pes_records(files: DataFrame) -> DataFrame:
    def rows(b):
        p = codec.read_pes(b)
        return [(k, kind, dx, dy, p["label"], p["palette"]) for k, (kind, dx, dy) in enumerate(p["ops"])]

    return _decoded(files, rows, PES_RECORDS)


def points(records: DataFrame, flip_y: bool) -> DataFrame:
    """Where stitches land: moves add up before anything is left out."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("rec").rowsBetween(Window.unboundedPreceding, 0)
    y = F.sum("dy").over(w)
    p = records.withColumns({"x": F.sum("dx").over(w).cast("int"), "y": (-y if flip_y else y).cast("int")})
    return p.where("kind = 'stitch'").select("file", "rec", "x", "y")


def _point_structs(z: np.ndarray) -> list[dict]:
    return [{"x": float(p.real), "y": float(p.imag)} for p in z]


def svg_regions(files: DataFrame, target: float = 1000.0) -> DataFrame:
    """(file, content as text) to regions."""

    def rows(text):
        return [(k, _point_structs(r["outer"]), [_point_structs(h) for h in r["holes"]], *r["color"]) for k, r in enumerate(svg.regions(text, target))]

    return _decoded(files, rows, REGIONS)


def projects(texts: DataFrame, column: str = "content") -> DataFrame:
    """Project documents with defaults: the known settings as columns, and all of them, known or not, as a map.  A document without a
    version, or of a later one, is not ok, and `error` says so."""
    p = texts.withColumn("p", F.from_json(column, PROJECT)).withColumn("m", F.from_json(F.get_json_object(column, "$.settings"), "map<string,string>"))
    default = lambda k, v: F.coalesce(F.col(f"p.settings.{k}"), F.lit(v)).alias(k)
    under = F.coalesce(F.col("p.settings.underlay"), F.array(F.lit("edge"))).alias("underlay")
    ok = F.coalesce(F.col("p.version") <= PROJECT_VERSION, F.lit(False))
    error = F.when(F.col("p.version").isNull(), "no version").when(~ok, F.concat(F.lit("version "), F.col("p.version").cast("string"), F.lit(f" is later than {PROJECT_VERSION}")))
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    every = merged_settings("m", {k: text(v) for k, v in PROJECT_DEFAULTS.items()} | {"underlay": '["edge"]'})
    return p.select("file", F.coalesce("p.name", F.lit("untitled")).alias("name"), "p.createdAt", "p.updatedAt", ok.alias("ok"), *(default(k, v) for k, v in PROJECT_DEFAULTS.items()), under, every.alias("settings"), error.alias("error"))


def project_json(df: DataFrame, now: Column | None = None) -> DataFrame:
    """(file, content) of project rows, saved at `now`: updatedAt is that, createdAt what the project has, or that as well."""
    settings = F.struct(*PROJECT_DEFAULTS, "underlay")
    at = F.date_format(F.to_utc_timestamp(F.current_timestamp() if now is None else now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    created = F.coalesce(F.col("createdAt"), at) if "createdAt" in df.columns else at
    return df.select("file", F.to_json(F.struct(F.lit(PROJECT_VERSION).alias("version"), "name", created.alias("createdAt"), at.alias("updatedAt"), settings.alias("settings"))).alias("content"))


def plan_of(pdf: pd.DataFrame, name: str) -> dict:
    """The nested plan of one design's stitch rows (block_idx, run_idx, seq, x, y, r, g, b, connection)."""
    blocks = []
    pdf = pdf.sort_values(["block_idx", "run_idx", "seq"])
    for _, b in pdf.groupby("block_idx", sort=True):
        runs = [{"stitches": list(zip(r["x"].tolist(), r["y"].tolist(), strict=True)), "connection": r["connection"].iloc[0]} for _, r in b.groupby("run_idx", sort=True)]
        blocks.append({"thread": {k: int(b[k].iloc[0]) for k in "rgb"}, "runs": runs})
    return {"name": name, "blocks": blocks}


def file_contents(stitches: DataFrame) -> DataFrame:
    """Each design as DST, PES and SVG."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        key = int(pdf["design_id"].iloc[0])
        plan = plan_of(pdf, f"DESIGN{key}")
        return pd.DataFrame([(key, codec.write_dst(plan), codec.write_pes(plan), codec.svg_preview(plan))], columns=["design_id", "dst", "pes", "svg"])

    return stitches.groupBy("design_id").applyInPandas(one, CONTENTS)


SKETCH_ROWS = "file string, block_idx bigint, run_idx bigint, seq bigint, x int, y int, connection string, stitch_type string"


def sketch_plans(texts: DataFrame) -> DataFrame:
    """Sketch documents (file, content) compiled to stitches."""

    def rows(text):
        blocks = sketch.compile_document(sketch.load(text))
        return [(bi, ri, k, int(p.real), int(p.imag), r["connection"], r["stitch_type"]) for bi, b in enumerate(blocks) for ri, r in enumerate(b["runs"]) for k, p in enumerate(r["stitches"])]

    return _decoded(texts, rows, SKETCH_ROWS)


def sketch_imports(files: DataFrame) -> DataFrame:
    """PES files as sketch documents."""
    return _decoded(files, lambda b: [(sketch.save(sketch.import_pes(b)),)], "file string, document string")


#: Exporters by name: a nested plan to bytes.
EXPORTERS = {"dst": codec.write_dst, "pes": codec.write_pes, "svg": lambda plan: codec.svg_preview(plan).encode()}


def register_exporter(name: str, write) -> None:
    """A format of one's own: `write` makes bytes of a plan ({"name", "blocks": [{"thread", "runs": [{"stitches", "connection"}]}]})."""
    EXPORTERS[name] = write


def exported(stitches: DataFrame, name: str) -> DataFrame:
    """Each design in a registered format: (design_id, format, content)."""
    write = EXPORTERS[name]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        key = int(pdf["design_id"].iloc[0])
        return pd.DataFrame([(key, name, write(plan_of(pdf, f"DESIGN{key}")))], columns=["design_id", "format", "content"])

    return stitches.groupBy("design_id").applyInPandas(one, "design_id bigint, format string, content binary")


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """PNG, PGM and PPM files as (design_id, file, content) for plans.pictures, which reads them; a design is a file."""
    return binary_files(spark, path).select(F.xxhash64("file").alias("design_id"), "file", "content")
