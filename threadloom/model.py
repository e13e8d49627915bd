"""Constants and schemas. Lengths ending in no unit are in units of 0.1 mm; origin at the centre of a design, y down."""

from __future__ import annotations

# Machine and digitising limits.
UNIT_MM = 0.1
HOOP_HALF = 500
MAX_STITCHES = 12_000
MIN_STITCH, MAX_STITCH = 5, 121
NEVER_TRIM_BELOW, TRIM_ABOVE = 30, 500
ROW_SPACING, STITCH_LENGTH, JITTER = 4, 30, 0.2
SATIN_SPACING, SATIN_MAX_WIDTH = 3, 70
RUNNING_LENGTH = 25
STITCHES_PER_MINUTE = 400
TRIM_WARN_FACTOR, COLOR_WARN_COUNT = 3, 12
LOCK_LENGTH = 10
CONTRAST = 25.0
UNDERLAY_SPACING, EDGE_INSET = 30, 8

POINT = "struct<x:int,y:int>"
POINT_D = "struct<x:double,y:double>"
THREAD = "struct<r:int,g:int,b:int,name:string,code:string>"
RUN = f"struct<stitches:array<{POINT}>,connection:string,object_id:int,stitch_type:string>"
PLAN_NESTED = f"design_id bigint, name string, blocks array<struct<thread:{THREAD},runs:array<{RUN}>>>"
STITCHES = "design_id bigint, block_idx bigint, run_idx bigint, seq bigint, x int, y int"
OPS = "design_id bigint, op_seq bigint, kind string, x int, y int"
REGIONS = f"design_id bigint, region_idx int, outer array<{POINT_D}>, holes array<array<{POINT_D}>>, color {THREAD}, fill_type string, angle_deg double"
