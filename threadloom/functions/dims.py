"""Small fixed dimensions: the 64 thread colours of the PEC format and the fabric recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the PEC format: number, red, green, blue, name.
PALETTE = (
    (1, 14, 31, 124, "Prussian Blue"),
    (2, 10, 85, 163, "Blue"),
    (3, 0, 135, 119, "Teal Green"),
    (4, 75, 107, 175, "Cornflower Blue"),
    (5, 237, 23, 31, "Red"),
    (6, 209, 92, 0, "Reddish Brown"),
    (7, 145, 54, 151, "Magenta"),
    (8, 228, 154, 203, "Light Lilac"),
    (9, 145, 95, 172, "Lilac"),
    (10, 158, 214, 125, "Mint Green"),
    (11, 232, 169, 0, "Deep Gold"),
    (12, 254, 186, 53, "Orange"),
    (13, 255, 255, 0, "Yellow"),
    (14, 112, 188, 31, "Lime Green"),
    (15, 186, 152, 0, "Brass"),
    (16, 168, 168, 168, "Silver"),
    (17, 125, 111, 0, "Russet Brown"),
    (18, 255, 255, 179, "Cream Brown"),
    (19, 79, 85, 86, "Pewter"),
    (20, 0, 0, 0, "Black"),
    (21, 11, 61, 145, "Ultramarine"),
    (22, 119, 1, 118, "Royal Purple"),
    (23, 41, 49, 51, "Dark Gray"),
    (24, 42, 19, 1, "Dark Brown"),
    (25, 246, 74, 138, "Deep Rose"),
    (26, 178, 118, 36, "Light Brown"),
    (27, 252, 187, 197, "Salmon Pink"),
    (28, 254, 55, 15, "Vermilion"),
    (29, 240, 240, 240, "White"),
    (30, 106, 28, 138, "Violet"),
    (31, 168, 221, 196, "Seacrest"),
    (32, 37, 132, 187, "Sky Blue"),
    (33, 254, 179, 67, "Pumpkin"),
    (34, 255, 243, 107, "Cream Yellow"),
    (35, 208, 166, 96, "Khaki"),
    (36, 209, 84, 0, "Clay Brown"),
    (37, 102, 186, 73, "Leaf Green"),
    (38, 19, 74, 70, "Peacock Blue"),
    (39, 135, 135, 135, "Gray"),
    (40, 216, 204, 198, "Warm Gray"),
    (41, 67, 86, 7, "Dark Olive"),
    (42, 253, 217, 222, "Flesh Pink"),
    (43, 249, 147, 188, "Pink"),
    (44, 0, 56, 34, "Deep Green"),
    (45, 178, 175, 212, "Lavender"),
    (46, 104, 106, 176, "Wisteria Violet"),
    (47, 239, 227, 185, "Beige"),
    (48, 247, 56, 102, "Carmine"),
    (49, 181, 75, 100, "Amber Red"),
    (50, 19, 43, 26, "Olive Green"),
    (51, 199, 1, 86, "Dark Fuchsia"),
    (52, 254, 158, 50, "Tangerine"),
    (53, 168, 222, 235, "Light Blue"),
    (54, 0, 103, 62, "Emerald Green"),
    (55, 78, 41, 144, "Purple"),
    (56, 47, 126, 32, "Moss Green"),
    (57, 255, 204, 204, "Flesh Pink"),
    (58, 255, 217, 17, "Harvest Gold"),
    (59, 9, 91, 166, "Electric Blue"),
    (60, 240, 249, 112, "Lemon Yellow"),
    (61, 227, 243, 91, "Fresh Green"),
    (62, 255, 153, 0, "Orange"),
    (63, 255, 240, 141, "Cream Yellow"),
    (64, 255, 200, 200, "Applique"),
)

# Id, row spacing, satin spacing, stitch length, underlays, pull, push, smallest object, trim distance, longest travel (mm),
# whether small areas get wider rows, needle.
FABRICS = (
    ("standard", 0.4, 0.4, 3.0, ("edge",), 0.2, 0.0, 1.0, 10.0, 12.0, True, "75/11"),
    ("thin", 0.45, 0.45, 2.8, ("edge",), 0.15, 0.0, 1.2, 8.0, 10.0, True, "70/10"),
    ("tshirt", 0.4, 0.4, 3.0, ("edge", "tatami"), 0.4, 0.1, 1.5, 10.0, 12.0, True, "75/11 ball point"),
    ("denim", 0.38, 0.38, 3.2, ("edge",), 0.15, 0.0, 1.0, 12.0, 14.0, False, "90/14"),
    ("canvas", 0.38, 0.38, 3.2, ("edge",), 0.1, 0.0, 1.0, 12.0, 14.0, False, "90/14"),
    ("felt", 0.4, 0.4, 3.0, (), 0.1, 0.0, 1.0, 10.0, 12.0, False, "75/11"),
    ("towel", 0.35, 0.35, 3.0, ("edge", "tatami"), 0.3, 0.1, 2.0, 10.0, 12.0, True, "75/11"),
    ("leather", 0.45, 0.45, 3.2, (), 0.1, 0.0, 1.2, 12.0, 14.0, True, "leather 90/14"),
    ("nylon", 0.45, 0.45, 2.8, ("edge",), 0.2, 0.0, 1.2, 8.0, 10.0, True, "70/10"),
    ("stretch", 0.42, 0.42, 3.0, ("edge", "tatami"), 0.5, 0.15, 1.5, 10.0, 12.0, True, "75/11 ball point"),
    ("quilt", 0.4, 0.4, 3.0, ("edge",), 0.15, 0.0, 1.0, 12.0, 14.0, False, "75/11"),
    ("patch-felt", 0.35, 0.35, 2.8, ("edge",), 0.1, 0.0, 1.0, 10.0, 12.0, False, "75/11"),
)

FABRIC_SCHEMA = (
    "id string, row_spacing_mm double, satin_spacing_mm double, stitch_length_mm double, underlay array<string>, pull_mm double, push_mm double, "
    "min_object_mm double, trim_distance_mm double, max_travel_mm double, auto_density boolean, needle string"
)


def palette(spark: SparkSession) -> DataFrame:
    """64 rows: pec_index, r, g, b, name."""
    return spark.createDataFrame(list(PALETTE), "pec_index int, r int, g int, b int, name string")


def fabrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*f[:4], list(f[4]), *f[5:]) for f in FABRICS], FABRIC_SCHEMA)


def sql_values(rows) -> str:
    """Rows as the body of a VALUES clause."""
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


PALETTE_SQL = f"palette(pec_index, pr, pg, pb, pname) AS (VALUES {sql_values(PALETTE)})"
FABRIC_SQL = f"fabric(id, row_mm, satin_mm, length_mm, pull_mm, push_mm, min_mm, trim_mm, needle) AS (VALUES {sql_values((f[0], f[1], f[2], f[3], f[5], f[6], f[7], f[8], f[11]) for f in FABRICS)})"
