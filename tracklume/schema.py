"""Declared schemas, canonical names and the named feature sets."""

from __future__ import annotations

from pyspark.sql import types as T

TRACK = ["file", "particle"]
FRAME = "frame"

OBSERVATIONS = T.StructType(
    [
        T.StructField("file", T.LongType()),
        T.StructField("particle", T.StringType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("x_micron", T.DoubleType()),
        T.StructField("y_micron", T.DoubleType()),
        T.StructField("D", T.DoubleType()),
        T.StructField("A", T.DoubleType()),
        T.StructField("P", T.DoubleType()),
        T.StructField("Dist", T.DoubleType()),
        T.StructField("serum", T.IntegerType()),
        T.StructField("serum_conc_percent", T.DoubleType()),
        T.StructField("time", T.IntegerType()),
        T.StructField("guide", T.StringType()),
        T.StructField("comment", T.StringType()),
    ]
)

SCORES = T.StructType(
    [
        T.StructField("kernel_size", T.IntegerType()),
        T.StructField("fset", T.StringType()),
        T.StructField("epochs", T.IntegerType()),
        T.StructField("repeat_no", T.IntegerType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("accuracy", T.DoubleType()),
    ]
)

# Column names of the older observation tables and their canonical names.
CANONICAL = {
    "diff_xy_micron": "D",
    "area_micron": "A",
    "perimeter_au_norm": "P",
    "min_dist_micron": "Dist",
}

# Names of the twenty track features, in their usual order.
FEATURES = [
    "MD", "MaxD", "VarD", "MA", "MP", "MDist", "VarDist", "rVarD", "rVarDist", "TD", "Pers", "ifFast", "DistR",
    "TDist", "ifCentr", "sDist", "sA", "sP", "out2sd", "out3sd",
]

# The sixteen features used for principal components (no masks, no counts).
PCA_FEATURES = [
    "MD", "MaxD", "VarD", "MA", "MP", "MDist", "VarDist", "rVarD", "rVarDist", "TD", "Pers", "DistR", "TDist",
    "sDist", "sA", "sP",
]

# The per-step columns of each named feature set (label and file are added on selection).
FEATURE_SETS = {
    "f_mot": ["x", "y", "min_dist_pxs"],
    "f_mot_morph": ["x", "y", "min_dist_pxs", "area_micron", "perimeter_au"],
    "f_mot_morph_dyn": ["x", "y", "min_dist_pxs", "dxy", "angle", "dangle", "darea", "dperimeter"],
    "f_mot_morph_dyn_2": [
        "x", "y", "min_dist_pxs", "area_micron", "perimeter_au", "dxy", "angle", "dangle", "darea", "dperimeter",
    ],
    "f_x": ["x"],
    "f_y": ["y"],
    "f_xy": ["x", "y"],
    "f_mindist": ["min_dist_pxs"],
    "f_morph": ["area_micron", "perimeter_au"],
    "f_area": ["area_micron"],
    "f_perim": ["perimeter_au"],
    "f_dxy": ["dxy"],
    "f_dxy_angle": ["dxy", "angle", "dangle"],
    "f_dxy_angle_morph": ["dxy", "angle", "dangle", "area_micron", "perimeter_au"],
    "f_dxy_angle_morphd": ["dxy", "angle", "dangle", "area_micron", "perimeter_au", "darea", "dperimeter"],
    "f_dxy_mindist": ["dxy", "min_dist_pxs"],
    "f_dxy_mindist_angle": ["dxy", "min_dist_pxs", "angle", "dangle"],
    "f_dxy_mindist_angle_morph": ["dxy", "min_dist_pxs", "angle", "dangle", "area_micron", "perimeter_au"],
    "f_dxy_angle_area": ["dxy", "angle", "dangle", "area_micron"],
    "f_dxy_mindist_angle_area": ["dxy", "min_dist_pxs", "angle", "dangle", "area_micron"],
}

# Families of features that are knocked out together.
FEATURE_FAMILIES = {
    "speed": ["MD", "MaxD", "VarD", "rVarD"],
    "morphology": ["MA", "MP", "sA", "sP"],
    "mindist": ["MDist", "VarDist", "rVarDist", "DistR", "TDist", "sDist"],
    "persistence": ["TD", "Pers", "out2sd", "out3sd"],
    "homologs": ["ifFast", "ifCentr"],
}
