"""Record types as StructType constants, from one table of field lists."""

from __future__ import annotations

from pyspark.sql import types as T

_F, _I, _D = T.FloatType(), T.IntegerType(), T.DoubleType()

#: Record name -> fields; a number after ':' is the length of a float array, '#' marks integers.
RECORDS = {
    "PointXYZ": "x y z", "PointXYZRGBA": "x y z #rgba", "PointXYZRGB": "x y z #rgb", "PointXYZRGBL": "x y z #rgb #label", "PointXYZHSV": "x y z h s v",
    "PointXY": "x y", "PointUV": "u v", "InterestPoint": "x y z strength", "PointXYZI": "x y z intensity", "PointXYZL": "x y z #label", "Label": "#label",
    "Normal": "normal_x normal_y normal_z curvature", "Axis": "normal_x normal_y normal_z", "PointNormal": "x y z normal_x normal_y normal_z curvature",
    "PointXYZRGBNormal": "x y z #rgb normal_x normal_y normal_z curvature", "PointXYZINormal": "x y z intensity normal_x normal_y normal_z curvature",
    "PointXYZLNormal": "x y z #label normal_x normal_y normal_z curvature", "PointWithRange": "x y z range", "PointWithViewpoint": "x y z vp_x vp_y vp_z",
    "MomentInvariants": "j1 j2 j3", "PrincipalRadiiRSD": "r_min r_max", "Boundary": "#boundary_point", "PrincipalCurvatures": "principal_curvature_x principal_curvature_y principal_curvature_z pc1 pc2",
    "PFHSignature125": "pfh:125", "PFHRGBSignature250": "pfhrgb:250", "PPFSignature": "f1 f2 f3 f4 alpha_m", "CPPFSignature": "f1 f2 f3 f4 f5 f6 f7 f8 f9 f10 alpha_m",
    "PPFRGBSignature": "f1 f2 f3 f4 r_ratio g_ratio b_ratio alpha_m", "NormalBasedSignature12": "values:12", "ShapeContext1980": "shape_context:1980 rf:9", "UniqueShapeContext1960": "shape_context:1960 rf:9",
    "SHOT352": "shot:352 rf:9", "SHOT1344": "shot:1344 rf:9", "FPFHSignature33": "fpfh:33", "BRISKSignature512": "scale orientation brisk_descriptor512:64", "VFHSignature308": "vfh:308", "GRSDSignature21": "histogram:21",
    "ESFSignature640": "esf:640", "Narf36": "x y z roll pitch yaw descriptor:36", "GFPFHSignature16": "histogram:16", "IntensityGradient": "gradient_x gradient_y gradient_z",
    "PointWithScale": "x y z scale", "PointSurfel": "x y z normal_x normal_y normal_z #rgba radius confidence curvature", "ReferenceFrame": "x_axis:3 y_axis:3 z_axis:3",
    "PointDEM": "x y z intensity intensity_variance height_variance", "RGB": "#rgb", "Intensity": "intensity", "Intensity8u": "#intensity", "Intensity32u": "#intensity",
}

#: Scalar field types of binary clouds -> numpy code and Spark type (unsigned widened one step).
SCALARS = {1: ("i1", T.ByteType()), 2: ("u1", T.ShortType()), 3: ("i2", T.ShortType()), 4: ("u2", _I), 5: ("i4", _I), 6: ("u4", T.LongType()), 7: ("f4", _F), 8: ("f8", _D)}


def _field(spec: str) -> T.StructField:
    if spec.startswith("#"):
        return T.StructField(spec[1:], _I)
    name, _, length = spec.partition(":")
    return T.StructField(name, T.ArrayType(_F) if length else _F)


def record(name: str) -> T.StructType:
    """The schema of a registered record type."""
    return T.StructType([_field(s) for s in RECORDS[name].split()])


def fields(schema: T.StructType) -> list[str]:
    """Field names without padding ('_')."""
    return [f.name for f in schema if not f.name.startswith("_")]


def common_fields(a: T.StructType, b: T.StructType) -> list[str]:
    return [n for n in fields(a) if n in set(fields(b))]
