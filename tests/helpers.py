import numpy as np


def plane_rows(spark, images, volume=0):
    """Block rows of a list of 2-D or (h, w, c) arrays; z is the place in the list."""
    rows = [
        (volume, z, int(a.shape[0]), int(a.shape[1]), [float(v) for v in np.asarray(a).ravel()])
        for z, a in enumerate(images)
    ]
    return spark.createDataFrame(rows, "volume_id int, z int, h int, w int, data array<double>")


def volume_rows(spark, cube, volume=0):
    """Long voxels of a 3-D array."""
    cube = np.asarray(cube, dtype=float)
    rows = [(volume, *map(int, at), float(v)) for at, v in np.ndenumerate(cube)]
    return spark.createDataFrame(rows, "volume_id int, z int, x int, y int, v double")


def to_planes(df):
    """List of arrays in z order."""
    return [np.asarray(r["data"]).reshape(r["h"], r["w"], -1).squeeze(-1) if len(r["data"]) == r["h"] * r["w"] else np.asarray(r["data"]).reshape(r["h"], r["w"], -1) for r in df.orderBy("volume_id", "z").collect()]


def to_cube(df, value="v"):
    pdf = df.toPandas()
    shape = tuple(int(pdf[a].max()) + 1 for a in ("z", "x", "y"))
    cube = np.full(shape, np.nan)
    cube[pdf["z"], pdf["x"], pdf["y"]] = pdf[value].astype(float)
    return cube
