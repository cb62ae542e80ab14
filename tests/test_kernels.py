import numpy as np
from pyspark.sql import functions as F

from trackloom.functions import kernels


def test_kernels(spark):
    flat, noisy = np.full((24, 30), 7, np.uint8), np.random.default_rng(1).integers(0, 256, (24, 30)).astype(np.uint8)
    left = np.zeros((24, 30), np.uint8)
    left[:, :15] = 200
    rows = [(n, a.tobytes(), 24, 30) for n, a in (("flat", flat), ("noisy", noisy), ("left", left), ("right", left[:, ::-1]))] + [("none", None, 1, 1)]
    df = spark.createDataFrame(rows, "name string, pixels binary, h int, w int")
    got = {r.name: r for r in df.select("name", kernels.sharpness("pixels", "h", "w").alias("s"), kernels.layout("pixels", "h", "w").alias("l"), kernels.histogram("pixels", "h", "w", F.lit(1)).alias("g")).collect()}
    assert got["flat"].s == 0.0 and got["noisy"].s > 0.9 and got["none"].s is None and got["none"].l is None
    assert np.dot(got["left"].l, got["right"].l) < -0.99, "mirror images are opposites"
    assert np.dot(got["left"].g, got["right"].g) > 0.999 and np.dot(got["flat"].g, got["flat"].g) > 0.999
    frames = spark.createDataFrame([(1, [noisy[:16, :16].tobytes()]), (2, [(noisy[:16, :16] // 2).tobytes()]), (3, [])], "id int, frames array<binary>")
    prints = {r.id: r.p for r in frames.select("id", kernels.fingerprint("frames").alias("p")).collect()}
    assert len(prints[1]) == 64 and prints[3] == ""
