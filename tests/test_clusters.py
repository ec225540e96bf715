from tessella.operators import clusters


def test_nearest_surface_takes_every_place(spark):
    side = 60
    points = spark.createDataFrame([(float(x), float(y), float(100 * y + x)) for x in range(side) for y in range(side)], "x double, y double, v double")
    got = {(r.gy, r.gx): r.value for r in clusters.nearest_surface(points, "x", "y", "v", side).collect()}
    assert got == {(y, x): float(100 * y + x) for x in range(side) for y in range(side)}
