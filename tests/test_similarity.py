from paircraft.functions.similarity import containment, cosine, jaccard


def test_jaccard_cases(spark):
    rows = [("cat sat mat", "cat sat mat"), ("cat", "dog"), ("", ""), ("cat sat", "cat sat mat"), (None, "cat")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(jaccard("a", "b")).collect()]
    assert got == [1.0, 0.0, 0.0, 2 / 3, 0.0]
    c = [r[0] for r in df.select(containment("a", "b")).collect()]
    assert c == [1.0, 0.0, 0.0, 1.0, 0.0]


def test_jaccard_symmetric(spark):
    df = spark.createDataFrame([("a b c d", "c d e")], "a string, b string")
    r = df.select(jaccard("a", "b").alias("x"), jaccard("b", "a").alias("y")).first()
    assert r.x == r.y


def test_cosine_zero_norm(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "u array<double>, v array<double>")
    got = [r[0] for r in df.select(cosine("u", "v")).collect()]
    assert got[0] == 0.0 and abs(got[1] - 1.0) < 1e-12
