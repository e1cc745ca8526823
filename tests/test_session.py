import pytest

from stepmill import session as s


def test_fits_bounds_rows_and_characters(spark):
    df = spark.createDataFrame([(i, "x" * 10, [1, 2], None) for i in range(20)], "a int, b string, c array<int>, d string")
    assert s.fits(df, rows=20) and not s.fits(df, rows=19)
    assert s.fits(df, size=1000) and not s.fits(df, size=200)
    assert s.fits(df.limit(0), rows=0, size=0)


def test_an_unset_shared_folder_is_an_error_on_a_cluster(spark):
    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        s.shared_folder(Cluster())
