import math

import pytest
from pyspark.sql import functions as F

from cladespark.functions import special, text


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_tails():
    assert special._chi2_tail(3.0, 2) == pytest.approx(math.exp(-1.5))
    assert special._chi2_tail(5.0, 4) == pytest.approx(math.exp(-2.5) * 3.5)
    assert special._chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert special._chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert special._chi2_tail(0.0, 3) == 1.0
    assert special._t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert special._t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert special._t_two_sided(0.1, 30) == pytest.approx(0.9210096, abs=1e-6)


def test_fisher():
    assert special._fisher(8, 2, 1, 5) == pytest.approx(0.03496503496503496)
    assert special._fisher(3, 0, 0, 3) == pytest.approx(0.1)
    assert special._fisher(5, 5, 5, 5) == pytest.approx(1.0)


@pytest.mark.parametrize(("raw", "want"), [(" A-B ", "A_B"), ("NA", None), ("-", None), ("", None), ("nan", None), ("x", "x")])
def test_labels(spark, raw, want):
    assert one(spark, text.normal_label(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [(" a.vcf.gz", "a"), ("a_library3", "a"), ("a_library3b", "a_library3b"), ("x.vcf", "x")])
def test_samples(spark, raw, want):
    assert one(spark, text.normal_sample(F.lit(raw))) == want


def test_sequences(spark):
    assert one(spark, text.reverse_complement(F.lit("AACG"))) == "CGTT"
    assert [one(spark, text.amino(F.lit(c))) for c in ("ATG", "TAA", "GGN", "TG")] == ["M", "*", "X", "X"]
    assert one(spark, text.context(F.lit("ACGT"), F.lit(1), 2)) == "GTACG"
    assert one(spark, text.context(F.lit("AC"), F.lit(2), 4)) == "CACACACAC"
    assert one(spark, text.info_map(F.lit("DB;DP=1;MQ=2=3;DP=7"))) == {"DP": "7", "MQ": "2=3"}
    assert one(spark, text.info_value(F.lit("DP=1;MQ=2;DP=7"), "DP")) == "7"
    assert one(spark, text.info_value(F.lit("ADP=1"), "DP")) is None
    assert [one(spark, text.effect_class(F.lit(v))) for v in (0.05, 0.1, 0.3, 0.5)] == ["negligible", "small", "medium", "large"]
    assert one(spark, text.name_key(F.lit(" Gyr-A_1 "))) == "gyra1"
