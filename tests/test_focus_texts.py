"""Digits and ties of findings and targets, as Python and the queries' rules have them."""

import random

import duckdb
from pyspark.sql import functions as F

from tellurion.operators.focus import three_digits
from tellurion.plans.focus import _share_sql


def test_three_digits_go_by_the_exact_binary_value(spark):
    rng = random.Random(5)
    values = [0.0, 1.0, 0.6345, 0.0625, 0.1875, 0.9995, 0.9999999999999999, 0.0005, 1e-17] + [(2 * rng.randrange(1000) + 1) / 2000 for _ in range(300)] + [rng.random() for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", three_digits(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{r.v:.3f}" for r in got]


def test_sql_gives_a_tie_of_shares_to_the_first_class():
    at = f"list_position({_share_sql('form')}, list_max({_share_sql('form')}))"
    sql = f"SELECT {at} FROM (SELECT unnest([[0.3::DOUBLE, 0.30000000000000004::DOUBLE], [0.3::DOUBLE, 0.4::DOUBLE]]) AS form_v)"
    assert duckdb.connect().execute(sql).fetchall() == [(1,), (2,)]
