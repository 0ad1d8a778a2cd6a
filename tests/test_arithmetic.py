"""Integer arithmetic against Python's, up to the ends of the 64-bit range."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from viewtide.functions import times
from viewtide.functions.arithmetic import floor_div, int_div

LONGS = st.integers(-(2**62), 2**62)
IN_BULK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@IN_BULK
@given(values=st.lists(LONGS, min_size=50, max_size=200), n=st.integers(1, 10**15))
def test_division(spark, values, n):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = df.select("v", floor_div(F.col("v"), n), int_div(F.col("v"), F.lit(n))).collect()
    for v, down, to_zero in got:
        assert down == v // n
        assert to_zero == (abs(v) // n if v >= 0 else -(abs(v) // n))


@IN_BULK
@given(values=st.lists(LONGS, min_size=50, max_size=200), unit=st.sampled_from(sorted(times.TICKS_PER_HOUR)))
def test_times(spark, values, unit):
    t = F.col("v")
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    hour = times.TICKS_PER_HOUR[unit]
    columns = [times.hour_of_day(t, unit), times.relative_day(t, unit), times.calendar_weekday(t, unit)]
    for v, h, day, weekday in df.select("v", *columns).collect():
        assert h == v // hour % 24
        assert day == v // (24 * hour) % 7
        assert weekday == (v // (24 * hour) + 3) % 7
