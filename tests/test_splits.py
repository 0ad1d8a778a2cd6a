import pytest
from pyspark.sql import functions as F

from viewtide.operators import splits


def table(spark, n):
    return spark.range(n).select(F.col("id").alias("row_id"))


def parts(df, name="part"):
    return {r["row_id"]: r[name] for r in df.collect()}


@pytest.mark.parametrize("n", [1, 4, 5, 6, 99, 1_001])
def test_positional_split_is_complete_and_sized(spark, n):
    got = parts(splits.positional_split(table(spark, n)))
    tests = sorted(i for i, p in got.items() if p == "test")
    assert len(got) == n
    assert tests == list(range(n - -(-n // 5), n))


def test_hash_split_is_stable_and_about_a_fifth(spark):
    a = parts(splits.hash_split(table(spark, 10_000)))
    b = parts(splits.hash_split(table(spark, 10_000).repartition(13)))
    assert a == b
    share = sum(p == "test" for p in a.values()) / len(a)
    assert 0.18 < share < 0.22
    other = parts(splits.hash_split(table(spark, 10_000), seed=1))
    assert other != a


@pytest.mark.parametrize("buckets", [1, 7, 1 << 16])
def test_shuffled_index_is_a_permutation(spark, buckets):
    got = parts(splits.shuffled_index(table(spark, 3_000), buckets=buckets), "shuffled_idx")
    assert sorted(got.values()) == list(range(3_000))
    assert got != {i: i for i in range(3_000)}
    reference = parts(splits.shuffled_index(table(spark, 3_000).repartition(5)), "shuffled_idx")
    assert got == reference


def test_exact_shuffled_split(spark):
    split = splits.positional_split(splits.shuffled_index(table(spark, 1_003)), "shuffled_idx")
    assert split.where("part = 'test'").count() == 201


@pytest.mark.parametrize("n,k", [(10, 3), (11, 3), (12, 3), (7, 5), (3, 5), (100, 1)])
def test_folds_are_contiguous_and_even(spark, n, k):
    got = parts(splits.kfold(table(spark, n), "row_id", k), "fold")
    sizes = [n // k + (1 if f < n % k else 0) for f in range(k)]
    assert [got[i] for i in range(n)] == [f for f, size in enumerate(sizes) for _ in range(size)]
    for fold in range(k):
        first, end = splits.fold_bounds(n, k, fold)
        assert [i for i in range(n) if got[i] == fold] == list(range(first, end))


def test_validation_tail(spark):
    got = parts(splits.validation_tail(table(spark, 101)))
    order = [got[i] for i in range(101)]
    assert order == ["train"] * 64 + ["validation"] * 16 + ["test"] * 21


@pytest.mark.parametrize("n,k", [(53, 5), (50, 5), (101, 3)])
def test_learning_curve_sizes_match_the_prefix_filters(spark, n, k):
    counted = {
        (r["held_out"], r["step"]): r["train_rows"]
        for r in splits.learning_curve_sizes(table(spark, n), "row_id", k).collect()
    }
    for fold in range(k):
        first, end = splits.fold_bounds(n, k, fold)
        train = [i for i in range(n) if not first <= i < end]
        for step in range(1, 11):
            rows = splits.fold_prefix(table(spark, n), "row_id", n, k, fold, step)
            assert sorted(r[0] for r in rows.collect()) == train[: splits.prefix_size(n, k, step)]
            assert counted[fold, step] == splits.prefix_size(n, k, step)


def test_head_rows(spark):
    assert splits.head_rows(table(spark, 10), 4).count() == 4
    assert splits.head_rows(table(spark, 10), None).count() == 10


@pytest.mark.parametrize(("n", "spans"), [(0, 1), (8_193, 2), (1 << 20, 128), (4_800_000, 74), (28_800_000, 110), (1 << 28, 256)])
def test_spans_of_a_fit_grow_before_their_number_does(spark, n, spans):
    ends = spark.createDataFrame([(i,) for i in {0, n // 2, max(0, n - 1)}], "idx bigint")
    laid = splits.by_spans(ends, "idx", n)
    assert laid.rdd.getNumPartitions() == spans
    assert sorted(r.idx for r in laid.collect()) == sorted(r.idx for r in ends.collect())


def test_spans_of_a_fit_can_be_fewer(spark):
    ends = spark.createDataFrame([(0,), (4_799_999,)], "idx bigint")
    laid = splits.by_spans(ends, "idx", 4_800_000, spans=32)
    assert laid.rdd.getNumPartitions() == 19
    assert sorted(r.idx for r in laid.collect()) == [0, 4_799_999]
