"""Invariants and small fixtures of the record, split, negative, metric and source operators."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowloom.functions import metrics as M
from rowloom.functions import sequences as S
from rowloom.operators import joins, negatives, neighbors, records, scoring, splits, summaries
from rowloom.sources import readers, writers


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_endpoint_groups_agree(spark):
    assert one(spark, "CASSF/CATW", S.endpoint_group) == one(spark, "ASS/AT", S.endpoint_group) == "ASS/AT"


def test_label_tokens(spark):
    got = [one(spark, x, S.label_token) for x in ("1.0", " yes ", "0.5", "NaN", None, "true")]
    assert got == ["1", "YES", "0.5", "NAN", None, "TRUE"]


def test_middle_padding_ids(spark):
    ids = lambda x: one(spark, x, lambda c: S.pad_tokens(S.encode(S.residue_tokens(c), S.BLOSUM_ORDER, 0, 23), 8, F.lit(24), "mid"))
    assert ids("ACDEF") == [0, 4, 3, 24, 24, 24, 6, 13]
    assert ids("CAOSF")[2] == 23
    assert ids("A") == [0] + [24] * 7


def test_pad_refuses_overlength(spark):
    assert one(spark, "AC", lambda c: S.pad(c, 4)) == "ACXX"
    with pytest.raises(Exception, match="longer than the field"):
        one(spark, "ACDEF", lambda c: S.pad(c, 4))


def test_compact_padding(spark):
    ids = one(spark, "AAAAAAAC", lambda c: S.pad_tokens(S.encode(S.letters(c), S.COMPACT_ORDER, 0), 34, F.lit(20)))
    assert len(ids) == 34 and ids[8:] == [20] * 26


def test_conflicting_labels_raise(spark):
    df = spark.createDataFrame([("P", "M", "ASS/AT", "1", 0), ("P", "M", "ASS/AT", "0", 1)], "pep string, mhc string, grp string, label string, row_id int")
    with pytest.raises(Exception, match="conflicting labels"):
        records.dedup_evaluation(df, ["pep", "mhc", "grp"], "label", ["row_id"]).collect()


def test_paired_chains(spark):
    df = spark.createDataFrame([(0, "pep", "/CASSF", "A*02:01")], "row_id int, pep string, ab string, hla_allele string")
    row = records.paired_chains(df).first()
    assert (row.alpha, row.beta, row.mhc, row.tcr) == ("<MIS>", "CASSF", "HLA-A*02:01", "<MIS>/CASSF|HLA-A*02:01")
    with pytest.raises(Exception, match="receptor chain"):
        records.paired_chains(df.withColumn("ab", F.lit("/"))).collect()


def test_unsupported_rows(spark):
    df = spark.createDataFrame([(0, "XBADPEP1", "CASSF"), (1, "AAAAAAAC", "CASSF")], "row_id int, peptide string, tcr string")
    kept, bad = records.unsupported(df, records.valid_compact())
    assert [r.csv_row for r in bad.collect()] == [2] and kept.count() == 1
    with pytest.raises(Exception, match="unsupported row 2"):
        records.unsupported(df, records.valid_compact(), "error")[0].collect()


def test_repeated_right_key_raises(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="right key repeats"):
        joins.many_to_one(left, right, ["k"]).collect()


def test_results_in_order(spark):
    inputs, results = spark.createDataFrame([(0,), (1,)], "row_id int"), spark.createDataFrame([(1, 0.8), (0, 0.2)], "row_id int, score double")
    assert [r.score for r in joins.rejoin_results(inputs, results, ["score"]).collect()] == [0.2, 0.8]
    with pytest.raises(Exception, match="result row missing"):
        joins.rejoin_results(inputs, results.where("row_id = 0"), ["score"]).collect()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 4])
def test_edit_pairs_against_all_pairs(spark, k):
    rng = random.Random(k)
    words = sorted({"".join(rng.choice("ABC") for _ in range(rng.randint(0, 9))) for _ in range(120)})
    want = {(a, b, levenshtein(a, b)) for a in words for b in words if a < b and levenshtein(a, b) <= k}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {tuple(r) for r in neighbors.bounded_self_join(df, "w", k).collect()} == want


def test_nearest_with_ties_and_far_strings(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ABCD") for _ in range(rng.randint(1, 24))) for _ in range(80)})
    a, b = words[::3], [w for i, w in enumerate(words) if i % 3]
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "w string")
    from rowloom.operators.components import checkpoint_dir

    checkpoint_dir(spark)
    got = {r.w: (r.min_edit_distance, r.nearest, r.nearest_ties) for r in neighbors.nearest_strings(frame(a), frame(b), "w").collect()}
    for w in a:
        ds = [(levenshtein(w, x), x) for x in b]
        low = min(ds)[0]
        assert got[w] == (low, min(ds)[1], sum(d == low for d, _ in ds))


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "pep string, mhc string, grp string")


def test_pair_validation_keeps_every_peptide(spark):
    keys = pairs_of(spark, [("P", "M", f"g{i}") for i in range(4)] + [("Q", "M", "g9")])
    chosen = splits.pair_validation(keys, splits.pair_quotas(keys, 0.4), [keys]).collect()
    held = spark.createDataFrame(chosen)
    rest = splits.apply_validation(keys, held, "pair_stratified")
    assert len(chosen) == 2 and {r.pep for r in rest.collect()} == {"P", "Q"}
    assert rest.join(held, ["pep", "mhc", "grp"]).count() == 0


def test_counts_of_sizes_are_nearest():
    rng = random.Random(3)
    for _ in range(300):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(2, 8))]
        limit, target, empty = sum(sizes) - 1, rng.randint(1, sum(sizes)), rng.random() < 0.5
        got = splits.nearest_counts(list(Counter(sizes).items()), target, limit, empty)
        sums = {sum(n for j, n in enumerate(sizes) if m >> j & 1) for m in range(0 if empty else 1, 1 << len(sizes))}
        best = min((x for x in sums if x <= limit), key=lambda x: (abs(x - target), x))
        assert sum(n * k for n, k in got.items()) == best and all(k <= sizes.count(n) for n, k in got.items())


def test_frequency_allocation_counts(spark):
    cycle = [1, 2, 4, 8, 20, 30]
    df = spark.createDataFrame([(f"p{i}", cycle[i % 6]) for i in range(600)], "pep string, n long")
    rows = splits.frequency_allocation(df, 90).collect()
    count = lambda s: sum(r.split == s for r in rows)
    assert (count("train"), count("valid"), count("test")) == (420, 90, 90)
    again = {tuple(r) for r in splits.frequency_allocation(df.orderBy(F.desc("pep")).repartition(7), 90).collect()}
    assert again == {tuple(r) for r in rows}
    assert {tuple(r) for r in splits.frequency_allocation(df, 90, seed=43).collect()} != again
    with pytest.raises(ValueError):
        splits.frequency_allocation(df, 400)


def test_rejection_partition_leaves_the_big_group(spark):
    counts = spark.createDataFrame([("p0", 100, 100)] + [(f"p{i}", i, i) for i in range(1, 8)], "pep string, rows long, unique long")
    got = {tuple(r) for r in splits.rejection_partition(counts, 2, 10, 0.5).collect()}
    assert len({p for p, _, _ in got}) == 4 and "p0" not in {p for p, _, _ in got} and len({a for _, _, a in got}) == 1
    assert got == {tuple(r) for r in splits.rejection_partition(counts.orderBy(F.desc("pep")).repartition(3), 2, 10, 0.5).collect()}
    order = lambda a: sorted((hashlib.md5(f"42|{a}|p{i}".encode()).hexdigest(), i) for i in range(8))
    rows = [100, *range(1, 8)]
    for attempt in range(1, 10_000):
        a, b = ([i for _, i in order(attempt)[lo : lo + 2]] for lo in (0, 2))
        x, y = (sum(rows[i] for i in side) for side in (a, b))
        if max(x, y) <= 10 and abs(x - y) <= 0.5 * max(x, y):
            break
    assert got == {(f"p{i}", "valid", attempt) for i in a} | {(f"p{i}", "test", attempt) for i in b}
    with pytest.raises(ValueError, match="no permutation"):
        splits.rejection_partition(counts, 2, 1, 0.5, attempts=50)
    with pytest.raises(ValueError, match="cannot take"):
        splits.rejection_partition(counts, 5, 10)


def test_folds_are_disjoint_and_even(spark):
    df = spark.createDataFrame([(f"p{i}",) for i in range(103)], "pep string")
    rows = splits.hash_folds(df, 5).collect()
    sizes = [sum(r.fold == k for r in rows) for k in range(5)]
    assert sizes[:4] == [21] * 4 and sum(sizes) + sum(r.fold is None for r in rows) == 103


def test_negatives_avoid_groups_across_alleles(spark):
    pool = spark.createDataFrame([(x,) for x in ("CASSF", "CATF", "CAWF")], "ab string")
    blocked = spark.createDataFrame([("P", "AT"), ("P", "CASSF")], "pep string, ab string")
    rows = spark.createDataFrame([("P", 1), ("P", 2)], "pep string, k int")
    got = negatives.drawn_negatives(rows, pool, blocked).collect()
    assert [r.ab for r in got] == ["CAWF", "CAWF"]
    none = negatives.drawn_negatives(rows, pool, blocked.union(spark.createDataFrame([("P", "CAWF")], "pep string, ab string")), tries=3).collect()
    assert [r.ab for r in none] == [None, None]


def test_balanced_cells(spark):
    df = spark.createDataFrame([("a", 0, i) for i in range(9)] + [("a", 1, i) for i in range(4)] + [("b", 0, i) for i in range(5)], "d string, label int, k int")
    assert {r["count"] for r in negatives.balanced(df, ["d", "label"], ["k"]).groupBy("d", "label").count().collect()} == {4}


def test_single_label_has_no_auc(spark):
    df = spark.createDataFrame([("A", 1, 0.5), ("A", 1, 0.6)], "pep string, label int, score double")
    row = M.ranking(df, ["pep"]).first()
    assert row.auroc is None and row.average_precision is None and M.macro(df, "pep").first().eligible == 0


def test_macro_weighs_groups_alike(spark):
    rows = [("A", 0, 0.1), ("A", 1, 0.9), ("B", 0, 0.8), ("B", 0, 0.9), ("B", 1, 0.1), ("B", 1, 0.2)]
    row = M.macro(spark.createDataFrame(rows, "pep string, label int, score double"), "pep").first()
    assert row.macro_auroc == 0.5 and row.eligible == 2


def test_threshold_checks(spark):
    df = spark.createDataFrame([(0.2, 0.3), (0.5, 0.7)], "score double, threshold double")
    assert M.single_threshold(df).first().thresholds == 2
    assert [r.predicted_label for r in scoring.predicted(df.drop("threshold"), 0.5).collect()] == [0, 1]


def test_weighted_moments(spark):
    df = spark.createDataFrame([([1.0, 5.0], 1), ([19.0, 5.0], 0), ([7.0, 5.0], 2)], "x array<double>, w int")
    rows = {r.i: (r.mean, r.std) for r in summaries.weighted_moments(df, "x", F.col("w")).collect()}
    assert rows[0] == (5.0, pytest.approx(8**0.5)) and rows[1] == (5.0, 1.0)


def test_csv_contracts(spark, tmp_path):
    df = spark.createDataFrame([("a", ""), ("b", None)], "k string, v string")
    writers.write_csv(df, f"{tmp_path}/t")
    assert {(r.k, r.v) for r in readers.read_strings(spark, f"{tmp_path}/t").collect()} == {("a", ""), ("b", "")}
    with pytest.raises(Exception, match="already exists"):
        writers.write_csv(df, f"{tmp_path}/t")
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_inputs(spark, f"{tmp_path}/t", ["k", "nothing"])
    with pytest.raises(ValueError, match="overwritten"):
        readers.read_inputs(spark, f"{tmp_path}/t", ["k"], ("v",))


def test_workspace_gate(spark, tmp_path):
    a, b = pairs_of(spark, [("P", "M", "x")]), pairs_of(spark, [("Q", "M", "x")])
    key = ["pep", "mhc", "grp"]
    with pytest.raises(ValueError, match="share keys"):
        writers.write_workspace({"train": a, "valid": a}, f"{tmp_path}/bad", {}, key)
    writers.write_workspace({"train": a, "valid": b}, f"{tmp_path}/good", {"rows": 2}, key)
    assert spark.read.text(f"{tmp_path}/good/report").first()[0] == '{"rows": 2}'
    with pytest.raises(ValueError, match="not finite"):
        writers.checked_report({"x": float("nan")})


def test_labels_stay_out(spark):
    with pytest.raises(ValueError):
        writers.label_free(spark.createDataFrame([(1, 0)], "row_id int, label int"), ["row_id", "label"])
