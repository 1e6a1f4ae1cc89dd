"""Generators, layouts, readers and writers."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rowtrace.operators import generators as G
from rowtrace.operators.attach import inequality_join
from rowtrace.operators.layout import store_grouped, store_plain, store_zoned
from rowtrace.plans.registry import jobs
from rowtrace.session import Limits
from rowtrace.sources.runs import FAMILIES, read_runs, union_families
from rowtrace.sources.sinks import write_csv

SHUFFLED = Limits(broadcast_rows=0, broadcast_bytes=0)


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(2000).select(F.col("id").alias("idx"))


@pytest.mark.parametrize("share", [0, 0.02, 0.2, 0.5, 0.8, 1])
def test_selectivity_is_exact(ids, share):
    z = G.selective(ids, 2000, share)
    assert z.filter("z = 0").count() == int(2000 * share)
    assert z.filter("z < 0 or z > 2000").count() == 0


@pytest.mark.parametrize("share", [0.1, 0.2, 0.5, 0.8])
@pytest.mark.parametrize("limits", [Limits(), SHUFFLED])
def test_inequality_pair_has_the_promised_size(spark, ids, share, limits):
    left = spark.range(100).select(F.col("id").alias("idx"))
    one, two = G.below_pair(left, 100, ids, 2000, share)
    joined = inequality_join(
        one.withColumnsRenamed({"v": "v1", "id": "id1"}), two.withColumnsRenamed({"v": "v2", "id": "id2"}), "v1", "v2",
        limits=limits, buckets=8, cell_rows=200,
    )
    assert joined.count() == int(share * 100) * int(share * 2000)


@pytest.mark.parametrize("groups", [10, 100, 1000])
@pytest.mark.parametrize("theta", [0, 0.5, 0.8, 1])
def test_zipf_shares_fall_with_the_rank(ids, groups, theta):
    z = G.zipf_groups(ids, groups, theta)
    assert z.count() == 2000
    assert z.filter((F.col("z") < 0) | (F.col("z") >= groups)).count() == 0
    counts = {r["z"]: r["n"] for r in G.profile(z).collect()}
    weights = [1 / (i + 1) ** theta for i in range(groups)]
    share = weights[0] / sum(weights)
    assert abs(counts.get(0, 0) / 2000 - share) < 4 * (share * (1 - share) / 2000) ** 0.5 + 0.01


def test_generated_values_do_not_depend_on_partitions(ids):
    other = ids.repartition(13)
    assert rows(G.zipf_groups(ids, 50, 1)) == rows(G.zipf_groups(other, 50, 1))
    assert rows(G.copies(ids, 2000, 3)) == rows(G.copies(other, 2000, 3))


def test_copies_keys_and_extra_columns(ids):
    assert G.copies(ids, 2000, 3).groupBy("z").count().filter("count <> 3").count() == 0
    assert G.keyed(ids).select("id").distinct().count() == 2000
    wide = G.widened(ids, 8)
    assert len(wide.columns) == 9
    for i in range(8):
        low, high = wide.agg(F.min(f"col{i}"), F.max(f"col{i}")).first()
        assert 0 <= low < 5 and 94 < high <= 99


def test_z_and_v_are_not_correlated(ids):
    assert abs(G.uniform_groups(ids, 100).stat.corr("z", "v")) < 0.1


def test_layouts_answer_alike(spark, tmp_path):
    edges = spark.createDataFrame([(i % 17 if i % 3 else 5, i) for i in range(400)], "out_id long, in_id long")
    expected = rows(edges.filter("out_id in (5, 6)"))
    plain = store_plain(edges, str(tmp_path / "p"))
    zoned = store_zoned(edges, path=str(tmp_path / "z"))
    grouped = store_grouped(edges, str(tmp_path / "g"), Limits(list_rows=20))
    assert rows(plain.filter("out_id in (5, 6)")) == expected
    assert rows(zoned.filter("out_id in (5, 6)")) == expected
    unpacked = grouped.select("out_id", F.explode("rids").alias("in_id")).select("out_id", F.col("in_id").cast("long"))
    assert rows(unpacked.filter("out_id in (5, 6)")) == expected
    assert grouped.filter("out_id = 5").count() > 1


def test_run_files_with_repeated_headers_and_other_columns(spark, tmp_path):
    path = tmp_path / "v3.csv"
    header = "query,runtime,sf,repeat,lineage_type,n_threads,output,stats,notes,plan_timings\n"
    path.write_text(header + '1,0.5,1,1,Baseline,1,4,,x,"{}"\n' + header + '2,0.7,1.0,1,SD_stats,1,,"1,2,3",x,"{}"\n')
    first = read_runs(spark, str(path), "capture_v3")
    assert rows(first.select("query", "runtime", "output", "stats")) == [("1", 0.5, 4, None), ("2", 0.7, None, "1,2,3")]
    old = spark.createDataFrame([("3", 0.9, 1.0, 1, "Perm", 1, 0, "n")], FAMILIES["capture_v1"])
    write_csv(old, str(tmp_path / "v1"))
    whole = union_families([first, read_runs(spark, str(tmp_path / "v1"), "capture_v1")])
    assert whole.count() == 3 and whole.filter("query = '3' and stats is null and size = 0").count() == 1


@pytest.mark.parametrize("family", list(FAMILIES))
def test_every_run_family_reads_back(spark, tmp_path, family):
    empty = spark.createDataFrame([], FAMILIES[family])
    one = spark.range(1).select(*[F.lit("7").cast(f.dataType).alias(f.name) for f in empty.schema.fields])
    write_csv(one, str(tmp_path / family), separator="|")
    assert rows(read_runs(spark, str(tmp_path / family), family, "|")) == rows(one)


@pytest.mark.parametrize("name", ["rid_group_list", "rid_group_concat"])
def test_list_forms_hold_the_rows_of_the_join_form(small, name):
    listed = jobs()[name](small)
    ids = F.explode("rids" if name.endswith("list") else F.split("rids", ","))
    unpacked = listed.select("l_suppkey", "cnt", ids.alias("l_rid"))
    for other in ("rid_group_join", "rid_group_window"):
        direct = jobs()[other](small).select("l_suppkey", "cnt", "l_rid")
        assert rows(unpacked) == rows(direct)


def test_filters_before_and_after_the_scan_agree(small):
    assert rows(jobs()["rid_filter"](small)) == rows(jobs()["rid_filter_late"](small))


def test_values_of_ids_beyond_the_modulus_differ(spark):
    far = spark.range(2**33, 2**33 + 500).select(F.col("id").alias("idx"))
    near = spark.range(500).select(F.col("id").alias("idx"))
    same = G.uniform_groups(far, 1000).select(F.col("idx") - 2**33, "z", "v").intersect(G.uniform_groups(near, 1000))
    assert same.count() < 5
    assert G.uniform_groups(far, 1000).filter("z < 0 or z >= 1000 or v < 0 or v >= 100").count() == 0
