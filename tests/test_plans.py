"""Scale properties checked on the physical plans, plus a round-trip
property test of diff + apply on random listings."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import apply as dml
from tessera.operators.diff import file_changes, folder_diff
from tessera.operators.grouping import NameGrouping
from tessera.operators.stats import folder_stats
from tessera.registry import catalog
from tessera.sources import derived
from tessera.sources.rules import plan_rules, rules_frame
from tessera.sources.tables import Tables

from conftest import SF_SMALL


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_are_resolved_per_folder(spark):
    t = Tables(spark, SF_SMALL)
    plan = plan_rules(rules_frame(spark))
    # prefixes are exploded for the distinct folders only
    text = plan_text(plan.resolve(derived.messy_listing(t)))
    generate = text.index("Generate explode")
    assert "HashAggregate(keys=[folder_path" in text[generate:]
    # the files are joined with the written result, whose size Spark knows, and it
    # is that side which is broadcast
    text = plan_text(plan.attach(derived.messy_listing(t)))
    assert "explode" not in text and "BuildRight" in text and "BuildLeft" not in text
    # per-name work is built-in expressions, no Python
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_no_window_without_partition_over_growing_rows(spark):
    """Numbering uses windows over counts per partition only."""
    t = Tables(spark, SF_SMALL)
    for df in (NameGrouping(catalog(t), rules_frame(spark)).numbered_rows(), dml.initial_snapshot(derived.docs_all(t))[1]):
        for line in plan_text(df).splitlines():
            if "Window [" in line:
                assert "_cnt" in line


def test_cells_aggregate_partially_before_the_shuffle(spark):
    t = Tables(spark, SF_SMALL)
    g = NameGrouping(catalog(t), rules_frame(spark), reuse=False)
    text = plan_text(g.cells)
    assert "partial_count" in text and "partial_max" in text and "partial_min" in text


def test_file_diff_is_one_full_outer_join(spark):
    t = Tables(spark, SF_SMALL)
    folders, files = dml.initial_snapshot(derived.docs_old(t))
    text = plan_text(file_changes(derived.docs_new(t), files))
    assert text.count("FullOuter") == 1


def test_scans_are_pruned(spark):
    t = Tables(spark, SF_SMALL)
    text = plan_text(derived.docs_new(t))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in text
    assert "PushedFilters: [IsNotNull(doc_id)]" in text


listing_rows = st.lists(st.tuples(st.sampled_from(["/a", "/b", "/c/d"]),
                                  st.sampled_from(["x", "y", "z", "w"]),
                                  st.integers(0, 3)),
                        max_size=10, unique_by=lambda r: (r[0], r[1]))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(old=listing_rows, new=listing_rows)
def test_apply_of_diff_reproduces_the_new_listing(spark, old, new):
    schema = "folder_path string, name string, size long"
    old_df, new_df = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    folders, files = dml.initial_snapshot(old_df)
    fd = folder_diff(folder_stats(new_df), folders, detect_removed=True)
    ch = file_changes(new_df, files, detect_removed=True)
    applied = dml.apply_file_changes(files, ch, dml.apply_folder_diffs(folders, fd))
    got = sorted((r[0], r[1], r[2]) for r in applied.select("folder_path", "name", "size").collect())
    assert got == sorted(new)
    ids = [r[0] for r in applied.select("id").collect()]
    assert len(ids) == len(set(ids))
