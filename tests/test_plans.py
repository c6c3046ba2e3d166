"""Plan shapes the design relies on (checked with explain, sf0.001)."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL


def plan_of(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_first_k_per_group_limits_before_the_shuffle(spark):
    plan = plan_of(spark, "head_per_split")
    tree = plan.split("\n\n")[0]
    assert tree.count("WindowGroupLimit") == 2  # partial (per task) and final
    assert tree.index("Exchange") < tree.rindex("WindowGroupLimit")


def test_first_k_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "first_k_valid")


@pytest.mark.parametrize("name", ["next_token_counts", "next_token_argmax", "embed_mean_pool"])
def test_hot_keys_meet_a_partial_aggregate_first(spark, name):
    tree = plan_of(spark, name).split("\n\n")[0]
    lines = [ln for ln in tree.splitlines() if "Aggregate" in ln or "Exchange" in ln]
    # bottom-up: an aggregate sits below the first hash exchange on the key
    assert "Aggregate" in lines[-1] or "Aggregate" in lines[-2]


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(spark, "embed_mean_pool")
    reads = [ln for ln in plan.splitlines() if ln.startswith("ReadSchema")]
    assert any(ln.strip() == "ReadSchema: struct<doc_id:bigint,text:string>" for ln in reads), reads
    plan = plan_of(spark, "train_val_split")
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in plan
