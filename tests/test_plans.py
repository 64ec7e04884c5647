"""Physical plan checks: broadcasts where the dimension is bounded, pushdown, pruning."""

from conftest import SF_SMALL
from plan_utils import plan_text

from prefspark.operators import evaluation, preferences
from prefspark.plans import catalog
from prefspark.plans import fixtures as fx
from prefspark.sources.literal import tasks_df


def test_constitution_and_domain_joins_broadcast(spark):
    judged = preferences.with_constitution(fx.pairs_with_constitution(spark, SF_SMALL), fx.constitutions(spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan_text(judged)
    ctx = (fx.F.pmod("conv_id", fx.F.lit(12)) + 1).cast("int")
    dom = preferences.with_domain(fx.pairs(spark, SF_SMALL).withColumn("context_id", ctx))
    assert "BroadcastHashJoin" in plan_text(dom)


def test_continual_grid_is_broadcast_theta_join(spark):
    grid = evaluation.continual_grid(tasks_df(spark, fx.task_config()))
    text = plan_text(grid)
    assert "BroadcastNestedLoopJoin" in text and "CartesianProduct" not in text


def test_prefix_filter_pushed_to_parquet(spark):
    text = plan_text(catalog.QUERIES["source_prefix_scan"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(source), StringStartsWith(source,src1)]" in text


def test_scan_reads_only_needed_columns(spark):
    text = plan_text(catalog.QUERIES["word_count"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_normalisation_joins_group_stats_not_window(spark):
    text = plan_text(catalog.QUERIES["normalize_rewards"](spark, SF_SMALL))
    assert "Window" not in text and "BroadcastHashJoin" in text


def test_flagship_has_no_shuffle_of_pairs_for_the_flip(spark):
    """The exact flip adds no exchange: only the fixture's own joins shuffle."""
    pairs_plan = plan_text(fx.pairs(spark, SF_SMALL))
    flip_plan = plan_text(catalog._flipped_pairs(spark, SF_SMALL))
    assert flip_plan.count("Exchange") == pairs_plan.count("Exchange")


def test_small_side_bounds_rows_and_bytes(spark):
    from prefspark.plans.broadcast import small_side
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    df = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "id long, text string")
    assert "BroadcastHashJoin" in plan_text(df.join(small_side(df.select("id")), "id"))
    # 50 rows of ~1 KB: too many bytes for a 10 KB bound, too many rows for a 10-row bound
    assert "BroadcastHashJoin" not in plan_text(spark.range(100).join(small_side(df, max_bytes=10_000), "id"))
    assert "BroadcastHashJoin" not in plan_text(spark.range(100).join(small_side(df, max_rows=10), "id"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_hot_group_normalisation_and_judge(spark):
    from prefspark.operators import batch, evaluation
    rows = [("hot", "d", i, float(i % 7)) for i in range(300)] + \
           [(f"m{i % 20}", f"d{i % 3}", i, float(i % 5)) for i in range(600)]
    scores = spark.createDataFrame(rows, "model string, dataset string, row_id long, reward double")
    norm = evaluation.normalize_rewards(scores)
    text = plan_text(norm)
    assert "BroadcastHashJoin" in text and "Window" not in text
    hot = [r["norm_reward"] for r in norm.where("model = 'hot'").collect()]
    assert len(hot) == 300 and min(hot) == 0.0 and max(hot) == 1.0
    pairs = spark.createDataFrame([(i, 0 if i < 100 else i % 7, f"p{i}", "a", "b") for i in range(300)],
                                  "conv_id long, constitution_id long, prompt string, response_1 string, response_2 string")
    consts = spark.createDataFrame([(j, f"rule {j}") for j in range(7)], "constitution_id long, text string")
    from prefspark.operators.preferences import with_constitution
    joined = plan_text(with_constitution(pairs, consts))
    assert "BroadcastHashJoin" in joined and "SortMergeJoin" not in joined
    judged = batch.judge_preferences(pairs, consts, batch_size=8)
    assert judged.count() == 300
