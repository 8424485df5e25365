"""The registered queries, and the same results in SQL."""

from __future__ import annotations

import importlib.util
import sys
import uuid
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from labelscope.operators import (  # noqa: E402
    bootstrap,
    correlation,
    describe,
    distribution,
    encoding,
    importance,
    impute,
    information,
    missing,
    sampling,
    states,
    trend,
)
from labelscope.plans.retention import retention_report  # noqa: E402
from labelscope.roles import Roles  # noqa: E402
from labelscope.sources import (  # noqa: E402
    NULL_MARK,
    ensure_sample,
    read_csv,
    read_table,
    shared_folder,
    write_csv,
)
from verification import inputs as given  # noqa: E402
from verification import relations, runs  # noqa: E402
from verification.oracle import ORACLES, SCATTER  # noqa: E402

# The training-data operators and their pipeline are optional.
_llm = importlib.util.find_spec("labelscope.llm")
if _llm is None or _llm.origin is None:
    LLM_QUERIES, LLM_ORACLES = {}, {}
else:
    import corpus_pipeline
    from labelscope.llm import queries as llm_queries
    from labelscope.llm import sql as llm_sql

    LLM_QUERIES = {**llm_queries.queries(), "pipeline": corpus_pipeline.run}
    LLM_ORACLES = llm_sql.ORACLES

Query = Callable[[SparkSession, str], DataFrame]

APP = given.APPLICATION_ROLES
KEY = ["application_id"]


def rounded(df: DataFrame, digits: int = 6, above: float = 0.0) -> DataFrame:
    """Doubles to a fixed number of digits, so that two engines can agree.

    ``above`` is added first where many values lie half-way between two.
    """
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`") + above, digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def _on(
    table: Callable[[SparkSession, str], DataFrame],
    run: Callable[[DataFrame], DataFrame],
    above: float = 0.0,
) -> Query:
    return lambda spark, folder: rounded(run(table(spark, folder)), above=above)


def _app(run: Callable[[DataFrame], DataFrame]) -> Query:
    return _on(given.application_table, run)


def _csv_round_trip(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/labelscope/{app}/csv-{uuid.uuid4().hex[:12]}"
    return read_csv(spark, write_csv(df, path), df.schema, NULL_MARK)


def _documents_csv(spark: SparkSession, folder: str) -> DataFrame:
    return _csv_round_trip(read_table(spark, f"{folder}/documents.parquet"))


def _stored_sample(spark: SparkSession, folder: str) -> DataFrame:
    df = given.application_table(spark, folder)
    name = folder.strip("/").replace("/", "-")
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/labelscope/{app}/sample-{name}"
    return rounded(ensure_sample(df, path, KEY, portable=True))


def _capped_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, f"{folder}/lineitem.parquet")
    rows = lines.select("l_orderkey", "l_linenumber", "l_suppkey")
    return sampling.cap_rows(rows, 10_000, ["l_suppkey"], portable=True)


def _event_times(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, f"{folder}/events.parquet")
    since = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    micros = events.select(since.alias("ts_micros"))
    return describe.numeric_percentiles(micros, Roles(), ["ts_micros"])


def _text_label(df: DataFrame) -> DataFrame:
    label = F.when(F.col("label") == 1, F.lit("1.0")).when(F.col("label") == 0, F.lit("0"))
    return information.information_values(df.withColumn("label", label), APP)


def _encoded_texts(spark: SparkSession, folder: str) -> DataFrame:
    texts = read_table(spark, f"{folder}/documents.parquet").select("doc_id", "text", "source")
    return importance.ordinal_encode(texts, ["text", "source"])


def _encoded_names(spark: SparkSession, folder: str) -> DataFrame:
    parts = read_table(spark, f"{folder}/part.parquet").select("p_partkey", "p_name", "p_brand")
    return importance.ordinal_encode(parts, ["p_name", "p_brand"])


def _halves(table: str, key: str, features: list[str]) -> Query:
    """Codes fitted on the even keys, stored, loaded, and applied to the odd ones."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = read_table(spark, f"{folder}/{table}.parquet").select(key, *features)
        app = spark.sparkContext.applicationId
        path = f"{shared_folder(spark)}/labelscope/{app}/code-versions-{uuid.uuid4().hex[:12]}"
        encoding.save_codes(encoding.fit_codes(rows.where(F.col(key) % 2 == 0), features), path)
        return encoding.encode(rows.where(F.col(key) % 2 != 0), encoding.load_codes(spark, path))

    return run


def _grown(run: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: rounded(run(*runs.two_runs(spark, folder)))


def _found_scatter(df: DataFrame) -> DataFrame:
    """Points of all pairs that are found to be strong, the label's left out."""
    found = _high_pairs(df, 0.0).select("feat1", "feat2").collect()
    return correlation.scatter_pairs(df, APP, sorted(map(tuple, found)), KEY, cap=500, portable=True)


def _high_pairs(df: DataFrame, threshold: float = correlation.THRESHOLD) -> DataFrame:
    _, features = impute.matrix_source(df, APP)
    return correlation.high_pairs(
        correlation.pearson_matrix(df, APP),
        correlation.spearman_matrix(df, APP),
        features,
        threshold,
    )


def _pearson_wide(df: DataFrame) -> DataFrame:
    _, features = impute.matrix_source(df, APP)
    return correlation.matrix_wide(correlation.pearson_matrix(df, APP), features)


def _encoded(df: DataFrame) -> DataFrame:
    columns = APP.categorical(df)
    return importance.ordinal_encode(df.select(*KEY, *columns), columns)


def _comparison(df: DataFrame) -> DataFrame:
    iv = information.information_values(df, APP)
    rf = importance.rf_importance(importance.rf_importance_by_seed(df, APP))
    return importance.importance_comparison(iv, rf)


def _part_counts(spark: SparkSession, folder: str) -> DataFrame:
    part = read_table(spark, f"{folder}/part.parquet")
    return distribution.value_counts(part, ["p_name", "p_brand", "p_type"])


def entry(spark: SparkSession) -> DataFrame:
    """Information Value of every feature of the application table."""
    return queries()["iv_all_features"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    """Every operator over whole tables, by name."""
    doc, event, line, vector = (
        given.document_table,
        given.event_table,
        given.line_table,
        given.vector_table,
    )
    event_rows = lambda spark, folder: read_table(spark, f"{folder}/events.parquet")
    doc_roles, event_roles = given.DOCUMENT_ROLES, given.EVENT_ROLES
    line_roles, vector_roles = given.LINE_ROLES, given.VECTOR_ROLES
    return {
        # sources, sinks and samples
        "applications": _app(lambda df: df),
        "csv_round_trip": _app(_csv_round_trip),
        "documents_csv_round_trip": _documents_csv,
        "stored_sample": _stored_sample,
        "hash_sample": _app(lambda df: sampling.hash_sample(df, KEY, 0.05, portable=True)),
        "capped_sample": _app(lambda df: sampling.cap_rows(df, 10_000, KEY, portable=True)),
        "capped_lines": _capped_lines,
        "bernoulli_sample": _app(lambda df: sampling.bernoulli_sample(df, 0.05)),
        # missing values and summaries
        "missing_stats": _app(lambda df: missing.missing_stats(df, APP)),
        "missing_significant": _app(
            lambda df: missing.significant_missing(missing.missing_stats(df, APP))
        ),
        "numeric_describe": _app(lambda df: describe.numeric_describe(df, APP)),
        "numeric_percentiles_exact": _app(lambda df: describe.numeric_percentiles(df, APP)),
        "numeric_percentiles_approx": _app(
            lambda df: describe.numeric_percentiles(df, APP, method="approx")
        ),
        "numeric_summary": _app(lambda df: describe.numeric_summary(df, APP)),
        "categorical_describe": _app(lambda df: describe.categorical_describe(df, APP)),
        # trends
        "monthly_stats": _app(lambda df: trend.monthly_stats(df, APP)),
        "age_bin_rates": _app(lambda df: trend.age_bin_rates(df, APP)),
        "age_bin_rates_from_zero": _app(
            lambda df: trend.age_bin_rates(df, APP, include_lowest=True)
        ),
        "age_bin_wilson": _app(lambda df: trend.age_bin_wilson(df, APP)),
        "age_bin_bootstrap": _app(lambda df: trend.age_bin_bootstrap(df, APP)),
        "window_volume_stats": _app(trend.window_volume_stats),
        "window_histogram": _app(trend.window_histogram),
        "scatter_age_accounts": _app(
            lambda df: trend.scatter_age_accounts(df, APP, KEY, cap=5_000, portable=True)
        ),
        # information value
        "iv_bins": _app(lambda df: information.iv_bins(df, APP)),
        "iv_all_features": _app(lambda df: information.information_values(df, APP)),
        "iv_text_label": _app(_text_label),
        "iv_drop_missing": _app(
            lambda df: information.information_values(df, APP, missing="drop")
        ),
        "iv_width_bins": _app(
            lambda df: information.information_values(df, APP, binning="width")
        ),
        # correlation
        "pearson_matrix": _app(lambda df: correlation.pearson_matrix(df, APP)),
        "pearson_matrix_wide": _app(_pearson_wide),
        "spearman_matrix": _app(lambda df: correlation.spearman_matrix(df, APP)),
        "high_corr_pairs": _app(_high_pairs),
        "median_impute": _app(lambda df: impute.median_impute(df, APP.numeric(df), KEY)),
        "outlier_counts": _app(lambda df: impute.outlier_counts(df, APP.numeric(df))),
        "scatter_pairs": _app(
            lambda df: correlation.scatter_pairs(df, APP, SCATTER, KEY, portable=True)
        ),
        "scatter_found_pairs": _app(_found_scatter),
        # distributions
        "clip_bounds": _app(lambda df: distribution.clip_bounds(df, APP)),
        "clipped_density_hist": _app(lambda df: distribution.density_histogram(df, APP)),
        "clipped_density_hist_auto": _app(
            lambda df: distribution.density_histogram(df, APP, "auto")
        ),
        "kde_curve": _app(lambda df: distribution.kde_curve(df, APP)),
        "class_means": _app(lambda df: distribution.class_means(df, APP)),
        "category_rates_top20": _app(lambda df: distribution.category_rates(df, APP)),
        "value_counts": _app(lambda df: distribution.value_counts(df, APP.categorical(df))),
        # importance
        "ordinal_encode": _app(_encoded),
        "rf_importance_by_seed": _app(lambda df: importance.rf_importance_by_seed(df, APP)),
        "rf_importance": _app(
            lambda df: importance.rf_importance(importance.rf_importance_by_seed(df, APP))
        ),
        "importance_comparison": _app(_comparison),
        "retention_report": _app(
            lambda df: retention_report(
                missing.missing_stats(df, APP), information.information_values(df, APP)
            )
        ),
        # what must hold of results that SQL can't give, and reports read back
        "bernoulli_sample_size": _app(lambda df: relations.sample_size(df, KEY)),
        "sketched_percentile_ranks": _app(lambda df: relations.sketch_ranks(df, APP)),
        "age_bin_bootstrap_brackets": _app(lambda df: relations.bootstrap_brackets(df, APP)),
        "kde_curve_error": _app(lambda df: relations.curve_error(df, APP)),
        "rf_importance_sums": _app(lambda df: relations.importance_sums(df, APP)),
        "importance_comparison_top30": _on(
            vector, lambda df: relations.compared(df, vector_roles)
        ),
        "importance_over_seeds": lambda spark, folder: rounded(
            relations.importance_over_seeds(read_table(spark, f"{folder}/lineitem.parquet"))
        ),
        "missing_report_file": _app(lambda df: relations.written(missing.missing_stats(df, APP))),
        "importance_report_file": _on(
            vector,
            lambda df: relations.written(relations.given_importance(df, vector_roles), False),
        ),
        # states of a table that grows, merged from two runs
        "incremental_monthly_stats": _grown(lambda f, m: states.monthly_from_states(m)),
        "incremental_missing_stats": _grown(lambda f, m: states.missing_from_states(f)),
        "incremental_numeric_describe": _grown(lambda f, m: states.numeric_from_states(f)),
        "incremental_distinct_estimates": _grown(lambda f, m: states.distinct_from_states(f)),
        "incremental_distinct_within": runs.distinct_within,
        "event_value_bootstrap": _on(
            event_rows, lambda df: bootstrap.bootstrap_means(df, "value", "event_type", ["event_id"])
        ),
        "event_value_bootstrap_brackets": _on(
            event_rows, lambda df: relations.mean_brackets(df, "value", "event_type", ["event_id"])
        ),
        # the same operators on other tables
        "document_missing_stats": _on(doc, lambda df: missing.missing_stats(df, doc_roles)),
        "document_iv": _on(doc, lambda df: information.information_values(df, doc_roles)),
        "document_category_rates": _on(
            doc, lambda df: distribution.category_rates(df, doc_roles)
        ),
        "event_monthly_stats": _on(event, lambda df: trend.monthly_stats(df, event_roles)),
        "event_density_hist": _on(
            event, lambda df: distribution.density_histogram(df, event_roles, "auto")
        ),
        "event_category_describe": _on(
            event, lambda df: describe.categorical_describe(df, event_roles)
        ),
        "event_value_counts": _on(
            event_rows, lambda df: distribution.value_counts(df, ["event_type", "props"])
        ),
        "line_numeric_summary": _on(
            line, lambda df: describe.numeric_summary(df, line_roles), above=2e-8
        ),
        "line_spearman_matrix": _on(line, lambda df: correlation.spearman_matrix(df, line_roles)),
        "line_pearson_matrix": _on(line, lambda df: correlation.pearson_matrix(df, line_roles)),
        "line_iv": _on(line, lambda df: information.information_values(df, line_roles)),
        "part_value_counts": _part_counts,
        "event_time_percentiles": lambda spark, folder: rounded(_event_times(spark, folder)),
        "document_text_codes": _encoded_texts,
        "part_name_codes": _encoded_names,
        "part_codes_of_other_rows": _halves("part", "p_partkey", ["p_name", "p_brand", "p_type"]),
        "document_codes_of_other_rows": _halves(
            "documents", "doc_id", ["text", "lang", "source"]
        ),
        "vector_iv": _on(vector, lambda df: information.information_values(df, vector_roles)),
        "vector_pearson_matrix": _on(
            vector, lambda df: correlation.pearson_matrix(df, vector_roles)
        ),
        "vector_spearman_matrix": _on(
            vector, lambda df: correlation.spearman_matrix(df, vector_roles)
        ),
        "vector_outlier_counts": _on(
            vector, lambda df: impute.outlier_counts(df, vector_roles.numeric(df))
        ),
        **LLM_QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    """The SQL for every query with exact results.

    There is none for sketched quantiles, Spark's own Bernoulli sample, the
    bootstrap and the random forests.
    """
    return {**ORACLES, **LLM_ORACLES}
