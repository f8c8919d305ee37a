"""Checks that return the violations as a DataFrame; an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sample-sheet columns, identity fields and missing-value tokens.
REQUIRED_COLUMNS = [
    "sample_id", "observation_id", "experimental_unit_id", "subject_id", "biospecimen_id", "time",
    "time_unit", "condition", "batch", "modality", "file_id", "replicate_type",
]
IDENTITY_FIELDS = [
    "sample_id", "observation_id", "experimental_unit_id", "subject_id", "biospecimen_id",
    "condition", "batch", "modality", "file_id", "time_unit",
]
NA_TOKENS = ["", "NA", "NaN", "nan", "None", "null", "."]

# Edge vocabulary.
FUNCTIONAL_ALIASES = ["string", "string-db", "stringdb", "string_db"]
DIRECTED_TYPES = ["gene_regulation", "gene_protein_coding"]
UNDIRECTED_TYPES = ["physical_ppi", "functional_association", "pathway_comembership"]


def first_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that is broken, NULL when none is."""
    col = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        col = F.when(broken, name).otherwise(col)
    return col


def missing_columns(df: DataFrame, required: list[str] | None = None) -> list[str]:
    return [c for c in required or REQUIRED_COLUMNS if c not in df.columns]


def na_tokens(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Identity fields that hold a missing-value token after trimming. NULL counts as missing."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    long = df.select(key, cells.alias("c")).select(key, "c.field", "c.value")
    return long.where(F.col("value").isNull() | F.trim("value").isin(NA_TOKENS))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def undeclared(df: DataFrame, column: str, declared: DataFrame) -> DataFrame:
    return df.join(declared, column, "left_anti")


def times_per_unit(sheet: DataFrame) -> DataFrame:
    return sheet.groupBy("experimental_unit_id").agg(
        F.count_distinct("time").alias("n_times"), F.count_distinct("subject_id").alias("n_subjects")
    )


def longitudinal_violations(sheet: DataFrame) -> DataFrame:
    """Units seen at a single time."""
    return times_per_unit(sheet).where("n_times < 2")


def cross_section_violations(sheet: DataFrame) -> DataFrame:
    """Units seen at several times, or mapped to several subjects (the reverse is not checked)."""
    return times_per_unit(sheet).withColumn(
        "reason", first_reason(("several_times", F.col("n_times") > 1), ("several_subjects", F.col("n_subjects") > 1))
    ).where("reason IS NOT NULL")


def observation_conflicts(sheet: DataFrame, strict: tuple[str, ...] = ("experimental_unit_id", "subject_id", "biospecimen_id", "time"), flagged: tuple[str, ...] = ("condition", "batch")) -> DataFrame:
    """Fields that vary inside one observation; ``severity`` separates errors from warnings."""
    fields = [*strict, *flagged]
    per = sheet.groupBy("observation_id").agg(
        *[F.min(F.col(f).cast("string")).alias(f"lo_{f}") for f in fields],
        *[F.max(F.col(f).cast("string")).alias(f"hi_{f}") for f in fields],
    )
    bad = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"lo_{f}") != F.col(f"hi_{f}"),
                    F.struct(F.lit(f).alias("field"), F.lit("error" if f in strict else "warning").alias("severity")),
                )
                for f in fields
            ]
        )
    )
    return per.select("observation_id", F.explode(bad).alias("v")).select("observation_id", "v.*")


def manifest_modality_gaps(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Declared modalities without a matrix file and matrix files of undeclared modalities."""
    owned = files.where("role = 'matrix'").select("dataset_id", "modality").distinct()
    missing = declared.join(owned, ["dataset_id", "modality"], "left_anti").withColumn("reason", F.lit("no_matrix_file"))
    unknown = owned.join(declared, ["dataset_id", "modality"], "left_anti").withColumn("reason", F.lit("unknown_modality"))
    return missing.select("dataset_id", "modality", "reason").unionByName(unknown.select("dataset_id", "modality", "reason"))


def review_violations(manifests: DataFrame) -> DataFrame:
    """Review state rules plus the training gate (only ``approved`` trains)."""
    status, open_items = F.col("status"), F.col("n_unresolved") > 0
    approved = status == "approved"
    reason = first_reason(
        ("approved_with_open_items", approved & open_items),
        ("required_without_items", (status == "required") & ~open_items),
        ("approved_without_taxon", approved & F.col("taxon_id").isNull()),
        ("approved_without_design", approved & (F.col("sampling_design") == "undeclared")),
        ("approved_without_pairing", approved & (F.col("pairing_level") == "undeclared")),
        ("rejected", status == "rejected"),
        ("needs_review", ~approved),
    )
    return manifests.withColumn("reason", reason).where("reason IS NOT NULL")


def design_violations(manifests: DataFrame) -> DataFrame:
    design, pairing = F.col("sampling_design"), F.col("pairing_level")
    declared, mirror = design != "undeclared", F.col("longitudinal")
    reason = first_reason(
        ("undeclared_design_with_flag", ~declared & mirror.isNotNull()),
        ("flag_disagrees", declared & mirror.isNotNull() & (mirror != (design == "longitudinal"))),
        ("cross_section_of_donors", (design == "repeated_cross_sectional") & (F.col("unit_of_independence") == "donor")),
        ("group_level_marked_paired", declared & (pairing == "group_level_only") & F.col("paired_modalities")),
    )
    return manifests.withColumn("reason", reason).where("reason IS NOT NULL")


def task_violations(tasks: DataFrame) -> DataFrame:
    """Tasks their design cannot support.

    Columns: ``kind, target_modality, input_modalities, modalities, sampling_design,
    pairing_level, target_time_min``.
    """
    wanted = F.concat(F.array("target_modality"), "input_modalities")
    subject = F.col("kind") == "subject_forecast"
    reason = first_reason(
        ("unknown_modality", F.size(F.array_except(wanted, F.col("modalities"))) > 0),
        ("undeclared_design", (F.col("sampling_design") == "undeclared") | (F.col("pairing_level") == "undeclared")),
        ("subject_forecast_needs_longitudinal", subject & (F.col("sampling_design") != "longitudinal")),
        ("group_level_feeds_several_modalities", subject & (F.col("pairing_level") == "group_level_only") & (F.size("input_modalities") > 1)),
        ("group_forecast_needs_target_time_min", (F.col("kind") == "group_time_forecast") & F.col("target_time_min").isNull()),
    )
    return tasks.withColumn("reason", reason).where("reason IS NOT NULL")


def assay_value_violations(cells: DataFrame, counts: list[str], intensities: list[str], log_like: list[str], zeros_are_missing: bool = True, log2_transform: bool = True) -> DataFrame:
    """Negative counts or intensities, infinite log-like values, zeros that log2 cannot take."""
    modality, raw = F.col("modality"), F.col("raw")
    rules = [
        ("negative", modality.isin([*counts, *intensities]) & (raw < 0)),
        ("infinite", modality.isin(log_like) & (F.abs(raw) == F.lit(float("inf")))),
    ]
    if log2_transform and not zeros_are_missing:
        rules.append(("zero_before_log2", modality.isin(intensities) & (raw == 0)))
    return cells.withColumn("reason", first_reason(*rules)).where("reason IS NOT NULL")


def edge_violations(edges: DataFrame) -> DataFrame:
    """Edges whose label, direction, score or causal flag breaks a rule."""
    name = F.replace(F.lower(F.trim("source_name")), F.lit(" "), F.lit(""))
    functional = reduce(lambda a, b: a | b, [F.contains(name, F.lit(a)) for a in FUNCTIONAL_ALIASES])
    kind = F.col("edge_type")
    reason = first_reason(
        ("unknown_edge_type", ~kind.isin(DIRECTED_TYPES + UNDIRECTED_TYPES)),
        ("score_out_of_range", ~F.coalesce(F.col("score").between(0.0, 1.0), F.lit(False))),
        ("functional_source_as_physical", functional & (kind == "physical_ppi")),
        ("functional_source_as_regulation", functional & (kind == "gene_regulation")),
        ("directed_type_undirected", kind.isin(DIRECTED_TYPES) & ~F.col("directed")),
        ("undirected_type_directed", kind.isin(UNDIRECTED_TYPES) & F.col("directed")),
        ("causal", F.col("is_causal")),
    )
    return edges.withColumn("reason", reason).where("reason IS NOT NULL")


def embedding_violations(embeddings: DataFrame, features: DataFrame, dim: int) -> DataFrame:
    """Wrong length, unknown modality or feature, repeated feature, feature without a vector."""
    on = ["modality", "feature"]
    known = features.select("modality").distinct()
    counted = embeddings.groupBy(*on).agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != dim).alias("bad_dim"))
    with_vectors = counted.select("modality").distinct()
    parts = [
        counted.where("bad_dim > 0").select(*on, F.lit("wrong_length").alias("reason")),
        counted.where("n > 1").select(*on, F.lit("repeated").alias("reason")),
        counted.join(known, "modality", "left_anti").select(*on, F.lit("unknown_modality").alias("reason")),
        counted.join(known, "modality", "left_semi").join(features, on, "left_anti").select(*on, F.lit("unknown_feature").alias("reason")),
        features.join(with_vectors, "modality", "left_semi").join(counted, on, "left_anti").select(*on, F.lit("no_vector").alias("reason")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def fitted_off_train(provenance: DataFrame) -> DataFrame:
    """Fitted records whose statistics did not come from train."""
    return provenance.where("learns_statistics AND NOT (fit_split <=> 'train')")


def objective_leaks(inputs: DataFrame) -> DataFrame:
    """Rows a tuning objective may not see."""
    return inputs.where("split NOT IN ('train', 'val') OR split IS NULL")


def unfillable_features(cells: DataFrame, value: str = "scaled") -> DataFrame:
    """Features with no observed train cell, which a mean fill cannot serve."""
    train = cells.groupBy("modality", "feature").agg(
        F.count(F.when(F.col("split") == "train", F.col(value))).alias("n_train")
    )
    return train.where("n_train = 0")


def spline_violations(train_obs: DataFrame, df: int) -> DataFrame:
    """Too few distinct train times or train rows for a spline of ``df`` columns."""
    stats = train_obs.agg(F.count_distinct("time").alias("n_times"), F.count("*").alias("n_rows"))
    reason = first_reason(
        ("degrees_below_three", F.lit(df < 3)),
        ("too_few_times", F.lit(df) >= F.col("n_times")),
        ("too_few_rows", F.col("n_rows") < df + 1),
    )
    return stats.withColumn("reason", reason).where("reason IS NOT NULL")
