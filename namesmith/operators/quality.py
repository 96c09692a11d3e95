"""Validation of source rows, documents and loaded collections: one row per issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions.order import running_index
from namesmith.functions.text import code_point_label, strip
from namesmith.session import checkpointed

REQUIRED = ("profile_id", "hangul", "hanja", "unicode", "sound_meaning", "strokes", "sound_ohaeng", "resource_ohaeng")
REQUIRED_GRAPH = (*REQUIRED, "is_person_name_hanja")


def _issue(when: Column, name: str, detail: Column | None = None) -> Column:
    detail = F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit("null"))
    return F.when(when, F.struct(F.lit(name).alias("issue"), detail.alias("detail")))


def _exploded(df: DataFrame, keep: list[str], issues: list[Column]) -> DataFrame:
    return df.select(*keep, F.explode(F.array_compact(F.array(*issues))).alias("_i")).select(*keep, "_i.*")


def _repeats(df: DataFrame, key: str, seq: str, flag: str) -> DataFrame:
    """Flag second and later rows of a key; blank keys never repeat. Only repeated keys are joined back."""
    first = df.filter(strip(F.col(key)) != "").groupBy(key).agg(F.min(seq).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return df.join(first, key, "left").withColumn(flag, F.coalesce(F.col(seq) > F.col("_first"), F.lit(False))).drop("_first")


def parsed_rows(df: DataFrame, raw: str, seq: str) -> DataFrame:
    """Source rows from JSON objects: the fields present, their values, and which are integers."""
    return df.select(
        seq, F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")).alias("fields"),
        F.from_json(raw, "MAP<STRING,STRING>").alias("v"),
        F.col(raw).rlike(r'"strokes"\s*:\s*-?[0-9]+\s*[,}]').alias("strokes_is_int"),
    )


def source_row_issues(rows: DataFrame, seq: str) -> DataFrame:
    """Issues of ``parsed_rows`` by input position; a row with missing fields gets only that issue."""
    required = F.array(*[F.lit(x) for x in REQUIRED])
    placed = running_index(rows, seq, "idx").select(
        "idx", "fields", "strokes_is_int", *[F.col("v")[f].alias(f) for f in REQUIRED],
        F.array_except(required, "fields").alias("missing"), F.array_except("fields", required).alias("extra"),
    )
    complete = placed.filter(F.size("missing") == 0)
    flagged = _repeats(complete, "profile_id", "idx", "repeated")
    expected = F.format_string("OHE-%05d", "idx")
    hanja = F.coalesce("hanja", F.lit("None"))
    single = F.length(hanja) == 1
    issues = _exploded(
        flagged,
        ["idx", "profile_id"],
        [
            _issue(F.size("extra") > 0, "unexpected_fields", F.array_join(F.array_sort("extra"), ",")),
            _issue(F.col("repeated"), "duplicate_profile_id"),
            _issue(~F.col("profile_id").eqNullSafe(expected), "profile_id_sequence_mismatch", expected),
            _issue(~single, "hanja_must_be_single_character", F.col("hanja")),
            _issue(single & ~F.col("unicode").eqNullSafe(code_point_label(F.col("hanja"))), "unicode_mismatch", code_point_label(F.col("hanja"))),
            _issue(F.length(F.coalesce("hangul", F.lit("None"))) != 1, "hangul_must_be_single_syllable", F.col("hangul")),
            _issue(strip(F.coalesce("sound_meaning", F.lit("None"))) == "", "empty_sound_meaning"),
            _issue(~F.col("strokes_is_int"), "strokes_must_be_integer", F.col("strokes")),
        ],
    )
    gaps = placed.filter(F.size("missing") > 0).select(
        "idx", F.coalesce("profile_id", F.concat(F.lit("row_"), "idx")).alias("profile_id"), F.lit("missing_required_fields").alias("issue"),
        F.array_join("missing", ",").alias("detail"),
    )
    return issues.unionByName(gaps)


def document_issues(sources: DataFrame, documents: DataFrame, seq: str) -> DataFrame:
    """Issues of documents against their source rows, joined by position.

    ``sources`` has the profile fields, ``documents`` id, document and a metadata map.
    """
    rows = running_index(sources, seq, "idx").select("idx", *REQUIRED)
    docs = running_index(documents, seq, "idx").select("idx", F.col("id").alias("doc_id"), "document", "metadata")
    sizes = sources.agg(F.count(F.lit(1)).alias("a")).withColumn("_k", F.lit(1)).join(
        F.broadcast(documents.agg(F.count(F.lit(1)).alias("b")).withColumn("_k", F.lit(1))), "_k"
    )
    counts = sizes.filter("a <> b").select(
        F.lit(0).cast("bigint").alias("idx"), F.lit("").alias("profile_id"), F.lit("document_count_mismatch").alias("issue"),
        F.concat_ws(":", "a", "b").alias("detail"),
    )
    # maps make rows far larger than their files let Spark expect, so they are merged, not broadcast
    both = _repeats(rows.join(docs.hint("merge"), "idx"), "doc_id", "idx", "repeated")
    expected = F.concat(F.lit("hanja_"), "profile_id")
    terms = [F.col(c).cast("string") for c in ("hanja", "hangul", "sound_meaning", "unicode", "strokes", "sound_ohaeng", "resource_ohaeng")]
    text = F.coalesce("document", F.lit(""))
    absent = F.filter(F.array(*terms), lambda t: ~F.contains(text, t))
    has_meta = F.col("metadata").isNotNull()
    issues = _exploded(
        both,
        ["idx", "profile_id"],
        [
            _issue(~F.col("doc_id").eqNullSafe(expected), "id_mismatch", expected),
            _issue(F.col("repeated"), "duplicate_document_id", F.col("doc_id")),
            _issue(text == "", "empty_document"),
            _issue(~has_meta, "metadata_not_object"),
            *[
                _issue(has_meta & ~F.col("metadata")[f].eqNullSafe(F.col(f).cast("string")), "metadata_value_mismatch", F.lit(f))
                for f in REQUIRED
            ],
            _issue(has_meta & (F.size(absent) > 0), "document_missing_required_terms", F.array_join(absent, ",")),
        ],
    )
    return issues.unionByName(counts)


def index_issues(documents: DataFrame, seq: str) -> DataFrame:
    """Shape of document records before they are indexed."""
    placed = running_index(documents, seq, "idx").withColumn("_ok", F.coalesce(F.col("id") != "", F.lit(False)))
    flagged = _repeats(placed, "id", "idx", "repeated")
    meta = F.col("metadata")
    missing = F.array_except(F.array(*[F.lit(x) for x in REQUIRED]), F.map_keys(meta))
    expected = F.concat(F.lit("hanja_"), meta["profile_id"])
    return _exploded(
        flagged.withColumn("doc_id", F.coalesce("id", F.lit(""))),
        ["idx", "doc_id"],
        [
            _issue(~F.col("_ok"), "missing_or_invalid_id"),
            _issue(F.col("repeated"), "duplicate_id"),
            _issue(strip(F.coalesce("document", F.lit(""))) == "", "missing_or_empty_document"),
            _issue(meta.isNull(), "metadata_not_object"),
            _issue(meta.isNotNull() & (F.size(missing) > 0), "missing_metadata_fields", F.array_join(missing, ",")),
            _issue(F.col("_ok") & (F.col("id") != expected), "id_profile_id_mismatch", expected),
        ],
    )


def graph_rows(documents: DataFrame, seq: str, default_dataset: str = "hanja_profiles") -> tuple[DataFrame, DataFrame]:
    """(valid rows, issues) of document records bound for the graph.

    ``documents`` has id, document, a metadata map and the flag ``strokes_is_int``. The
    issues, few beside the rows, are checkpointed: both results are derived from them.
    """
    meta = F.col("metadata")
    placed = running_index(documents, seq, "idx").withColumn("_ok", F.coalesce(strip(F.col("id")) != "", F.lit(False)))
    with_id = _repeats(placed.filter("_ok"), "id", "idx", "repeated_id")
    required = F.array(*[F.lit(x) for x in REQUIRED_GRAPH])
    missing = F.coalesce(F.array_except(required, F.map_keys(meta)), F.array().cast("array<string>"))
    checked = with_id.withColumn("missing", missing).withColumn("_complete", meta.isNotNull() & (F.size("missing") == 0))
    head = _exploded(
        checked,
        ["idx", "id"],
        [
            _issue(F.col("repeated_id"), "duplicate_id"),
            _issue(strip(F.coalesce("document", F.lit(""))) == "", "missing_or_empty_document"),
            _issue(meta.isNull(), "metadata_not_object"),
            _issue(meta.isNotNull() & ~F.col("_complete"), "missing_metadata_fields", F.array_join("missing", ",")),
        ],
    )
    fields = checked.filter("_complete").select(
        "idx", "id", "document", "strokes_is_int", *[meta[f].alias(f) for f in REQUIRED_GRAPH],
        F.coalesce(F.nullif(meta["collection"], F.lit("")), F.lit(default_dataset)).alias("dataset"),
    )
    has_profile = F.coalesce(strip(F.col("profile_id")) != "", F.lit(False))
    flagged = _repeats(fields, "profile_id", "idx", "repeated_profile")
    expected = F.concat(F.lit("hanja_"), "profile_id")
    blank = [
        _issue(F.coalesce(strip(F.col(f)) == "", F.lit(True)), f"invalid_{f}", F.col(f))
        for f in ("hangul", "hanja", "unicode", "sound_meaning", "dataset")
    ]
    elements = [
        _issue(~F.coalesce(F.col(f).isin(*E.LABELS), F.lit(False)), f"invalid_{f}", F.col(f)) for f in ("sound_ohaeng", "resource_ohaeng")
    ]
    good_strokes = F.coalesce(F.col("strokes_is_int") & (F.col("strokes").try_cast("bigint") > 0), F.lit(False))
    found = F.array_compact(
        F.array(
            _issue(~has_profile, "invalid_profile_id"),
            _issue(has_profile & (F.col("id") != expected), "id_profile_id_mismatch", expected),
            _issue(F.col("repeated_profile"), "duplicate_profile_id"),
            *blank,
            _issue(~good_strokes, "invalid_strokes", F.col("strokes")),
            *elements,
            _issue(~F.coalesce(F.col("is_person_name_hanja").isin("true", "false"), F.lit(False)), "invalid_is_person_name_hanja", F.col("is_person_name_hanja")),
        )
    )
    body = checkpointed(flagged.select("idx", "id", F.explode(found).alias("_i")).select("idx", "id", "_i.*"))
    no_id = placed.filter("NOT _ok").select("idx", F.lit("").alias("id"), F.lit("missing_or_invalid_id").alias("issue"), F.lit("").alias("detail"))
    valid = fields.join(body.select("idx"), "idx", "left_anti").select(
        "idx", "id", "document", "dataset", *REQUIRED[:5], F.col("strokes").try_cast("int").alias("strokes"), *REQUIRED[6:],
        (F.col("is_person_name_hanja") == "true").alias("is_person_name_hanja"),
    )
    return valid, head.unionByName(body).unionByName(no_id)


def duplicate_code_points(rows: DataFrame, seq: str, samples: int = 10) -> DataFrame:
    """Profiles of the first ``samples`` code points that occur more than once, one row each,
    with the total number of such code points."""
    repeated = rows.groupBy("unicode").agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("_first")).filter("n > 1")
    total = repeated.agg(F.count(F.lit(1)).alias("code_points")).withColumn("_k", F.lit(1))
    first = repeated.orderBy("_first").limit(samples).withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")
    return rows.join(F.broadcast(first), "unicode").select("unicode", "profile_id", "n", "code_points")


def inconsistent_readings(rows: DataFrame) -> DataFrame:
    """Readings with more than one sound element."""
    sets = rows.groupBy("hangul").agg(F.array_sort(F.collect_set("sound_ohaeng")).alias("_s"))
    return sets.filter(F.size("_s") > 1).select("hangul", F.array_join("_s", ",").alias("elements"))


def collection_issues(collection: DataFrame, records: DataFrame, seq: str) -> DataFrame:
    """Count and first/last id of what was loaded against what should have been."""
    wanted = records.agg(
        F.count(F.lit(1)).alias("expected"), F.array(F.min_by("id", seq), F.max_by("id", seq)).alias("_ids")
    ).withColumn("_k", F.lit(1))
    there = collection.agg(F.count(F.lit(1)).alias("actual")).withColumn("_k", F.lit(1))
    one = wanted.join(F.broadcast(there), "_k")
    size = one.filter("expected <> actual").select(
        F.lit("collection_count_mismatch").alias("issue"), F.concat_ws(":", "expected", "actual").alias("detail")
    )
    absent = one.select(F.explode("_ids").alias("id")).distinct().join(collection.select("id"), "id", "left_anti")
    return size.unionByName(absent.select(F.lit("sample_ids_not_found").alias("issue"), F.col("id").alias("detail")))


def report(sources: DataFrame, documents: DataFrame, issues: DataFrame, seq: str) -> DataFrame:
    """One-row validation report: status, counts and the first five document ids."""
    def one(df: DataFrame, *aggs: Column) -> DataFrame:
        return df.agg(*aggs).withColumn("_k", F.lit(1))

    n = F.count(F.lit(1))
    first = documents.select("id", seq).orderBy(seq).limit(5)
    samples = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, "id"))), lambda s: s["id"]), ",")
    return (
        one(sources, n.alias("source_count"))
        .join(one(documents, n.alias("document_count")), "_k")
        .join(one(issues, n.alias("issue_count")), "_k")
        .join(one(first, samples.alias("sample_ids")), "_k")
        .select(
            F.when(F.col("issue_count") == 0, "ok").otherwise("failed").alias("status"), (F.col("issue_count") == 0).alias("ok"),
            "source_count", F.when(F.col("issue_count") == 0, F.col("document_count")).otherwise(0).alias("document_count"), "issue_count",
            F.when(F.col("issue_count") == 0, F.col("sample_ids")).otherwise("").alias("sample_ids"),
        )
    )


class ValidationFailed(ValueError):
    """Raised by the gate; the report has been written."""


def gated_write(documents: DataFrame, issues: DataFrame, validation: DataFrame, path: str, report_path: str) -> None:
    """Write the report, then the documents only if there is no issue."""
    from namesmith.sources.readers import write_documents, write_report

    write_report(validation, report_path)
    if not issues.isEmpty():
        raise ValidationFailed(f"validation failed, see {report_path}")
    write_documents(documents, path, mode="overwrite")

