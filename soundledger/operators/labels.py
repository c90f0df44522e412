"""The label table of an audit, its releases and its history."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soundledger.functions import scores as S
from soundledger.functions import text as X
from soundledger.operators import aggregates as A
from soundledger.operators.chunks import number_names
from soundledger.operators.joins import last_by_key, temporal_neighbours
from soundledger.operators.windows import row_split, session_split

# Version texts a release carries.
RELEASE_SCHEMA_VERSION = "v2"
LABEL_SOURCE = "auto_ensemble_no_human_in_label_loop"


def assemble(
    captures: DataFrame,
    triggers: DataFrame | None,
    positive: str,
    scores: Sequence[str],
    device: str = "device_id",
    session: str = "session_id",
    time_s: str = "t_s",
    window_s: int = 300,
    ensemble_version: str = "v0.2",
    oracle_version: str = "",
    audited_at: str = "",
    disabled: Sequence[str] = (),
) -> DataFrame:
    """One label row per capture: combined scores, tier, neighbours, trigger note and provenance.

    ``scores`` are the names of the independent score columns, the first being
    ``positive`` and the second the feature score that a verdict needs. Triggers
    meet captures on session and the first 19 characters of the time text; the
    last trigger of a second wins.
    """
    rows = temporal_neighbours(captures, [device], time_s, F.col(positive) >= 0.5, window_s)
    used = S.ablate({n: F.col(n) for n in scores}, disabled)
    rows = rows.withColumns(
        {"oracle_agreement": S.score_spread(used), "consensus_score": S.score_consensus(used), "confidence_tier": S.confidence_tier(used)}
    )
    if triggers is not None:
        second = triggers.withColumn("_second", F.substring("ts_iso", 1, 19))
        rows = rows.withColumn("_second", F.substring("ts_iso", 1, 19))
        rows = last_by_key(rows, second, [session, "_second"], "line", ["trigger_note", "trigger_rms", "trigger_conf"]).drop("_second")
    else:
        rows = rows.withColumn("trigger_note", F.lit(None).cast("string"))
    feature_score = used[1] if len(used) > 1 else F.lit(None).cast("double")
    rows = rows.withColumn("trigger_note", F.coalesce("trigger_note", F.lit("")))
    rows = rows.withColumns({"human_note_label": X.note_label(F.col("trigger_note")), "human_note_text": X.note_text(F.col("trigger_note"))})
    return rows.withColumns(
        {
            "human_note_agrees": S.note_agreement(F.col("human_note_label"), F.col("confidence_tier"), feature_score),
            "oracle_version": F.lit(oracle_version),
            "ensemble_version": F.lit(ensemble_version),
            "audited_at": F.lit(audited_at),
        }
    )


def label_rows(
    captures: DataFrame, triggers: DataFrame | None, positive: Sequence[str], confounder: Sequence[str], feature_score: str, embedding_score: str, subtype: Column,
    raw: Sequence[str] = (), high: float = 0.5, **options,
) -> DataFrame:
    """The whole label row: class scores and their groups, all three scores, sub-type, neighbours, raw features, trigger and provenance.

    ``positive`` and ``confounder`` name class-score columns; a sub-type is given to captures whose group score reaches ``high``.
    """
    groups = S.group_scores([F.col(c) for c in positive], [F.col(c) for c in confounder])
    named = {"cry_pos_max": "pos_max", "cry_neg_max": "neg_max", "cry_score": "pos_score", "speech_score": "neg_score", "cry_purity": "purity"}
    rows = captures.withColumns({out: groups[name] for out, name in named.items()})
    rows = rows.withColumn("cluster_label", F.when(F.col("cry_score") >= high, subtype))
    rows = assemble(rows, triggers, "cry_score", ["cry_score", feature_score, embedding_score], **options)
    kept = [
        options.get("session", "session_id"), "capture_file", "ts_iso", *positive, *confounder, *named, feature_score, embedding_score, "cluster_label", "neighbours",
        "high_neighbours", "oracle_agreement", "consensus_score", "confidence_tier", *raw, "trigger_note", "trigger_rms", "trigger_conf", "human_note_label",
        "human_note_text", "human_note_agrees", "oracle_version", "ensemble_version", "audited_at",
    ]
    return rows.select(*[c for c in dict.fromkeys(kept) if c in rows.columns])


RELEASE_COLUMNS = [
    "consensus_score", "oracle_agreement", "confidence_tier", "cluster_label", "high_neighbours", "human_note_label", "human_note_agrees",
]
DISTRIBUTIONS = {"human_note_agrees": "human_note_agreement_distribution"}
RECOMMENDATION = "Train on captures of the tiers high_pos and high_neg. The others are for evaluation. Human notes only monitor; they change no label."


def release_captures(master: DataFrame, name: str = "capture_file", session: str = "session_id", scores: Sequence[str] = (), by: str = "row") -> DataFrame:
    """Slim record of each capture in a release: split, scores to four decimals, tier and notes.

    ``by`` "row" splits by position in name order, "session" keeps sessions whole.
    """
    rows = number_names(master, name, "_pos")
    split = row_split(F.col("_pos")) if by == "row" else session_split(F.col(session))
    numeric = [*scores, "consensus_score", "oracle_agreement"]
    keep = [c for c in RELEASE_COLUMNS if c in master.columns and c not in numeric]
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select(
        F.col(name).alias("file"), session, *[c for c in ("ts_iso",) if c in master.columns], split.alias("split"), *[F.bround(c, 4).alias(c) for c in numeric],
        *[blank(c) if c in ("cluster_label", "human_note_label") else F.col(c) for c in keep],
    )


def release_header(captures: DataFrame, release_id: str, session: str = "session_id", **provenance: str) -> DataFrame:
    """One row: counts, the number of sessions, distributions as maps, recommendation and provenance."""
    dims = [c for c in ("split", "confidence_tier", "cluster_label", "human_note_label", "human_note_agrees") if c in captures.columns]
    counts = A.histograms(captures, dims)
    maps = counts.agg(
        *[
            F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("column") == c, F.struct("value", "n"))))).alias(DISTRIBUTIONS.get(c, f"{c}_distribution"))
            for c in dims
        ]
    )
    base = captures.agg(
        F.count(F.lit(1)).alias("n_captures"), F.count_if(S.is_eligible(F.col("confidence_tier"))).alias("train_eligible_n"), F.countDistinct(session).alias("n_sessions")
    )
    # Two one-row frames.
    row = base.crossJoin(maps)
    return row.select(
        F.lit(RELEASE_SCHEMA_VERSION).alias("schema_version"), F.lit(release_id).alias("release_id"), "*",
        F.lit(LABEL_SOURCE).alias("label_source"), F.lit(RECOMMENDATION).alias("training_recommendation"), *[F.lit(v).alias(k) for k, v in provenance.items()],
    )


def drift_hashes(captures: DataFrame, content: DataFrame, n: int = 5, name: str = "file") -> DataFrame:
    """``(file, sha256)`` of the first ``n`` captures by name, to notice files that change later."""
    first = captures.select(name).orderBy(name).limit(n)
    return content.join(F.broadcast(first), name, "left_semi").select(name, F.sha2("content", 256).alias("sha256"))


def write_release(captures: DataFrame, header: DataFrame, folder: str, release_id: str, hashes: DataFrame | None = None, session: str = "session_id") -> None:
    """Freeze a release; an existing one is never overwritten.

    Captures, sessions and hashes go to folders of this attempt's own. The header names them and is written last: it
    alone makes the release, so an attempt that dies leaves nothing that counts.
    """
    target = f"{folder.rstrip('/')}/release_id={release_id}"
    attempt = uuid.uuid4().hex
    captures.write.parquet(f"{target}/captures-{attempt}")
    captures.select(session).distinct().write.parquet(f"{target}/sessions-{attempt}")
    if hashes is not None:
        hashes.write.parquet(f"{target}/hashes-{attempt}")
    row = header.withColumns({"attempt": F.lit(attempt), "has_hashes": F.lit(hashes is not None)})
    row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("errorifexists").text(f"{target}/header")


def read_frozen(spark: SparkSession, folder: str, release_id: str) -> dict[str, DataFrame]:
    """Header, captures, sessions and hashes of a release."""
    target = f"{folder.rstrip('/')}/release_id={release_id}"
    header = spark.read.json(f"{target}/header")
    row = header.select("attempt", "has_hashes").first()
    parts = ["captures", "sessions", *(["hashes"] if row["has_hashes"] else [])]
    return {"header": header, **{p: spark.read.parquet(f"{target}/{p}-{row['attempt']}") for p in parts}}


def label_history(audits: DataFrame, key: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Append-only label history as validity intervals: a row each time a capture's labels change.

    One row per audit exists for each capture, so a capture's group stays as small as the number of audits.
    """
    by = Window.partitionBy(*key).orderBy(at)
    packed = F.struct(*values)
    changed = audits.withColumn("_was", F.lag(packed).over(by)).filter(F.col("_was").isNull() | ~F.col("_was").eqNullSafe(packed))
    return changed.drop("_was").select("*", F.lead(at).over(by).alias("valid_to")).withColumnRenamed(at, "valid_from")


def as_of_release(history: DataFrame, frozen_at: Column) -> DataFrame:
    """Labels as they stood when a release was frozen, whatever was relabelled later."""
    return history.filter((F.col("valid_from") <= frozen_at) & (F.col("valid_to").isNull() | (F.col("valid_to") > frozen_at)))


def disagreement_alarm(master: DataFrame, session: str, trailing: int = 3, factor: float = 2.0) -> DataFrame:
    """Share of disagreeing captures per session, and whether it exceeds its trailing mean by a factor."""
    share = master.groupBy(session).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("confidence_tier") == "low").cast("int")).alias("low_share"))
    placed = number_names(share, session, "_pos")
    ahead = placed.select(F.explode(F.sequence(F.col("_pos") + 1, F.col("_pos") + trailing)).alias("_pos"), "low_share")
    out = placed.join(ahead.groupBy("_pos").agg(F.avg("low_share").alias("trailing_mean")), "_pos", "left").drop("_pos")
    return out.withColumn("alarm", F.coalesce(F.col("low_share") > factor * F.col("trailing_mean"), F.lit(False)))


def inventory(master: DataFrame, day: str = "day", session: str = "session_id", tier: str = "confidence_tier", subtype: str = "cluster_label") -> dict[str, DataFrame]:
    """The profile report as small tables, each a grouped count."""
    high = master.filter(F.col(tier) == "high_pos").filter(F.coalesce(F.col(subtype), F.lit("")) != "")
    return {
        "days": A.tier_crosstab(master, day, tier),
        "sessions": A.session_summary(master, session, F.col(day), tier),
        "subtypes": A.tier_crosstab(high, day, subtype, ["fuss", "full_cry", "distress", "screech"], total=False),
        "readiness": A.readiness(master, tier, subtype),
        **extra_tables(master, tier),
    }


def extra_tables(master: DataFrame, tier: str) -> dict[str, DataFrame]:
    """Tables for which the label rows have the columns: tiers by hour of day, by era, negatives by source, rows by version."""
    out = {}
    for name, column in (("hours", "hour"), ("eras", "era"), ("versions", "ensemble_version")):
        if column in master.columns:
            out[name] = A.tier_crosstab(master, column, tier)
    if "negative_source" in master.columns:
        out["negatives"] = master.filter(F.col(tier) == "high_neg").groupBy("negative_source").count()
    return out


def render_inventory(tables: dict[str, DataFrame], title: str = "Data inventory", max_rows: int = 10_000) -> str:
    """Markdown text of the profile tables, one row per day or session; tables too long to print are an error, not cut."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        rows = df.orderBy(df.columns[0]).limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise ValueError(f"table {name} has more than {max_rows} rows; write it as a table instead")
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
        out.append("")
    return "\n".join(out)
