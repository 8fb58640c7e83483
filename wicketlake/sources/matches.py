"""Raw match files: reading, identity, revision choice and flattening to the delivery table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wicketlake.functions.rates import CREDITED_KINDS
from wicketlake.functions.text import clean_text, lenient_int
from wicketlake.operators.aggregates import latest_per_key
from wicketlake.schemas import DELIVERY_COLUMNS, DELIVERY_DDL, RAW_MATCH_DDL

# Folders that hold no source files.
SKIPPED_FOLDERS = r"^(\..*|all_json|__pycache__|.*_csv)$"
CORRUPT = "_corrupt_record"


def holds_json(spark: SparkSession, folder: str) -> bool:
    """Whether a JSON file lies in the folder itself; the file system is asked, no job runs."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    entries = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatusIterator(place)
    while entries.hasNext():
        entry = entries.next()
        name = entry.getPath().getName()
        if entry.isFile() and name.endswith(".json") and name[0] not in "._":
            return True
    return False


def path_below(spark: SparkSession, path: Column, folder: str) -> Column:
    """The rest of a file's path below ``folder``, compared as a path: without scheme and host, escapes as they are."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getRawPath().rstrip("/")
    bare = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.when(F.startswith(bare, F.lit(root + "/")), F.substring(bare, len(root) + 2, 1 << 30))


def read_matches(spark: SparkSession, root: str) -> DataFrame:
    """Every JSON file below ``root`` with its source folder, path and age.

    The folder right below the root is the source; files in the root itself make the root the
    only source. Malformed files keep their text in ``_corrupt_record``. Files whose names start with
    an underscore or a dot are hidden, as for Spark.
    """
    base = root.rstrip("/")
    raw = (
        spark.read.schema(RAW_MATCH_DDL)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(base)
    )
    inside = path_below(spark, F.col("path"), base)
    folder = F.when(F.contains(inside, F.lit("/")), F.substring_index(inside, "/", 1)).otherwise(F.lit(""))
    found = raw.select(
        "*",
        F.col("_metadata.file_path").alias("path"),
        F.unix_micros(F.col("_metadata.file_modification_time")).alias("modified"),
    ).withColumn("_folder", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))))
    # Files in the root itself win over folders, as one source.
    if holds_json(spark, base):
        kept = found.filter("_folder = ''").withColumn("source_folder", F.lit(base.rsplit("/", 1)[-1]))
    else:
        kept = found.filter(~F.lower("_folder").rlike(SKIPPED_FOLDERS)).withColumn("source_folder", F.col("_folder"))
    return kept.drop("_folder")


def readable(files: DataFrame) -> DataFrame:
    return files.filter(F.col(CORRUPT).isNull())


def quarantined(files: DataFrame) -> DataFrame:
    """Malformed files: source, path and their text as the error."""
    return files.filter(F.col(CORRUPT).isNotNull()).select(
        "source_folder", "path", F.col(CORRUPT).alias("error")
    )


def match_date(dates) -> Column:
    kept = F.filter(F.transform(dates, lambda d: clean_text(d)), lambda d: d != "")
    return F.coalesce(F.array_min(kept), F.lit(""))


def team_list(teams, players) -> Column:
    """Sorted non-empty teams, else the keys of the players map."""

    def named(values) -> Column:
        return F.array_sort(F.filter(F.transform(values, lambda t: clean_text(t)), lambda t: t != ""))

    listed, keyed = named(teams), named(F.map_keys(players))
    none = F.array().cast("array<string>")
    return F.when(F.size(F.coalesce(listed, none)) > 0, listed).otherwise(F.coalesce(keyed, none))


def with_identity(files: DataFrame) -> DataFrame:
    """Adds ``match_id`` (file's id, else file name, else a key made of date, teams, type and venue) and revision."""

    def part(c: Column) -> Column:
        return F.regexp_replace(F.lower(clean_text(c)), r"[^\p{L}\p{N} _-]", "")

    composite = F.regexp_replace(
        F.concat_ws(
            "|",
            part(match_date("info.dates")),
            part(F.array_join(team_list("info.teams", "info.players"), ",")),
            part(F.col("info.match_type")),
            part(F.col("info.venue")),
        ),
        r"^\|+|\|+$",
        "",
    )
    own = F.coalesce(
        F.nullif(clean_text("meta.match_id"), F.lit("")), F.nullif(clean_text("info.match_id"), F.lit(""))
    )
    file_name = F.regexp_replace(F.substring_index(F.url_decode("path"), "/", -1), r"\.json$", "")
    identity = F.coalesce(
        own, F.nullif(clean_text(file_name), F.lit("")), F.nullif(composite, F.lit("")), F.col("path")
    )
    return files.withColumns({"match_id": identity, "revision": lenient_int("meta.revision")})


def latest_revisions(files: DataFrame) -> DataFrame:
    """One file per match: highest revision, then the newest file, then the smallest path."""
    return latest_per_key(files, ["match_id"], [F.desc("revision"), F.desc("modified"), F.asc("path")])


def primary_wicket(wickets) -> Column:
    """First credited wicket with a named player, else the first named, else the first."""

    def named(w) -> Column:
        return clean_text(w.player_out) != ""

    def credited(w) -> Column:
        return F.lower(clean_text(w.kind)).isin(CREDITED_KINDS) & named(w)

    one = F.lit(1)
    return F.coalesce(
        F.try_element_at(F.filter(wickets, credited), one),
        F.try_element_at(F.filter(wickets, named), one),
        F.try_element_at(wickets, one),
    )


def fielder_names(fielders) -> Column:
    """Names joined by ``; ``; an entry is a name or a JSON object with one."""

    def name(f) -> Column:
        return clean_text(F.when(F.startswith(F.trim(f), F.lit("{")), F.get_json_object(f, "$.name")).otherwise(f))

    return F.array_join(F.filter(F.transform(F.coalesce(fielders, F.array().cast("array<string>")), name), lambda n: n != ""), "; ")


def _present(c: str) -> Column:
    """Whether a raw JSON value counts as present."""
    text = F.trim(F.coalesce(F.col(c), F.lit("")))
    return ~text.isin("", "{}", "[]", "false", "0", "null", '""')


def _flag_int(c: Column) -> Column:
    return F.when(F.lower(c) == "true", F.lit(1).cast("bigint")).otherwise(lenient_int(c))


def flatten(selected: DataFrame) -> DataFrame:
    """One row per delivery with the columns of the delivery table and ``row_seq``, its place in the match."""
    header = selected.select(
        "match_id",
        "source_folder",
        clean_text("meta.data_version").alias("data_version"),
        match_date("info.dates").alias("match_date"),
        *[clean_text(f"info.{c}").alias(c) for c in ("season", "match_type", "gender", "team_type", "venue", "city")],
        clean_text("info.outcome.winner").alias("match_winner"),
        clean_text("info.toss.winner").alias("toss_winner"),
        clean_text("info.toss.decision").alias("toss_decision"),
        "innings",
    )
    names = [c for c in header.columns if c != "innings"]
    innings = header.select(*names, F.posexplode("innings").alias("i_no", "i"))
    overs = innings.select(*names, "i_no", "i.team", F.posexplode("i.overs").alias("o_no", "o"))
    balls = overs.select(
        *names, "i_no", "team", "o_no", lenient_int("o.over").alias("over"),
        F.posexplode("o.deliveries").alias("d_no", "d"),
    ).withColumn("w", primary_wicket(F.col("d.wickets")))
    runs = {c: lenient_int(f"d.runs.{c}") for c in ("batter", "extras", "total")}
    extras = {c: lenient_int(f"d.extras.{c}") for c in ("wides", "noballs", "byes", "legbyes", "penalty")}
    values = {
        "inning": F.col("i_no") + 1,
        "batting_team": clean_text("team"),
        "over": F.col("over"),
        "ball_in_over": F.col("d_no") + 1,
        "ball_id": F.concat_ws(".", F.col("over").cast("string"), (F.col("d_no") + 1).cast("string")),
        "batter": clean_text("d.batter"),
        "bowler": clean_text("d.bowler"),
        "non_striker": clean_text("d.non_striker"),
        "runs_batter": runs["batter"],
        "runs_extras": runs["extras"],
        "runs_total": runs["total"],
        "non_boundary": _flag_int(F.coalesce("d.runs.non_boundary", "d.non_boundary")),
        **{f"extras_{c}": e for c, e in extras.items()},
        "wicket_count": F.coalesce(F.size("d.wickets"), F.lit(0)),
        "wicket_player_out": clean_text("w.player_out"),
        "wicket_kind": F.lower(clean_text("w.kind")),
        "wicket_fielders": fielder_names(F.col("w.fielders")),
        "has_review": F.when(_present("d.review") | _present("d.reviews"), 1).otherwise(0),
        "has_replacements": F.when(_present("d.replacements"), 1).otherwise(0),
    }
    columns = [
        (values[name] if name in values else F.col(name)).cast(kind).alias(name) for name, kind in DELIVERY_COLUMNS
    ]
    place = F.col("i_no") * F.lit(10**12) + F.col("o_no") * F.lit(10**6) + F.col("d_no")
    return balls.filter(F.col("d").isNotNull()).select(*columns, place.cast("bigint").alias("row_seq"))


def source_counters(files: DataFrame, selected: DataFrame, rows: DataFrame) -> DataFrame:
    """Per source folder: files found, selected, skipped and duplicate, and rows written."""
    parts = (
        files.select("source_folder", F.lit("found").alias("k"), F.lit(1).alias("n"))
        .unionByName(quarantined(files).select("source_folder", F.lit("skipped").alias("k"), F.lit(1).alias("n")))
        .unionByName(selected.select("source_folder", F.lit("selected").alias("k"), F.lit(1).alias("n")))
        .unionByName(rows.select("source_folder", F.lit("rows").alias("k"), F.lit(1).alias("n")))
    )

    def total(kind: str) -> Column:
        return F.sum(F.when(F.col("k") == kind, F.col("n")).otherwise(0))

    return parts.groupBy("source_folder").agg(
        total("found").alias("json_files_found"),
        total("selected").alias("selected_match_files"),
        total("rows").alias("rows_written"),
        total("skipped").alias("skipped_files"),
        F.greatest(total("found") - total("selected") - total("skipped"), F.lit(0)).alias("duplicate_files"),
    )


def build_deliveries(spark: SparkSession, root: str) -> DataFrame:
    """Files to delivery rows; duplicates go before the arrays are exploded."""
    return flatten(latest_revisions(with_identity(readable(read_matches(spark, root)))))


def dataset_manifest(files: DataFrame, selected: DataFrame, rows: DataFrame, errors_listed: int | None = None) -> DataFrame:
    """The one-row manifest of a build; it lists every malformed file, or the first ``errors_listed`` by path."""
    from wicketlake.operators.aggregates import dataset_profile

    one = F.lit(1).alias("_k")
    headers = selected.select(
        match_date("info.dates").alias("date"),
        *[clean_text(f"info.{c}").alias(c) for c in ("season", "venue", "match_type", "gender", "team_type")],
        clean_text("meta.data_version").alias("data_version"),
    )

    def names(c: str) -> Column:
        return F.array_sort(F.collect_set(F.nullif(c, F.lit("")))).alias(c + "s")

    def filled(c: str) -> Column:
        return F.nullif(c, F.lit(""))

    about = headers.agg(
        F.count(F.lit(1)).alias("files_selected"),
        F.coalesce(F.min(filled("date")), F.lit("")).alias("min_date"),
        F.coalesce(F.max(filled("date")), F.lit("")).alias("max_date"),
        F.count_distinct(filled("season")).alias("distinct_seasons"),
        F.count_distinct(filled("venue")).alias("distinct_venues"),
        names("match_type"),
        names("gender"),
        names("team_type"),
    ).withColumn("_k", F.lit(1))
    versions = (
        headers.filter("data_version != ''").groupBy("data_version").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("data_version", "n")))).alias("data_versions"))
        .withColumn("_k", F.lit(1))
    )
    profile = dataset_profile(rows).select(
        one, "rows_written", "matches_with_rows", "deliveries_with_wickets", "deliveries_with_reviews",
        "deliveries_with_replacements",
    )
    per_source = source_counters(files, selected, rows)
    sources = per_source.agg(
        F.sum("json_files_found").alias("files_discovered"),
        F.sum("skipped_files").alias("files_skipped"),
        F.sum("duplicate_files").alias("duplicate_files"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("source_folder", F.struct(*per_source.columns[1:]).alias("counts"))))
        ).alias("per_source"),
    ).withColumn("_k", F.lit(1))
    listed = quarantined(files).select("path", "error")
    if errors_listed is not None:
        listed = listed.orderBy("path").limit(errors_listed)
    errors = (
        listed.agg(F.array_sort(F.collect_list(F.struct("path", "error"))).alias("errors"))
        .withColumn("_k", F.lit(1))
    )
    out = about.join(versions, "_k").join(profile, "_k").join(sources, "_k").join(errors, "_k").drop("_k")
    return out.withColumn("matches_without_rows", F.col("files_selected") - F.col("matches_with_rows"))


def write_deliveries(rows: DataFrame, path: str) -> None:
    """Partitioned by season, ordered inside files by source and match.

    A season may hold most of the rows, so rows spread by season and match, not by season alone.
    """
    (
        rows.repartition("season", "match_id")
        .sortWithinPartitions("season", "source_folder", "match_id", "row_seq")
        .write.partitionBy("season")
        .parquet(path)
    )


def read_deliveries(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """The stored delivery table; rows without a match id are dropped."""
    reader = spark.read.schema(DELIVERY_DDL + (", row_seq bigint" if kind == "parquet" else ""))
    stored = reader.option("header", True).csv(path) if kind == "csv" else reader.parquet(path)
    return stored.filter(F.trim("match_id") != "")
