"""Sources and sinks: recordings, models, parameters and outputs as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUTS = ("array", "wide", "long")


def read_recordings(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """signal(recording_id, source, sample_idx, channels) from a Parquet table.

    layout: "array" holds channels as one array, "wide" as columns ch0, ch1, ..., "long"
    as rows (channel, value). Unknown layouts raise ValueError.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; one of {', '.join(LAYOUTS)}")
    df = spark.read.parquet(path)
    return {"array": lambda d: d, "wide": from_wide, "long": from_long}[layout](df)


#: Tables of a data set beside the signal, with the columns that each must have.
TABLES = {
    "recordings": ("recording_id", "fs"),
    "profile": ("recording_id", "sample_idx", "t"),
    "spikes": ("recording_id", "source", "unit", "sample_idx"),
}


def write_dataset(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Write signal, recordings, profile and spikes (those given) where read_dataset finds them."""
    unknown = set(tables) - {"signal", *TABLES}
    if unknown:
        raise ValueError(f"unknown tables {', '.join(sorted(unknown))}")
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def read_dataset(spark: SparkSession, path: str, layout: str = "array") -> dict[str, DataFrame]:
    """Tables of a folder of recordings: the signal (in any layout), and of the others those that are there.

    recordings holds the metadata (fs, ext_fact, channel map, bad channels, further arrays by name), profile
    the tasks' courses (t, angle, force), spikes the ground truth (source "gt").
    """
    out = {"signal": read_recordings(spark, f"{path}/signal", layout)}
    for name, columns in TABLES.items():
        df = _there(spark, f"{path}/{name}")
        if df is None:
            continue
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"table {name} lacks {', '.join(missing)}")
        out[name] = df
    return out


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path, None where there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def from_wide(df: DataFrame, prefix: str = "ch") -> DataFrame:
    names = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.array(*[F.col(c).cast("double") for c in names]).alias("channels"))


def from_long(df: DataFrame) -> DataFrame:
    keys = [c for c in df.columns if c not in ("channel", "value")]
    pairs = F.array_sort(F.collect_list(F.struct("channel", F.col("value").cast("double").alias("value"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["value"]).alias("channels"))


def transpose(df: DataFrame, by: list[str], row: str, values: str) -> DataFrame:
    """Matrix rows (row, values) of each group turned into its columns (row_idx, values)."""
    cells = df.select(*by, row, F.posexplode(values).alias("row_idx", "v"))
    cell = F.array_sort(F.collect_list(F.struct(F.col(row).alias("at"), "v")))
    return cells.groupBy(*by, "row_idx").agg(F.transform(cell, lambda c: c["v"]).alias("values"))


def read_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of calibrated models from Parquet with a row for each recording.

    Its columns: recording_id, WH (matrix rows), BRT (a row for each whitened dimension),
    N_CENT, SIG_CENT, EXT_FACT, EMG (a row for each channel), IPTs (a row for each unit)
    and firings (sample numbers of each unit, counted from 1). Results: recordings,
    model_whitening, model_units, and the calibration's signal, ipts and spikes.
    """
    df = spark.read.parquet(path)
    key = F.col("recording_id")

    def turned(matrix: str, row: str, out: str) -> DataFrame:
        rows = df.select(key, F.posexplode(matrix).alias("at", "values"))
        return transpose(rows, ["recording_id"], "at", "values").select(key, F.col("row_idx").alias(row), F.col("values").alias(out))

    units = turned("BRT", "unit", "w").join(df.select(key, "N_CENT", "SIG_CENT"), "recording_id")
    centre = lambda name: F.get(F.col(name), F.col("unit"))
    units = units.select(key, F.lit(0).cast("long").alias("version"), "unit", "w", centre("N_CENT").alias("base_centr"), centre("SIG_CENT").alias("spikes_centr"))
    ipts = df.select(key, F.posexplode("IPTs").alias("unit", "row")).select(key, "unit", F.posexplode("row").alias("sample_idx", "ipt"))
    firings = df.select(key, F.posexplode("firings").alias("unit", "firings"))
    long = lambda t: t.withColumn("sample_idx", F.col("sample_idx").cast("long"))
    return {
        "recordings": df.select(key, F.col("EXT_FACT").cast("int").alias("ext_fact")),
        "model_whitening": df.select(key, F.lit(0).cast("long").alias("version"), F.posexplode("WH").alias("row_idx", "w")),
        "model_units": units.withColumn("height", F.col("spikes_centr") - (F.col("spikes_centr") - F.col("base_centr")) / 2),
        "signal": long(turned("EMG", "sample_idx", "channels")).withColumn("source", F.lit("calib")),
        "ipts": long(ipts).withColumn("run_id", F.lit("calib")),
        "spikes": long(firings_to_spikes(firings, one_based=True)).withColumn("source", F.lit("calib")),
    }


def firings_to_spikes(df: DataFrame, one_based: bool = False) -> DataFrame:
    """Rows with an array ``firings`` -> one row for each spike, sample_idx counted from 0."""
    keys = [c for c in df.columns if c != "firings"]
    return df.select(*keys, F.explode(F.transform("firings", lambda i: i - int(one_based))).alias("sample_idx"))


def spikes_to_firings(spikes: DataFrame) -> DataFrame:
    keys = [c for c in spikes.columns if c != "sample_idx"]
    return spikes.groupBy(*keys).agg(F.sort_array(F.collect_list("sample_idx")).alias("firings"))


# Parameters of the presets (name, whitening rate, separation rate, adapting or not).
PRESETS = (
    ("neuromotion", 7.0e-3, 3.0e-3, True),
    ("wrist", 1.0e-3, 5.0e-4, True),
    ("forearm", 2.0e-3, 5.0e-4, True),
    ("fixed", 0.0, 0.0, False),
)
# What the presets share.
COMMON = {
    "fs": 2048,
    "lowcut": 20.0,
    "highcut": 500.0,
    "powerline_freq": 50.0,
    "ext_fact": 10,
    "batch_ms": 100,
    "compute_loss": True,
    "sv_epochs": 1,
    "sv_tol": 1.0e-4,
    "contrast": "logcosh",
    "cov_alpha": 0.1,
    "spike_height_mult": 3,
    "spike_prev_weight": 5,
    "spike_dist_ms": 10,
}


#: Names that settings files use for parameters here.
ALIASES = {"contrast_fun": "contrast"}


def load_params(spark: SparkSession, overrides: dict | None = None, path: str | None = None) -> DataFrame:
    """One row for each preset, or the one of a YAML file of defaults; overrides applied to known names only, derived columns last."""
    rows = [{"preset": n, "wh_learning_rate": w, "sv_learning_rate": s, "adapt_wh": a, "adapt_sv": a, "adapt_sd": a} | COMMON for n, w, s, a in PRESETS]
    known = set(rows[0]) - {"preset"}
    fitting = lambda values: {ALIASES.get(k, k): v for k, v in (values or {}).items() if ALIASES.get(k, k) in known}
    if path is not None:
        rows = [rows[0] | {"preset": path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]} | fitting(_yaml(spark, path))]
    plain = lambda row: {k: type(rows[0][k])(v) for k, v in row.items()}
    return derive(spark.createDataFrame([plain(r | fitting(overrides)) for r in rows]))


def _yaml(spark: SparkSession, path: str) -> dict:
    try:
        import yaml
    except ImportError as error:
        raise ValueError("reading a settings file takes PyYAML") from error
    return yaml.safe_load(spark.read.text(path, wholetext=True).first().value) or {}


def derive(params: DataFrame) -> DataFrame:
    per_ms = lambda ms: F.floor(F.col(ms) * F.col("fs") / 1000).cast("int")
    return params.withColumns({"batch_size": per_ms("batch_ms"), "spike_dist": per_ms("spike_dist_ms")})


def write_outputs(outputs: dict[str, DataFrame], path: str, mode: str = "errorifexists", rows_per_file: int = 1 << 22, folders: bool = True) -> None:
    """One Parquet table for each output, partitioned by recording. An existing one is an error unless mode says otherwise.

    Rows are dealt by ranges of recording and place in it, so that a long recording is written by many tasks, in files of at most
    rows_per_file rows. Without ``folders`` rows lie in that order in files that short recordings share: a folder and a file for
    each of very many recordings take longer than their rows, and readers of some recordings skip the rest by the files' statistics.
    """
    for name, df in outputs.items():
        place = [c for c in ("sample_idx", "batch_idx", "version", "unit") if c in df.columns]
        rows = df.repartitionByRange("recording_id", *place)
        if not folders:
            rows = rows.sortWithinPartitions("recording_id", *place)
        writer = rows.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
        (writer.partitionBy("recording_id") if folders else writer).parquet(f"{path}/{name}")


def read_outputs(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}").withColumn("recording_id", F.col("recording_id").cast("string")) for n in names}


def append_params(df: DataFrame, path: str) -> None:
    """Append snapshots (recording_id, version, ...); those that the table has already are left out."""
    have = _there(df.sparkSession, path)
    fresh = df if have is None else df.join(have.select("recording_id", "version").distinct(), ["recording_id", "version"], "left_anti")
    fresh.write.mode("append").parquet(path)


def log_metrics(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Write metric rows and run summaries of a run, a table for each kind; a run written again replaces its rows."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/run_id={run_id}")


def write_stream(rows: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = (), **options):
    """A started query (options: of writeStream, as trigger's) that writes each trigger's rows as a table of its own, path/trigger=<number>.

    A trigger that runs again after a failure replaces its table, so that it leaves one copy; nothing that is stored is
    read, and triggers don't meet.
    """

    def commit(df: DataFrame, trigger: int) -> None:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/trigger={trigger}")

    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """All triggers' rows of write_stream, without the trigger's number."""
    return spark.read.schema(schema).parquet(path)
