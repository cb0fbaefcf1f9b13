"""Bars: reading, column names, times, contract, cleaning, sinks and indices of what is stored."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.joins import counted

# Raw column names and the names that take their place, and other names a column may come under.
RENAMES = {"timestamp_utc": "time_utc", "tick_volume": "volume", "spread_points": "spread"}
CANDIDATES = {
    "symbol": ("symbol", "ticker", "sym"),
    "time_utc": ("time_utc", "timestamp_utc", "time", "timestamp", "datetime", "date"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c"),
    "volume": ("volume", "vol", "tick_volume", "v"),
    "spread": ("spread", "spread_points"),
}
OPTIONAL = ("volume", "spread")
BAR_COLUMNS = ["symbol", "time_utc", "open", "high", "low", "close", "volume", "spread"]
CONTRACT = T.StructType([
    T.StructField("timestamp_utc", T.LongType()), T.StructField("timestamp_local", T.TimestampNTZType()), T.StructField("symbol", T.StringType()),
    T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()),
    T.StructField("tick_volume", T.LongType()), T.StructField("real_volume", T.LongType()), T.StructField("spread_points", T.DoubleType()),
    T.StructField("broker", T.StringType()), T.StructField("server_tz", T.StringType()),
])


def build_bars(ticks: DataFrame, width: str) -> DataFrame:
    """Ticks (symbol, time_utc, price, seq) as bars of that width; empty slots have no row."""
    at = F.struct("time_utc", "seq")
    rows = ticks.groupBy("symbol", F.window("time_utc", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
        (F.round(F.max("price") - F.min("price"), 6) / 10).alias("spread"),
    )
    return rows.select("symbol", F.col("w.start").alias("time_utc"), "open", "high", "low", "close", "volume", "spread")


def rename_columns(df: DataFrame, names: Mapping[str, str] = RENAMES) -> DataFrame:
    """Raw names replaced, unless the new name is there already."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns and new not in df.columns})


def resolve_columns(df: DataFrame, candidates: Mapping[str, Sequence[str]] = CANDIDATES, optional: Sequence[str] = OPTIONAL) -> DataFrame:
    """The first column that goes by any of a name's candidates, whatever its case; an optional one that is missing becomes 0.0."""
    have = {c.lower(): c for c in reversed(df.columns)}
    out = []
    for name, options in candidates.items():
        found = next((have[o] for o in options if o in have), None)
        if found is None and name not in optional:
            raise ValueError(f"no column for {name}: looked for {', '.join(options)}")
        out.append(F.lit(0.0).alias(name) if found is None else F.col(f"`{found}`").alias(name))
    return df.select(out)


def epoch_to_timestamp(epoch: Column) -> Column:
    """Whole seconds, milliseconds, microseconds or nanoseconds since 1970, told apart row by row by magnitude."""
    size = F.abs(epoch)
    return (
        F.when(size > 10**17, F.timestamp_micros(F.expr("bigint(0)") + F.floor(epoch / 1000)))
        .when(size > 10**14, F.timestamp_micros(epoch))
        .when(size > 10**11, F.timestamp_millis(epoch))
        .otherwise(F.timestamp_seconds(epoch))
    )


def canonical_time(df: DataFrame, column: str = "time_utc") -> DataFrame:
    kind = dict(df.dtypes)[column]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return df.withColumn(column, F.col(column).cast("timestamp"))
    if kind == "string":
        return df.withColumn(column, F.try_to_timestamp(F.col(column)))
    return df.withColumn(column, epoch_to_timestamp(F.col(column).cast("bigint")))


def dedup(df: DataFrame, keys: Sequence[str] = ("symbol", "time_utc"), order: Sequence[str] = ("ingest_seq",), keep: str = "last") -> DataFrame:
    """One row a key: the last (or first) in an explicit order."""
    by = [F.col(c).desc_nulls_last() if keep == "last" else F.col(c).asc_nulls_last() for c in order]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_rn = 1").drop("_rn")


def normalise(df: DataFrame, symbols: Sequence[str] | None = None, order: Sequence[str] | None = None, keep: str = "last") -> DataFrame:
    """Names, times, upper-case symbols, symbol filter, one row a key. Without an order, equal keys are told apart by all columns."""
    rows = canonical_time(rename_columns(df)).withColumn("symbol", F.upper(F.trim("symbol")))
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin([s.strip().upper() for s in symbols]))
    order = order or [c for c in rows.columns if c not in ("symbol", "time_utc")]
    return dedup(rows, order=order, keep=keep)


def load_bars(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Bars from Parquet files."""
    return normalise(spark.read.parquet(path), symbols, order)


load_features = load_bars


def load_partitioned(spark: SparkSession, base: str, symbols: Sequence[str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Bars of a store, or from folders symbol=S/year=Y/month=M; only the folders of the symbols asked for are read."""
    rows = spark.read.option("basePath", base).parquet(base) if last_manifest(spark, base) is None else read_store(spark, base)
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin([s.strip().upper() for s in symbols]))
    return normalise(rows.drop("year", "month"), None, order)


def project_source(df: DataFrame, zone: str, broker: str | None = None) -> DataFrame:
    """Source bars (time in seconds) in the contract's types: milliseconds, local time, constants."""
    at = F.timestamp_seconds(F.col("time"))
    return df.select(
        (F.col("time") * 1000).cast("long").alias("timestamp_utc"), F.from_utc_timestamp(at, zone).cast("timestamp_ntz").alias("timestamp_local"), "symbol",
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], F.col("tick_volume").cast("long").alias("tick_volume"), F.lit(None).cast("long").alias("real_volume"),
        F.col("spread").cast("double").alias("spread_points"), F.lit(broker).cast("string").alias("broker"), F.lit(zone).alias("server_tz"),
    )


def enforce_contract(df: DataFrame, schema: T.StructType = CONTRACT) -> DataFrame:
    """Columns of the contract in its order; missing ones as typed nulls; others follow in name order."""
    own = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*own, *sorted(set(df.columns) - set(schema.names)))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def to_number(column: str, kind: str = "double") -> Column:
    """A cast that gives null where it fails, and null for NaN."""
    x = F.col(column).try_cast(kind)
    return F.when(~F.isnan(x), x) if kind in ("double", "float") else x


PRICES = ("open", "high", "low", "close")


def clean_bars(df: DataFrame, order: Sequence[str] = ("ingest_seq",), keep: str = "last") -> DataFrame:
    """Bars under raw names: numbers cast or null, rows without key or price dropped, low <= high, one row a key."""
    rows = df.withColumns({c: to_number(c) for c in (*PRICES, "spread_points")} | {"timestamp_utc": to_number("timestamp_utc", "bigint"), "tick_volume": to_number("tick_volume", "bigint")})
    rows = rows.dropna(subset=["symbol", "timestamp_utc", *PRICES]).where("low <= high")
    return dedup(rows, ("symbol", "timestamp_utc"), order, keep).withColumn("spread_points", F.col("spread_points").cast("float"))


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    place, files = _files(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(place)) if files.exists(place) else []


def last_manifest(spark: SparkSession, path: str) -> int | None:
    """Number of a store's current manifest; null: there is no store."""
    found = [int(name[2:]) for name in _names(spark, f"{path}/manifest") if name.startswith("n=")]
    return max(found, default=None)


def _manifest(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema("symbol string, year int, month int, version string").parquet(f"{path}/manifest/n={number}")


def _publish(spark: SparkSession, rows: DataFrame, path: str, number: int) -> None:
    """Write a manifest beside the others and give it its number by one rename: readers see all of a change or nothing of it."""
    draft = f"{path}/manifest/draft-{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(draft)
    end, files = _files(spark, f"{path}/manifest/n={number}")
    if files.exists(end) or not files.rename(_files(spark, draft)[0], end):
        raise RuntimeError(f"manifest {number} was published by another writer")


def read_store(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A store's bars with year and month, as its last manifest (or one of that number) lists them: each month in one version."""
    number = last_manifest(spark, path) if number is None else number
    if number is None:
        raise ValueError(f"no bars are stored in {path}")
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    rows = rows.withColumns({"symbol": F.col("symbol").cast("string"), "version": F.col("version").cast("string")})
    listed = _manifest(spark, path, number).select(*(F.col(c).alias(f"_{c}") for c in ("symbol", "year", "month", "version")))
    same = [rows[c].eqNullSafe(F.col(f"_{c}")) for c in ("symbol", "year", "month", "version")]
    return rows.join(counted(listed), same, "left_semi").drop("version")


def write_bars(df: DataFrame, path: str, force_days: DataFrame | None = None) -> None:
    """Bars under data/version=/symbol=/year=/month=. Days that are stored stay, unless forced; then their month is written anew.

    A write adds a version that holds the months it touches, and then a manifest that names the version of every month. A write that
    ends before its manifest has its number leaves the store as it was; its files belong to no manifest. Of two writers at once the second fails.
    """
    spark, number, version = df.sparkSession, last_manifest(df.sparkSession, path), uuid.uuid4().hex
    rows = df.withColumns({"day": F.to_date("time_utc"), "year": F.year("time_utc"), "month": F.month("time_utc")})
    out = rows
    if number is not None:
        kept = read_store(spark, path, number).select(*df.columns, "year", "month").withColumn("day", F.to_date("time_utc"))
        have = kept.select("symbol", "day").distinct()
        if force_days is not None:
            forced = force_days.select("symbol", "day").distinct()
            kept = kept.join(forced, ["symbol", "day"], "left_anti")
            have = have.join(forced, ["symbol", "day"], "left_anti")
        new = rows.join(have, ["symbol", "day"], "left_anti")
        touched = new.select("symbol", "year", "month").distinct()
        out = kept.join(touched, ["symbol", "year", "month"], "left_semi").select(*rows.columns).unionByName(new.select(*rows.columns))
    place = f"{path}/data/version={version}"
    out.drop("day").repartition("symbol", "year", "month").sortWithinPartitions("symbol", "time_utc").write.partitionBy("symbol", "year", "month").option("compression", "zstd").parquet(place)
    if not any(name.startswith("symbol=") for name in _names(spark, place)):
        if number is None:
            raise ValueError("no bars to store")
        return
    months = spark.read.parquet(place).select(F.col("symbol").cast("string").alias("symbol"), F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month")).distinct().withColumn("version", F.lit(version))
    if number is not None:
        before = _manifest(spark, path, number)
        own = months.select(*(F.col(c).alias(f"_{c}") for c in ("symbol", "year", "month")))
        same = [before[c].eqNullSafe(own[f"_{c}"]) for c in ("symbol", "year", "month")]
        months = before.join(own.hint("shuffle_merge"), same, "left_anti").unionByName(months)
    _publish(spark, months, path, (number or 0) + 1)


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the versions that none of the last manifests names, those of broken writes included, and older manifests. Not beside a running write."""
    number = last_manifest(spark, path) or 0
    last = [n for n in range(max(1, number - keep + 1), number + 1)]
    named = {f"version={r.version}" for n in last for r in _manifest(spark, path, n).select("version").distinct().collect()}
    gone = [f"data/{x}" for x in _names(spark, f"{path}/data") if x.startswith("version=") and x not in named]
    gone += [f"manifest/{x}" for x in _names(spark, f"{path}/manifest") if x.startswith("draft-") or x.startswith("n=") and int(x[2:]) not in last]
    for name in gone:
        place, files = _files(spark, f"{path}/{name}")
        files.delete(place, True)
    return gone


def run_log(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """A run's rows of a log of JSON lines; path is dst where there is one."""
    return spark.read.json(path).where(F.col("run_id") == run_id).withColumn("path", F.coalesce("dst", "path"))


def symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file of symbols, one a line: trimmed, upper-cased, blanks and repeats dropped."""
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("symbol")).where("symbol <> ''").distinct()


def snapshot_json(df: DataFrame) -> DataFrame:
    """Each row as JSON: NaN as null, times in ISO form, nulls written."""
    cleaned = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    return df.select(cleaned).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def fingerprints(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Path, size and SHA-256 of data files, each hashed where it is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def changed_files(now: DataFrame, log: DataFrame) -> DataFrame:
    """Files whose digest is not that of their last record (path, logged_at, sha256)."""
    last = log.groupBy("path").agg(F.max_by("sha256", "logged_at").alias("before"))
    return now.join(last, "path", "left").withColumn("status", F.when(F.col("before").isNull(), "NEW").when(F.col("before") == F.col("sha256"), "SAME").otherwise("CHANGED"))


def instrument_snapshot(quotes: DataFrame, run_id: str, taken_at: Column) -> DataFrame:
    """Instruments in typed columns with the run's constants."""
    return quotes.select("symbol", "path", "description", F.col("bid").cast("double"), F.col("ask").cast("double"), F.col("contract_size").cast("double"), F.col("visible").cast("boolean"), F.col("trade_mode").cast("int"), F.lit(run_id).alias("run_id"), taken_at.alias("taken_at"))


def upsert(catalog: DataFrame, rows: DataFrame, key: str = "symbol") -> DataFrame:
    """The catalog with the rows of these keys replaced."""
    return catalog.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def by_priority(layers: Sequence[DataFrame], keys: Sequence[str] = ("symbol", "day")) -> DataFrame:
    """For each key all rows of the first layer that has it."""
    union = None
    for k, layer in enumerate(layers):
        one = layer.withColumn("layer", F.lit(k))
        union = one if union is None else union.unionByName(one, allowMissingColumns=True)
    return union.withColumn("_best", F.min("layer").over(Window.partitionBy(*keys))).where("layer = _best").drop("_best")


def work_list(present: DataFrame, symbols: DataFrame, until: Column, reprocess: DataFrame | None = None) -> DataFrame:
    """Days to fetch (symbol, day, reason): gaps, days since the last one, and days to be done again, where symbol * stands for all; none after `until`."""
    spans = present.groupBy("symbol").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    wanted = spans.select("symbol", "last", F.explode(F.sequence("first", F.greatest(until, F.col("first")))).alias("day"))
    missing = wanted.join(present.select("symbol", "day").distinct().hint("shuffle_merge"), ["symbol", "day"], "left_anti").where(F.col("day") <= until)
    out = missing.select("symbol", "day", F.when(F.col("day") > F.col("last"), "TAIL").otherwise("GAP").alias("reason"))
    if reprocess is not None:
        named = reprocess.where("symbol <> '*'").select("symbol", "day")
        # One row with the days that all symbols do again.
        days = reprocess.where("symbol = '*'").agg(F.collect_set("day").alias("days"))
        stars = symbols.select("symbol").distinct().join(F.broadcast(days)).select("symbol", F.explode("days").alias("day"))
        again = named.unionByName(stars.select("symbol", "day")).where(F.col("day") <= until).distinct().withColumn("reason", F.lit("REPROCESS"))
        out = out.unionByName(again)
    return out.groupBy("symbol", "day").agg(F.max("reason").alias("reason"))


def daily_close(bars: DataFrame) -> DataFrame:
    """Last close of each UTC day, and the return from the day before it."""
    rows = bars.groupBy("symbol", F.to_date("time_utc").alias("day")).agg(F.max_by("close", "time_utc").alias("close"))
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("day"))
    return rows.withColumn("ret", F.try_divide(F.col("close"), before) - 1)


def trailing_windows(gold: DataFrame, raw: DataFrame, last_day: Column, sizes: Sequence[int] = (30, 90, 180)) -> DataFrame:
    """Bars of the trailing windows of so many days up to last_day: gold rows, and raw ones for days that gold lacks."""
    g, r = (x.withColumn("day", F.to_date("time_utc")) for x in (gold, raw))
    rows = g.withColumn("layer", F.lit("gold")).unionByName(r.join(g.select("symbol", "day").distinct(), ["symbol", "day"], "left_anti").withColumn("layer", F.lit("raw")), allowMissingColumns=True)
    member = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: (F.col("day") > F.date_sub(last_day, n)) & (F.col("day") <= last_day))
    return rows.withColumn("window_days", F.explode(member))
