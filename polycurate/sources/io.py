"""Reading and writing: CSV at the edges, Parquet between stages."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence
from hashlib import md5
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import text as T
from .scratch import delete_path, settled

QA = StructType([StructField(c, StringType()) for c in ("ID", "input", "output", "subset")])
DIAGNOSTIC = StructType([
    *QA.fields,
    *[StructField(c, StringType()) for c in ("q_script", "a_script", "expected_script")],
    *[StructField(c, BooleanType()) for c in ("q_script_ok", "a_script_ok")],
    StructField("q_lang", StringType()), StructField("q_lang_conf", DoubleType()),
    StructField("a_lang", StringType()), StructField("a_lang_conf", DoubleType()),
    *[StructField(c, BooleanType()) for c in ("q_lang_ok", "a_lang_ok")],
    *[StructField(c, IntegerType()) for c in ("q_tokens", "a_tokens")],
    *[StructField(c, DoubleType()) for c in ("a_repetition", "qa_cos")],
])
#: What a CSV cell may hold for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
REQUIRED = ("input", "output", "subset")
#: The folder of partitions' marks, which readers skip; how Spark names the partition of a null.
MARKS, NO_VALUE = "_finished", "__HIVE_DEFAULT_PARTITION__"
SYNTHETIC_SUBSETS = ("Aka_Gha", "Amh_Eth", "Lug_Uga", "Swa_Eas", "Eng")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def without_missing(df: DataFrame) -> DataFrame:
    """Strings that stand for a missing value become null."""
    return df.select([F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    return without_missing((reader.schema(schema) if schema else reader).csv(path))


def read_present(spark: SparkSession, paths: list[str], schema: StructType | None = None) -> tuple[DataFrame | None, list[str]]:
    """(union of the files that exist, the paths that do not)."""
    present = [p for p in paths if exists(spark, p)]
    frames = [read_csv(spark, p, schema) for p in present]
    union = None
    for f in frames:
        union = f if union is None else union.unionByName(f, allowMissingColumns=True)
    return union, [p for p in paths if p not in present]


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    if lacking := missing_columns(df, required):
        raise ValueError(f"columns {lacking} are missing; there are {df.columns}")
    return df


def _header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV file, from its first line; compressed files are opened as Spark would."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    raw = target.getFileSystem(conf).open(target)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(target)
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(raw) if codec else raw, "UTF-8")).readLine()
    finally:
        raw.close()
    return next(csv.reader([line.lstrip("\ufeff")])) if line else []


def _one_scan(spark: SparkSession, headers: dict[str, list[str]]) -> DataFrame:
    """(file, input, output, subset, source, more) of all files in one scan for each kind of header; more: the row has more fields than the header."""
    kinds: dict[tuple[str, ...], list[str]] = {}
    for path, names in headers.items():
        kinds.setdefault(tuple(names), []).append(path)
    union = None
    for names, paths in kinds.items():
        unique = [n if names.index(n) == i else f"{n}.{i}" for i, n in enumerate(names)]
        schema = StructType([StructField(n, StringType()) for n in [*unique, "_more"]])
        rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("columnPruning", False).csv(paths)
        file = F.col("_metadata.file_path")
        stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.csv", 1)
        rows = without_missing(rows.select(file.alias("file"), *REQUIRED, (F.coalesce("source", stem) if "source" in names else stem).alias("source"), F.col("_more").isNotNull().alias("more")))
        union = rows if union is None else union.unionByName(rows)
    return union


def _scanned(spark: SparkSession, headers: dict[str, list[str]]) -> tuple[list[DataFrame], dict[str, str]]:
    """(the rows of all files, written; what cannot be read). One job if every file can be read; else the files are halved until those that cannot stand alone."""
    try:
        return [settled(_one_scan(spark, headers), "external")], {}
    except Exception as error:  # noqa: BLE001  whatever a file does, the others are read
        if len(headers) == 1:
            return [], {next(iter(headers)): f"cannot be read: {type(error).__name__}"}
    names = list(headers)
    halves = [_scanned(spark, {n: headers[n] for n in part}) for part in (names[: len(names) // 2], names[len(names) // 2 :])]
    return halves[0][0] + halves[1][0], halves[0][1] | halves[1][1]


def read_external(spark: SparkSession, folder: str) -> tuple[DataFrame | None, dict[str, str]]:
    """(clean rows of all CSV files of a folder; what is wrong with the others).

    Headers are looked at first. The files that have the columns are then read by one scan and written once; a file that cannot be
    read to its end, or has a row of more fields than its header, is left out and reported. Each row's source is its own or its file's name.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.csv*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    headers, wrong = {}, {}
    for name in sorted(str(x.getPath()) for x in found):
        try:
            names = _header(spark, name)
        except Exception as error:  # noqa: BLE001
            wrong[name] = f"cannot be read: {type(error).__name__}"
            continue
        if lacking := [c for c in REQUIRED if c not in names]:
            wrong[name] = f"lacks {', '.join(lacking)}"
        else:
            headers[name] = names
    if not headers:
        return None, wrong
    parts, unread = _scanned(spark, headers)
    wrong |= unread
    if not parts:
        return None, dict(sorted(wrong.items()))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    torn = [r.file for r in rows.filter("more").select("file").distinct().collect()]  # names of files, of which the driver has a list anyway
    plain = {unquote(n).split(":", 1)[-1].lstrip("/"): n for n in headers}
    wrong |= {plain.get(unquote(f).split(":", 1)[-1].lstrip("/"), f): "has rows of more fields than its header" for f in torn}
    rows = rows.filter(~F.col("file").isin(*torn)) if torn else rows
    return clean_rows(rows.select(*REQUIRED, "source"), REQUIRED), dict(sorted(wrong.items()))


def clean_rows(df: DataFrame, keys: tuple[str, ...] = ("input", "output", "subset")) -> DataFrame:
    """Without rows whose keys are null or blank; keys stripped."""
    df = df.dropna(subset=list(keys))
    df = df.withColumns({k: T.strip(F.col(k).cast("string")) for k in keys})
    for k in keys:
        df = df.filter(F.col(k) != "")
    return df


def clean_counts(df: DataFrame, keys: tuple[str, ...] = ("input", "output", "subset")) -> DataFrame:
    """One row: how many rows `clean_rows` is given, keeps and drops."""
    filled = F.lit(True)
    for k in keys:
        filled = filled & F.coalesce(T.strip(F.col(k).cast("string")) != "", F.lit(False))
    return df.agg(F.count("*").alias("n"), F.count_if(filled).alias("kept"), F.count_if(~filled).alias("dropped"))


def written_clean(df: DataFrame, path: str, keys: tuple[str, ...] = ("input", "output", "subset")) -> tuple[DataFrame, dict[str, int]]:
    """(clean rows, read back from path; how many rows were given, kept and dropped). The writing job counts as it goes."""
    seen, kept = Observation("given"), Observation("kept")
    rows = clean_rows(df.observe(seen, F.count(F.lit(1)).alias("n")), keys).observe(kept, F.count(F.lit(1)).alias("kept"))
    rows.write.mode("overwrite").parquet(path)
    counts = seen.get | kept.get
    return df.sparkSession.read.schema(rows.schema).parquet(path), counts | {"dropped": counts["n"] - counts["kept"]}


def synthetic_rows(spark: SparkSession, split: str, n: int = 500) -> DataFrame:
    """Placeholder rows, the languages in turn."""
    i = F.col("id")
    tag = F.element_at(F.array(*[F.lit(s) for s in SYNTHETIC_SUBSETS]), (i % len(SYNTHETIC_SUBSETS) + 1).cast("int"))
    return spark.range(n).select(
        F.format_string(f"{split}_%06d", i).alias("ID"),
        F.concat(F.lit("Sample question "), i.cast("string"), F.lit(" in "), tag).alias("input"),
        F.concat(F.lit("Sample answer "), i.cast("string")).alias("output"),
        tag.alias("subset"),
    )


def parameter_table(spark: SparkSession, default: dict, overrides: dict[str, dict], key: str = "subset") -> DataFrame:
    """One row per key: the defaults with each key's own entries over them (entries replace whole values)."""
    rows = [{key: k} | default | own for k, own in overrides.items()]
    names = [key, *dict.fromkeys(n for r in rows for n in r if n != key)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], names)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json_report(report: DataFrame, path: str) -> None:
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_with_provenance(df: DataFrame, path: str, columns: tuple[str, ...] = ("input", "output", "subset")) -> None:
    """The training columns, and beside them the rows with all columns."""
    df.write.mode("overwrite").parquet(f"{path}/provenance")
    df.sparkSession.read.parquet(f"{path}/provenance").select(*columns).write.mode("overwrite").parquet(f"{path}/training")


def _folder(spark: SparkSession, path: str):
    """(Hadoop's path, its file system)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders_of(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder; none where it does not exist."""
    target, files = _folder(spark, path)
    return sorted(str(x.getPath()) for x in files.listStatus(target) if x.isDirectory()) if files.exists(target) else []


def _partitions(spark: SparkSession, path: str, key: str) -> dict[str, str]:
    """The partitions that a folder has: value of key -> name."""
    target, files = _folder(spark, path)
    names = [x.getPath().getName() for x in files.listStatus(target)] if files.exists(target) else []
    return {unquote(n.split("=", 1)[1]): n for n in names if n.startswith(f"{key}=")}


def finished_partitions(spark: SparkSession, path: str, key: str = "subset") -> list[str]:
    """Values of key whose partitions have their mark."""
    return sorted(_partitions(spark, f"{path}/{MARKS}", key))


def write_missing_partitions(rows: DataFrame | Callable[[str], DataFrame], path: str, key: str = "subset", values: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Writes the partitions of key that path has not finished; returns the values of those that it had.

    A partition is finished when its mark lies beside it, which is put there after the job that wrote it. Folders without a mark are
    what a failed job left; they are removed and made again. With `values`, rows is a function of one of them and each is a job of its
    own, so those that have ended stay when a later one fails; a value without rows is finished too.
    """
    spark = spark or rows.sparkSession
    had = finished_partitions(spark, path, key)
    for value, name in _partitions(spark, path, key).items():
        if value not in had:
            delete_path(spark, f"{path}/{name}")
    target, files = _folder(spark, path)
    files.mkdirs(target)

    def finish(df: DataFrame, *own: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
        names = {v: f"{key}={quote(v, safe='')}" for v in own} or _partitions(spark, path, key)
        for value, name in names.items():
            if value not in had:
                mark, there = _folder(spark, f"{path}/{MARKS}/{name}")
                there.create(mark, True).close()

    if values is None:
        value = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(NO_VALUE))
        finish(rows.filter(~value.isin(*had)) if had else rows)
    else:
        for v in values:
            if v not in had:
                finish(rows(v).filter(F.col(key) == v), v)
    return had


def unless_written(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, made first where it does not exist."""
    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def write_embeddings(df: DataFrame, path: str, key: str, vectors: dict[str, Column]) -> DataFrame:
    df.select(key, *[v.cast("array<float>").alias(n) for n, v in vectors.items()]).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def cached_embeddings(df: DataFrame, folder: str, key: str, vectors: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """key and vectors as a table in folder, dealt into buckets by key and sorted in them; made from df only where folder lacks it.

    Joins on key read it where it lies: no exchange stands above its scan. A later session registers the files that are there.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{folder.rstrip('/')}/{buckets}-by-{key}"
    name = f"polycurate_cache_{md5(path.encode()).hexdigest()}"
    if exists(spark, f"{path}/_SUCCESS"):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"create table if not exists {name} ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets location '{path}'")
    else:
        rows = df.select(key, *[v.cast("array<float>").alias(n) for n, v in vectors.items()]).repartition(buckets, key)
        spark.sql(f"drop table if exists {name}")
        rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


def with_cached(rows: DataFrame, cached: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows with the columns of a cache; only rows are dealt out, by the cache's buckets."""
    return rows.join(cached.hint("merge"), key, how)


def tokenised(df: DataFrame, tokenizer_path: str, prompt: str = "prompt", target: str = "output", max_prompt: int = 256, max_target: int = 384) -> DataFrame:
    """df with input_ids and labels: token ids of two texts, cut to their greatest lengths. Each worker loads the tokenizer once."""

    def encode(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        for frame in batches:
            ids = lambda column, most: [e.ids[:most] for e in tokenizer.encode_batch(frame[column].fillna("").tolist())]  # noqa: B023, E731
            yield frame.assign(input_ids=ids(prompt, max_prompt), labels=ids(target, max_target))

    kinds = [StructField(n, ArrayType(IntegerType())) for n in ("input_ids", "labels")]
    return df.mapInPandas(encode, StructType([*df.schema.fields, *kinds]))


def training_export(examples: DataFrame, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """Examples with neither inputs nor labels empty."""
    return examples.filter((F.size(ids) > 0) & (F.size(labels) > 0))


def submission(predictions: DataFrame) -> DataFrame:
    p = F.col("prediction")
    return predictions.select("ID", p.alias("TargetRLF1"), p.alias("TargetR1F1"), p.alias("TargetLLM"))


def write_submission(predictions: DataFrame, path: str) -> None:
    write_csv(submission(predictions), path)
