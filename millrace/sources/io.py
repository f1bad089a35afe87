"""Readers, source mixes and sinks."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from ..operators import sampling

#: The fields of annotation, question and detection rows.
ANNOTATION = "object_id string, conversations array<struct<from:string,value:string>>, conversation_type string, meta struct<original_object_id:string,qa_type:string,node_id:string,node_name:string>"
QA_ITEM = "qa_type string, question string, think string, answer string, brief string, object_id string, node_id string, node_name string, extra map<string,string>"
DETECTION = "image string, problem string, normal_caption string, solution array<double>, normalized_solution array<double>"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are each one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True, required: str | None = None) -> DataFrame:
    """Files of one JSON object a line.  Tolerant: blank and malformed lines and rows without ``required`` are skipped."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kept = spark.read.schema(f"{schema}, __bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    kept = kept.filter(F.col("__bad").isNull()).drop("__bad")
    return kept.filter(F.coalesce(F.col(required), F.lit("")) != "") if required else kept


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON arrays, JSON lines or Parquet by extension; others are an error."""
    if path.endswith(".jsonl"):
        return json_lines(spark, path, schema)
    if path.endswith(".json"):
        return json_array(spark, path, schema)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def mix(spark: SparkSession, sources: list[dict], id_col: str, schema: str, read: Callable[[SparkSession, str, str], DataFrame] = read_any, seed: int = 0) -> DataFrame:
    """All sources, each by its own ``sampling_strategy``, one after the other; columns that a source lacks are null."""
    out = None
    for source in sources:
        part = sampling.take(read(spark, source["json_path"], schema), source.get("sampling_strategy", "all"), id_col, seed)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def paired(spark: SparkSession, paths: str, schema: str, read: Callable[[SparkSession, str, str], DataFrame] = read_any, **columns: str) -> DataFrame:
    """``:``-separated paths, each with its part of the equally long columns (image roots, reward methods)."""
    files = paths.split(":")
    values = {k: v.split(":") for k, v in columns.items()}
    for k, v in values.items():
        if len(v) != len(files):
            raise ValueError(f"{len(files)} files but {len(v)} values of {k}")
    out = None
    for i, f in enumerate(files):
        part = read(spark, f, schema).withColumns({k: F.lit(v[i]) for k, v in values.items()})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merged_config(path: str) -> dict:
    """A YAML or JSON config over the one its ``_base_`` names, key by key, nested ones too."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        import json

        own = json.loads(text)
    else:
        import yaml

        own = yaml.safe_load(text)
    own = own or {}
    base = own.pop("_base_", None)
    if base is None:
        return own

    def over(a: dict, b: dict) -> dict:
        return a | {k: over(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    return over(merged_config(str(Path(path).parent / base)), own)


def categories(spark: SparkSession, path: str) -> DataFrame:
    """(index, name): a line of a text file each, from 0; the file is read whole, as its order is its meaning."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("index", "name"))
    return lines.select(F.col("index").cast("long"), F.trim("name").alias("name"))


@F.pandas_udf(ArrayType(ArrayType(FloatType())))
def npy_points(content: pd.Series) -> pd.Series:
    """The rows of ``.npy`` files; null if one does not parse."""
    import numpy as np

    def one(c):
        try:
            return np.load(io.BytesIO(c), allow_pickle=False).astype("float32").tolist()
        except (TypeError, ValueError, EOFError):
            return None

    return content.map(one)


@F.pandas_udf(BinaryType())
def npy_bytes(points: pd.Series) -> pd.Series:
    """Rows as ``.npy`` files of 32-bit floats."""
    import numpy as np

    def one(p):
        out = io.BytesIO()
        np.save(out, np.stack([np.asarray(r, "float32") for r in p]) if len(p) else np.zeros((0, 3), "float32"))
        return out.getvalue()

    return points.map(lambda p: None if p is None else one(p))


def named_points(files: DataFrame, colour: bool = True) -> DataFrame:
    """(object_id, n, points) of files (path, content) named ``{object_id}_{n}.npy`` or ``{object_id}.npy``; without ``colour`` three channels stay."""
    points = npy_points("content")
    name = F.regexp_extract("path", r"([^/]*)\.npy\z", 1)
    n = F.try_element_at(F.regexp_extract_all(name, F.lit(r"_(\d+)\z"), F.lit(1)), F.lit(1)).cast("int")
    return files.select(F.regexp_replace(name, r"_\d+\z", "").alias("object_id"), n.alias("n"), (points if colour else F.transform(points, lambda p: F.slice(p, 1, 3))).alias("points"))


def point_files(spark: SparkSession, folder: str, colour: bool = True) -> DataFrame:
    """``named_points`` of a folder."""
    return named_points(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select("path", "content"), colour)


def points_of(ids: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """Each id's cloud of ``n`` points, else its file without a number cut to ``n`` farthest points; ``points`` is null if it has neither."""
    from ..functions import kernels

    @F.pandas_udf("array<array<float>>")
    def cut(clouds: pd.Series) -> pd.Series:
        import numpy as np

        def one(p):
            if p is None:
                return None
            a = np.stack([np.asarray(x, "float32") for x in p])
            return a[kernels.farthest_points(a[:, :3].astype(float), n)].tolist()

        return clouds.map(one)

    exact = files.filter(F.col("n") == n).select("object_id", F.col("points").alias("__exact"))
    whole = files.filter(F.col("n").isNull()).select("object_id", F.col("points").alias("__whole"))
    return ids.join(exact, "object_id", "left").join(whole, "object_id", "left").withColumn("points", F.coalesce("__exact", cut("__whole"))).drop("__exact", "__whole")


def labelled_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(index, label, points) of an ``.npz`` with arrays ``points`` and ``labels``; pickles are converted to that once, as reading them runs code."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            for content in b["content"]:
                z = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"index": range(len(z["labels"])), "label": z["labels"].astype("int64").ravel(), "points": [p.astype("float32").tolist() for p in z["points"]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "index long, label long, points array<array<float>>")


def stems(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(object_id) of the files in a folder that match a glob."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?\z", 1).alias("object_id"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with line ends and commas in texts replaced by spaces."""
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    df.select(*[F.regexp_replace(c, "[\r\n,]+", " ").alias(c) if c in texts else F.col(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    """One folder for each split; reading the parent gives all rows."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key is not there yet, and returns them. Spark's commit protocol makes the write all or nothing."""
    try:
        old = df.sparkSession.read.schema(df.schema).parquet(path)
        new = df.join(old.select(key), key, "left_anti")
    except Exception as e:  # the first write: there is no such path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = df
    new.write.mode("append").parquet(path)
    return new

