"""Recognise, plan, decode, resample and encode pictures: transforms of entries."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from inkflow.config import KERNELS, Jpeg, one_of
from inkflow.functions import jvm, magic, names, resizing
from inkflow.operators import registry

SOURCE = Path(__file__).parent / "java" / "Pictures.java"
SIZE, PICTURE = "struct<width: int, height: int>", "width int, height int, data binary"
FOUND = "struct<engine: string, width: int, height: int>"


def identify(entries: DataFrame, formats: registry.Registry | None = None) -> DataFrame:
    """Adds engine, width and height: those of the first decoder whose first bytes fit and whose header gives a size.

    Decoders are asked in the order of their registration; one that refuses the header yields to the next. A picture that none of them
    takes fails the query. Only decoders that bring no size column are asked in Python, and only about what is still open.
    """
    formats = formats or registry.default()
    _codecs(entries.sparkSession)
    content, rows = F.col("content"), entries
    found = F.lit(None).cast(FOUND)
    for name, decoder in formats.decoders.items():
        size = decoder.size_column(content)
        if size is None:
            rows = rows.withColumn("found_", found)
            found, open_ = F.col("found_"), F.when(F.col("found_").isNull() & decoder.matched(content), content)
            rows = rows.withColumn("size_", _read_size(decoder)(open_))
            size = F.col("size_")
        known = decoder.matched(content) & (size["width"] > 0) & (size["height"] > 0)
        found = F.coalesce(found, F.when(known, F.struct(F.lit(name).alias("engine"), size["width"].alias("width"), size["height"].alias("height"))))
    problem = F.raise_error(F.concat(F.lit("Identify: "), F.col("path"), F.lit(" error, unknown image")))
    sized = rows.withColumn("found_", F.coalesce(found, problem))
    return sized.select(*entries.columns, "found_.*")


def _read_size(decoder: registry.Decoder) -> Callable[[Column], Column]:
    @pandas_udf(SIZE)
    def read(body: pd.Series) -> pd.DataFrame:
        found = [decoder.size(bytes(b)) if b is not None else None for b in body]
        return pd.DataFrame({"width": [f[0] if f else None for f in found], "height": [f[1] if f else None for f in found]}, dtype="Int32")

    return read


def plan(identified: DataFrame, ratio: int = 70, formats: registry.Registry | None = None) -> DataFrame:
    """Adds target_w, target_h, do_resize, warn_small and out_path."""
    target = (formats or registry.default()).encoder.name
    planned = identified.withColumns(resizing.plan(F.col("width"), F.col("height"), ratio))
    return planned.withColumn("out_path", names.renamed(F.col("path"), F.col("ext"), target))


def flagged(rows: DataFrame) -> DataFrame:
    """Adds name_collision: whether another member of the archive has the same out_path. Leave contents out before."""
    return rows.withColumn("name_collision", F.count("*").over(Window.partitionBy("archive", "out_path")) > 1)


def manifest(entries: DataFrame, ratio: int = 70, formats: registry.Registry | None = None) -> DataFrame:
    """What a conversion would do with each member, without its content."""
    return flagged(entries.transform(identify, formats).transform(plan, ratio, formats).drop("content"))


def _codecs(spark: SparkSession) -> None:
    jvm.load(spark, SOURCE)
    spark.udf.registerJavaFunction("inkflow_jpeg_size", "Pictures$JpegSize", SIZE.removeprefix("struct<").removesuffix(">"))
    spark.udf.registerJavaFunction("inkflow_decode", "Pictures$Decode", PICTURE)
    spark.udf.registerJavaFunction("inkflow_resample", "Pictures$Resample", PICTURE)
    spark.udf.registerJavaFunction("inkflow_encode", "Pictures$Encode", "binary")


def decoded(planned: DataFrame, formats: registry.Registry | None = None) -> DataFrame:
    """Replaces content by picture (width, height, data); a format without a decoder fails the query."""
    _codecs(planned.sparkSession)
    formats = formats or registry.default()
    own = {n: d for n, d in formats.decoders.items() if d.decodable and d.own_codec()}

    @pandas_udf(PICTURE)
    def read(engine: pd.Series, body: pd.Series) -> pd.DataFrame:
        images = [None if e is None else own[e].decode(bytes(b)) for e, b in zip(engine, body, strict=True)]
        return pd.DataFrame({"width": pd.array([None if i is None else i.shape[1] for i in images], dtype="Int32"), "height": pd.array([None if i is None else i.shape[0] for i in images], dtype="Int32"), "data": [None if i is None else np.ascontiguousarray(i, dtype=np.uint8).tobytes() for i in images]})

    engine, content = F.col("engine"), F.col("content")
    unsupported = F.raise_error(F.concat(F.lit("Decoder: "), F.col("path"), F.lit(" error, no decoder for "), engine))
    by_jvm = formats.supports(engine) & ~engine.isin(*own) if own else formats.supports(engine)
    picture = F.when(by_jvm, F.call_function("inkflow_decode", content, F.col("path")))
    if own:
        chosen = lambda c: F.when(engine.isin(*own), c)
        picture = picture.when(engine.isin(*own), read(chosen(engine), chosen(content)))
    return planned.withColumn("picture", picture.otherwise(unsupported)).drop("content")


def resampled(pictures: DataFrame, kernel: str = "lanczos3") -> DataFrame:
    """Resamples the pictures that are to be; the others pass. Both in one expression, so nothing below runs twice."""
    one_of(kernel, KERNELS, "interpolation")
    _codecs(pictures.sparkSession)
    sized = F.call_function("inkflow_resample", "picture", F.col("target_w").cast("int"), F.col("target_h").cast("int"), F.lit(kernel))
    return pictures.withColumn("picture", F.when(F.col("do_resize"), sized).otherwise(F.col("picture")))


def encoded(pictures: DataFrame, jpeg: Jpeg = Jpeg(), formats: registry.Registry | None = None) -> DataFrame:  # noqa: B008  frozen
    """Replaces picture by out_content, JPEG bytes. The DCT method is checked, but the JVM's encoder has one only."""
    encoder = (formats or registry.default()).encoder
    if encoder.own_codec():

        @pandas_udf("binary")
        def write(picture: pd.DataFrame) -> pd.Series:
            images = (np.frombuffer(d, dtype=np.uint8).reshape(h, w, 3) for w, h, d in zip(picture["width"], picture["height"], picture["data"], strict=True))
            return pd.Series([encoder.encode(i, jpeg.quality, jpeg.progressive, jpeg.optimize) for i in images])

        return pictures.withColumn("out_content", write("picture")).drop("picture")
    _codecs(pictures.sparkSession)
    return pictures.withColumn("out_content", F.call_function("inkflow_encode", "picture", F.lit(jpeg.quality), F.lit(jpeg.progressive), F.lit(jpeg.optimize))).drop("picture")


def convert(entries: DataFrame, ratio: int = 70, kernel: str = "lanczos3", jpeg: Jpeg = Jpeg(), formats: registry.Registry | None = None) -> DataFrame:  # noqa: B008
    planned = entries.transform(identify, formats).transform(plan, ratio, formats)
    return planned.transform(decoded, formats).transform(resampled, kernel).transform(encoded, jpeg, formats)
