"""Java sources of this package, compiled by the driver's JDK and sent to the executors by Spark."""

from __future__ import annotations

import os
import subprocess
import tempfile
import zipfile
from pathlib import Path

import pyspark
from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

_added: dict[tuple[str, str], JavaObject] = {}


def load(spark: SparkSession, source: Path) -> JavaObject:
    """The class of a Java file (a java.lang.Class), whose jar every task of this session gets."""
    key = (spark._jsparkSession.sessionUUID(), str(source))  # jars belong to a session
    if key not in _added:
        folder = os.path.realpath(tempfile.mkdtemp(prefix="inkflow-java-"))
        compiler = Path(spark._jvm.java.lang.System.getProperty("java.home"), "bin", "javac")
        if not compiler.exists():
            raise RuntimeError(f"compiling {source.name} needs a JDK on the driver, not only a Java runtime")
        home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
        subprocess.run([compiler, "-nowarn", "-cp", f"{home}/jars/*", "-d", folder, source.resolve()], check=True, capture_output=True, text=True)
        jar = f"{folder}/{source.stem}.jar"
        with zipfile.ZipFile(jar, "w") as out:
            for part in Path(folder).glob("*.class"):
                out.write(part, part.name)
        spark.sql(f"ADD JAR '{jar}'")
        _added[key] = spark._jsparkSession.artifactManager().classloader().loadClass(source.stem)
    return _added[key]


def call(spark: SparkSession, owner: JavaObject, name: str, *arguments) -> JavaObject:
    """owner's public static method of that name."""
    method = next(m for m in owner.getMethods() if m.getName() == name)
    array = spark._sc._gateway.new_array(spark._jvm.java.lang.Object, len(arguments))
    for i, argument in enumerate(arguments):
        array[i] = argument
    return method.invoke(None, array)
