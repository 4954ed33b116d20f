"""Functions whose loops are too long for Python or column expressions, in Java.

The source lies beside this file.  Spark's own compiler of generated code (Janino) compiles it, and a
jar takes it to the executors, which need neither a compiler nor an install.
"""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

_MADE: dict[tuple[str, str], object] = {}  # by application and class


def java_function(spark: SparkSession, name: str, returns: DataType):
    """The class ``name``, an ``org.apache.spark.sql.api.java.UDFn``, as a function from columns to a column."""
    sc = spark.sparkContext
    made = (sc.applicationId, name)
    if made not in _MADE:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook((Path(__file__).parent / f"{name}.java").read_text())
        jar = os.path.join(sc._temp_dir, f"{name}.jar")  # goes with the context
        with zipfile.ZipFile(jar, "w") as z:
            for c, code in compiler.getBytecodes().items():
                z.writestr(c.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(sc._jvm.java.io.File(jar).toURI().toString())
        _MADE[made] = compiler.getClassLoader().loadClass(f"pathloom.{name}").getDeclaredConstructors()[0].newInstance(
            sc._gateway.new_array(sc._jvm.java.lang.Object, 0))
    spark._jsparkSession.udf().register(f"pathloom_{name}", _MADE[made], spark._jsparkSession.parseDataType(returns.json()))

    def call(*columns) -> Column:
        return F.call_udf(f"pathloom_{name}", *columns)

    return call
