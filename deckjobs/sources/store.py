"""A store of styles that several jobs may save to at once: a log of generations over folders of files.

``data/<id>/`` holds the style files of one save and never changes; ``log/<n>.json`` is a
generation, the folder of each style's current file. A save writes its data, then publishes
the next generation by a rename that fails if that number is taken; whoever comes second
starts again from the generation that came first. So no save loses another's style, and a
reader, who takes the latest generation, sees all of a save or nothing of it. Earlier
generations stay readable.

The log holds a line for each style, a few dozen; it is all that passes the driver. The
rename is as atomic as the file system's (on a local folder it is checked before it is made).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .tables import sink_styles, src_styles


class StyleStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        self._fs.mkdirs(self._at("log"))

    def _at(self, name: str):
        return self._fs.makeQualified(self._hadoop.Path(f"{self.path}/{name}"))

    def generations(self) -> list[int]:
        """Numbers of the generations there are, from 1."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def folders(self, generation: int | None = None) -> dict[str, str]:
        """Style -> folder of its file, in the latest generation or an earlier one."""
        there = self.generations()
        if not there:
            return {}
        text = self.spark.read.schema("value string").text(str(self._at(f"log/{generation or there[-1]}.json")), wholetext=True).first()
        return json.loads(text["value"])

    def publish(self, generation: int, folders: dict[str, str]) -> bool:
        """Make this generation, unless its number is taken."""
        draft = self._at(f"log/_{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
        out.close()
        try:
            kind = getattr(self._hadoop, "Options$Rename")
            self._context.rename(draft, self._at(f"log/{generation}.json"), self.spark._sc._gateway.new_array(kind, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def _change(self, put: dict[str, str], drop: Iterable[str] = ()) -> int:
        while True:
            last = max(self.generations(), default=0)
            folders = {**(self.folders(last) if last else {}), **put}
            if self.publish(last + 1, {k: v for k, v in folders.items() if k not in set(drop)}):
                return last + 1

    def save(self, styles: DataFrame, order: str) -> int:
        """Save styles, the last by ``order`` of each name; returns the generation that has them."""
        folder = uuid.uuid4().hex
        sink_styles(styles, f"{self.path}/data/{folder}", order)
        return self._change({r["name"]: folder for r in styles.select("name").distinct().collect()})

    def remove(self, *names: str) -> int:
        return self._change({}, names)

    def load(self, generation: int | None = None) -> DataFrame:
        """Styles of the latest generation, or of an earlier one."""
        folders = self.folders(generation)
        if not folders:
            return src_styles_of_nothing(self.spark)
        current = self.spark.createDataFrame(sorted(folders.items()), "name string, folder string")
        read = src_styles(self.spark, [f"{self.path}/data/{f}" for f in sorted(set(folders.values()))], "folder")
        return read.join(F.broadcast(current), ["name", "folder"]).drop("folder")


def src_styles_of_nothing(spark: SparkSession) -> DataFrame:
    x = spark.createDataFrame([], schemas.STYLE_FILES)
    return x.select("name", "kind", F.transform_values("templates", lambda k, v: F.unbase64(v)).alias("templates"), "settings")
