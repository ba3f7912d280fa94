"""Messages by language: JSON files beside this one, or in any folder that Spark reads."""

from __future__ import annotations

import json
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = "en"


def _own() -> dict[str, dict[str, str]]:
    files = (f for f in resources.files(__name__).iterdir() if f.name.endswith(".json"))
    return {f.name[:-5]: json.loads(f.read_text(encoding="utf-8")) for f in files}


#: Messages by language and key; the default language has all of them.
MESSAGES = _own()


def message(key: str, language: str = DEFAULT) -> str:
    """A message in a language, else in the default one, else its key."""
    return MESSAGES.get(language, {}).get(key) or MESSAGES[DEFAULT].get(key, key)


def catalog(spark: SparkSession, folder: str | None = None, language: str | None = None) -> DataFrame:
    """(locale, key, message) of the package's files, or of every ``<locale>.json`` in a folder.

    With ``language``, only that one, and the default one in its place if it has no file.
    """
    if folder is None:
        rows = spark.createDataFrame([(loc, k, m) for loc, d in MESSAGES.items() for k, m in d.items()], "locale string, key string, message string")
    else:
        files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
        rows = files.select(name.alias("locale"), F.explode(F.from_json("value", "map<string,string>")).alias("key", "message"))
    if language is None:
        return rows
    wanted = language if not rows.where(F.col("locale") == language).isEmpty() else DEFAULT
    return rows.where(F.col("locale") == wanted)
