"""Files with access rules in JSON sidecars, read as DataFrames; `formats` has the Spark data source."""

from __future__ import annotations

import json
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidPrincipalError, SourceError
from ..functions.policy import EVERYONE
from ..principals import check_id
from ..schemas import RAW

#: A folder's sidecar by default; a file's has the file's name and this ending.
DIRECTORY_SIDECAR, FILE_SIDECAR = ".gatehouse-acl.json", ".acl.json"
#: Endings of files that are documents.
ENDINGS = (".md", ".txt", ".markdown", ".rst")
NAME = "filesystem"


def parse_rules(raw: str) -> tuple[list[str], list[str]]:
    """(grants, denies) of a sidecar; anything but two lists of valid ids raises."""
    try:
        rules = json.loads(raw)
    except ValueError:
        raise SourceError("access rules aren't JSON") from None
    if not isinstance(rules, dict):
        raise SourceError("access rules must be an object")
    out = []
    for kind in ("grants", "denies"):
        named = rules.get(kind, [])
        if not isinstance(named, list) or not all(isinstance(x, str) for x in named):
            raise SourceError(f"{kind} must be a list of strings")
        try:
            out.append(sorted({x if x == EVERYONE else check_id(x) for x in named}))
        except InvalidPrincipalError as e:
            raise SourceError(f"{kind}: {e}") from None
    return out[0], out[1]


def path_of(uri: str, root: str) -> Path:
    """The file of a file:// uri, percent-decoded; it must lie below the root, links resolved."""
    if not uri.startswith("file://"):
        raise SourceError("not a file:// uri")
    path, top = Path(unquote(uri[len("file://") :])).resolve(), Path(root).resolve()
    if top not in path.parents:
        raise SourceError("the path leaves the root")
    return path


def nearest_rules(documents: DataFrame, sidecars: DataFrame, root: str, folder_sidecar: str = DIRECTORY_SIDECAR) -> DataFrame:
    """(path, rules_path): the sidecar that decides for a document, null if none does.

    The file's own one, or else the one of the nearest folder up to the root.
    Each document yields its candidate paths with their distance, which are
    joined by equality with the sidecars; the least distance wins.
    """
    top = root.rstrip("/")
    parts = F.split(F.substring("path", len(top) + 2, 100_000), "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.struct((d + 1).alias("distance"), F.concat_ws("/", F.lit(top), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1 - d), "/")).alias("folder")))
    names = F.transform(folders, lambda f: F.struct(f["distance"].alias("distance"), F.concat(F.rtrim(f["folder"], F.lit("/")), F.lit(f"/{folder_sidecar}")).alias("rules_path")))
    own = F.array(F.struct(F.lit(0).alias("distance"), F.concat("path", F.lit(FILE_SIDECAR)).alias("rules_path")))
    candidates = documents.select("path", F.explode(F.concat(own, names)).alias("c")).select("path", "c.*")
    found = candidates.join(sidecars.select(F.col("path").alias("rules_path")), "rules_path")
    nearest = found.groupBy("path").agg(F.min_by("rules_path", "distance").alias("rules_path"))
    return documents.select("path").join(nearest, "path", "left")


def read_folder(spark: SparkSession, root: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """(documents as schemas.RAW, skipped: uri, error), by the format of `formats.FolderSource`.

    The nearest sidecar that exists decides; if it is malformed, nobody may
    read the document. A document that can't be read is skipped.
    """
    from . import formats

    formats.register(spark)
    rows = spark.read.format(formats.FOLDER).options(root=root, **options).load()
    return rows.where("error IS NULL").select(RAW.names), rows.where("error IS NOT NULL").select("uri", "error")
