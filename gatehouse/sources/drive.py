"""A drive API as a source: listing, permissions and contents as DataFrames.

Executors list (`formats.DriveSource`) and fetch permissions and contents, by
clients that tasks make.
What makes a client may hold a way to get a token, but no token.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions import policy
from ..plans.tables import written
from ..schemas import RAW
from . import formats

NAME, PREFIX = "gdrive", "gdrive://"
#: MIME types that are listed; documents of the first are exported.
DOCUMENT_TYPE = "application/vnd.google-apps.document"
TEXT_TYPES = ("text/plain", "text/markdown")
PERMISSIONS = "array<struct<type string, emailAddress string, domain string>>"
#: Paths, fields and parameters of the API.
FILES = ("/drive/v3/files", {"fields": "nextPageToken, files(id, name, mimeType, modifiedTime)", "pageSize": 100})
RULES = ("/drive/v3/files/{id}/permissions", {"fields": "nextPageToken, permissions(type, emailAddress, domain)", "pageSize": 100})
CONTENTS = {"document": ("/drive/v3/files/{id}/export", {"mimeType": "text/plain"}), "file": ("/drive/v3/files/{id}", {"alt": "media"})}

#: (path, parameters) -> decoded JSON, or text for contents.
Call = Callable[[str, dict], object]


def uri_parts(uri: Column) -> Column:
    """struct(kind, id) of well-formed uris: gdrive://document/<id>, gdrive://file/<id> or gdrive://<id>; null otherwise."""
    m = lambda i: F.regexp_extract(uri, r"^gdrive://(?:(document|file)/(.+)|([^/]+))$", i)
    return F.when(m(2) != "", F.struct(m(1).alias("kind"), m(2).alias("id"))).when(m(3) != "", F.struct(F.lit("file").alias("kind"), m(3).alias("id")))


def grants_of(permissions: Column | str) -> Column:
    """Users and groups by e-mail, domains as domain:x, anyone as everyone; other kinds grant nothing."""
    p = F.col(permissions) if isinstance(permissions, str) else permissions
    known = lambda x: F.when(x["type"].isin("user", "group"), x["emailAddress"]).when(x["type"] == "domain", F.concat(F.lit("domain:"), x["domain"])).when(x["type"] == "anyone", F.lit(policy.EVERYONE))
    return policy.ids(F.transform(F.coalesce(p, F.array().cast(PERMISSIONS)), known))


def answers(call: Call, path: str, parameters: dict) -> Iterator[str]:
    """The JSON of every page of an answer; each names the next one by a token."""
    more: dict = {}
    while more is not None:
        page = call(path, parameters | more)
        yield json.dumps(page)
        after = page.get("nextPageToken") if isinstance(page, dict) else None
        more = {"pageToken": after} if after else None


def read_drive(spark: SparkSession, call: Call, files_a_task: int = 500) -> tuple[DataFrame, DataFrame]:
    """`read_listed` with a transport that is sent to executors as it is."""
    return read_listed(spark, formats.client_option(lambda: call), files_a_task)


def read_listed(spark: SparkSession, client: str, files_a_task: int = 500) -> tuple[DataFrame, DataFrame]:
    """(documents as schemas.RAW, skipped: uri, error).

    client: an option of `formats.DriveSource`, which lists on executors; what
    is listed is written, dealt out, and fetched by a client that each task
    makes. Rules that can't be read in full admit nobody; files whose contents
    can't be read are skipped. What was fetched is written once, as both
    results read it.
    """

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = formats.client_of(client)
        for batch in batches:
            rules, texts, errors = [], [], []
            for kind, file_id in zip(batch["kind"], batch["id"], strict=True):
                path, parameters = RULES
                try:
                    rules.append([*answers(ask, path.format(id=file_id), parameters)])
                except SourceError:
                    rules.append([])
                path, parameters = CONTENTS[kind]
                try:
                    texts.append(str(ask(path.format(id=file_id), parameters)))
                    errors.append(None)
                except SourceError as e:
                    texts.append(None)
                    errors.append(type(e).__name__)
            yield batch[["uri", "title", "version"]].assign(rules=rules, text=texts, error=errors)

    formats.register(spark)
    listed = written(spark.read.format(formats.DRIVE).option("client", client).load().select("uri", "title", "version", "kind", "id"), "listing")
    tasks = max(1, -(-listed.count() // files_a_task))
    fetched = listed.repartition(tasks).mapInPandas(fetch, "uri string, title string, version string, rules array<string>, text string, error string")
    fetched = written(fetched, "drive")
    pages = F.transform("rules", lambda x: F.from_json(x, f"permissions {PERMISSIONS}")["permissions"])
    whole = F.forall(pages, lambda p: p.isNotNull())
    permissions = F.when(whole, F.flatten(pages)).otherwise(F.array().cast(PERMISSIONS))
    raw = fetched.where("error IS NULL").select(F.concat(F.lit(f"{NAME}:"), "uri").alias("document_id"), F.lit(NAME).alias("connector"), "uri", "title", "version", grants_of(permissions).alias("grants"), policy.no_ids().alias("denies"), "text")
    return raw.select(RAW.names), fetched.where("error IS NOT NULL").select("uri", "error")
