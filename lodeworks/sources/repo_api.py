"""Tables of a code host's REST API, from saved JSON pages.

Every entity has declared columns; `raw` keeps the whole object. Pages are
<root>/<entity>/*.json, each a JSON array (or an object that wraps one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

from lodeworks.errors import InvalidInput
from lodeworks.functions.scalar import json_text, tail_number
from lodeworks.plans.spec import TableSpec
from lodeworks.sources.files import listing

_KINDS = {"long": LongType(), "tail": LongType(), "text": StringType(), "json": StringType(), "bool": BooleanType(), "time": TimestampType(), "raw": StringType()}


def _columns(spec: str) -> list[tuple[str, str, tuple[str, ...]]]:
    """'name:kind[:dotted.path]' items; the path is the name where none is given."""
    out = []
    for item in spec.split():
        name, kind, *path = item.split(":")
        out.append((name, kind, tuple((path[0] if path else name).split("."))))
    return [*out, ("raw", "raw", ())]


ENTITIES = {
    "issues": dict(cursor="updated_at", drop="pull_request", columns=_columns("id:long number:long title:text state:text author:text:user.login labels:json comments:long created_at:time updated_at:time closed_at:time body:text")),
    "pull_requests": dict(columns=_columns("id:long number:long title:text state:text author:text:user.login base_ref:text:base.ref head_ref:text:head.ref draft:bool created_at:time updated_at:time merged_at:time closed_at:time")),
    "commits": dict(cursor="committed_at", columns=_columns("sha:text author_name:text:commit.author.name author_login:text:author.login message:text:commit.message authored_at:time:commit.author.date committed_at:time:commit.committer.date")),
    "stargazers": dict(columns=_columns("user_id:long:user.id user_login:text:user.login starred_at:time")),
    "releases": dict(columns=_columns("id:long tag_name:text name:text author:text:author.login draft:bool prerelease:bool created_at:time published_at:time")),
    "issue_comments": dict(cursor="updated_at", columns=_columns("id:long issue_number:tail:issue_url issue_url:text author:text:user.login created_at:time updated_at:time body:text")),
    "workflow_runs": dict(wrap="workflow_runs", columns=_columns("id:long name:text event:text status:text conclusion:text branch:text:head_branch sha:text:head_sha created_at:time updated_at:time")),
    "branches": dict(columns=_columns("name:text sha:text:commit.sha protected:bool")),
    "tags": dict(columns=_columns("name:text sha:text:commit.sha")),
    "labels": dict(columns=_columns("id:long name:text color:text description:text is_default:bool:default")),
}


def _value(kind: str, path: tuple[str, ...]) -> Column:
    obj = F.col("obj")
    if kind == "raw":
        return obj
    text = json_text(obj, *path)
    if kind == "tail":
        return tail_number(text)
    return text.cast({"long": "bigint", "bool": "boolean", "time": "timestamp"}.get(kind, "string"))


def objects(pages: DataFrame, wrap: str | None = None) -> DataFrame:
    """One JSON object (column obj) for each element of the pages (column value)."""
    body = F.get_json_object("value", f"$.{wrap}") if wrap else F.col("value")
    return pages.select(F.explode(F.from_json(body, "array<variant>")).alias("v")).select(F.to_json("v").alias("obj"))


def entity_frame(pages: DataFrame, name: str) -> DataFrame:
    """The entity's typed rows from its pages; objects with the entity's drop key are left out."""
    spec = ENTITIES.get(name)
    if spec is None:
        raise InvalidInput(f"unknown API table {name!r}; one of {', '.join(ENTITIES)}")
    rows = objects(pages, spec.get("wrap"))
    if spec.get("drop"):
        rows = rows.where(F.get_json_object("obj", f"$.{spec['drop']}").isNull())
    return rows.select(*[_value(kind, path).alias(col) for col, kind, path in spec["columns"]])


class ApiPages:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.url = spark, root.rstrip("/"), f"api://{root}"

    def tables(self, schema: str | None = None) -> list[TableSpec]:
        there = {n for n, folder, _ in listing(self.spark, self.root) if folder}
        return [self.probe(n) for n in ENTITIES if n in there]

    def probe(self, table: str) -> TableSpec:
        if table not in ENTITIES:
            raise InvalidInput(f"unknown API table {table!r}; one of {', '.join(ENTITIES)}")
        cols = ENTITIES[table]["columns"]
        return TableSpec(table, StructType([StructField(n, _KINDS[k]) for n, k, _ in cols]), pk=(cols[0][0],), engine="api")

    def frame(self, table: str, cursor: str | None = None, parallel: int | None = None) -> DataFrame:
        self.probe(table)
        return entity_frame(self.spark.read.text(f"{self.root}/{table}", wholetext=True), table)
