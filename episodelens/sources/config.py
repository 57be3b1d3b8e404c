"""Robot configuration: small JSON documents, read on the driver and checked before any scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import json_config

SECTIONS, GROUPS = ("action", "observation_state"), ("left", "right")
#: Tolerance of a topic without a policy, and of "exact_frame".
DEFAULT_TOLERANCE_NS = 3_000_000


def tolerance(policy: str | None, default_ns: int = DEFAULT_TOLERANCE_NS) -> int:
    """Nanoseconds of a sync policy in milliseconds (half to even); an error unless it is blank, exact_frame or a number of 0 or more."""
    text = (policy or "").strip()
    if text in ("", "exact_frame"):
        return default_ns if not text else DEFAULT_TOLERANCE_NS
    try:
        ms = float(text)
    except ValueError:
        ms = -1.0
    if not 0 <= ms < float("inf"):
        raise ValueError(f"bad sync policy: {policy!r}")
    return round(ms * 1_000_000)


def entries(spark: SparkSession, path: str) -> list[dict]:
    """The configured topics, in order: section, position, name, grp, topic, fields, parser, sync_policy, tolerance_ns, main_time_topic."""
    found = [r.asDict() for r in json_config(spark, path).collect()]  # a configuration's few rows
    found.sort(key=lambda e: (SECTIONS.index(e["section"]), e["position"]))
    return [e | {"tolerance_ns": tolerance(e["sync_policy"])} for e in found if e["topic"] and e["fields"]]


def topic_fields(found: list[dict], topics: list[str] | None = None) -> list[dict]:
    """Entries of the wanted topics, exactly one each; without topics those of poses: parser pose7d, or seven fields."""
    if topics is None:
        return [e for e in found if e["parser"] == "pose7d" or len(e["fields"]) == 7]
    out = []
    for topic in dict.fromkeys(topics):
        own = [e for e in found if e["topic"] == topic]
        if len(own) != 1:
            raise ValueError(f"{topic} is configured {len(own)} times")
        out += own
    return out


def grippers(found: list[dict]) -> dict[tuple[str, str], dict]:
    """Gripper entries by (section, group): parser gripper, or the one field angle; the last of repeated ones counts, all four must be there."""
    out = {(e["section"], e["grp"]): e for e in found if (e["parser"] == "gripper" or e["fields"] == ["angle"]) and e["grp"] in GROUPS and len(e["fields"]) == 1}
    lacking = [(s, g) for s in SECTIONS for g in GROUPS if (s, g) not in out]
    if lacking:
        raise ValueError(f"no gripper for {lacking}")
    return out


def main_topic(found: list[dict]) -> str:
    names = {e["main_time_topic"] for e in found if e["main_time_topic"]}
    if len(names) != 1:
        raise ValueError("no main_time_topic")
    return names.pop()


def vector_topics(found: list[dict]) -> list[str]:
    """Main topic, topics of poses and of grippers, once each, in order."""
    return list(dict.fromkeys([main_topic(found), *(e["topic"] for e in topic_fields(found)), *(e["topic"] for e in grippers(found).values())]))


def topic_tolerances(found: list[dict], override_ns: int | None = None) -> dict[str, int]:
    """Tolerance by topic; entries of one topic must agree."""
    if override_ns is not None and override_ns < 0:
        raise ValueError("the tolerance must not be negative")
    out: dict[str, int] = {}
    for e in found:
        if out.setdefault(e["topic"], e["tolerance_ns"]) != e["tolerance_ns"]:
            raise ValueError(f"{e['topic']} has several sync policies")
    return out if override_ns is None else dict.fromkeys(out, override_ns)


def cameras(spark: SparkSession, path: str, expected: int | None = None) -> list[dict]:
    """Cameras (key, name, group, topic) of a configuration; none may be blank or repeat a name, key or topic."""
    raw = spark.read.option("multiLine", True).schema("cameras array<struct<key string, name string, group string, topic string>>").json(path)
    found = [r.asDict() for r in raw.select(F.explode("cameras").alias("c")).select("c.*").collect()]
    for part in ("key", "name", "topic"):
        values = [c[part] for c in found]
        if not all((v or "").strip() for v in values) or len(set(values)) < len(values):
            raise ValueError(f"cameras: {part} must be filled and unique")
    if not found or (expected is not None and len(found) != expected):
        raise ValueError(f"{len(found)} cameras")
    return found


def camera_sides(found: list[dict]) -> dict[str, str]:
    """Topic of the left and of the right camera, by group; each side must have one."""
    sides = {g: [c["topic"] for c in found if c["group"] == g] for g in GROUPS}
    if any(len(v) != 1 for v in sides.values()):
        raise ValueError("one left and one right camera are needed")
    return {g: v[0] for g, v in sides.items()}


def store_conf(endpoint: str, access_key: str | None = None, secret_key: str | None = None, region: str | None = None) -> dict[str, str]:
    """Spark settings of an S3 store; the endpoint is host[:port] or a URL without a path.  Keys come from the caller's own configuration."""
    scheme, _, rest = endpoint.strip().rpartition("://")
    host, _, path = rest.partition("/")
    if not host or path or scheme not in ("", "http", "https") or (":" in host and not host.rpartition(":")[2].isdigit()):
        raise ValueError(f"bad endpoint: {endpoint!r}")
    if (access_key is None) != (secret_key is None):
        raise ValueError("both keys or none")
    out = {"fs.s3a.endpoint": host, "fs.s3a.connection.ssl.enabled": str(scheme != "http").lower(), "fs.s3a.path.style.access": "true"}
    out |= {} if access_key is None else {"fs.s3a.access.key": access_key, "fs.s3a.secret.key": secret_key}
    return {f"spark.hadoop.{k}": v for k, v in (out | ({"fs.s3a.endpoint.region": region} if region else {})).items()}


def tasks_table(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of per-task tables, by task number; a table's name is the number in lower case with _ for -, and must begin with task_."""
    out = None
    for number, df in tables.items():
        name = number.strip().lower().replace("-", "_")
        if not name.startswith("task_"):
            raise ValueError(f"not a task number: {number!r}")
        part = df.withColumn("task_no", F.lit(number))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no task")
    return out
