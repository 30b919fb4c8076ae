"""Deeply nested reports as related flat tables.

One pass over each document: a depth-first visitor emits rows of (table tag, primary key, parent key, payload). The rows
are written once, partitioned by tag; a table is read from its own partitions alone, and its schema applied then.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.session import stage_table

#: Requests received more than once that are broadcast at most (some 50 MB); more of them are all grouped by a shuffle.
BROADCAST_ROWS = 1_000_000
EMITTED = "tag string, request_id long, pk string, parent_pk string, payload string"
#: Payload schema of every table; the key columns are common to all.
TABLES = {
    "report": "version string, n_runs int",
    "run": "run_no int, tool string, n_results int",
    "rule": "run_no int, rule_no int, rule_id string, default_level string",
    "artifact": "run_no int, artifact_no int, uri string",
    "result": "run_no int, result_no int, rule_id string, level string, eff_level string, message string, n_locations int",
    "location": "run_no int, result_no int, location_no int, rule_id string, eff_level string, uri string, start_line int",
}
_NESTED_STRINGS = 4  # a body may be a JSON string holding the document; deeper nesting than this is not a report


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def parse_body(body: str | None) -> object:
    """The JSON value of a body, unwrapping strings that hold JSON; None where it is not valid."""
    value: object = body
    try:
        for _ in range(_NESTED_STRINGS):
            if not isinstance(value, str):
                break
            value = json.loads(value, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return None if isinstance(value, str) else value


def _dict(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def _list(x: object) -> list:
    return x if isinstance(x, list) else []


def _text(x: object) -> str:
    return x if isinstance(x, str) else ""


def _at(items: list, position: object) -> dict:
    if isinstance(position, int) and not isinstance(position, bool) and 0 <= position < len(items):
        return _dict(items[position])
    return {}


def visit(request_id: int, document: object) -> Iterator[tuple[str, str, str | None, dict]]:
    """Depth-first rows (tag, primary key, parent key, payload) of one report.

    Keys are paths of 0-based positions below the request id, so they are stable and point to the parent by
    construction. Missing, null or wrongly typed fields count as absent; every entry of a list keeps its position.
    """
    if not isinstance(document, dict):
        return
    root = str(request_id)
    runs = _list(document.get("runs"))
    yield "report", root, None, {"version": _text(document.get("version")), "n_runs": len(runs)}
    for run_no, run in enumerate(map(_dict, runs)):
        run_key = f"{root}/{run_no}"
        driver = _dict(_dict(run.get("tool")).get("driver"))
        results = _list(run.get("results"))
        at_run = {"run_no": run_no}
        yield "run", run_key, root, at_run | {"tool": _text(driver.get("name")), "n_results": len(results)}
        rules, levels = _list(driver.get("rules")), {}
        for rule_no, rule in enumerate(map(_dict, rules)):
            rule_id, level = _text(rule.get("id")), _text(_dict(rule.get("defaultConfiguration")).get("level"))
            levels[rule_id] = level
            yield "rule", f"{run_key}/rule/{rule_no}", run_key, at_run | {"rule_no": rule_no, "rule_id": rule_id, "default_level": level or None}
        artifacts = _list(run.get("artifacts"))
        for artifact_no, artifact in enumerate(map(_dict, artifacts)):
            uri = _text(_dict(artifact.get("location")).get("uri"))
            yield "artifact", f"{run_key}/artifact/{artifact_no}", run_key, at_run | {"artifact_no": artifact_no, "uri": uri}
        for result_no, result in enumerate(map(_dict, results)):
            result_key = f"{run_key}/{result_no}"
            rule_id = (
                _text(result.get("ruleId"))
                or _text(_dict(result.get("rule")).get("id"))
                or _text(_at(rules, result.get("ruleIndex")).get("id"))
            )
            level = _text(result.get("level"))
            effective = level or (rule_id and levels.get(rule_id)) or "warning"
            locations = _list(result.get("locations"))
            at_result = at_run | {"result_no": result_no, "rule_id": rule_id, "eff_level": effective}
            yield "result", result_key, run_key, at_result | {
                "level": level or None,
                "message": _text(_dict(result.get("message")).get("text")),
                "n_locations": len(locations),
            }
            for location_no, location in enumerate(map(_dict, locations)):
                place = _dict(location.get("physicalLocation"))
                where = _dict(place.get("artifactLocation"))
                uri = _text(where.get("uri")) or _text(_dict(_at(artifacts, where.get("index")).get("location")).get("uri"))
                line = _dict(place.get("region")).get("startLine")
                yield "location", f"{result_key}/{location_no}", result_key, at_result | {
                    "location_no": location_no,
                    "uri": uri,
                    "start_line": line if isinstance(line, int) and not isinstance(line, bool) and abs(line) < 2**31 else None,
                }


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["tag", "request_id", "pk", "parent_pk", "payload"]
    for pdf in batches:
        rows = []
        for request_id, body in zip(pdf["request_id"].tolist(), pdf["sarif"].tolist()):
            for tag, key, parent, payload in visit(request_id, parse_body(body)):
                rows.append((tag, request_id, key, parent, json.dumps(payload)))
                if len(rows) >= 20_000:  # one huge report must not become one huge batch
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        yield pd.DataFrame(rows, columns=columns)


def latest_bodies(requests: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The last received body of every request (ties by the greater body, NULL lowest).

    Only bodies of requests received more than once are shuffled, pre-aggregated map-side; the others stay where they are.
    """
    rows = requests.where(F.col("request_id").isNotNull()).select("request_id", "received_at", "sarif")
    again = stage_table(rows.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("request_id"), "requests-again")
    few = again.count() <= broadcast_rows
    repeated = rows.join(F.broadcast(again), "request_id", "left_semi") if few else rows
    last = repeated.groupBy("request_id").agg(F.max(F.struct("received_at", "sarif")).alias("last")).select("request_id", F.col("last.sarif").alias("sarif"))
    return last.unionByName(rows.join(F.broadcast(again), "request_id", "left_anti").select("request_id", "sarif")) if few else last


def emit_tagged(requests: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Tagged rows of all reports: tag, request_id, pk, parent_pk, payload (JSON).

    requests: request_id, sarif, received_at. A body that is NULL, cut off or otherwise not JSON gives no rows, also
    when an earlier body of the request was valid. Rows without request_id are ignored, extra columns too.
    """
    bodies = latest_bodies(requests, broadcast_rows).where(F.col("sarif").isNotNull())
    return bodies.mapInPandas(_emit, EMITTED)


def apply_schema(tagged: DataFrame, tag: str) -> DataFrame:
    """One flat table of the tagged rows, typed."""
    return (
        tagged.where(F.col("tag") == tag)
        .select("request_id", "pk", "parent_pk", F.from_json("payload", TABLES[tag]).alias("p"))
        .select("request_id", "pk", "parent_pk", "p.*")
    )


def write_tables(requests: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all tables in one pass, partitioned by tag, to a folder or to the shared one; gives the tagged rows read back."""
    tagged = emit_tagged(requests)
    if folder is None:
        return stage_table(tagged, "tagged", by=("tag",))
    tagged.write.partitionBy("tag").mode("overwrite").parquet(folder)
    return requests.sparkSession.read.schema(EMITTED).parquet(folder)


def read_table(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    """A table written by :func:`write_tables`; only its own partition is read."""
    return apply_schema(spark.read.schema(EMITTED).parquet(folder), tag)


def result_locations(tagged: DataFrame) -> DataFrame:
    """Locations with their result's rule and level; a result without locations gives one row with location_no -1."""
    results, places = apply_schema(tagged, "result"), apply_schema(tagged, "location")
    columns = ["request_id", "run_no", "result_no", "location_no", "rule_id", "eff_level", "uri"]
    bare = results.where("n_locations = 0").withColumn("location_no", F.lit(-1)).withColumn("uri", F.lit(""))
    return places.select(*columns).unionByName(bare.select(*columns))


def links(tagged: DataFrame) -> DataFrame:
    """The keys of every row of every table: tag, pk, parent_pk."""
    return tagged.select("tag", "pk", "parent_pk")
