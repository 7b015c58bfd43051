"""Inert verification plans for taint and route findings. Nothing is ever sent or run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.text import finding_id

# --- Fixed values ------------------------------------------------------------
MARKER = "TEST_MARKER_123"
HOST = "127.0.0.1:8000"
NO_PATH = "/REPLACE_WITH_LOCAL_TEST_PATH"
TEMPLATE_METHOD, TEMPLATE_PATH = "REPLACE_WITH_METHOD", "REPLACE_WITH_LOCAL_TEST_PATH"
PRECONDITIONS = (
    "Use an isolated local fixture or disposable test environment.",
    "Use synthetic accounts and marker values only.",
    "Do not send the request to production or a third-party service.",
)
STEPS = (
    "Create a minimal fixture that reaches the reported code path.",
    f"Provide the benign marker value {MARKER} at the reported trust boundary.",
    "Observe whether the marker reaches the reported sink or changes protected state.",
    "Record the result and remove the fixture after verification.",
)
EXPECTED_SIGNAL = "The marker should be rejected, encoded, parameterized, or denied by an authorization policy."
SAFETY_NOTE = "This is a proof blueprint only. It contains no exploit payload and is never executed by the engine."
# Parts of the text, in order; {names} are filled per finding.
TITLE_LINE = "# Non-executing proof blueprint for {check_id}\n# Target: {file}:{line}\n"
CURL_HEAD = "# 1. curl reproduction block (do NOT run against production):\n"
CURL = "curl -i -X {method} 'http://" + HOST + "{target}'"
CURL_BODY = " \\\n  -H 'Content-Type: application/json' \\\n  -d '{body}'"
HTTP_HEAD = "\n\n# 2. Raw HTTP request spec:\n"
HTTP = "{method} {target} HTTP/1.1\r\nHost: " + HOST + "\r\nContent-Type: application/json\r\nConnection: close"
SIGNAL = (
    "\n\n# 3. Expected signal: the benign marker " + MARKER + " should be rejected, encoded, parameterized, or denied "
    "by an authorization policy.\n# Safety: this blueprint is never executed by the engine."
)
# --- end of fixed values -----------------------------------------------------


def _fill(template: str, **values: Column) -> Column:
    """Put columns into a fixed text."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def blueprint_text(findings: DataFrame) -> DataFrame:
    """Adds ``poc_payload``.

    The parameter is the route parameter, else the variable of the first path step. It is
    replaced by a benign marker in the route, or added as a query when the route lacks it;
    without any parameter the marker goes into a request body.
    """
    evidence = F.col("route_evidence")
    method = F.upper(F.coalesce(evidence["method"], F.lit("GET")))
    route = F.coalesce(evidence["route"], F.lit(NO_PATH))
    given = F.coalesce(evidence["parameter"], F.get("taint_path", F.lit(0))["variable"])
    parameter = F.coalesce(given, F.lit("field"))
    marked = F.replace(route, F.concat(F.lit(":"), parameter), F.lit(MARKER))
    marked = F.replace(marked, F.concat(F.lit("{"), parameter, F.lit("}")), F.lit(MARKER))
    query = F.when(given.isNotNull() & (marked == route), F.concat(F.lit("?"), parameter, F.lit("=" + MARKER))).otherwise("")
    target = F.concat(marked, query)
    body = F.concat(F.lit('{"'), parameter, F.lit('":"' + MARKER + '"}'))
    no_parameter = given.isNull()
    text = F.concat(
        _fill(TITLE_LINE, check_id=F.col("check_id"), file=F.col("file"), line=F.col("line")),
        F.lit(CURL_HEAD),
        _fill(CURL, method=method, target=target),
        F.when(no_parameter, _fill(CURL_BODY, body=body)).otherwise(""),
        F.lit(HTTP_HEAD),
        _fill(HTTP, method=method, target=target),
        F.when(no_parameter, F.concat(F.lit("\n\n"), body)).otherwise(""),
        F.lit(SIGNAL),
    )
    return findings.withColumn("poc_payload", text)


def blueprints(findings: DataFrame) -> DataFrame:
    """One plan per taint and route-authorization finding."""
    sourced = findings.filter(F.col("flow_evidence").isNotNull() | F.col("route_evidence").isNotNull())
    evidence = F.col("route_evidence")
    return blueprint_text(sourced).select(
        "repo",
        finding_id("RESEARCH-POC-", F.lit("POC"), F.col("file"), F.col("line"), F.col("id")).alias("id"),
        F.col("id").alias("source_finding_id"),
        "check_id",
        F.concat(F.lit("Local verification plan for "), "category").alias("title"),
        "file",
        "line",
        F.lit("non-executing").alias("mode"),
        "poc_payload",
        F.array(*[F.lit(p) for p in PRECONDITIONS]).alias("preconditions"),
        F.array(*[F.lit(s) for s in STEPS]).alias("steps"),
        F.struct(
            F.coalesce(evidence["method"], F.lit(TEMPLATE_METHOD)).alias("method"),
            F.coalesce(evidence["route"], F.lit(TEMPLATE_PATH)).alias("path"),
            F.lit("application/json").alias("content_type"),
            F.lit(MARKER).alias("field"),
        ).alias("request_template"),
        F.lit(EXPECTED_SIGNAL).alias("expected_signal"),
        F.lit(SAFETY_NOTE).alias("safety_note"),
    )


def attach_blueprints(findings: DataFrame, plans: DataFrame) -> DataFrame:
    """The plan texts on the findings; two findings of one id share a plan.

    Plans are made of research findings, and no others share their ids, so only these are joined.
    """
    text = plans.groupBy("repo", F.col("source_finding_id").alias("id")).agg(F.max("poc_payload").alias("plan"))
    research = F.col("check_id").startswith("research-")
    none = F.array().cast(findings.schema["taint_path"].dataType)
    joined = findings.filter(research).join(text, ["repo", "id"], "left").withColumn("poc_payload", F.coalesce("plan", "poc_payload"))
    others = findings.filter(~research).select(*findings.columns)
    return joined.select(*findings.columns).unionByName(others).withColumn("taint_path", F.coalesce("taint_path", none)).select(*findings.columns)
