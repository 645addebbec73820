"""Other scanners' reports: format detection by shape, and importers to the common shape of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetstone import schema as S
from vetstone.operators.render import WHOLE

# Other tools' grades.
SEVERITIES = {"CRITICAL": "critical", "HIGH": "high", "MEDIUM": "medium", "MODERATE": "medium", "LOW": "low", "ERROR": "high", "WARNING": "medium", "NOTE": "low", "INFO": "informational", "UNKNOWN": "informational"}


def severity(label: Column, default: str = "informational") -> Column:
    out = F.lit(default)
    for k, v in SEVERITIES.items():
        out = F.when(F.upper(label) == k, v).otherwise(out)
    return out


def kind(report: Column) -> Column:
    """sarif, trivy, checkov, zap, semgrep, or null: by what keys the root object has."""
    keys = F.json_object_keys(report)

    def has(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out &= F.array_contains(keys, n)
        return out

    return (
        F.when(has("runs") & F.coalesce(F.get_json_object(report, "$.version").startswith("2.1"), F.lit(False)), "sarif")
        .when(has("SchemaVersion") | has("Results"), "trivy")
        .when(has("check_type", "results"), "checkov")
        .when(has("site"), "zap")
        .when(has("results", "errors") | has("results"), "semgrep")
    )


def _common(tool: str, rule: Column, identity: tuple, title: Column, level: Column, path: Column, line: Column, fixed: Column, cwe: Column) -> list[Column]:
    name, f1, f2, f3 = identity
    none = F.lit(None).cast("string")
    return [
        F.lit(f"external:{tool}").alias("engine_id"), rule.alias("rule_id"),
        F.struct(F.lit(name).alias("finding_class"), f1.alias("f1"), f2.alias("f2"), f3.alias("f3")).alias("identity"),
        F.coalesce(title, rule).alias("title"), none.alias("description"), level.alias("severity"), F.lit("heuristic").alias("confidence"),
        F.struct(F.lit("repository").alias("kind"), path.alias("identifier")).alias("asset"), F.struct(path.alias("path"), line.cast("long").alias("line")).alias("location"),
        F.array(F.struct(F.lit("imported").alias("kind"), F.coalesce(title, rule).alias("summary"), none.alias("detail"), F.array().cast("array<string>").alias("dependency_path"))).alias("evidence"),
        F.when(fixed.isNotNull(), F.struct(F.lit(True).alias("fix_available"), fixed.alias("fixed_version"), none.alias("summary"))).alias("remediation"),
        F.coalesce(cwe, F.array().cast("array<string>")).alias("cwe"),
    ]


def sarif(reports: DataFrame) -> DataFrame:
    schema = "runs array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>>>>>"
    r = reports.select(F.from_json("report", schema).alias("j")).select(F.explode("j.runs").alias("run")).select(F.col("run.tool.driver.name").alias("tool"), F.explode("run.results").alias("r"))
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    rule = F.coalesce("r.ruleId", F.lit("unknown"))
    path = at["artifactLocation"]["uri"]
    out = r.select("tool", *_common("sarif", rule, ("structural_pattern", rule, path, F.concat(F.lit("sarif:"), F.sha2(rule, 256))), F.col("r.message.text"), severity(F.col("r.level")), path, at["region"]["startLine"], F.lit(None).cast("string"), F.lit(None).cast("array<string>")))
    return out.withColumn("engine_id", F.concat(F.lit("external:"), F.coalesce(F.lower("tool"), F.lit("unknown")))).drop("tool")


def findings(reports: DataFrame) -> DataFrame:
    """The findings that this engine's own SARIF documents carry whole: what was written, without loss."""
    schema = f"runs array<struct<results:array<struct<properties:struct<`{WHOLE}`:struct<{S.FINDING}>>>>>>"
    results = F.flatten(F.array_compact(F.from_json("report", schema)["runs"]["results"]))
    return reports.select(F.explode(results["properties"][WHOLE]).alias("f")).where("f.finding_id is not null").select("f.*")


def as_observations(found: DataFrame) -> DataFrame:
    """Imported findings as observations to be merged with a scan's: each stands for its first source."""
    first = F.get("sources", F.lit(0))
    return found.select(
        F.coalesce(first["engine_id"], F.lit("external:unknown")).alias("engine_id"), first["rule_id"].alias("rule_id"), "identity", "title", "description",
        "severity", "confidence", "asset", "location", "evidence", "remediation", "cwe",
    )


def trivy(reports: DataFrame) -> DataFrame:
    schema = "Results array<struct<Target:string,Type:string,Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,Severity:string,Title:string,PkgIdentifier:struct<PURL:string>>>>>"
    r = reports.select(F.explode(F.from_json("report", schema)["Results"]).alias("r")).select("r.Target", "r.Type", F.explode("r.Vulnerabilities").alias("v"))
    types = F.create_map(*(F.lit(x) for p in {"npm": "npm", "yarn": "npm", "pnpm": "npm", "pip": "pypi", "poetry": "pypi", "cargo": "cargo", "gomod": "golang", "bundler": "gem", "composer": "composer", "pom": "maven", "debian": "deb", "ubuntu": "deb", "alpine": "apk"}.items() for x in p))
    built = F.concat(F.lit("pkg:"), F.coalesce(F.try_element_at(types, F.col("Type")), F.coalesce("Type", F.lit("generic"))), F.lit("/"), F.col("v.PkgName"), F.coalesce(F.concat(F.lit("@"), "v.InstalledVersion"), F.lit("")))
    purl = F.coalesce("v.PkgIdentifier.PURL", built)
    return r.select(*_common("trivy", F.col("v.VulnerabilityID"), ("vulnerable_dependency", purl, F.col("v.VulnerabilityID"), F.col("Target")), F.col("v.Title"), severity(F.col("v.Severity")), F.col("Target"), F.lit(None), F.col("v.FixedVersion"), F.lit(None).cast("array<string>")))


def semgrep(reports: DataFrame) -> DataFrame:
    schema = "results array<struct<check_id:string,path:string,start:struct<line:bigint>,extra:struct<severity:string,message:string,metadata:struct<cwe:array<string>>>>>"
    r = reports.select(F.explode(F.from_json("report", schema)["results"]).alias("r")).select("r.*")
    return r.select(*_common("semgrep", F.col("check_id"), ("structural_pattern", F.col("check_id"), F.col("path"), F.concat(F.lit("semgrep:"), F.sha2("check_id", 256))), F.col("extra.message"), severity(F.col("extra.severity")), F.col("path"), F.col("start.line"), F.lit(None).cast("string"), F.col("extra.metadata.cwe")))


def checkov(reports: DataFrame) -> DataFrame:
    schema = "results struct<failed_checks:array<struct<check_id:string,check_name:string,file_path:string,resource:string,severity:string,guideline:string>>>"
    r = reports.select(F.explode(F.from_json("report", schema)["results"]["failed_checks"]).alias("r")).select("r.*")
    path = F.regexp_replace("file_path", "^/+", "")
    return r.select(*_common("checkov", F.col("check_id"), ("iac_misconfiguration", F.col("check_id"), path, F.col("resource")), F.col("check_name"), severity(F.col("severity"), "medium"), path, F.lit(None), F.lit(None).cast("string"), F.lit(None).cast("array<string>")))


def zap(reports: DataFrame) -> DataFrame:
    schema = "site array<struct<`@name`:string,alerts:array<struct<pluginid:string,alert:string,name:string,riskcode:string,desc:string,cweid:string,instances:array<struct<uri:string>>>>>>"
    r = reports.select(F.explode(F.from_json("report", schema)["site"]).alias("s")).select(F.col("s.@name").alias("site"), F.explode("s.alerts").alias("a"))
    r = r.select("site", "a", F.explode_outer("a.instances").alias("i")).withColumn("uri", F.coalesce("i.uri", "site"))
    origin, path = F.regexp_extract("uri", "^([a-zA-Z]+://[^/?#]+)", 1), F.regexp_replace("uri", "^[a-zA-Z]+://[^/?#]+", "")
    level = F.when(F.col("a.riskcode") == "3", "high").when(F.col("a.riskcode") == "2", "medium").when(F.col("a.riskcode") == "1", "low").otherwise("informational")
    cwe = F.when(~F.col("a.cweid").isin("", "-1"), F.array(F.concat(F.lit("CWE-"), "a.cweid")))
    path = F.when(path == "", "/").otherwise(path)
    return r.select(*_common("zap", F.col("a.pluginid"), ("web_exposure", F.col("a.pluginid"), origin, path), F.coalesce("a.alert", "a.name"), level, F.col("uri"), F.lit(None), F.lit(None).cast("string"), cwe))


IMPORTERS = {"sarif": sarif, "trivy": trivy, "checkov": checkov, "zap": zap, "semgrep": semgrep}


def observations(reports: DataFrame) -> DataFrame:
    """All reports (report: JSON text) as observations; unrecognised ones give none."""
    tagged = reports.withColumn("kind", kind(F.col("report")))
    out = None
    for name, f in IMPORTERS.items():
        part = f(tagged.where(F.col("kind") == name))
        out = part if out is None else out.unionByName(part)
    return out
