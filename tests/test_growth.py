"""What a query costs on larger tables: plans that do costly work once, and results that don't hang on the order of rows."""

import re

import pytest
from pyspark.sql import functions as F

from vetstone import schema as S
from vetstone.functions import hashing
from vetstone.functions import versions as V
from vetstone.operators import advisories, enrich, merge
from vetstone.sources import feeds, reports

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def observations(spark, *assets):
    return spark.createDataFrame([("e", "r", ("exposed_secret", "r", "./a//b/", "h"), "t", None, "low", "heuristic", ("repository", a), ("a/b", 1), [], None, []) for a in assets], S.RAW).coalesce(1)


@pytest.mark.parametrize("turn", [1, -1])
def test_merge_decides_ties_by_values(spark, turn):
    (m,) = merge.merge(observations(spark, *("x", "y")[::turn])).collect()
    assert (m.asset.identifier, m.identity.f2, m.location.path) == ("x", "a/b", "a/b")


def test_merge_sorts_by_a_hash_and_keeps_the_order_once(spark):
    text = plan(merge.merge(observations(spark, "x")).select("title", "asset", "location"))
    assert re.search(r"Aggregate\(key=\[h#", text)
    assert text.count("partial_min") == 1 and "min_by" not in text


def test_ranking_reads_merged_findings_once(spark):
    from vetstone.plans.registry import QUERIES

    for name in ("findings_ranked", "secret_findings_ranked"):
        text = plan(QUERIES[name](spark, SF))
        assert re.search(r"Exchange rangepartitioning[^\n]*\n[^\n]*Exchange hashpartitioning\(finding_id#", text), name


VERSIONS = ["1.0.0", "v1.0.0", "1.0.0-rc.1", "1.0.0-rc.1.1", "1.0.0-rc.2", "1.0.0-rc.10", "1.0.0-rc", "1.0.0-1", "1.0.0-a..b", "1.0.0-99999999999999999999", "1.0.0-0", "1.0.0+b", "1.2", "", "x", "2.0.0", "10.0.0", "9.0.0",
            "99999999999999999999.0.0", "9223372036854775807.0.0", "1.0.0\n", "007.1.2", "٣.0.0", "0.0.0", "0", "1.0.0-a-b", "1.0.0-a", "1.0.0-ab", "é", "dev"]


def test_semantic_versions_have_one_order(spark):
    rows = spark.createDataFrame([(v,) for v in VERSIONS], "v string").select("v", V.semver_text_of(F.col("v")).alias("k")).collect()
    assert {r.v: r.k for r in rows} == {v: V.semver_text(v) for v in VERSIONS}
    sign = lambda x, y: (x > y) - (x < y)
    for a in rows:
        for b in rows:
            assert sign(a.k, b.k) == V.compare("semver", a.v, b.v), (a, b)


def test_advisories_judge_semantic_versions_natively(spark):
    sets = [
        (None, [("SEMVER", [("0", None, None), (None, "1.0.0", None), ("2.0.0", None, None), (None, None, "9.0.0")])]),
        (["x", "1.0.0-rc"], [("SEMVER", [("1.0.0", None, None)]), ("GIT", [("0", "10.0.0", None)]), ("SEMVER", [("1.0.0-rc.2", "1.0.0", None)])]),
        ([], [("SEMVER", [("1.0.0-1", "", None), (None, "1.2", None), (None, "2.0.0", None)]), ("SEMVER", None)]),
        (["1.0.0\n"], None), (None, [("SEMVER", [(None, None, "0"), ("x", None, None), ("0", None, None)])]), (None, None),
    ]
    osv = spark.createDataFrame([(f"G-{i}", "s", None, None, [((e, "p"), names, rs)]) for e in ("npm", "Maven") for i, (names, rs) in enumerate(sets)], feeds.OSV)
    packages = spark.createDataFrame([(e, "p", v) for e in ("npm", "Maven") for v in VERSIONS], "ecosystem string, name string, version string")
    want = set()
    for e in ("npm", "Maven"):
        s = V.scheme_of(e)
        for i, (names, rs) in enumerate(sets):
            rs = [{"type": t, "events": [dict(zip(V.BOUNDS, x, strict=True)) for x in events or []]} for t, events in rs or []]
            ends = lambda r: any(x["fixed"] or x["last_affected"] for x in r["events"])
            for v in VERSIONS:
                if v in (names or []) or any(V.in_range(s, v, r["events"]) for r in rs if r["type"] != "GIT" and (ends(r) or not names)):
                    want.add((e, v, f"G-{i}", V.lowest_fix(s, v, rs)))
    found = advisories.match(packages, osv)
    got = [(r.ecosystem, r.version, r.id, r.fixed_version) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    text = plan(advisories.match(packages.where("ecosystem = 'npm'").withColumn("ecosystem", F.lit("npm")), osv))
    assert "judged" not in text and "keyed" in text


def test_exploit_lookup_joins_once_and_collects_nothing(spark):
    from vetstone.plans.registry import QUERIES

    text = plan(QUERIES["exploit_signals"](spark, SF))
    assert len(re.findall(r"HashJoin|SortMergeJoin", text)) == 1 and "collect_set" not in text
    found = spark.createDataFrame([("a", ["CVE-2", "CVE-2", "CVE-1"]), ("a", ["G-1"]), ("b", []), ("c", None), ("d", ["G-1", None])], "k string, aliases array<string>")
    kev = spark.createDataFrame([("CVE-2",), ("CVE-2",), (None,)], "cve string")
    epss = spark.createDataFrame([("CVE-1", 0.9, 1), ("CVE-1", 0.2, 2), ("G-1", 0.1, 1), (None, 0.8, 1)], "cve string, epss double, ordinal int")
    got = {tuple(r) for r in enrich.exploit(found, "k", F.col("aliases"), kev, epss).collect()}
    assert got == {("a", True, 0.2, "CVE-1"), ("b", False, None, None), ("c", False, None, None), ("d", False, 0.1, None)}
    assert {r.epss for r in enrich.exploit(found, "k", F.col("aliases"), kev, epss.drop("ordinal")).collect()} == {0.9, 0.1, None}


def test_sarif_round_trip_sorts_nothing_and_keeps_all_runs(spark):
    from vetstone.plans.registry import QUERIES

    text = plan(QUERIES["sarif_round_trip"](spark, SF))
    assert "Exchange" not in text and text.count("Generate ") == 1
    result = lambda k: '{"properties":{"vetstone/finding":{"finding_id":"%s"}}}' % k
    docs = ['{"runs":[{"results":[%s,%s,{}]},{"results":null},{},null,{"results":[{"properties":null},%s]}]}' % tuple(map(result, "abc")), '{"runs":null}', "{}", "not JSON", None, '{"runs":[{"results":[%s]}]}' % result("d")]
    assert sorted(r.finding_id for r in reports.findings(spark.createDataFrame([(d,) for d in docs], "report string")).collect()) == ["a", "b", "c", "d"]


def test_hashing_pads_each_row_once():
    class Row(bytes):
        padded = 0

        def ljust(self, *x):
            Row.padded += 1
            return super().ljust(*x)

    rows = [Row(b"x" * n) for n in (0, 64, 65, 200, 1024)]
    assert hashing.blake3_many(rows) == [hashing.blake3(bytes(r)) for r in rows] and Row.padded == len(rows)
