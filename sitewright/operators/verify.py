"""Checks of a deployed site against its package, and of one audit against another.

Inputs are tables: live responses (as html.page_records gives them, with links, ld and text), the package's files, the
expected drafts.  Each check is one row (id, status, evidence); what was not looked at makes a check warn or skip,
never pass."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import robots as R
from ..functions import text as X
from ..functions import urls as U
from ..sources import html
from . import diff, rules

CAP = 20


def _row(one: DataFrame, check: str, verdict: Column, /, **evidence) -> DataFrame:
    """One check from one row of counters."""
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.col(v).cast("string"))]
    none = F.expr("cast(map() as map<string,string>)")
    return one.select(F.lit(check).alias("id"), verdict.alias("status"), (F.create_map(*pairs) if pairs else none).alias("evidence"))


def _sample(c: Column) -> Column:
    return F.array_join(F.slice(F.array_sort(F.collect_set(c)), 1, CAP), " ")


def summary(checks: DataFrame) -> DataFrame:
    """Counts of the four statuses, 0 where none."""
    return checks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in C.CHECK_ORDER])


def incomplete(checks: DataFrame) -> DataFrame:
    """check, kind, n of what a run left unlooked at."""
    kinds = F.array(F.lit("remaining"), F.lit("unverified"))
    rows = checks.select("id", F.explode(kinds).alias("kind"), "evidence").select("id", "kind", F.expr("try_cast(evidence[kind] as bigint)").alias("n"))
    return rows.where("n > 0").groupBy("id", "kind").agg(F.max("n").alias("n"))


def exit_code(checks: DataFrame) -> int:
    """1 if a check failed, 2 if all passed but something was left out, else 0."""
    if summary(checks).first()["fail"]:
        return 1
    return 2 if incomplete(checks).limit(1).count() else 0


def noindex_check(expected: DataFrame, live: DataFrame, before: DataFrame) -> DataFrame:
    """expected: urls that should be indexed; before: urls that had noindex already."""
    now = F.array_contains(R.directives("meta_robots", F.lit(None).cast("string"), "x_robots_tag"), "noindex")
    seen = expected.select("url").join(live.select("url", (F.col("status") == 200).alias("ok"), now.alias("now")), "url", "left").join(before.select("url", F.lit(True).alias("was")), "url", "left")
    fresh = F.coalesce(F.col("ok") & F.col("now") & F.col("was").isNull(), F.lit(False))
    one = seen.agg(F.count_if(F.coalesce("ok", F.lit(False))).alias("checked"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("unverified"), F.count_if(fresh).alias("new"), _sample(F.when(fresh, F.col("url"))).alias("urls"))
    status = F.when((F.col("new") > 0) | (F.col("checked") == 0), "fail").when(F.col("unverified") > 0, "warn").otherwise("pass")
    return _row(one, "noindex", status, checked="checked", unverified="unverified", urls="urls")


def robots_checks(live: DataFrame, original: DataFrame, package: DataFrame) -> DataFrame:
    """Each table has at most one row (raw; live also status, present)."""
    one = live.select("status", "present", F.col("raw").alias("live"))
    status = _row(one, "robots.status", F.when(F.col("present"), "pass").otherwise("fail"), status="status")
    lines = lambda t: t.select(F.explode(F.split(F.coalesce("raw", F.lit("")), "\n")).alias("l")).select(X.collapse("l").alias("line")).where("line <> ''").distinct()
    has_original = original.agg(F.count_if(X.falsy("raw", F.lit(None)).isNotNull()).alias("had"))
    lost = lines(original).join(lines(live), "line", "left_anti").agg(F.count("*").alias("lost"), _sample(F.col("line")).alias("lines"))
    kept = has_original.crossJoin(F.broadcast(lost))  # one row each
    preserved = _row(kept, "robots.preserved", F.when(F.col("had") == 0, "skip").when(F.col("lost") > 0, "fail").otherwise("pass"), lost="lost", lines="lines")
    agents = live.sparkSession.createDataFrame([("s", u) for g in C.CRAWLERS.values() for u in g], "site string, ua string")
    policy = lambda t, n: R.policies(R.rules_table(t.select(F.lit("s").alias("site"), F.coalesce("raw", F.lit("")).alias("raw"))), agents).select("ua", F.col("policy").alias(n))
    had_package = package.agg(F.count_if(X.falsy("raw", F.lit(None)).isNotNull()).alias("had"))
    wrong = policy(package, "p").join(policy(live, "l"), "ua").where("p <> l").agg(F.count("*").alias("wrong"), _sample(F.concat_ws("=", "ua", "l")).alias("agents"))
    both = had_package.crossJoin(F.broadcast(wrong))
    policies = _row(both, "robots.policy", F.when(F.col("had") == 0, "skip").when(F.col("wrong") > 0, "fail").otherwise("pass"), wrong="wrong", agents="agents")
    declared = _row(one.withColumn("n", F.size(R.declared_sitemaps("live"))), "robots.sitemap", F.when(F.col("n") > 0, "pass").otherwise("fail"), declared="n")
    return reduce(DataFrame.unionByName, (status, preserved, policies, declared))


def sitemap_checks(locs: DataFrame, live: DataFrame, host: str, coverage: DataFrame) -> DataFrame:
    """locs (url, pos); coverage: one row (files, reachable, remaining, limit_urls)."""
    bare = lambda c: F.regexp_replace(c, r"/+\z", "")
    own = locs.where(U.host_of("url") == host).groupBy(U.normalize("url").alias("url")).agg(F.min("pos").alias("pos"))
    off = locs.agg(F.count_if(U.host_of("url") != host).alias("off"), F.count("*").alias("locs"))
    pages = live.select(F.col("url"), F.col("status"), F.col("final_url"), "canonical", F.array_contains(R.directives("meta_robots", F.lit(None).cast("string"), "x_robots_tag"), "noindex").alias("noindex"))
    seen = own.join(pages, "url", "left")
    alive = F.coalesce(F.col("status") == 200, F.lit(False))
    odd = alive & ((bare(U.normalize("final_url")) != bare(F.col("url"))) | (~rules.missing("canonical") & (bare(U.normalize("canonical")) != bare(U.normalize("final_url")))))
    flags = {"dead": F.col("status").isNotNull() & ~alive, "noindex_n": alive & F.col("noindex"), "odd": F.coalesce(odd, F.lit(False)), "unverified": F.col("status").isNull()}
    one = seen.agg(F.count("*").alias("own"), F.count_if(alive).alias("checked"), *[F.count_if(t).alias(n) for n, t in flags.items()], *[_sample(F.when(t, F.col("url"))).alias(f"{n}_urls") for n, t in flags.items()])
    one = one.crossJoin(F.broadcast(off)).crossJoin(F.broadcast(coverage))  # one row each
    none = F.col("files") == 0
    ladder = lambda bad: F.when(none | (F.col("own") == 0), "skip").when(F.col(bad) > 0, "fail").when(F.col("unverified") > 0, "warn").otherwise("pass")
    return reduce(DataFrame.unionByName, (
        _row(one, "sitemap.reachable", F.when(none, "skip").when(F.col("reachable") < F.col("files"), "fail").when(F.col("remaining") > 0, "warn").otherwise("pass"), remaining="remaining", files="files"),
        _row(one, "sitemap.host", F.when(none, "skip").when(F.col("off") > 0, "warn").otherwise("pass"), off="off"),
        _row(one, "sitemap.locs", ladder("dead"), unverified="unverified", urls="dead_urls"), _row(one, "sitemap.noindex", ladder("noindex_n"), unverified="unverified", urls="noindex_n_urls"),
        _row(one, "sitemap.canonical", ladder("odd"), unverified="unverified", urls="odd_urls")))


def llms_checks(live: DataFrame, package: DataFrame) -> DataFrame:
    """One row each at most: live (status, body), package (body)."""
    had = package.agg(F.count("*").alias("had"), F.coalesce(F.max(F.regexp_count("body", F.lit(C.TODO))), F.lit(0)).alias("todo_package"))
    now = live.agg(F.max("status").alias("status"), F.coalesce(F.max(F.regexp_count("body", F.lit(C.TODO))), F.lit(0)).alias("todo"))
    one = had.crossJoin(F.broadcast(now))
    good = F.col("status") == 200
    status = _row(one, "llms.status", F.when(F.col("had") == 0, "skip").when(F.coalesce(good, F.lit(False)), "pass").otherwise("fail"), status="status")
    todo = _row(one, "llms.todo", F.when((F.col("had") == 0) | ~F.coalesce(good, F.lit(False)), "skip").when(F.col("todo") > 0, "fail").otherwise("pass"), todo="todo")
    return status.unionByName(todo)


def ld_targets(files: DataFrame, manifest: DataFrame | None, pages: DataFrame, home: str) -> DataFrame:
    """name, url of the package's JSON-LD files: by the manifest if there is one, even if it is empty; else by the page's
    file name, and the organisation's file by the home page."""
    if manifest is not None:
        return files.select("name").join(manifest.select("name", "url"), "name", "left")
    by_slug = pages.select(F.concat(U.slug("url"), F.lit(".json")).alias("name"), F.col("url"))
    known = files.select("name").join(by_slug, "name", "left")
    return known.withColumn("url", F.coalesce("url", F.when(F.col("name").isin("organization.json", "website.json"), F.lit(home))))


def jsonld_checks(package: DataFrame, targets: DataFrame, live: DataFrame, has_manifest: bool) -> DataFrame:
    """package: html.ld_table of the files with url = file name; live: pages with url, ld, text."""
    now = html.ld_table(live)
    want = package.withColumnRenamed("url", "name").join(targets, "name", "left")
    mapped = want.where("url is not null")
    found = mapped.join(now.where("valid").select("url", "identity", F.lit(True).alias("found")).distinct(), ["url", "identity"], "left")
    text = live.select("url", F.coalesce("text", F.lit("")).alias("text"))
    shown = mapped.select("url", F.explode("visible").alias("needle")).join(text, "url")
    unseen = shown.where(~F.exists(X.price_forms("needle"), lambda n: F.col("text").contains(n))).agg(F.count("*").alias("unseen"), _sample(F.concat_ws(" ", "url", "needle")).alias("needles"))
    ids = now.select("url", F.explode("org_ids").alias("org")).agg(F.count_distinct("org").alias("orgs"))
    broken = now.agg(F.count_if(~F.col("valid")).alias("broken"))
    one = want.agg(F.count("*").alias("files"), F.count_if(F.col("url").isNull()).alias("unmapped")).crossJoin(F.broadcast(found.agg(F.count_if(F.col("found").isNull()).alias("absent"), _sample(F.when(F.col("found").isNull(), F.col("url"))).alias("absent_urls"))))
    for t in (unseen, ids, broken):
        one = one.crossJoin(F.broadcast(t))  # one row each
    none = F.col("files") == 0
    bad = (F.col("absent") > 0) | (F.col("broken") > 0)
    return reduce(DataFrame.unionByName, (
        _row(one, "jsonld.present", F.when(none, "skip").when(F.col("absent") > 0, "fail").otherwise("pass"), absent="absent", urls="absent_urls"),
        _row(one, "jsonld.mapping", F.when(none, "skip").when(F.col("unmapped") > 0, "fail" if has_manifest else "warn").otherwise("pass"), unmapped="unmapped"),
        _row(one, "jsonld.type", F.when(none, "skip").when(bad, "fail").otherwise("pass"), broken="broken"),
        _row(one, "jsonld.visible", F.when(none, "skip").when(F.col("unseen") > 0, "fail").when(bad, "skip").otherwise("pass"), unseen="unseen", needles="needles"),
        _row(one, "jsonld.org_id", F.when(F.col("orgs") > 1, "fail").when(F.col("orgs") == 0, "skip").otherwise("pass"), ids="orgs")))


DRAFT_FIELDS = {"draft_title": "title", "draft_description": "meta_description", "draft_canonical": "canonical"}


def meta_checks(drafts: DataFrame, live: DataFrame) -> DataFrame:
    """Finished drafts (without the TODO mark) against the live page, space aside."""
    seen = drafts.select("url", *DRAFT_FIELDS).join(live.select("url", (F.col("status") == 200).alias("ok"), *DRAFT_FIELDS.values()), "url", "left")
    fields = F.filter(F.array(*[F.struct(F.lit(v).alias("field"), F.col(k).alias("want"), F.col(v).alias("have")) for k, v in DRAFT_FIELDS.items()]), lambda x: X.falsy(x["want"], F.lit(None)).isNotNull() & ~x["want"].contains(C.TODO))
    rows = seen.select("url", F.coalesce("ok", F.lit(False)).alias("ok"), F.explode(fields).alias("f"))
    same = X.collapse("f.want") == X.collapse(F.coalesce("f.have", F.lit("")))
    one = rows.agg(F.count_if(F.col("ok")).alias("checked"), F.count_if(~F.col("ok")).alias("unverified"), F.count_if(F.col("ok") & ~same).alias("misses"), _sample(F.when(F.col("ok") & ~same, F.concat_ws(" ", "url", "f.field"))).alias("fields"))
    status = F.when((F.col("checked") == 0) & (F.col("unverified") == 0), "skip").when(F.col("misses") > 0, "fail").when(F.col("unverified") > 0, "warn").otherwise("pass")
    applied = _row(one, "meta.applied", status, misses="misses", unverified="unverified", fields="fields")
    again = rules.duplicated(live.where("status = 200"), "title").agg(F.count("*").alias("groups"), _sample(F.col("title")).alias("titles"))
    return applied.unionByName(_row(again, "meta.duplicate", F.when(F.col("groups") > 0, "fail").otherwise("pass"), groups="groups", titles="titles"))


def diff_checks(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Six checks of two audits, each a dict of tables: findings (with pos), stats (key, value), pages, scorecard (lane, status)."""
    spark = before["findings"].sparkSession
    f = diff.finding_diff(*[diff.findings_by_code(x["findings"]).select("code", "severity", "urls") for x in (before, after)])
    critical = F.col("severity_after") == "critical"
    grew = (F.col("state") == "persisting") & (F.col("urls_after") > F.col("urls_before"))
    n = lambda s: F.count_if(F.col("state") == s)
    one = f.agg(n("resolved").alias("resolved"), n("new").alias("new"), n("persisting").alias("persisting"), F.count_if((F.col("state") == "new") & critical).alias("new_critical"), F.count_if((F.col("state") == "persisting") & critical).alias("old_critical"), F.count_if(grew).alias("grew"), *[_sample(F.when(F.col("state") == s, F.col("code"))).alias(f"{s}_codes") for s in ("resolved", "new", "persisting")])
    lanes = diff.lane_diff(rules.lanes(spark).select("lane"), before["scorecard"], after["scorecard"]).agg(F.count_if("worse").alias("worse"), _sample(F.when(F.col("worse"), F.col("lane"))).alias("lanes"))
    stats = diff.stats_diff(before["stats"], after["stats"]).agg(F.count_if(F.col("change") != 0).alias("changed"))
    pages = diff.page_diff(before["pages"], after["pages"]).agg(n("gone").alias("gone"), n("new").alias("added"), _sample(F.when(F.col("state") == "gone", F.col("url"))).alias("urls"))
    return reduce(DataFrame.unionByName, (
        _row(one, "diff.resolved", F.lit("pass"), n="resolved", codes="resolved_codes"), _row(one, "diff.new", F.when(F.col("new_critical") > 0, "fail").when(F.col("new") > 0, "warn").otherwise("pass"), n="new", codes="new_codes"),
        _row(one, "diff.persisting", F.when((F.col("old_critical") > 0) | (F.col("grew") > 0), "warn").otherwise("pass"), n="persisting", grew="grew", codes="persisting_codes"),
        _row(lanes, "diff.scorecard", F.when(F.col("worse") > 0, "fail").otherwise("pass"), worse="worse", lanes="lanes"), _row(stats, "diff.stats", F.lit("pass"), changed="changed"),
        _row(pages, "diff.pages", F.when(F.col("gone") > 0, "warn").otherwise("pass"), gone="gone", added="added", urls="urls")))
