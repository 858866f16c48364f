"""Which project holds which version, who is behind, who is not listed, and in which order to move."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.globs import glob_regex
from concord.functions.versions import normalize_version, version_key
from concord.operators.graphs import layers
from concord.operators.skew import lookup_join, spread_join


def newest(df: DataFrame, group: Sequence[str], version: str, out: str = "newest") -> DataFrame:
    """The newest version of each group, by number and not by text; of spellings of one version the last by text."""
    return df.groupBy(*group).agg(F.max_by(version, F.struct(version_key(F.col(version)).alias("key"), F.col(version).alias("text"))).alias(out))


def effective_level(declared: DataFrame, locked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``effective``: the lockfile's level, else the declared one."""
    locks = locked.groupBy(*keys).agg(F.min("locked").alias("locked"))
    return spread_join(declared, locks, keys).withColumn("effective", F.coalesce("locked", "level"))


def judge(observations: DataFrame, current: DataFrame) -> DataFrame:
    """Standing of each consumer and library.

    ``observations`` is (consumer, library, ord, own, level, locked, delivers, error, lag);
    ``current`` (library, newest). Any error: unread. Own declarations: unpinned, current or
    behind by the first one. Delivered only: unpinned where one names no level, else via-provider.
    ``level`` is the own one or the one that is delivered; where several are, it is null and
    ``delivered_levels`` has them as rows.
    """
    own, effective = F.col("own"), F.coalesce("locked", "level")
    rows = observations.groupBy("consumer", "library").agg(
        F.bool_or(F.col("error").isNotNull()).alias("_error"),
        F.bool_or(own).alias("_own"),
        F.min(F.when(own, F.struct("ord", effective.alias("level"))))["level"].alias("_level"),
        F.bool_or(~own & F.col("level").isNull()).alias("_unpinned"),
        F.min(F.when(~own, F.col("delivers"))).alias("_least"),
        F.max(F.when(~own, F.col("delivers"))).alias("_most"),
        F.max("lag").alias("lag"),
    )
    known = lookup_join(rows, current.select("library", "newest"), ["library"])
    same = normalize_version(F.col("_level")) == normalize_version(F.col("newest"))
    standing = (
        F.when(F.col("_error"), "unread")
        .when(F.col("_own"), F.when(F.col("_level").isNull(), "unpinned").when(F.coalesce(same, F.lit(False)), "current").otherwise("behind"))
        .when(F.col("_unpinned"), "unpinned")
        .otherwise("via-provider")
    )
    level = F.when(F.col("_error"), None).when(F.col("_own"), F.col("_level")).when(F.col("_least") == F.col("_most"), F.col("_least"))
    return known.select("consumer", "library", level.alias("level"), standing.alias("standing"), "lag")


def delivered_levels(observations: DataFrame, standings: DataFrame) -> DataFrame:
    """(consumer, library, delivers): a row for each level that reaches a consumer by its providers alone."""
    by_provider = standings.where("standing = 'via-provider'").select("consumer", "library")
    rows = observations.where("NOT own AND delivers IS NOT NULL").select("consumer", "library", "delivers").distinct()
    return spread_join(rows, by_provider, ["consumer", "library"], "left_semi")


def explain(standings: DataFrame) -> DataFrame:
    """Standings that lack a reason, and reasons that no longer hold."""
    state = F.when(F.col("standing").isin("behind", "unpinned") & F.col("lag").isNull(), "unexplained").when(
        (F.col("standing") == "current") & F.col("lag").isNotNull(), "stale reason"
    )
    return standings.withColumn("finding", state).where("finding IS NOT NULL")


def scoped_level(df: DataFrame, level: str, direct: Column, mapping: DataFrame) -> DataFrame:
    """Adds ``scoped``: the level itself at the direct entry point, else what it delivers."""
    delivered = mapping.select(F.col("version").alias(level), F.col("delivers").alias("_delivers"))
    joined = lookup_join(df, delivered, [level])
    return joined.withColumn("scoped", normalize_version(F.when(direct, F.col(level)).otherwise(F.col("_delivers")))).drop("_delivers")


def disagreements(declarations: DataFrame, governed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Levels that declarations of one agreement state when they should state one.

    Governed packages of a library are one release and share a key; any other package is its own.
    One row per level, so the disagreement is whole.
    """
    key = F.col("package")
    for library, packages in governed.items():
        key = F.when((F.col("library") == library) & F.col("package").isin(*packages), F.lit(f"{library}-release")).otherwise(key)
    stated = declarations.where("level IS NOT NULL").select("consumer", "library", key.alias("key"), normalize_version(F.col("level")).alias("level")).distinct()
    many = stated.groupBy("consumer", "library", "key").agg(F.count(F.lit(1)).alias("levels")).where("levels > 1")
    return spread_join(stated, many, ["consumer", "library", "key"], "inner")


def strangers(found: DataFrame, roster: DataFrame, unread: DataFrame, out_of_scope: Sequence[str]) -> DataFrame:
    """Holders of a dependency that the roster does not list, one row per declaration.

    Names fold case. A repository that could not be read is listed as such, never taken as clean.
    """
    known = roster.select(F.lower("repository").alias("_folded")).distinct()

    def unlisted(df: DataFrame) -> DataFrame:
        return spread_join(df.withColumn("_folded", F.lower("repository")), known, ["_folded"], "left_anti").drop("_folded")

    failed = unlisted(unread).select("repository", F.lit("unread").alias("finding"), F.lit(None).cast("string").alias("declaration")).distinct()
    held = found.where(~F.col("package").isin(*out_of_scope)).select("repository", "path", "package").distinct()
    readable = spread_join(held, unread.select("repository").distinct(), ["repository"], "left_anti")
    holders = unlisted(readable).select(
        "repository", F.lit("stranger").alias("finding"), F.concat_ws(": ", "path", "package").alias("declaration")
    ).distinct()
    return holders.unionByName(failed)


# Sections of a manifest that hold dependencies, and their names here.
SECTIONS = {
    "dependencies": "dependencies", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional",
}


def dependencies(files: DataFrame, keys: Sequence[str], json: str, packages: DataFrame) -> DataFrame:
    """Dependencies on packages of interest: (keys, section, package, requirement)."""
    schema = ", ".join(f"`{s}` MAP<STRING, STRING>" for s in SECTIONS)
    parsed = files.select(*keys, F.from_json(json, schema).alias("_m"))
    sections = F.array(*[F.struct(F.lit(name).alias("section"), F.col(f"_m.{s}").alias("held")) for s, name in SECTIONS.items()])
    rows = parsed.select(*keys, F.explode(sections).alias("_s")).select(*keys, "_s.section", F.explode("_s.held").alias("package", "requirement"))
    return lookup_join(rows, packages.select("package").distinct(), ["package"], "left_semi")


def disabled_schedules(schedules: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Schedules switched off for inactivity; what a person switched off is not a finding.
    Repositories that could not be listed are findings of their own."""
    bad = unreadable.select("repository").distinct()
    off = spread_join(schedules.where("state = 'disabled_inactivity'"), bad, ["repository"], "left_anti")
    return off.select("repository", "name", F.lit("disabled").alias("finding")).unionByName(
        bad.select("repository", F.lit(None).cast("string").alias("name"), F.lit("unreadable").alias("finding"))
    )


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, wave): a node comes one wave after the last of what it depends on (src needs dst). See ``layers``."""
    return layers(nodes, edges)


def order_gate(requests: DataFrame, releases: DataFrame) -> DataFrame:
    """Requests whose provider has no release at the level asked for."""
    held = releases.select("provider", "level").distinct()
    return spread_join(requests, held, ["provider", "level"], "left_anti")


def qualify(draft: Column, tag: Column, prerelease: Column, assets: Column) -> Column:
    """Why an entry is no release, the first reason that applies, or null."""
    return (
        F.when(draft, "draft")
        .when(~F.coalesce(tag.rlike(r"^v\d+\.\d+\.\d+$"), F.lit(False)), "tag is not exact")
        .when(prerelease, "prerelease")
        .when(assets == 0, "no assets")
    )


def awaiting(releases: DataFrame, version: str, newest_supported: str, records: DataFrame) -> DataFrame:
    """Releases newer than the newest supported one that have no record yet."""
    newer = releases.where(version_key(F.col(version)) > version_key(F.lit(newest_supported)))
    return newer.join(records.select(version).distinct(), version, "left_anti")


def pick_asset(assets: DataFrame, keys: Sequence[str], name: str, roles: Mapping[str, str], stated: str | None = None) -> DataFrame:
    """The one asset per role (a glob), with ``problem`` where there is not one.

    Builds are told apart by the system release in the name. A stated build must be there once;
    otherwise the oldest build is taken, and builds that cannot be told apart are a problem.
    """
    fits = F.filter(
        F.array(*[F.when(F.col(name).rlike(glob_regex(glob)), F.lit(role)) for role, glob in roles.items()]), lambda r: r.isNotNull()
    )
    numbers = F.transform(F.split(F.regexp_extract(name, r"[uU]buntu-?(\d+(?:\.\d+)*)", 1), r"\."), lambda n: n.try_cast("int"))
    build = F.when(F.col(name).rlike(r"[uU]buntu-?\d"), numbers)
    rows = assets.select(*keys, name, build.alias("_build"), F.explode(fits).alias("role"))
    if stated is not None:
        wanted = F.array(*[F.lit(int(n)) for n in stated.split(".")])
        hits = rows.groupBy(*keys, "role").agg(
            F.count_if(F.col("_build") == wanted).alias("_n"), F.min(F.when(F.col("_build") == wanted, F.col(name))).alias("asset")
        )
        fine = F.col("_n") == 1
    else:
        hits = rows.groupBy(*keys, "role").agg(
            F.count(F.lit(1)).alias("_n"), F.count("_build").alias("_b"), F.countDistinct("_build").alias("_d"), F.min(name).alias("_only"),
            F.min_by(name, "_build").alias("_oldest"),
        )
        hits = hits.withColumn("asset", F.when(F.col("_n") == 1, F.col("_only")).otherwise(F.col("_oldest")))
        fine = (F.col("_n") == 1) | ((F.col("_b") == F.col("_n")) & (F.col("_d") == F.col("_n")))
    return hits.select(
        *keys, "role", F.when(fine, F.col("asset")).alias("asset"), F.when(~fine, F.concat("_n", F.lit(" assets fit"))).alias("problem")
    )


def drift(recorded: DataFrame, live: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Recorded sources that changed or are no longer published."""
    now = live.select(*keys, F.struct(*cols).alias("_now"))
    joined = recorded.select(*keys, F.struct(*cols).alias("_then")).join(now, list(keys), "left")
    state = F.when(F.col("_now").isNull(), "no longer published").when(~F.col("_now").eqNullSafe(F.col("_then")), "changed")
    return joined.select(*keys, state.alias("change")).where("change IS NOT NULL")


# Review states that replace an earlier verdict, and names of machine accounts.
VERDICTS = ("APPROVED", "CHANGES_REQUESTED", "DISMISSED")
BOT = r"\[bot\]$|^github-actions$"


def standing_approval(reviews: DataFrame, heads: DataFrame, request: str) -> DataFrame:
    """The newest standing approval of each request's current head by a person.

    ``reviews`` is (request, ord, login, state, commit, at). The last verdict of each person in
    listing order counts, and only when it approves the head.
    """
    deciding = reviews.where(F.col("login").isNotNull() & ~F.col("login").rlike(BOT) & F.col("state").isin(*VERDICTS))
    # A plain aggregation: one person may hold any share of the reviews.
    last = deciding.groupBy(request, "login").agg(F.max(F.struct("ord", "state", "commit", "at")).alias("_v"))
    approved = last.where("_v.state = 'APPROVED'")
    standing = spread_join(approved, heads.select(request, "head"), [request], "inner").where("_v.commit = head")
    return standing.groupBy(request).agg(F.max(F.struct("_v.at", "login")).alias("_a")).select(
        request, F.col("_a.login").alias("by"), F.col("_a.at").alias("at")
    )
