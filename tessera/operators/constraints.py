"""Relational parts of dependency constraints: range joins, classes of equal releases, closures, solutions.

Tables: releases (package, version), requirements (package, version, pos, target, range) and roots (target, range),
with versions and ranges as in tessera.functions.versions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.versions import contains
from tessera.operators.lineage import cut
from tessera.operators.numbering import running_count


#: Releases in a bin, and spans of requirements that meet a bin in one task.
BIN, SPANS = 1024, 4096
#: Pairs that one ask makes in a task, about, and rows of a table that may be broadcast.
MADE, FEW = 1_000_000, 100_000
#: Before and after all versions.
LEAST = "struct(struct(-1L AS major, -1L AS minor, -1L AS patch) AS version, 0 AS side)"
MOST = "struct(struct(9223372036854775807L AS major, 0L AS minor, 0L AS patch) AS version, 2 AS side)"


def spans_of(range_: str) -> Column:
    """The disjoint intervals that a range admits, as an array of (start, end).

    A place is (version, side): side 0 is just before the version, 2 just after it. Bounds cut from either end, and every != cuts
    one version out of the middle.
    """
    at = lambda ops, after: f"transform(filter({range_}, c -> c.op IN ({ops})), c -> struct(c.version AS version, IF(c.op IN ({after}), 2, 0) AS side))"
    low = f"array_max(concat(array({LEAST}), {at("'>=', '>', '=='", "'>'")}))"
    high = f"array_min(concat(array({MOST}), {at("'<=', '<', '=='", "'<=', '=='")}))"
    holes = f"array_sort(array_distinct(transform(filter({range_}, c -> c.op = '!='), c -> c.version)))"
    starts = f"concat(array({low}), transform({holes}, v -> greatest({low}, struct(v AS version, 2 AS side))))"
    ends = f"concat(transform({holes}, v -> least({high}, struct(v AS version, 0 AS side))), array({high}))"
    return F.expr(f"filter(zip_with({starts}, {ends}, (s, e) -> struct(s AS start, e AS end)), p -> p.start < p.end)")


def ordinal_spans(requirements: DataFrame, releases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: the distinct (target, range) with a number `ask`; ask, low, high: the spans of ordinals from low to before
    high that it admits, none of them empty; ordinal, version of the releases.

    Ordinals number all releases by package and version, so a package's are contiguous. The ends of the intervals are put in
    line with the releases, and a running count over ranges of that line gives each end its ordinal: no package meets in
    one task, and no requirement meets a release yet.
    """
    asks = cut(requirements.select("target", "range").where("target IS NOT NULL AND range IS NOT NULL").distinct().withColumn("ask", F.monotonically_increasing_id()))
    ends = asks.select("ask", "target", F.posexplode(spans_of("range")).alias("part", "span"))
    ends = ends.select("ask", "part", F.col("target").alias("package"), F.explode(F.array(F.struct(F.col("span.start").alias("at"), F.lit(0).alias("end")), F.struct(F.col("span.end").alias("at"), F.lit(1).alias("end")))).alias("e"))
    ends = ends.select("package", "e.at.version", "e.at.side", "ask", "part", "e.end")
    offered = releases.select("package", "version", F.lit(1).alias("side"), F.lit(None).cast("long").alias("ask"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("end"))
    line = running_count(offered.unionByName(ends), "ordinal", F.when(F.col("side") == 1, 1).otherwise(0), ["package", "version", "side", "ask", "part", "end"])
    pick = lambda end: F.max(F.when(F.col("end") == end, F.col("ordinal")))
    spans = line.where("ask IS NOT NULL").groupBy("ask", "part").agg(pick(0).alias("low"), pick(1).alias("high")).where("low < high")
    return asks, spans.select("ask", "low", "high"), line.where("side = 1").select("ordinal", "version")


def matches(requirements: DataFrame, releases: DataFrame, bin_size: int = BIN, share: int = SPANS) -> DataFrame:
    """Each requirement with each release of its target that it admits, in column `found`.

    A range join by bins: releases are gathered into bins of `bin_size` ordinals, spans ask for the bins that they meet, and a span takes
    from a bin the slice that is its own, so only admitted pairs come out. A bin that many spans ask for is copied for
    every `share` of them, so neither a package with many releases nor a range that many have makes a large task. Slices stay
    arrays until they meet the requirements, which are dealt by the pairs that they make.
    """
    asks, spans, placed = ordinal_spans(requirements, _offered(requirements, releases))
    spans = cut(spans)
    bins = placed.groupBy(F.expr(f"ordinal div {bin_size}").alias("bin")).agg(F.min("ordinal").alias("first"), F.sort_array(F.collect_list(F.struct("ordinal", "version"))).alias("held"))
    wanted = spans.withColumn("bin", F.explode(F.expr(f"sequence(low div {bin_size}, (high - 1) div {bin_size})")))
    wanted = wanted.withColumn("part", F.expr(f"pmod(xxhash64(ask, low), {PARTS})"))
    # a bin's share of the PARTS: as many copies as it takes for `share` spans each
    copies = wanted.groupBy("bin").agg(F.least(F.lit(PARTS), F.ceil(F.count(F.lit(1)) / share)).cast("int").alias("copies"))
    wanted = wanted.join(copies, "bin").withColumn("copy", F.expr("pmod(part, copies)")).drop("part", "copies")
    bins = bins.join(copies, "bin").withColumn("copy", F.explode(F.expr("sequence(0, copies - 1)"))).drop("copies")
    inside = F.expr("slice(held, CAST(greatest(low - first, 0) + 1 AS INT), CAST(least(high - first, size(held)) - greatest(low - first, 0) AS INT)).version")
    slices = wanted.join(bins, ["bin", "copy"]).select("ask", inside.alias("__slice"))
    return _dealt(_asked(requirements, asks), spans, slices).select(*requirements.columns, F.explode("__slice").alias("found"))


def _offered(requirements: DataFrame, releases: DataFrame) -> DataFrame:
    """The releases of packages that are asked for, made once; all releases where those packages are too many to be broadcast."""
    targets = cut(requirements.select(F.col("target").alias("package")).where("package IS NOT NULL").distinct())
    return cut(releases.join(F.broadcast(targets), "package", "left_semi") if targets.count() <= FEW else releases)


def _dealt(asked: DataFrame, spans: DataFrame, slices: DataFrame) -> DataFrame:
    """`asked` with each slice of its ask, in partitions counted by the pairs to come, not by the bytes that are joined.

    An ask that makes more than MADE pairs is dealt into copies of its slices, for 8 requirements each at least.
    """
    sizes = spans.groupBy("ask").agg(F.sum(F.col("high") - F.col("low")).alias("m")).join(asked.groupBy("ask").agg(F.count(F.lit(1)).alias("n")), "ask")
    sizes = cut(sizes.select("ask", (F.col("n") * F.col("m")).alias("made"), F.least(F.ceil(F.col("n") * F.col("m") / MADE), F.ceil(F.col("n") / 8)).cast("int").alias("__copies")))
    made, n = sizes.agg(F.coalesce(F.sum("made"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(made / MADE))
    copies = sizes.select("ask", "__copies")
    copies = F.broadcast(copies) if n <= FEW else copies
    hashed = [c for c, kind in asked.dtypes if "map<" not in kind]
    left = asked.join(copies, "ask").withColumn("__copy", F.pmod(F.xxhash64(*hashed), "__copies").cast("int")).drop("__copies")
    right = slices.join(copies, "ask").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).drop("__copies")
    return left.repartition(parts, "ask", "__copy").join(right.repartition(parts, "ask", "__copy"), ["ask", "__copy"])


#: Copies of a bin at most.
PARTS = 1 << 16


def _asked(requirements: DataFrame, asks: DataFrame) -> DataFrame:
    """`requirements` with the number of their target and range."""
    few = F.broadcast(asks) if asks.count() <= FEW else asks
    return requirements.join(few, ["target", "range"]).select(*requirements.columns, "ask")


def newest_match(requirements: DataFrame, releases: DataFrame, by: list[str]) -> DataFrame:
    """The newest admitted release of each requirement, null if there is none; `by` names the requirement.

    It is the last release of the last span: one row for each distinct range, no pairs.
    """
    asks, spans, placed = ordinal_spans(requirements, _offered(requirements, releases))
    last = spans.groupBy("ask").agg((F.max("high") - 1).alias("ordinal")).join(placed, "ordinal").select("ask", F.col("version").alias("found"))
    best = _asked(requirements, asks).join(last, "ask").groupBy(*by).agg(F.max("found").alias("newest"))
    return requirements.join(best, by, "left")


def newest_first(releases: DataFrame) -> DataFrame:
    """Releases with their rank, 1 for the newest of a package."""
    return releases.withColumn("rank", F.row_number().over(Window.partitionBy("package").orderBy(F.col("version").desc())).cast("long"))


def signature_classes(releases: DataFrame, tests: DataFrame) -> DataFrame:
    """package, signature, newest, n: releases that meet the same ones of `tests` (test, target, range) are alike,
    and the newest stands for them."""
    met = matches(tests, releases).groupBy(F.col("target").alias("package"), F.col("found").alias("version")).agg(F.sort_array(F.collect_set("test")).alias("signature"))
    rows = releases.join(met, ["package", "version"], "left").withColumn("signature", F.coalesce("signature", F.array().cast("array<string>")))
    return rows.groupBy("package", "signature").agg(F.max("version").alias("newest"), F.count(F.lit(1)).alias("n"))


def contiguous_runs(releases: DataFrame, flag: str) -> DataFrame:
    """package, first, last, n: maximal runs, in the order of versions, of releases for which `flag` holds."""
    order = Window.partitionBy("package").orderBy("version")
    rows = releases.withColumn("__at", F.row_number().over(order)).where(F.col(flag))
    rows = rows.withColumn("__run", F.col("__at") - F.row_number().over(order))
    return rows.groupBy("package", "__run").agg(F.min("version").alias("first"), F.max("version").alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")


def learned_window(releases: DataFrame, requirements: DataFrame) -> DataFrame:
    """package, target, allowed: if every release of a package asks for a target, the target's versions that at
    least one of them admits; several requirements of one release must all admit a version.

    Releases of a package that ask for a target in the same ranges are one, so pairs are made for each set of ranges only.
    """
    asks = requirements.groupBy("package", "version", "target").agg(F.collect_set("range").alias("ranges"), F.count_if(F.col("range").isNull()).alias("broken"))
    every = asks.groupBy("package", "target").agg(F.count(F.lit(1)).alias("n")).join(releases.groupBy("package").agg(F.count(F.lit(1)).alias("n")), ["package", "n"]).select("package", "target")
    # no version meets a requirement without a range
    sets = cut(asks.where("broken = 0").join(every, ["package", "target"]).select("package", "target", F.array_sort("ranges").alias("ranges")).distinct().withColumn("set", F.monotonically_increasing_id()))
    admitted = matches(sets.select("set", "target", F.explode("ranges").alias("range")), releases.distinct())
    met = admitted.groupBy("set", "found").agg(F.count(F.lit(1)).alias("met")).join(sets.select("set", "package", "target", F.size("ranges").alias("met")), ["set", "met"])
    return met.groupBy("package", "target").agg(F.sort_array(F.collect_set("found")).alias("allowed"))


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node: all that `starts` (node) reach over `edges` (src, dst), themselves included; cycles are allowed.

    A frontier loop: each round joins only what the last one found and drops what is known, so a round's cost follows
    its new nodes; the driver sees a count.
    """
    known = frontier = cut(starts.select("node").distinct())
    while True:
        step = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(known, "node", "left_anti"))
        if not frontier.limit(1).count():
            return known
        known = cut(known.unionByName(frontier))


def reach_doubling(edges: DataFrame, depth: int) -> DataFrame:
    """src, dst over paths of up to `depth` edges in log2(depth) joins: for chains too deep for one join a level."""
    reach = cut(edges.select("src", "dst").distinct())
    length = 1
    while length < depth:
        longer = reach.alias("a").join(reach.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        reach, length = cut(reach.unionByName(longer).distinct()), length * 2
    return reach


def fact_problems(facts: DataFrame, releases: DataFrame, requirements: DataFrame) -> DataFrame:
    """fact, problem of facts (fact, package, version, target, range): unpublished releases, and requirements that a
    release does not have in that very form."""
    unpublished = facts.join(releases, ["package", "version"], "left_anti").select("fact", F.lit("unpublished").alias("problem"))
    published = facts.join(releases, ["package", "version"], "left_semi")
    unknown = published.join(requirements, ["package", "version", "target", "range"], "left_anti").select("fact", F.lit("not required").alias("problem"))
    return unpublished.unionByName(unknown)


def assignments(releases: DataFrame, group: str) -> DataFrame:
    """group, chosen (map of package to version): every choice of a release, or of none, for each package.

    This enumerates, so it is for small universes: CAP choices in each at most.
    """
    sizes = releases.groupBy(group, "package").agg(F.log(F.count(F.lit(1)) + 1).alias("l")).groupBy(group).agg(F.exp(F.sum("l")).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) > CAP:
        raise ValueError(f"over {CAP} choices")
    kind = "map<string,struct<major:bigint,minor:bigint,patch:bigint>>"
    none = F.create_map().cast(kind)
    one = releases.groupBy(group, "package").agg(F.concat(F.array(none), F.collect_list(F.create_map("package", "version").cast(kind))).alias("options"))
    product = F.aggregate("all", F.array(none), lambda done, options: F.flatten(F.transform(done, lambda m: F.transform(options, lambda o: F.map_concat(m, o)))))
    return one.groupBy(group).agg(F.collect_list("options").alias("all")).select(group, F.explode(product).alias("chosen"))


#: Choices that an enumeration may have.
CAP = 400_000


def _key(package, version):
    return F.concat(package, F.lit("/"), F.to_json(version))


def _with_tables(choices: DataFrame, requirements: DataFrame, roots: DataFrame, group: str) -> DataFrame:
    """Choices with their universe's requirements, as a map from release to (t, r), and its roots, as an array."""
    one = requirements.groupBy(group, _key(F.col("package"), F.col("version")).alias("key")).agg(F.collect_list(F.struct(F.col("target").alias("t"), F.col("range").alias("r"))).alias("asks"))
    needs = one.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("key", "asks"))).alias("needs"))
    asked = roots.groupBy(group).agg(F.collect_list(F.struct(F.col("target").alias("t"), F.col("range").alias("r"))).alias("asked"))
    return choices.join(needs, group, "left").join(asked, group)


def _asks(package, version):
    """The requirements of a release in the row's universe."""
    return F.coalesce(F.element_at("needs", _key(package, version)), F.slice("asked", 1, 0))


def valid_assignments(choices: DataFrame, requirements: DataFrame, roots: DataFrame, group: str) -> DataFrame:
    """The choices that meet all roots and requirements and hold nothing that is not asked for; a check inside each row."""
    rows = _with_tables(choices, requirements, roots, group)
    met = lambda a: F.map_contains_key("chosen", a["t"]) & F.coalesce(contains(a["r"], F.element_at("chosen", a["t"])), F.lit(False))
    edges = F.flatten(F.transform(F.map_entries("chosen"), lambda e: _asks(e["key"], e["value"])))
    targets = lambda known: F.flatten(F.transform(F.filter(F.map_entries("chosen"), lambda e: F.array_contains(known, e["key"])), lambda e: F.transform(_asks(e["key"], e["value"]), lambda a: a["t"])))
    reached = F.aggregate(F.sequence(F.lit(0), F.size("chosen")), F.array_distinct(F.col("asked.t")), lambda known, _: F.array_union(known, targets(known)))
    good = F.forall("asked", met) & F.forall(edges, met) & (F.size(F.array_except(F.map_keys("chosen"), reached)) == 0)
    return rows.where(good).select(group, "chosen")


def preferred(valid: DataFrame, requirements: DataFrame, roots: DataFrame, group: str) -> DataFrame:
    """group, package, version: of the valid choices the one that the law names.

    A choice fixes the order in which its packages are decided. Where the orders of two choices first differ in a
    version, they have decided the same before, so they decide the same package there, and the newer release is
    preferred: the law's choice is the one whose versions, in the order of the decisions, are largest.
    """
    rows = _with_tables(valid, requirements, roots, group)
    start = F.struct(F.array_distinct(F.col("asked.t")).alias("needed"), F.slice(F.map_keys("chosen"), 1, 0).alias("decided"), F.slice(F.map_values("chosen"), 1, 0).alias("versions"))

    def decide(s, _):
        package = F.array_min(F.array_except(s["needed"], s["decided"]))
        version = F.element_at("chosen", package)
        needed = F.array_union(s["needed"], F.transform(_asks(package, version), lambda a: a["t"]))
        return F.struct(needed.alias("needed"), F.concat(s["decided"], F.array(package)).alias("decided"), F.concat(s["versions"], F.array(version)).alias("versions"))

    order = F.aggregate(F.sequence(F.lit(1), F.size("chosen")), start, decide, lambda s: F.struct(s["versions"].alias("versions"), s["decided"].alias("decided")))
    best = rows.where(F.size("chosen") > 0).groupBy(group).agg(F.max(order).alias("b"))
    pairs = F.explode(F.arrays_zip(F.col("b.decided").alias("package"), F.col("b.versions").alias("version")))
    return best.select(group, pairs.alias("p")).select(group, F.col("p.package").alias("package"), F.col("p.version").alias("version"))


def untrue_facts(facts: DataFrame, releases: DataFrame, requirements: DataFrame) -> DataFrame:
    """fact of those facts (fact, package, versions, target, range) that the registry does not bear out: a release of the package
    in `versions` has no requirement on the target, or its requirements together admit a release of it that `range` does not."""
    covered = cut(matches(facts.select("fact", F.col("package").alias("target"), F.col("versions").alias("range"), F.col("target").alias("on")), releases).select("fact", F.col("target").alias("package"), F.col("found").alias("version"), F.col("on").alias("target")))
    declared = cut(covered.join(requirements.select("package", "version", "target", "range").distinct(), ["package", "version", "target"]))
    silent = covered.join(declared, ["fact", "version"], "left_anti").select("fact")
    asked = declared.groupBy("fact", "version").agg(F.count(F.lit(1)).alias("asked"))
    met = matches(declared, releases).groupBy("fact", "version", "found").agg(F.count(F.lit(1)).alias("met"))
    really = met.join(asked, ["fact", "version"]).where("met = asked").select("fact", "found").distinct()
    escapes = really.join(matches(facts.select("fact", "target", "range"), releases), ["fact", "found"], "left_anti")
    return silent.unionByName(escapes.select("fact")).distinct()


def explanation_problems(facts: DataFrame, releases: DataFrame, requirements: DataFrame, roots: DataFrame, group: str) -> DataFrame:
    """group, problem, fact: what is wrong with explanations of why universes have no solution.

    Facts are group, fact, package, versions, target, range; a fact without a package cites a root. E2: a cited root that nobody
    asked for; E3: a fact that is untrue of the registry. Of explanations without these, E4: some choice meets all facts (fact is null);
    and of those without E4, E5: a fact that is not needed. One look at every choice decides both: an explanation is sufficient
    if every choice breaks a fact, and a fact is needed if some choice breaks that one alone, so no fact is left out in turn.
    Choices are enumerated as in `assignments`, so this is for small universes.
    """
    facts = cut(facts)
    name = lambda c: F.concat_ws(":", F.col(group).cast("string"), F.col(c)).alias(c)
    told = facts.select(group, F.struct(group, "fact").alias("fact"), name("package"), "versions", name("target"), "range", F.col("package").isNotNull().alias("dep"))
    never = facts.where("package IS NULL").join(roots, [group, "target", "range"], "left_anti").select(group, F.lit("E2").alias("problem"), "fact")
    false = untrue_facts(told.where("dep"), releases.select(name("package"), "version"), requirements.select(name("package"), "version", name("target"), "range"))
    problems = cut(never.unionByName(false.select(f"fact.{group}", F.lit("E3").alias("problem"), "fact.fact")))
    sound = roots.select(group).distinct().join(problems, group, "left_anti")
    entry = F.struct("fact", "package", "versions", "target", "range")
    cited = sound.join(facts, group, "left").groupBy(group).agg(F.collect_list(F.when(F.col("fact").isNotNull(), entry)).alias("cited"))
    picked = lambda p: F.element_at("chosen", p)
    admits = lambda r, p: F.map_contains_key("chosen", p) & F.coalesce(contains(r, picked(p)), F.lit(False))
    broken = lambda f: F.when(f["package"].isNull(), ~admits(f["range"], f["target"])).otherwise(admits(f["versions"], f["package"]) & ~admits(f["range"], f["target"]))
    rows = assignments(releases, group).join(cited, group).select(group, F.transform(F.filter("cited", broken), lambda f: f["fact"]).alias("broken"))
    seen = cut(rows.where("size(broken) <= 1").select(group, F.get("broken", F.lit(0)).alias("fact")).distinct())
    open_ = seen.where("fact IS NULL").select(group, F.lit("E4").alias("problem"), F.lit(None).cast(dict(facts.dtypes)["fact"]).alias("fact"))
    sufficient = facts.join(sound, group, "left_semi").join(open_, group, "left_anti")
    spare = sufficient.join(seen, [group, "fact"], "left_anti").select(group, F.lit("E5").alias("problem"), "fact")
    return problems.unionByName(open_).unionByName(spare)
