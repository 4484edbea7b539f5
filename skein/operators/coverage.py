"""Checks of drafts against their specification. The rules are written procedures of the surveyed project that no code of
it carries out; these renderings are ours. All joins are equi-joins on slug and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The marks of a finding.
COVERED, PARTIAL, MISSING = "Covered", "Partial", "Missing"
_KEY = ["slug", "dim", "sub"]


def coverage(spec: DataFrame, findings: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Each commitment of the spec (slug, dim, sub) with its finding; without one it is Missing. With chapters (slug,
    chapter), of which each is reviewed by itself, each chapter's findings against all commitments of its slug."""
    key, wanted = list(_KEY), spec.select(_KEY)
    if chapters is not None:
        key, wanted = ["slug", "chapter", "dim", "sub"], wanted.join(chapters.select("slug", "chapter"), "slug")
    return wanted.join(findings.select(*key, "status", "note"), key, "left").select(*key, F.coalesce("status", F.lit(MISSING)).alias("status"), "note")


def _review(covered: DataFrame) -> list[str]:
    """What one review is of: a chapter, or a whole story."""
    return [c for c in ("slug", "chapter") if c in covered.columns]


def severity(covered: DataFrame, families: DataFrame) -> DataFrame:
    """Findings with their rank: core Missing, core Partial, then those of the source relationship; Covered is no finding."""
    core, own = F.col("family") == "core", _review(covered)
    rank = F.when(core & (F.col("status") == MISSING), 1).when(core & (F.col("status") == PARTIAL), 2).when(~core, 3)
    found = covered.join(families.select("dim", "family").distinct(), "dim").where(F.col("status") != COVERED)
    return found.select(*own, "dim", "sub", "status", rank.alias("rank")).orderBy(*own, "rank", "dim", "sub")


def gate(covered: DataFrame, families: DataFrame) -> DataFrame:
    """Per review: blocked if any core commitment is Missing. Of chapters also may_start: no chapter before is blocked, as
    a blocked one keeps those behind it from being drafted. The first blocked chapter of a slug is an aggregate."""
    rows = covered.join(families.select("dim", "family").distinct(), "dim")
    judged = rows.groupBy(*_review(covered)).agg(F.bool_or((F.col("family") == "core") & (F.col("status") == MISSING)).alias("blocked"))
    if "chapter" not in covered.columns:
        return judged
    first = judged.groupBy("slug").agg(F.min(F.when(F.col("blocked"), F.col("chapter"))).alias("first_blocked"))
    return judged.join(first, "slug").select("slug", "chapter", "blocked", F.coalesce(F.col("chapter") <= F.col("first_blocked"), F.lit(True)).alias("may_start"))


def status_counts(covered: DataFrame) -> DataFrame:
    return covered.groupBy(*_review(covered), "dim", "status").agg(F.count("*").alias("n"))


def without_plan(spec: DataFrame, plan: DataFrame) -> DataFrame:
    """Dimensions of a spec that its plan does not carry."""
    return spec.select("slug", "dim").distinct().join(plan.select("slug", "dim"), ["slug", "dim"], "left_anti")


def unanswered(required: DataFrame, spec: DataFrame) -> DataFrame:
    """Required answers that a spec has not; any choice that is not blank is one, also "does not apply"."""
    return required.join(spec.where("trim(choice) <> ''").select(_KEY), _KEY, "left_anti")


def without_brief(chapters: DataFrame, briefs: DataFrame) -> DataFrame:
    return chapters.select("slug", "chapter").join(briefs.select("slug", "chapter"), ["slug", "chapter"], "left_anti")


def unpaid_setups(briefs: DataFrame) -> DataFrame:
    """Setups that no later chapter pays off; a payoff in the same chapter or before does not count. The last payoff of
    each element is aggregated first, so nothing pairs up."""
    paid = briefs.select("slug", "chapter", F.explode("payoffs").alias("element")).groupBy("slug", "element").agg(F.max("chapter").alias("paid"))
    setups = briefs.select("slug", "chapter", F.explode("setups").alias("element"))
    return setups.join(paid, ["slug", "element"], "left").where("paid is null or paid <= chapter").select("slug", "chapter", "element")


def pov_drift(briefs: DataFrame, voices: DataFrame | None = None) -> DataFrame:
    """Chapters whose point of view is not that of the chapter before or, with voices (slug, wanted), not that which the
    spec chose, unless an exception is noted. A spec without a choice asks for none. (slug, chapter, was, wanted, pov);
    without voices there is no wanted."""
    last = F.lag("pov").over(Window.partitionBy("slug").orderBy("chapter"))
    rows, off, columns = briefs.withColumn("was", last), "was <> pov", ["slug", "chapter", "was", "pov"]
    if voices is not None:
        rows, off, columns = rows.join(voices.select("slug", "wanted"), "slug", "left"), "coalesce(was <> pov, false) or wanted <> pov", ["slug", "chapter", "was", "wanted", "pov"]
    return rows.where(f"({off}) and not coalesce(pov_exception, false)").select(columns)


def continuity(summaries: DataFrame, most: int | None = None) -> DataFrame:
    """Before each chapter: the summaries (slug, chapter, summary) of those before it, in order, as one text; with most, of
    the last so many. Without that bound the texts of a story grow with the square of its chapters."""
    before = Window.partitionBy("slug").orderBy("chapter").rowsBetween(Window.unboundedPreceding if most is None else -most, -1)
    return summaries.select("slug", "chapter", F.array_join(F.collect_list("summary").over(before), " ").alias("so_far"))


def whole_story(briefs: DataFrame, voices: DataFrame | None = None) -> DataFrame:
    """Per slug: setups without payoff, and chapters that drift."""
    unpaid = unpaid_setups(briefs).groupBy("slug").agg(F.count("*").alias("unpaid"))
    drift = pov_drift(briefs, voices).groupBy("slug").agg(F.count("*").alias("drifts"))
    out = briefs.select("slug").distinct().join(unpaid, "slug", "left").join(drift, "slug", "left")
    return out.select("slug", F.coalesce("unpaid", F.lit(0)).cast("long").alias("unpaid"), F.coalesce("drifts", F.lit(0)).cast("long").alias("drifts"))


#: Artefacts in the order of work.
WORKFLOW = ("spec", "plan", "prose", "review")


def out_of_order(artefacts: DataFrame) -> DataFrame:
    """Artefacts (slug, kind, at) that appear before the one they build on, or without it."""
    first = artefacts.groupBy("slug").pivot("kind", list(WORKFLOW)).agg(F.min("at"))
    pairs = F.array(*(F.struct(F.lit(b).alias("kind"), F.lit(a).alias("needs"), F.col(b).alias("at"), F.col(a).alias("needed_at")) for a, b in zip(WORKFLOW, WORKFLOW[1:], strict=False)))
    return first.select("slug", F.inline(pairs)).where("at is not null and (needed_at is null or at < needed_at)").select("slug", "kind", "needs")


def signed_off(gates: DataFrame) -> DataFrame:
    """Slugs (slug, kind, signed) whose spec and plan are both signed off."""
    return gates.where("kind in ('spec', 'plan') and signed").groupBy("slug").agg(F.count_distinct("kind").alias("n")).where("n = 2").select("slug")
