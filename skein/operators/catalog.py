"""The catalogue of dimensions that a story's specification answers, and which answers a source relationship asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Family, dimension and its sub-dimensions in order.
DIMENSIONS = [
    ("core", "writing style", ["lexical complexity", "sentence structure", "rhythm & flow", "rhetorical patterns", "discourse organisation", "tone & voice"]),
    ("core", "narrative voice", ["point of view", "narrative distance", "narrator presence", "temporal perspective", "focalisation pattern", "reader engagement"]),
    ("core", "character", ["identity & traits", "arc & development", "relationships & dynamics", "background & motivation", "expression & behaviour", "function & role"]),
    ("core", "plot structure", ["event sequence & causality", "story architecture", "conflict construction", "turning points", "temporal structure", "functions & convergence"]),
    ("core", "scene sequence", ["identity & content", "internal structure", "sequence architecture", "transitions", "pacing & rhythm", "functions & types"]),
    ("core", "world-building", ["geographic & spatial", "rules & system", "cultural & social", "historical & temporal", "material & sensory", "function & logic"]),
    ("defence", "parody/satire", ["evocation", "differences", "humorous character", "critical character", "fair balance"]),
    ("defence", "pastiche", ["style evocation", "artistic skill", "homage", "differences", "fair balance"]),
    ("defence", "quotation", ["identification", "legitimate purpose", "fair practice", "attribution", "fair balance", "already disclosed"]),
    ("defence", "scènes à faire", ["genre conventions", "stock characters", "plot devices", "thematic commonplaces", "technical elements", "creative elaboration"]),
]
#: Sub-dimensions for which a brief answer is fine, and those that gate the rest.
WEAK = {("narrative voice", "reader engagement"), ("character", "function & role"), ("plot structure", "functions & convergence"), ("scene sequence", "functions & types"), ("world-building", "function & logic")}
GATES = {("parody/satire", "fair balance"): "hard stop", ("quotation", "identification"): "threshold"}
#: The defence dimensions that each source relationship asks for; the others ask for none.
RELATIONSHIPS = {
    "none": [],
    "loosely inspired": [],
    "retelling": ["scènes à faire"],
    "parody": ["parody/satire", "scènes à faire"],
    "pastiche": ["pastiche", "scènes à faire"],
    "quotation": ["quotation", "scènes à faire"],
}


def dimensions(spark: SparkSession) -> DataFrame:
    rows = [(family, dim, k, sub, (dim, sub) in WEAK, GATES.get((dim, sub))) for family, dim, subs in DIMENSIONS for k, sub in enumerate(subs, 1)]
    return spark.createDataFrame(rows, "family string, dim string, ord int, sub string, weak boolean, gate string")


def required_answers(stories: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(slug, family, dim, ord, sub) for stories (slug, relationship): all core rows and those of the relationship; a null
    relationship is none. The catalogue has 58 rows."""
    asked = [(r, d) for r, dims in RELATIONSHIPS.items() for d in [*(x[1] for x in DIMENSIONS if x[0] == "core"), *dims]]
    asks = stories.sparkSession.createDataFrame(asked, "relationship string, dim string")
    rows = stories.select("slug", F.coalesce("relationship", F.lit("none")).alias("relationship"))
    return rows.join(asks, "relationship").join(catalogue, "dim").select("slug", "family", "dim", "ord", "sub")
