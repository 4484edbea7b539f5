"""How an agent is put together, as columns: settings, subagents, stages, routes and prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.content import first_set, sections, strip_front_matter

#: The stages around a model, in order; those that a flag can switch off have one.
STAGES = (("todo", None), ("retry", "enable_retry"), ("model_limit", "enable_model_limit"), ("tool_limit", "enable_tool_limit"), ("tool_error", None))

#: Tools on stored documents, and the one that a shell adds.
FILE_TOOLS = ("read_file", "write_file", "edit_file", "ls", "glob", "grep")
SHELL_TOOL = "execute"
#: The sections of the settings with name, type and default of their fields. A null limit is no limit.
SECTIONS = {
    "personal": (("name", "string", "human"),),
    "agent": (("orchestration_model_name", "string", "anthropic:claude-sonnet-4-6"), ("subagent_model_name", "string", "anthropic:claude-sonnet-4-6"), ("model_kwargs", "map<string,string>", "{}"), ("subagent_model_kwargs", "map<string,string>", "{}")),
    "backend": (("root_dir", "string", None), ("enable_shell", "boolean", "false")),
    "rate_limiter": (("enable_rate_limiter", "boolean", "true"), ("requests_per_second", "bigint", "25"), ("check_every_n_seconds", "double", "0.1"), ("max_bucket_size", "bigint", "50")),
    "model_retry": (("enable_model_retry", "boolean", "true"), ("max_retries", "bigint", "3"), ("backoff_factor", "double", "2.0"), ("initial_delay", "double", "1.0"), ("jitter", "boolean", "true")),
    "model_call_limit": (("enable_call_limit", "boolean", "true"), ("thread_limit", "bigint", None), ("run_limit", "bigint", "50"), ("exit_behavior", "string", "end")),
    "tool_call_limit": (("enable_call_limit", "boolean", "true"), ("thread_limit", "bigint", None), ("run_limit", "bigint", "200"), ("exit_behavior", "string", "end")),
}
#: Fields with a closed list of values.
CHOICES = {"model_call_limit.exit_behavior": ("end", "error"), "tool_call_limit.exit_behavior": ("continue", "end", "error")}


def stages(settings: DataFrame) -> DataFrame:
    """(id, pos, stage) for settings (id, own array<string>, flags): the caller's own stages come first."""
    built = F.array(*(F.struct(F.lit(n).alias("stage"), (F.col(f) if f else F.lit(True)).alias("on")) for n, f in STAGES))
    names = F.transform(F.filter(built, lambda s: F.coalesce(s["on"], F.lit(False))), lambda s: s["stage"])
    return settings.select("id", F.posexplode(F.concat(F.coalesce("own", F.array().cast("array<string>")), names)).alias("pos", "stage"))


def subagents(fixed: DataFrame, own: DataFrame, model: Column) -> DataFrame:
    """The two fixed subagents, then the caller's; names may repeat. Only the fixed ones get the model."""
    mine = fixed.select(F.lit(0).alias("part"), "ord", "name", model.alias("model"))
    return mine.unionByName(own.select(F.lit(1).alias("part"), "ord", "name", F.col("model"))).orderBy("part", "ord")


def effective(settings: DataFrame) -> DataFrame:
    """The model (command line over environment over default; empty text is not set) and the session's id."""
    return settings.select("id", first_set(F.col("cli"), F.col("env"), F.col("default_model")).alias("model"), first_set(F.col("session"), F.col("new_session")).alias("session"))


def routed(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """The backend of each path: that of the longest mounted prefix, else `default`. A path's own prefixes are joined by
    equality; the longest rule is ours, the surveyed tree does not have it. Of routes with one prefix the greatest backend
    wins; a null path has none."""
    prefixes = F.expr("transform(sequence(1, length(path)), i -> substr(path, 1, i))")
    found = paths.where("path <> ''").distinct().select("path", F.explode(prefixes).alias("prefix")).join(routes, "prefix").groupBy("path").agg(F.max_by("backend", F.struct(F.length("prefix"), "backend")).alias("backend"))
    return paths.join(found, "path", "left").select("path", F.coalesce("backend", F.lit("default")).alias("backend"))


def system_prompt(skills: DataFrame) -> DataFrame:
    """(id, prompt) of (id, application, skill, mapping): the application's own text, the skill without front matter and,
    if there is one, the mapping."""
    return skills.select("id", sections(F.col("application"), strip_front_matter(F.col("skill")), F.col("mapping")).alias("prompt"))


def settings_from(spark: SparkSession, environment: dict[str, str], prefix: str) -> DataFrame:
    """(path, value) of the variables of one process, as settings_of."""
    return settings_of(spark.createDataFrame(sorted(environment.items()), "name string, value string"), prefix)


def settings_of(variables: DataFrame, prefix: str) -> DataFrame:
    """(path, value, and all other columns) of the variables (name, value) with the prefix: `__` parts a path, names are
    lower-cased, as a settings reader does."""
    own = variables.where(F.upper(F.substring("name", 1, len(prefix))) == prefix.upper())
    path = F.replace(F.lower(F.substring("name", len(prefix) + 1, 1 << 30)), F.lit("__"), F.lit("."))
    return own.select(path.alias("path"), "value", *(c for c in variables.columns if c not in ("name", "value")))


def _typed(raw: Column, kind: str, allowed: tuple[str, ...]) -> Column:
    if kind.startswith("map"):
        return F.from_json(raw, kind, {"mode": "FAILFAST"})
    if kind == "boolean":
        raw = F.when(F.lower(raw) == "on", "true").when(F.lower(raw) == "off", "false").otherwise(raw)
    if allowed:
        raw = F.when(raw.isNull() | raw.isin(*allowed), raw).otherwise(F.raise_error(F.concat(F.lit("not a choice: "), raw)))
    return raw.cast(kind)


def settings_tree(settings: DataFrame, root_dir: str, by: Sequence[str] = ()) -> DataFrame:
    """One row (or one for each value of the columns by, where many tenants' settings are in one table) with a struct for each section, of typed fields: a field's own variable, else its place in a section given
    as one JSON object, else the default. root_dir is the default of backend.root_dir.

    Values that don't fit their type or choice raise an error; of several values for one path the greatest counts; paths
    of no field are ignored. Without any settings all is default.
    """
    once = settings.groupBy(*by, "path").agg(F.max("value").alias("value")).where("path is not null and value is not null")
    given = once.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("given"))

    def field(section: str, name: str, kind: str, default: str | None) -> Column:
        own, whole = (F.try_element_at("given", F.lit(p)) for p in (f"{section}.{name}", section))
        usual = root_dir if (section, name) == ("backend", "root_dir") else default
        raw = F.coalesce(own, F.get_json_object(whole, f"$.{name}"), F.lit(usual).cast("string"))
        return _typed(raw, kind, CHOICES.get(f"{section}.{name}", ())).alias(name)

    return given.select(*by, *(F.struct(*(field(section, *f) for f in fields)).alias(section) for section, fields in SECTIONS.items()))


def equipment(settings: DataFrame) -> DataFrame:
    """What two flags give an agent, for settings (id, enable_shell, enable_rate_limiter, requests_per_second,
    max_bucket_size): the kind of its backend, its file tools (with a shell also `execute`), and the rate and burst that
    its main model is held to, null without a limiter. A null flag is the default: no shell, but a limiter."""
    shell, limited = F.coalesce("enable_shell", F.lit(False)), F.coalesce("enable_rate_limiter", F.lit(True))
    tools = F.concat(F.array(*map(F.lit, FILE_TOOLS)), F.when(shell, F.array(F.lit(SHELL_TOOL))).otherwise(F.array().cast("array<string>")))
    return settings.select("id", F.when(shell, "shell").otherwise("files").alias("backend"), tools.alias("tools"), F.when(limited, F.col("requests_per_second")).alias("rate"), F.when(limited, F.col("max_bucket_size")).alias("burst"))


def map_setting(settings: DataFrame, path: str) -> DataFrame:
    """A JSON object in a setting as a map, beside all other columns; malformed text gives null."""
    others = [c for c in settings.columns if c not in ("path", "value")]
    return settings.where(F.col("path") == path).select(*others, F.from_json("value", "map<string,string>").alias("value"))
