"""The rule set: dictionaries, weights and limits that the expressions are built from."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import fixed_values as fixed
from gleaner import schemas
from gleaner.functions.text import alternation
from gleaner.sources import sinks

# A rule set is typed in by hand; it becomes literals in the plan.  More rows than this mean
# that the wrong table was passed, so loading stops instead of pulling it to the driver.
MAX_RULE_ROWS = 50_000


@dataclass(frozen=True)
class RuleSet:
    stack: Mapping[str, int] = field(default_factory=dict)
    hiring: Mapping[str, int] = field(default_factory=dict)
    pain: Mapping[str, int] = field(default_factory=dict)
    money: Mapping[str, int] = field(default_factory=dict)
    anti: tuple[str, ...] = ()
    closed: tuple[str, ...] = ()
    noise: Mapping[str, int] = field(default_factory=dict)
    aliases: Mapping[str, str] = field(default_factory=dict)
    weights: Mapping[str, int] = field(default_factory=dict)
    stack_cap: int = fixed.STACK_CAP
    intent_cap: int = fixed.INTENT_CAP
    noise_cap: int = fixed.NOISE_CAP
    notify_threshold: int = fixed.NOTIFY_THRESHOLD
    help_min_score: int = fixed.HELP_MIN_SCORE
    help_pattern: str = fixed.HELP_PATTERN
    version: str = fixed.RULES_VERSION

    @cached_property
    def patterns(self) -> dict[str, str | None]:
        return {
            name: alternation(getattr(self, name))
            for name in ("stack", "hiring", "pain", "money", "anti", "closed", "noise")
        }

    def weight(self, rule: str) -> int:
        return self.weights.get(rule, fixed.FALLBACK_WEIGHTS[rule])


def seed_keyword_rows() -> list[tuple[str, str, int, str | None, bool]]:
    """Seed rows of the keyword table, the first of equal (dict_type, term) winning."""
    listed = [
        ("stack_core", fixed.STACK_CORE, fixed.CORE_WEIGHT),
        ("stack_periph", fixed.STACK_PERIPH, fixed.PERIPH_WEIGHT),
        ("hiring_intent", fixed.HIRING_STRONG, fixed.HIRING_STRONG_WEIGHT),
        ("hiring_intent", fixed.HIRING_WEAK, fixed.HIRING_WEAK_WEIGHT),
        ("pain_point", fixed.PAIN_POINT, fixed.PAIN_WEIGHT),
        ("money", fixed.MONEY, fixed.MONEY_WEIGHT),
        ("anti", fixed.ANTI, 0),
        ("closed", fixed.CLOSED, 0),
        ("noise", fixed.NOISE, fixed.NOISE_WEIGHT),
        ("noise", fixed.OFF_NICHE, fixed.OFF_NICHE_WEIGHT),
    ]
    rows: dict[tuple[str, str], tuple] = {}
    for dict_type, terms, weight in listed:
        for term in terms:
            rows.setdefault((dict_type, term), (dict_type, term, weight, None, True))
    for term, target in fixed.ALIASES.items():
        rows.setdefault(("alias", term), ("alias", term, 0, target, True))
    return list(rows.values())


def seed_keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(seed_keyword_rows(), schemas.KEYWORDS)


def seed_rule_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.RULE_WEIGHTS.items()), schemas.RULE_WEIGHTS)


def seed_sources(spark: SparkSession) -> DataFrame:
    """Seed sources of both circuits; all enabled and not muted."""
    rows = [
        (name, category, circuit, True, None, priority, None, None)
        for circuit, listed in (("main", fixed.SOURCES_MAIN), ("browse", fixed.SOURCES_BROWSE))
        for name, category, priority in listed
    ]
    return spark.createDataFrame(rows, schemas.SOURCES)


def rule_set(keyword_rows, weight_rows=(), **limits) -> RuleSet:
    """A rule set from (dict_type, term, weight, maps_to) and (key, weight) rows."""
    named: dict[str, dict] = {kind: {} for kind in fixed.DICT_TYPES}
    for dict_type, term, weight, maps_to in keyword_rows:
        if dict_type == "alias":
            if maps_to:
                named["alias"][term] = maps_to
        elif dict_type in named:
            named[dict_type][term] = weight
    weights = dict(weight_rows)
    if fixed.THRESHOLD_KEY in weights:
        limits["notify_threshold"] = weights.pop(fixed.THRESHOLD_KEY)
    # A term in both stack dictionaries keeps the larger weight, whatever the row order.
    stack = dict(named["stack_periph"])
    for term, weight in named["stack_core"].items():
        stack[term] = max(weight, stack.get(term, weight))
    return RuleSet(
        stack=stack,
        hiring=named["hiring_intent"],
        pain=named["pain_point"],
        money=named["money"],
        anti=tuple(named["anti"]),
        closed=tuple(named["closed"]),
        noise=named["noise"],
        aliases=named["alias"],
        weights=weights,
        **limits,
    )


def _bounded_rows(df: DataFrame, what: str) -> list:
    rows = df.limit(MAX_RULE_ROWS + 1).collect()
    if len(rows) > MAX_RULE_ROWS:
        raise ValueError(f"{what} has more than {MAX_RULE_ROWS} rows; not a rule table")
    return rows


def load_rules(keywords: DataFrame, rule_weights: DataFrame | None = None, **limits) -> RuleSet:
    """Read the enabled keywords and the weights into a rule set."""
    words = keywords.filter("enabled IS TRUE").select("dict_type", "term", "weight", "maps_to")
    rows = sorted(map(tuple, _bounded_rows(words, "keywords")), key=lambda row: row[:2])
    weights = []
    if rule_weights is not None:
        weights = [
            tuple(row) for row in _bounded_rows(rule_weights.select("key", "weight"), "weights")
        ]
    return rule_set(rows, weights, **limits)


def seed_rules(**limits) -> RuleSet:
    """The rule set of the seed dictionaries, without reading a table."""
    rows = [row[:4] for row in seed_keyword_rows()]
    return rule_set(rows, fixed.RULE_WEIGHTS.items(), **limits)


def dictionary_listing(keywords: DataFrame) -> DataFrame:
    """Enabled terms in order, each with the size of its dictionary."""
    enabled = keywords.filter("enabled IS TRUE")
    sizes = enabled.groupBy("dict_type").agg(F.count("*").alias("terms"))
    return (
        enabled.join(sizes, "dict_type")
        .select("dict_type", "terms", "term", "weight")
        .orderBy("dict_type", "term")
    )


# --- versions of the rule tables -------------------------------------------------------------


def publish_rules(spark: SparkSession, folder: str, keywords: DataFrame, rule_weights: DataFrame) -> int:
    """Write both rule tables as the next version, which counts from then on; returns its number."""
    version = sinks.current_version(spark, f"{folder}/weights")[0] + 1
    keywords.write.mode("overwrite").parquet(f"{folder}/keywords/version={version}")
    sinks.write_version(rule_weights, f"{folder}/weights", version, 0)
    return version


class RuleReader:
    """Gives the rules of the current version; the tables are read only when the version has changed.

    Called once per micro-batch, it makes an edit count from the next batch on.  The version number
    stands in ``rules_version`` of every match.
    """

    def __init__(self, spark: SparkSession, folder: str, **limits):
        self.spark, self.folder, self.limits = spark, folder, limits
        self.version, self.rules = 0, RuleSet()

    def __call__(self) -> RuleSet:
        version, _ = sinks.current_version(self.spark, f"{self.folder}/weights")
        if version != self.version:
            keywords = self.spark.read.schema(schemas.KEYWORDS).parquet(f"{self.folder}/keywords/version={version}")
            weights = self.spark.read.schema(schemas.RULE_WEIGHTS).parquet(
                f"{self.folder}/weights-versions/version={version}"
            )
            self.rules = load_rules(keywords, weights, version=f"v{version}", **self.limits)
            self.version = version
        return self.rules
