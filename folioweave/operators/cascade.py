"""Three-tier cascade: rules over learned values over defaults, with provenance.

``specs`` are parsed format specs (see ``sources.specs``) with a ``spec_id``.
``rules`` is a long relation (rule set, ``key``, ``val``); a rule counts by its
presence, so a null value wins. The default plan is local to a spec's row: the
tiers are arrays, merged by filters, so nothing is shuffled but what the join
with the rules needs. ``resolve_by_union`` ranks the tiers with a window; it is
kept as an independent second form that the tests compare with the first.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioweave.functions.text import json_scalar
from folioweave.schemas import (
    BUILT_IN_DEFAULTS,
    ENTRY_TYPE,
    LAYOUT_KEYS,
    MIN_CONFIDENCE,
    RESERVED_KEY,
    TYPOGRAPHY_KEYS,
    VALUE_TYPE,
)


def value(x: object) -> Column:
    """Tagged value of a Python value; lists, tuples and dicts keep their JSON text."""
    kinds = {str: ("string", "s"), bool: ("boolean", "b"), int: ("number", "d"), float: ("number", "d"), list: ("array", "s"), tuple: ("array", "s"), dict: ("object", "s")}
    if x is None:
        return _null_value()
    kind, slot = kinds[type(x)]
    x = json.dumps(x, ensure_ascii=False) if kind in ("array", "object") else x
    parts = {"s": F.lit(None).cast("string"), "d": F.lit(None).cast("double"), "b": F.lit(None).cast("boolean")}
    parts[slot] = F.lit(float(x) if slot == "d" else x)
    return F.struct(F.lit(kind).alias("type"), *[c.alias(k) for k, c in parts.items()])


def _null_value() -> Column:
    return F.struct(
        F.lit("null").alias("type"),
        F.lit(None).cast("string").alias("s"),
        F.lit(None).cast("double").alias("d"),
        F.lit(None).cast("boolean").alias("b"),
    )


def _entry(key: str | Column, val: Column, provenance: str) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.struct(key.alias("key"), val.cast(VALUE_TYPE).alias("val"), F.lit(provenance).alias("provenance"))


def _string(col: Column) -> Column:
    return F.struct(
        F.lit("string").alias("type"), col.alias("s"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("boolean").alias("b")
    )


def _number(col: Column) -> Column:
    return F.struct(
        F.lit("number").alias("type"), F.lit(None).cast("string").alias("s"), col.alias("d"), F.lit(None).cast("boolean").alias("b")
    )


def pick_defaults(defaults: dict | None) -> dict:
    """None or an empty dict means the built-in defaults; any other replaces them whole."""
    chosen = defaults or BUILT_IN_DEFAULTS
    if RESERVED_KEY in chosen:
        raise ValueError(f"{RESERVED_KEY} is reserved")
    return chosen


def built_in_defaults(spark: SparkSession, defaults: dict | None = None) -> DataFrame:
    """The defaults tier as a relation: key, val."""
    entries = F.array(*[_entry(k, value(v), "default") for k, v in pick_defaults(defaults).items()])
    return spark.range(1).select(F.inline(entries)).select("key", "val")


def truthy(val: Column) -> Column:
    """Python truth of a tagged value, never null; NaN is true."""
    t = val["type"]
    true = (
        F.when(t == "string", val["s"] != "")
        .when(t == "number", F.isnan(val["d"]) | (val["d"] != 0))
        .when(t == "boolean", val["b"])
        .when(t.isin("array", "object"), ~val["s"].rlike(r"^[\[{]\s*[\]}]$"))
    )
    return F.coalesce(true, F.lit(False))


def _at_least(confidence: Column, least: float) -> Column:
    return F.coalesce(~F.isnan(confidence) & (confidence >= least), F.lit(False))


def overall_gate(confidence: Column) -> Column:
    """Is the learned tier considered at all; null, NaN and 0 say no."""
    return F.coalesce(~F.isnan(confidence) & (confidence > 0), F.lit(False))


def typography_candidates() -> Column:
    """Array of (key, val, confidence, admitted) of the three typography values."""
    out = []
    for name, confidence, key in TYPOGRAPHY_KEYS:
        col, conf = F.col("typography")[name], F.col("typography")[confidence]
        val = _string(col) if name == "font_family" else _number(col)
        out.append(
            F.struct(
                F.lit(key).alias("key"),
                val.cast(VALUE_TYPE).alias("val"),
                conf.alias("confidence"),
                (truthy(val) & _at_least(conf, MIN_CONFIDENCE)).alias("admitted"),
            )
        )
    return F.array(*out)


def learned_entries() -> Column:
    """Array of the admitted learned entries of a spec; empty if the overall gate is shut."""
    typography = F.transform(
        F.filter(typography_candidates(), lambda e: e["admitted"]),
        lambda e: _entry(e["key"], e["val"], "ml_learned"),
    )
    layout = F.filter(
        F.array(*[_entry(key, _number(F.col("layout")[name]), "ml_learned") for name, key in LAYOUT_KEYS.items()]),
        lambda e: e["val"]["d"].isNotNull(),
    )
    none = F.array().cast(f"ARRAY<{ENTRY_TYPE}>")
    return F.when(overall_gate(F.col("overall_confidence")), F.concat(typography, layout)).otherwise(none)


def rules_from_json(texts: DataFrame, json_col: str = "value", rule_set_col: str = "rule_set", part: str = "page_format") -> DataFrame:
    """Rules of JSON documents that hold them in an object ``part``: rule set, pos, key, val.

    Values keep their types, arrays and objects as JSON text; a null rule stays.
    Text that is null, not JSON or without that part has no rules.
    """
    found = F.from_json(F.col(json_col), f"`{part}` MAP<STRING, VARIANT>")[part]
    rows = texts.select(rule_set_col, F.posexplode(found).alias("pos", "key", "_v"))
    return rows.select(rule_set_col, "pos", "key", json_scalar(F.to_json("_v")).alias("val"))


def rules_from_dicts(spark: SparkSession, rules: dict[str, dict], rule_set_col: str = "rule_set", part: str = "page_format") -> DataFrame:
    """:func:`rules_from_json` of a few rule sets, as a caller holds them: name -> {"page_format": {key: value}}."""
    rows = [(name, json.dumps(r)) for name, r in rules.items()]
    return rules_from_json(spark.createDataFrame(rows, f"`{rule_set_col}` STRING, value STRING"), rule_set_col=rule_set_col, part=part)


def rule_sets(rules: DataFrame, rule_set_col: str) -> DataFrame:
    """One row a rule set with its rules as an array.

    Of a key given twice the last by ``pos`` counts; of a relation without that
    column, which has no order, the greatest value.

    The reserved key is refused when the query runs.
    """
    key = F.when(F.col("key") != RESERVED_KEY, F.col("key")).otherwise(F.raise_error(F.lit(f"{RESERVED_KEY} is reserved")))
    one = rules.filter("key IS NOT NULL").groupBy(rule_set_col, key.alias("key")).agg(
        (F.max_by("val", "pos") if "pos" in rules.columns else F.max("val")).alias("val")
    )
    return one.groupBy(rule_set_col).agg(F.collect_list(_entry(F.col("key"), F.col("val"), "rule")).alias("_rules"))


def _with_rules(specs: DataFrame, rules: DataFrame | None, rule_set_col: str) -> DataFrame:
    none = F.array().cast(f"ARRAY<{ENTRY_TYPE}>")
    if rules is None:
        return specs.withColumn("_rules", none)
    # The optimiser broadcasts the rule sets when their size is under the session's threshold.
    joined = specs.join(rule_sets(rules, rule_set_col), rule_set_col, "left")
    return joined.withColumn("_rules", F.coalesce("_rules", none))


def resolve(
    specs: DataFrame,
    rules: DataFrame | None = None,
    defaults: dict | None = None,
    rule_set_col: str = "rule_set",
    learned: bool = True,
) -> DataFrame:
    """Resolved entries of every spec: spec_id, key, val, provenance.

    A spec without a rule set, or whose set is null or unknown, has no rules.
    ``learned=False`` leaves the learned tier out, as a merge without a spec does.
    Repeated specs give repeated rows; no specs give none. Other columns of the
    specs, whatever their names, are not looked at.
    """
    base = F.array(*[_entry(k, value(v), "default") for k, v in pick_defaults(defaults).items()])
    used = ["spec_id", "overall_confidence", "typography", "layout"]
    specs = specs.select(*used, *([rule_set_col] if rules is not None and rule_set_col not in used else []))
    specs = _with_rules(specs, rules, rule_set_col)
    none = F.array().cast(f"ARRAY<{ENTRY_TYPE}>")
    tiers = specs.select("spec_id", "_rules", (learned_entries() if learned else none).alias("_ml"))
    ml_keys, rule_keys = F.col("_ml")["key"], F.col("_rules")["key"]
    merged = F.concat(
        F.filter(base, lambda e: ~F.array_contains(ml_keys, e["key"]) & ~F.array_contains(rule_keys, e["key"])),
        F.filter(F.col("_ml"), lambda e: ~F.array_contains(rule_keys, e["key"])),
        F.col("_rules"),
    )
    return tiers.select("spec_id", F.inline(merged))


def resolve_by_union(
    specs: DataFrame, rules: DataFrame | None = None, defaults: dict | None = None, rule_set_col: str = "rule_set"
) -> DataFrame:
    """As :func:`resolve` for unique spec ids: a union of tiers, the last of each key kept."""
    base = F.array(*[_entry(k, value(v), "default") for k, v in pick_defaults(defaults).items()])
    tiers = specs.select("spec_id", F.lit(0).alias("tier"), F.inline(base)).unionByName(
        specs.select("spec_id", F.lit(1).alias("tier"), F.inline(learned_entries()))
    )
    if rules is not None:
        ruled = specs.select("spec_id", rule_set_col).join(rules.filter("key IS NOT NULL"), rule_set_col)
        tiers = tiers.unionByName(
            ruled.select("spec_id", F.lit(2).alias("tier"), "key", F.col("val").cast(VALUE_TYPE).alias("val"), F.lit("rule").alias("provenance"))
        )
    last = Window.partitionBy("spec_id", "key").orderBy(F.desc("tier"), F.desc("val"))
    return tiers.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("spec_id", "key", "val", "provenance")


def value_text(val: Column) -> Column:
    """A tagged scalar as text, null for the JSON null."""
    return F.coalesce(val["s"], val["d"].cast("string"), val["b"].cast("string"))


def to_wide(resolved: DataFrame) -> DataFrame:
    """One row a spec: ``values`` (key to text), ``typed`` (key to tagged value) and ``_provenance`` (key to tier), all maps."""
    pairs = F.collect_list(F.struct("key", value_text(F.col("val")).alias("v")))
    tiers = F.collect_list(F.struct("key", "provenance"))
    return resolved.groupBy("spec_id").agg(
        F.map_from_entries(pairs).alias("values"),
        F.map_from_entries(F.collect_list(F.struct("key", "val"))).alias("typed"),
        F.map_from_entries(tiers).alias(RESERVED_KEY)
    )
