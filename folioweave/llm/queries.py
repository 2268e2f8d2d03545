"""The subpackage's queries over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm.frequencies import marked, record_terms
from folioweave.llm.packing import fill_report, pack
from folioweave.llm.pairs import beyond_chance, cooccurrences
from folioweave.llm.pii import find_personal, redact_personal
from folioweave.llm.subsequences import frequent_subsequences
from folioweave.llm.terms import terms
from folioweave.llm.tokens import decode_corpus, encode_corpus, token_counts
from folioweave.operators.deliveries import latest

#: Pack sizes are a parameter table; more rows than this are an error.
MAX_SIZES = 1000
LABELS = ["section_type", "argument_type", "standard_of_review"]


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _specs(spark: SparkSession, sf: str, *columns: Column) -> DataFrame:
    """The row that counts of each spec; the columns are computed before the rows are moved."""
    return latest(_read(spark, sf, "structure_specs").select("spec_id", "received_at", *columns), "spec_id")


def _record() -> Column:
    """Name of a spec; specs without an id are told apart by their labels."""
    return F.coalesce(F.col("spec_id").cast("string"), F.concat(F.lit("?"), F.xxhash64("labels").cast("string")))


def _label_counts(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    sections = F.col("argument_sections")
    labels = F.array(*[F.struct(F.lit(n).alias("field_name"), terms(sections[n]).alias("terms")) for n in LABELS])
    return record_terms(_specs(spark, sf, labels.alias("labels")).select(_record().alias("record"), "labels"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    counts, n_all = _label_counts(spark, sf)
    return marked(counts, n_all).filter("mark IS NOT NULL").select("field_name", "term", "mark")


def p2_term_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts, n_all = _label_counts(spark, sf)
    counts = counts.withColumnRenamed("n_occurrences", "n_sections").withColumnRenamed("n_records", "n_specs")
    return marked(counts.withColumn("n_records", F.col("n_specs")), n_all).drop("n_records")


def _baskets(spark: SparkSession, sf: str) -> DataFrame:
    flows = F.transform(F.coalesce("argument_sections", F.array()), lambda s: terms(s["reasoning_flow"]))
    counts = F.map_filter(F.col("citation_graph.signal_distribution"), lambda _, n: n > 0)
    signals = F.array(terms(F.map_keys(counts)))
    specs = _specs(spark, sf, flows.alias("flows"), signals.alias("signals"))
    fields = F.array(
        F.struct(F.lit("reasoning_flow").alias("field_name"), F.col("flows").alias("lists")),
        F.struct(F.lit("signal_distribution").alias("field_name"), F.col("signals").alias("lists")),
    )
    return specs.select(F.inline(fields)).select("field_name", F.explode("lists").alias("items"))


def _frequent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrences(_baskets(spark, sf), least=3, one_in=1000)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _frequent_pairs(spark, sf).filter(beyond_chance(2)).select("field_name", "item_a", "item_b")


def p3_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair, however rare."""
    return cooccurrences(_baskets(spark, sf)).select("field_name", "item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    flows = F.transform(F.coalesce("argument_sections", F.array()), lambda s: terms(s["reasoning_flow"]))
    components = F.transform(F.coalesce("reasoning_patterns", F.array()), lambda p: terms(p["components"]))
    specs = _specs(spark, sf, flows.alias("flows"), components.alias("components"))
    fields = F.array(
        F.struct(F.lit("reasoning_flow").alias("field_name"), F.col("flows").alias("lists")),
        F.struct(F.lit("components").alias("field_name"), F.col("components").alias("lists")),
    )
    return specs.select(F.inline(fields)).select("field_name", F.explode("lists").alias("items"))


def _patterns(spark: SparkSession, sf: str, shortest: int) -> DataFrame:
    found = frequent_subsequences(_sequences(spark, sf), least=3, one_in=100, shortest=shortest)
    return found.select("field_name", F.array_join("pattern", " > ").alias("pattern"), "n_sequences", "n_all")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _patterns(spark, sf, 3).select("field_name", "pattern")


def p4_supports(spark: SparkSession, sf: str) -> DataFrame:
    return _patterns(spark, sf, 1)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(_read(spark, sf, "documents"))


def p6_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The round trip: every text out of its ids."""
    return decode_corpus(p6_ids(spark, sf))


def _capacities(spark: SparkSession, sf: str) -> dict[str, int]:
    sizes = _read(spark, sf, "pack_sizes").select("size_name", "capacity_tokens").limit(MAX_SIZES + 1).collect()
    if len(sizes) > MAX_SIZES:
        raise ValueError(f"more than {MAX_SIZES} pack sizes")
    return {r.size_name: r.capacity_tokens for r in sizes}


def p7_packs(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), token_counts(F.col("text")).alias("size"))
    packed = pack(docs, _capacities(spark, sf))
    return packed.withColumnsRenamed({"item_id": "doc_id", "n_units": "n_tokens"})


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    packed = p7_packs(spark, sf).withColumnsRenamed({"doc_id": "item_id", "n_tokens": "n_units"})
    return fill_report(packed, _capacities(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    spans = find_personal(_read(spark, sf, "documents"), _read(spark, sf, "name_lexicon"))
    return spans.select("doc_id", "pii_type", "pii_text").distinct()


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redact_personal(_read(spark, sf, "documents"), _read(spark, sf, "name_lexicon"))


QUERIES = {
    "p2_found": p2_found,
    "p2_term_counts": p2_term_counts,
    "p3_found": p3_found,
    "p3_pair_counts": p3_pair_counts,
    "p4_found": p4_found,
    "p4_supports": p4_supports,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_packs": p7_packs,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}

# --- SQL ---------------------------------------------------------------------

_S = "s AS (SELECT * FROM structure_specs QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY received_at DESC) = 1)"


def _term(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower({x}), '[ \\t\\n\\x{{00A0}}_\\x{{2010}}-\\x{{2014}}-]+', '_', 'g'), '_.,;:'), '')"


def _terms(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda x: {_term('x')}), lambda x: x IS NOT NULL)"


_LABEL_ROWS = " UNION ALL ".join(
    f"SELECT '{n}' AS field_name, spec_id, {_term('a.' + n)} AS term FROM (SELECT spec_id, unnest(argument_sections) AS a FROM s)" for n in LABELS
)
_COUNTS = (
    f"WITH {_S}, t AS ({_LABEL_ROWS}), c AS (SELECT field_name, term, count(*) AS n_sections, count(DISTINCT spec_id) AS n_specs FROM t "
    "WHERE term IS NOT NULL GROUP BY ALL), m AS (SELECT *, CASE WHEN n_specs < 3 OR n_specs * 5000 < (SELECT count(*) FROM s) THEN 'rare' "
    "WHEN n_specs * 10 > 4 * (SELECT count(*) FROM s) THEN 'common' END AS mark FROM c)"
)
_BASKETS = (
    f"WITH {_S}, l AS (SELECT 'reasoning_flow' AS field_name, list_distinct({_terms('a.reasoning_flow')}) AS items "
    "FROM (SELECT unnest(argument_sections) AS a FROM s) UNION ALL "
    f"SELECT 'signal_distribution', list_distinct({_terms('list_transform(list_filter(map_entries(citation_graph.signal_distribution), lambda e: e.value > 0), lambda e: e.key)')}) FROM s), "
    "b AS (SELECT row_number() OVER () AS id, * FROM l WHERE len(items) > 0), i AS (SELECT id, field_name, unnest(items) AS item FROM b), "
    "n AS (SELECT field_name, count(*) AS n FROM b GROUP BY ALL), o AS (SELECT field_name, item, count(*) AS c FROM i GROUP BY ALL), "
    "p AS (SELECT x.field_name, x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM i x JOIN i y ON x.id = y.id AND x.item < y.item GROUP BY ALL), "
    "f AS (SELECT p.*, a.c AS n_a, z.c AS n_b, n FROM p JOIN o a ON a.field_name = p.field_name AND a.item = item_a "
    "JOIN o z ON z.field_name = p.field_name AND z.item = item_b JOIN n ON n.field_name = p.field_name)"
)

# Every subsequence of every sequence, by its earliest place: an item is taken only where it comes first after the one before.
_PATTERNS = (
    f"WITH RECURSIVE {_S}, l AS (SELECT 'reasoning_flow' AS field_name, {_terms('a.reasoning_flow')} AS items FROM (SELECT unnest(argument_sections) AS a FROM s) "
    f"UNION ALL SELECT 'components', {_terms('a.components')} FROM (SELECT unnest(reasoning_patterns) AS a FROM s)), "
    "q AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM l WHERE len(items) > 0), n AS (SELECT field_name, count(*) AS n_all FROM q GROUP BY ALL), "
    "x AS MATERIALIZED (SELECT id, field_name, unnest(items) AS item, unnest(range(len(items))) AS pos FROM q), "
    "o AS (SELECT field_name, item FROM x JOIN n USING (field_name) GROUP BY field_name, item, n_all HAVING count(DISTINCT id) >= 3 AND count(DISTINCT id) * 100 >= n_all), "
    "y AS MATERIALIZED (SELECT *, coalesce(lag(pos) OVER (PARTITION BY id, item ORDER BY pos), -1) AS before FROM x JOIN o USING (field_name, item)), "
    "r AS (SELECT id, field_name, item AS pattern, pos, 1 AS k FROM y WHERE before = -1 UNION ALL "
    "SELECT r.id, r.field_name, r.pattern || ' > ' || y.item, y.pos, k + 1 FROM r JOIN y ON y.id = r.id AND y.pos > r.pos AND y.before <= r.pos), "
    "f AS (SELECT field_name, pattern, k, count(*) AS n_sequences, n_all FROM r JOIN n USING (field_name) GROUP BY field_name, pattern, k, n_all "
    "HAVING count(*) >= 3 AND count(*) * 100 >= n_all)"
)

SQL = {
    "p4_found": _PATTERNS + " SELECT field_name, pattern FROM f WHERE k >= 3",
    "p4_supports": _PATTERNS + " SELECT field_name, pattern, n_sequences, n_all FROM f",
    "p2_found": _COUNTS + " SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_term_counts": _COUNTS + " SELECT * FROM m",
    "p3_found": _BASKETS + " SELECT field_name, item_a, item_b FROM f WHERE n_ab >= 3 AND 1000 * n_ab >= n AND n_ab * n >= 2 * n_a * n_b",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p3_pair_counts": _BASKETS + " SELECT field_name, item_a, item_b, n_ab, n_a, n_b, n, round(n_ab * n::DOUBLE / (n_a * n_b::DOUBLE), 6) AS lift FROM f",
}
