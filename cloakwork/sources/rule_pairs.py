"""Rule-pair files: the JSON envelope (schema version 2.0) and a form for large corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cloakwork.catalogue import ENTITY_TYPES
from cloakwork.functions.text import trim_space
from cloakwork.operators.pairs import PAIR_FIELDS, pairs_of_row

# Envelope version and its field names.
SCHEMA_VERSION = "2.0"
JSON_NAMES = {
    "entity_type": "entityType", "origin": "origin", "source": "source",
    "replacement": "replacement", "region": "region", "rule_id": "ruleId",
}


class InvalidRulesFile(ValueError):
    """The whole import is refused: a rule file is malformed or one of its pairs is invalid."""


def envelope(pairs: Column, generated_at: str) -> Column:
    """The JSON text of an array of pairs; null fields are left out."""
    rules = F.transform(pairs, lambda p: F.struct(*[p[n].alias(j) for n, j in JSON_NAMES.items()]))
    return F.to_json(
        F.struct(
            F.lit(SCHEMA_VERSION).alias("schemaVersion"),
            F.lit(generated_at).alias("generatedAt"),
            F.size(pairs).alias("total"),
            rules.alias("rules"),
        )
    )


def export_envelopes(masked: DataFrame, id_cols: Sequence[str], generated_at: str, swap: bool = False) -> DataFrame:
    """One envelope per document, made inside the row: ``(*id_cols, rules_json)``."""
    rows = masked.select(*id_cols, pairs_of_row(F.col("spans"), swap).alias("_pairs"))
    return rows.select(*id_cols, envelope(F.col("_pairs"), generated_at).alias("rules_json"))


def write_pairs(pairs: DataFrame, path: str, generated_at: str, mode: str = "errorifexists") -> None:
    """A pair table of any size: JSON lines under ``rules``, the envelope's head under ``head``."""
    body = pairs.select(*[c for c in pairs.columns if c not in PAIR_FIELDS],
                        *[F.col(n).alias(j) for n, j in JSON_NAMES.items()])
    body.write.mode(mode).json(f"{path}/rules")
    written = pairs.sparkSession.read.json(f"{path}/rules", schema=body.schema)
    head = written.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(generated_at).alias("generatedAt"), "total"
    )
    head.write.mode(mode).json(f"{path}/head")


def _string(value: str, field: str) -> Column:
    """The field if it holds a JSON string, else null."""
    kind = F.expr(f"schema_of_variant(variant_get({value}, '$.{field}', 'variant'))")
    return F.when(kind == "STRING", F.expr(f"variant_get({value}, '$.{field}', 'string')"))


def valid_pair(pair: Column) -> Column:
    """Type known, origin system or user, source and replacement not blank."""
    return F.coalesce(
        pair["entity_type"].isin(*ENTITY_TYPES)
        & pair["origin"].isin("system", "user")
        & (trim_space(pair["source"]) != "")
        & (trim_space(pair["replacement"]) != ""),
        F.lit(False),
    )


def parse_envelopes(files: DataFrame, json_col: str) -> DataFrame:
    """Add ``pairs`` (array of pairs in file order) and ``valid`` to rows of JSON texts."""
    doc = files.withColumn("_v", F.expr(f"try_parse_json({json_col})"))
    is_array = F.expr("schema_of_variant(variant_get(_v, '$.rules', 'variant'))").startswith("ARRAY")
    doc = doc.withColumn("_rules", F.when(is_array, F.expr("variant_get(_v, '$.rules', 'array<variant>')")))
    pairs = F.transform("_rules", lambda p: F.struct(*_fields(p)))
    doc = doc.withColumn("pairs", pairs).withColumn("_version", _string("_v", "schemaVersion"))
    valid = F.coalesce(
        (F.col("_version") == SCHEMA_VERSION) & F.forall("pairs", valid_pair), F.lit(False)
    )
    return doc.withColumn("valid", valid).drop("_v", "_rules", "_version")


def _fields(p: Column) -> list[Column]:
    out = []
    for name, json_name in JSON_NAMES.items():
        value = F.variant_get(p, f"$.{json_name}", "variant")
        text = F.variant_get(p, f"$.{json_name}", "string")
        out.append(F.when(F.schema_of_variant(value) == "STRING", text).alias(name))
    return out


def import_envelopes(files: DataFrame, json_col: str, id_cols: Sequence[str] = ()) -> DataFrame:
    """The pairs of all files, ``(*id_cols, ord, <pair fields>)``; one invalid file fails the whole query.

    The check runs in the same pass as the parsing.
    """
    parsed = parse_envelopes(files, json_col)
    refuse = F.raise_error(F.lit("invalid-rules-file")).cast(parsed.schema["pairs"].dataType)
    sound = F.when(F.col("valid"), F.col("pairs")).otherwise(refuse)
    return parsed.select(*id_cols, F.posexplode(sound).alias("ord", "_p")).select(*id_cols, "ord", "_p.*")


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Read envelope files (whole files, so any layout): ``(file, ord, <pair fields>)``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return import_envelopes(files, "value", ["file"])


def _parsed_pairs(spark: SparkSession, path: str, others: str) -> DataFrame:
    body = spark.read.text(f"{path}/rules").select(F.try_parse_json("value").alias("_v"))
    more = StructType.fromDDL(others) if others else StructType()
    return body.select(
        *[F.try_variant_get("_v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in more],
        *_fields(F.col("_v")),
    )


def _agrees(spark: SparkSession, path: str, rows: int, sound: bool) -> bool:
    head = spark.read.json(f"{path}/head", schema="schemaVersion string, generatedAt string, total bigint").first()
    return head is not None and head.schemaVersion == SCHEMA_VERSION and head.total == rows and sound


def read_pairs(spark: SparkSession, path: str, others: str = "", into: str | None = None) -> DataFrame:
    """Read what :func:`write_pairs` wrote, with the same checks as for an envelope: a value that is no string is none.

    ``others`` is the schema of further columns, such as ``doc_id bigint, ord bigint``.

    With ``into``, a path, the pairs are parsed once: they are written there as Parquet while they are counted and checked, and
    read back.  If a pair is bad, or their number is not that of the head, nothing stays there.  Without it they are
    checked now and parsed again by whoever reads the result, which needs no space.
    """
    pairs = _parsed_pairs(spark, path, others)
    ok = valid_pair({n: F.col(n) for n in PAIR_FIELDS})
    checks = [F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("ok")]
    if into is None:
        seen = pairs.agg(*checks).first()
        if not _agrees(spark, path, seen.n, seen.ok):
            raise InvalidRulesFile("invalid-rules-file")
        return pairs
    observed = Observation()
    target = spark._jvm.org.apache.hadoop.fs.Path(into)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    pairs.observe(observed, *checks).write.mode("errorifexists").parquet(into)
    if not _agrees(spark, path, observed.get["n"], observed.get["ok"]):
        files.delete(target, True)
        raise InvalidRulesFile("invalid-rules-file")
    return spark.read.schema(pairs.schema).parquet(into)
