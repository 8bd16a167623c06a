"""Reading the analytic-inclusion state that receipts declare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions import strict
from trailmark.functions.labels import reason_codes


def read_eligibility(receipts: DataFrame, record: str = "record", field: str = "analytic_eligibility") -> DataFrame:
    """Adds eligible, eligibility_status and reason_codes from a VARIANT receipt.

    An absent field is eligible; JSON null and any other shape fail closed. The steps
    are separate projections so that each JSON lookup is evaluated once per row.
    """
    v, path = F.col(record), f"$.{field}"
    looked_up = receipts.withColumns(
        {
            "_kind": strict.json_type(v, path),
            "_flag": strict.strict_bool(v, path),
            "_nested": strict.strict_bool(v, f"{path}.eligible"),
            "_named": strict.strict_string(v, f"{path}.status"),
            "_codes": reason_codes(strict.child(v, path)),
        }
    )
    kind = F.col("_kind")
    mapping = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    excluded_name = F.col("_named").isin("EXCLUDED", "INELIGIBLE")
    status = (
        F.when(kind.isNull(), "NOT_DECLARED_LEGACY_ELIGIBLE")
        .when(F.col("_flag"), "EXPLICIT_BOOLEAN_ELIGIBLE")
        .when(~F.col("_flag"), "EXPLICIT_BOOLEAN_EXCLUDED")
        .when(mapping & F.col("_nested"), "EXPLICIT_MAPPING_ELIGIBLE")
        .when(mapping & ~F.col("_nested"), "EXPLICIT_MAPPING_EXCLUDED")
        .when(mapping & (F.col("_named") == "ELIGIBLE"), "EXPLICIT_MAPPING_STATUS_ELIGIBLE")
        .when(mapping & excluded_name, "EXPLICIT_MAPPING_STATUS_EXCLUDED")
        .otherwise("MALFORMED_EXPLICIT_FIELD_EXCLUDED")
    )
    known = looked_up.withColumn("eligibility_status", status)
    named = F.col("eligibility_status")
    codes = (
        F.when(named.startswith("EXPLICIT_MAPPING"), F.col("_codes"))
        .when(named == "EXPLICIT_BOOLEAN_EXCLUDED", F.array(F.lit("EXPLICIT_BOOLEAN_EXCLUDED")))
        .when(named.startswith("MALFORMED"), F.array(F.lit("MALFORMED_EXPLICIT_FIELD")))
        .otherwise(F.array().cast("array<string>"))
    )
    decided = known.withColumns({"eligible": named.endswith("ELIGIBLE"), "reason_codes": codes})
    return decided.drop("_kind", "_flag", "_nested", "_named", "_codes")
