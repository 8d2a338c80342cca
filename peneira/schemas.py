"""Table contracts. One StructType per stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


LONG, INT, STRING, DOUBLE = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
DATE, TIME, STRINGS = T.DateType(), T.TimestampType(), T.ArrayType(T.StringType())


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


JOB_SOURCES = _schema(
    source_id=LONG, name=STRING, label=STRING, label_id=STRING, status=STRING, parser=STRING,
    last_sync_at=TIME, updated_at=TIME,
)
LABEL_CATALOG = _schema(label_id=STRING, label_path=STRING)
EMAIL_MESSAGES = _schema(
    message_id=STRING, label=STRING, received_at=TIME, subject=STRING, sender=STRING,
    raw_text=STRING, raw_html=STRING, status=STRING, error=STRING,
)
JOBS = _schema(
    job_id=STRING, message_id=STRING, block_no=INT, source_id=LONG, title=STRING, company=STRING,
    location=STRING, url=STRING, canonical_url=STRING, description=STRING, posted_at=DATE,
    lang=STRING, technologies=STRINGS, seniority=STRING, modality=STRING, missing_fields=STRINGS,
    parser_version=INT, extracted_at=TIME,
)
PROFILES = _schema(
    profile_id=LONG, full_name=STRING, email=STRING, current_role=STRING, location=STRING,
    ui_lang=STRING, material_lang=STRING, summary=STRING, version=INT,
)
PREFERENCES = _schema(
    profile_id=LONG, roles=STRINGS, seniority=STRINGS, technologies=STRINGS, modalities=STRINGS,
    locations=STRINGS, required=STRINGS,
    unwanted=T.ArrayType(_schema(term=STRING, action=STRING)),
    avoid_companies=STRINGS, avoid_areas=STRINGS, interest_areas=STRINGS, contract_types=STRINGS,
    salary_expectation=T.DecimalType(12, 2), min_score=INT, max_age_days=INT,
)
EVIDENCE = _schema(
    profile_id=LONG, kind=STRING, name=STRING, name_norm=STRING, level=STRING, years=DOUBLE,
    evidence=STRING,
)
ANALYSES = _schema(
    profile_id=LONG, job_id=STRING, score=INT, breakdown=T.MapType(STRING, DOUBLE),
    strengths=STRINGS, gaps=STRINGS, reason=STRING, classification=STRING, profile_version=INT,
    scored_at=TIME,
)
MATERIALS = _schema(
    profile_id=LONG, job_id=STRING, kind=STRING, lang=STRING, body=STRING, facts_used=STRINGS,
    created_at=TIME,
)


class ContractError(ValueError):
    """A table does not have the columns or types its contract states."""


def assert_contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Return ``df`` cut to the contract's columns, or fail on a missing or mistyped one."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    problems = [
        f"{f.name}: expected {f.dataType.simpleString()}, found {found.get(f.name, 'nothing')}"
        for f in schema.fields
        if found.get(f.name) != f.dataType.simpleString()
    ]
    if problems:
        raise ContractError("; ".join(problems))
    return df.select(*schema.names)
