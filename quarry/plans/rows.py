"""Queries over unparsed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.rows import INDEX_LINE, checked, invalid_rows, valid_rows


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark.read.parquet(f"{sf_dir}/raw_index_lines.parquet"), "raw_line", INDEX_LINE)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rows(_tested(spark, sf_dir), "raw_id").select("raw_id")


def p4_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_rows(_tested(spark, sf_dir), INDEX_LINE, "raw_id", "batch_no")


_FIELD = r'(?:"(?:[^"]|"")*"|[^",\n\x01]*)'
_TYPE = "(?:warcinfo|response|resource|request|metadata|revisit|conversion|continuation)"
_ROW = rf'(?s)^{_FIELD},(?:[ \t]*{_TYPE}[ \t]*|"[ \t]*{_TYPE}[ \t]*"),{_FIELD},{_FIELD},{_FIELD},(?:[ \t]*([0-9]*)[ \t]*|"[ \t]*([0-9]*)[ \t]*"),{_FIELD}\r?$'
_LENGTH = f"concat(regexp_extract(line, '{_ROW}', 1), regexp_extract(line, '{_ROW}', 2))"
_VALID = f"regexp_matches(line, '{_ROW}') AND NOT contains(line, chr(1)) AND ({_LENGTH} = '' OR TRY_CAST({_LENGTH} AS BIGINT) IS NOT NULL)"
_LINES = "(SELECT raw_id, batch_no, coalesce(raw_line, '') AS line FROM raw_index_lines)"

QUERIES = {f.__name__: f for f in (p4_found, p4_valid)}
_CUT = "list_transform(regexp_extract_all(regexp_replace(line, '\\r$', '') || ',', '((?:\"(?:[^\"]|\"\")*\"|[^\",]*)),', 1), lambda f: CASE WHEN starts_with(f, '\"') THEN replace(f[2:-2], '\"\"', '\"') ELSE f END)"
ORACLE = {
    "p4_found": f"SELECT raw_id FROM {_LINES} WHERE NOT ({_VALID})",
    "p4_valid": f"""
        SELECT raw_id, batch_no, f[1] AS record_id, trim(f[2], chr(32) || chr(9)) AS warc_type, f[3] AS warc_target_uri, f[4] AS warc_date, f[5] AS content_type,
               TRY_CAST(nullif(trim(f[6], chr(32) || chr(9)), '') AS BIGINT) AS content_length, f[7] AS warc_payload_digest
        FROM (SELECT raw_id, batch_no, {_CUT} AS f FROM {_LINES} WHERE {_VALID})""",
}
