"""WARC record columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Record layout.
LINE_END = "\r\n"
BLANK_LINE = "\r\n\r\n"
VERSION = "WARC/1.0"
RECORD_TYPE = "response"
CONTENT_TYPE = "application/http; msgtype=response"
DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def record_date(moment: Column) -> Column:
    """UTC date text, whatever the session zone."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), DATE_FORMAT)


def record_header(url: Column, body_bytes: Column, date: Column, record_id: Column) -> Column:
    return F.concat(
        F.lit(f"{VERSION}{LINE_END}WARC-Type: {RECORD_TYPE}{LINE_END}WARC-Target-URI: "), url,
        F.lit(f"{LINE_END}WARC-Date: "), date,
        F.lit(f"{LINE_END}WARC-Record-ID: <urn:uuid:"), record_id,
        F.lit(f">{LINE_END}Content-Type: {CONTENT_TYPE}{LINE_END}Content-Length: "),
        body_bytes.cast("string"), F.lit(BLANK_LINE),
    )


def record(url: Column, body: Column, date: Column, record_id: Column) -> Column:
    """Header, body and the closing blank line, as bytes."""
    header = record_header(url, F.octet_length(body), date, record_id)
    return F.encode(F.concat(header, body, F.lit(BLANK_LINE)), "UTF-8")
