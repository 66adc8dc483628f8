"""Mailboxes made from the test tables, one expression a mail: round trips for the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(*parts) -> Column:
    """The parts, strings or columns, joined by CRLF."""
    return F.concat_ws(CRLF, *[F.lit(p) if isinstance(p, str) else p for p in parts])


def header(name: str, value) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value))


def mail(frame: DataFrame, key: str, raw: Column) -> DataFrame:
    """(mail_id, content) and all columns of frame."""
    return frame.select("*", F.col(key).cast("string").alias("mail_id"), F.encode(raw, "UTF-8").alias("content"))


def base64(text: Column) -> Column:
    """Base64 in lines of 76 characters."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "(.{76})(?=.)", "$1\r\n")


def quoted_printable(text: Column) -> Column:
    """Every byte as an escape, in lines that end softly."""
    return F.regexp_replace(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "=$1"), "((?:=..){24})(?==)", "$1=\r\n")


def multipart(kind: str, parts: Column, *more) -> Column:
    """A message of a multipart type; parts: an array of whole parts."""
    body = F.concat(F.lit("--b1" + CRLF), F.array_join(parts, CRLF + "--b1" + CRLF), F.lit(CRLF + "--b1--" + CRLF))
    return F.concat(lines(*more, f'Content-Type: multipart/{kind}; boundary="b1"', ""), F.lit(CRLF), F.lit("preamble" + CRLF), body)


def part(content_type, body, *more) -> Column:
    return F.concat(lines(header("Content-Type", content_type), *more, ""), F.lit(CRLF), body if isinstance(body, Column) else F.lit(body))


def order_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain mail for each order, from its customer."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    frame = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    raw = F.concat(
        lines(
            F.concat(F.lit('From: "'), F.col("c_name"), F.lit('" <c'), F.col("c_custkey").cast("string"), F.lit("@example.com>")),
            "To: desk@example.com",
            header("Subject", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(': "'), F.col("o_orderpriority"), F.lit('"'))),
            header("Date", F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss '+0000'")),
            "Content-Type: text/plain; charset=utf-8",
            "",
        ),
        F.lit(CRLF),
        F.concat(F.lit("Status "), F.col("o_orderstatus"), F.lit("   " + CRLF)),
    )
    return mail(frame, "o_orderkey", raw)
