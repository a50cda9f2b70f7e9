"""Queries over whole documents as bytes, written here row by row and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import documents
from .catalog import query, spread, table

_FIRST = "%PDF-1.7\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"
_PAGES = "2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n"
_AT_2, _AT_3 = len(_FIRST), len(_FIRST + _PAGES)


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer: four objects; every third has a second revision that replaces object 3 and frees object 4, every third one whose older anchor is its own."""
    name, segment, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey") % 3

    def ends(at: Column, trailer: Column) -> Column:
        return F.concat(F.lit("trailer\n"), trailer, F.lit("\nstartxref\n"), at.cast("string"), F.lit("\n%%EOF\n"))

    def row(at: Column) -> Column:
        return F.concat(F.lpad(at.cast("string"), 10, "0"), F.lit(" 00000 n \n"))

    three = F.concat(F.lit("3 0 obj\n("), name, F.lit(")\nendobj\n"))
    four = F.concat(F.lit("4 0 obj\n<< /Length "), F.length(segment).cast("string"), F.lit(" >>\nstream\n"), segment, F.lit("\nendstream\nendobj\n"))
    at_4 = F.lit(_AT_3) + F.length(three)
    at_x = at_4 + F.length(four)
    base = F.concat(F.lit(_FIRST + _PAGES), three, four, F.lit("xref\n0 5\n0000000000 65535 f \n"), row(F.lit(9)), row(F.lit(_AT_2)), row(F.lit(_AT_3)), row(at_4), ends(at_x, F.lit("<< /Size 5 /Root 1 0 R >>")))
    docs = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select("c_custkey", k.alias("k"), F.reverse("c_name").alias("second"), at_x.alias("at_x"), base.alias("base"))
    again = F.concat(F.lit("3 0 obj\n("), F.col("second"), F.lit(")\nendobj\n"))
    later = F.length("base") + F.length(again)
    older = F.when(F.col("k") == 1, F.col("at_x")).otherwise(later)
    update = F.concat(again, F.lit("xref\n3 2\n"), row(F.length("base")), F.lit("0000000000 00001 f \n"), ends(later, F.concat(F.lit("<< /Size 5 /Root 1 0 R /Prev "), older.cast("string"), F.lit(" >>"))))
    return docs.select("c_custkey", F.encode(F.concat("base", F.when(F.col("k") == 0, "").otherwise(update)), "UTF-8").alias("content"))


#: Offsets by the lengths of what lies before: object 3 holds a name, object 4 a segment of up to two digits of length.
_PLACES = f"""
    p AS (SELECT c_custkey, c_custkey % 3 AS k, c_name, c_mktsegment, {_AT_3} + 18 + length(c_name) AS at4, {_AT_3} + 18 + length(c_name) + 48 + length(length(c_mktsegment)::VARCHAR) + length(c_mktsegment) AS atx FROM customer),
    q AS (SELECT *, atx + 9 + 20 * 5 + 8 + 25 + 11 + length(atx::VARCHAR) + 7 AS base FROM p)"""


@query(f"""
    WITH {_PLACES}
    SELECT c_custkey, CASE WHEN k = 1 THEN 1 ELSE 0 END AS revision, unnest([0, 1, 2, 3, 4]) AS object, unnest(['free', 'in-use', 'in-use', 'in-use', 'in-use']) AS kind, unnest([NULL, 9, {_AT_2}, {_AT_3}, at4]) AS "offset", 'ready' AS outcome FROM q WHERE k < 2
    UNION ALL SELECT c_custkey, 0, unnest([3, 4]), unnest(['in-use', 'free']), unnest([base, NULL]), 'ready' FROM q WHERE k = 1
    UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, 'anchor-order' FROM q WHERE k = 2""")
def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.entries(_bytes(spark, sf_dir), "c_custkey").select("c_custkey", "revision", "object", "kind", "offset", "outcome")


@query(f"""
    WITH {_PLACES}
    SELECT c_custkey, unnest([1, 2, 3]) AS object, unnest([9, {_AT_2}, CASE WHEN k = 1 THEN base ELSE {_AT_3} END]) AS "offset" FROM q WHERE k < 2
    UNION ALL SELECT c_custkey, 4, at4 FROM q WHERE k = 0""")
def document_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that hold over all revisions of documents."""
    return documents.effective_entries(documents.entries(_bytes(spark, sf_dir), "c_custkey"), "c_custkey").select("c_custkey", "object", "offset")


@query("""
    WITH c AS (SELECT c_custkey, c_custkey % 3 AS k, c_name, c_mktsegment FROM customer)
    SELECT c_custkey, unnest([1, 2, 3]) AS object, unnest(['Catalog', 'Pages', NULL]) AS type, unnest([NULL, NULL, '"' || CASE WHEN k = 1 THEN reverse(c_name) ELSE c_name END || '"']) AS text, NULL::VARCHAR AS stream, 'ready' AS outcome FROM c WHERE k < 2
    UNION ALL SELECT c_custkey, 4, NULL, NULL, c_mktsegment, 'ready' FROM c WHERE k = 0
    UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, 'anchor-order' FROM c WHERE k = 2""")
def document_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = documents.objects(_bytes(spark, sf_dir), "c_custkey")
    return o.select("c_custkey", "object", "type", F.when(F.col("object") == 3, F.col("value")).alias("text"), F.decode("stream", "UTF-8").alias("stream"), "outcome")


_TREE = "<< /Type /Pages /Kids ["


@query("""
    SELECT s_suppkey, 2 AS root, 1 + s_suppkey % 5 AS pages, CASE WHEN s_suppkey % 4 = 3 THEN 'count-mismatch' ELSE 'ready' END AS outcome FROM supplier""")
def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page tree of one to five pages for each supplier; every fourth declares one page too many."""
    k = F.col("s_suppkey")
    n = (k % 5 + 1).cast("int")
    numbers = F.transform(F.sequence(F.lit(3), n + 2), lambda i: i.cast("string"))
    kids = F.array_join(F.transform(numbers, lambda i: F.concat(i, F.lit(" 0 R"))), " ")
    tree = F.concat(F.lit(f"2 0 obj\n{_TREE}"), kids, F.lit("] /Count "), (n + F.when(k % 4 == 3, 1).otherwise(0)).cast("string"), F.lit(" >>\nendobj\n"))
    page = "%s 0 obj\n<< /Type /Page >>\nendobj\n"
    pages = F.array_join(F.transform(numbers, lambda i: F.concat(i, F.lit(page[2:]))), "")
    at_3 = F.lit(_AT_2) + F.length(tree)
    row = lambda at: F.concat(F.lpad(at.cast("string"), 10, "0"), F.lit(" 00000 n \n"))
    rows = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: row(at_3 + i * (len(page) - 1))), "")
    at_x = at_3 + n * (len(page) - 1)
    text = F.concat(F.lit(_FIRST), tree, pages, F.lit("xref\n0 "), (n + 3).cast("string"), F.lit("\n0000000000 65535 f \n"), row(F.lit(9)), row(F.lit(_AT_2)), rows, F.lit("trailer\n<< /Root 1 0 R >>\nstartxref\n"), at_x.cast("string"), F.lit("\n%%EOF\n"))
    docs = spread(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", F.encode(text, "UTF-8").alias("content"))
    return documents.page_counts(documents.objects(docs, "s_suppkey"), "s_suppkey")
