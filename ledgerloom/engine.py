"""The library's front door: what a service would offer, as functions from rows to rows.

Requests are rows: ``files`` is (request_id, filename, content, file_ord), any number of requests at once, and each
request's answer is one row with a JSON object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions.text import markdown_name
from .operators import pages as P
from .operators import pdf
from .operators.documents import last_upload_wins
from .operators.jobs import route
from .operators.statements import exists, load_lookup, save_lookup
from .plans.registry import SCHEMES, file_type, listing
from .sources.files import archives_markdown, parse

VERSION = "0.2.0"
SEPARATOR = "\n\n---\n\n"


def _scheme(name: str, background: bool = False):
    if name not in SCHEMES:
        raise ValueError(f"Unknown scheme: {name}. Available: {sorted(SCHEMES)}")
    if background and name == "raw":
        raise ValueError(f"Scheme '{name}' is not a background-job scheme")
    return SCHEMES[name]


def latest(files: DataFrame) -> DataFrame:
    """Of files of a request with one name the last counts."""
    names = F.struct("request_id", "filename")
    return last_upload_wins(files.select(names.alias("filename"), "content", "file_ord")).select("filename.request_id", "filename.filename", "content", "file_ord")


def _sorted(what: list, keep: Column | None = None) -> Column:
    row = F.struct(*what)
    return F.array_sort(F.collect_list(row if keep is None else F.when(keep, row)))


def _answers(texts: DataFrame, scheme: str, output_mode: str) -> DataFrame:
    """(request_id, ``json``) of texts (request_id, filename, text, error, [meta])."""
    good = F.col("error").isNull()
    # Maps have no order; their entries have.
    described = "meta" in texts.columns
    fields = ["filename", "text"] + ([F.map_entries("meta").alias("meta")] if described else [])
    out = texts.groupBy("request_id").agg(_sorted(fields, good).alias("f"), _sorted(["filename", "error"], ~good).alias("errors"))
    n = F.size("f")
    one = F.get("f", F.lit(0))
    merged = F.array_join(F.transform("f", lambda x: F.concat(F.lit("=== "), x["filename"], F.lit(" ===\n\n"), x["text"]) if scheme == "raw" else x["text"]), SEPARATOR)
    individual = F.lit(output_mode == "individual")
    head = [F.lit(scheme).alias("scheme"), F.col("errors")]
    if scheme == "raw":
        single = F.to_json(F.struct(*head, one["text"].alias("text"), one["filename"].alias("filename")))
        several = F.to_json(F.struct(*head, F.lit(False).alias("merged"), F.col("f").alias("files")))
        whole = F.to_json(F.struct(*head, F.lit(True).alias("merged"), merged.alias("text"), F.lit("merged_extraction.txt").alias("filename"), n.alias("file_count")))
        body = F.when(n == 1, single).when(individual, several).otherwise(whole)
    else:
        extra = [F.map_from_entries(one["meta"]).alias("metadata")] if described else []
        entry = lambda x: F.struct(x["filename"].alias("filename"), x["text"].alias("text"), *([F.map_from_entries(x["meta"]).alias("metadata")] if described else []))
        single = F.to_json(F.struct(*head, one["text"].alias("text"), one["filename"].alias("filename"), *extra))
        several = F.to_json(F.struct(*head, F.lit("").alias("text"), F.lit("").alias("filename"), F.transform("f", entry).alias("files"), n.alias("file_count")))
        whole = F.to_json(F.struct(*head, merged.alias("text"), F.lit("converted.md").alias("filename"), n.alias("file_count")))
        body = F.when(individual, several).when(n == 1, single).otherwise(whole)
    failed = F.to_json(F.struct(F.concat(F.lit("All extractions failed: "), F.to_json("errors")).alias("detail")))
    return out.select("request_id", F.when(n == 0, failed).otherwise(body).alias("json"))


def extract(files: DataFrame, scheme: str = "raw", output_mode: str = "consolidated") -> DataFrame:
    """(request_id, ``json``): each request's files as text, or converted by a scheme.

    A file that cannot be read is an entry of ``errors``; one of a kind that the scheme does not take is the answer.
    """
    found = _scheme(scheme)
    files = latest(files)
    if scheme == "raw":
        return _answers(_with_request(files, parse), scheme, output_mode)
    ext = F.concat(F.lit("."), F.lower(F.regexp_extract("filename", r"\.([^./]*)$", 1)))
    files = files.withColumn("ext", ext).withColumn("taken", ext.isin(*found.accepts))
    refused = files.where("not taken").groupBy("request_id").agg(F.min(F.struct("filename", "ext")).alias("f"))
    detail = F.concat(F.lit("File '"), "f.filename", F.lit("' ("), "f.ext", F.lit(f") not accepted by scheme '{scheme}'. Accepted: {list(found.accepts)}"))
    refused = refused.select("request_id", F.to_json(F.struct(detail.alias("detail"))).alias("json"))
    files = files.join(refused.select("request_id"), "request_id", "left_anti")
    if scheme == "mhtml2md":
        texts = archives_markdown(files, keys=("request_id",)).withColumn("error", F.lit(None).cast("string"))
    else:
        texts = _with_request(files, lambda f: found.transform(f).withColumn("error", F.lit(None).cast("string")), lambda c: markdown_name(c, scheme))
    return _answers(texts, scheme, output_mode).union(refused)


def _with_request(files: DataFrame, transform, name=lambda c: c) -> DataFrame:
    """``transform`` of files under names that hold the request, which comes back as a column."""
    tagged = files.select(F.concat(F.col("request_id").cast("string"), F.lit("/"), "filename").alias("filename"), "content")
    out = transform(tagged)
    at = F.instr("filename", "/")
    out = out.select(F.substr("filename", F.lit(1), at - 1).alias("request_id"), F.substr("filename", at + 1).alias("filename"), "text", "error")
    kind = files.schema["request_id"].dataType
    return out.withColumn("request_id", F.col("request_id").cast(kind))


def events(files: DataFrame, scheme: str = "raw", output_mode: str = "consolidated") -> DataFrame:
    """The progress feed of requests: request_id, ``seq``, ``type``, ``frame``.

    One ``progress`` per file, then ``processing`` for a scheme, then exactly one ``result`` or ``error``; a request that is too large
    gets a single ``job_queued`` instead.
    """
    found = _scheme(scheme)
    sizes = files.select("request_id", F.lit(scheme).alias("scheme"), F.length("content").cast("long").alias("bytes"), F.lit(None).cast("long").alias("pages"))
    routes = route(sizes).select("request_id", "route")
    by = W.partitionBy("request_id")
    frame = lambda type_, *fields: F.concat(F.lit("data: "), F.to_json(F.struct(F.lit(type_).alias("type"), *fields)), F.lit("\n\n"))
    inline = files.join(routes, "request_id").where("route = 'inline'")
    current, total = F.row_number().over(by.orderBy("file_ord")), F.count("*").over(by)
    steps = inline.select("request_id", current.alias("current"), total.alias("total"), "filename")
    steps = steps.select("request_id", F.col("current").alias("seq"), F.lit("progress").alias("type"), frame("progress", "current", "total", "filename").alias("frame"))
    n = inline.groupBy("request_id").agg(F.count("*").alias("n"))
    if scheme != "raw":
        note = frame("processing", F.lit(scheme).alias("scheme"), F.lit(found.label).alias("scheme_label"), F.col("n").alias("file_count"))
        steps = steps.union(n.select("request_id", (F.col("n") + 1).cast("int"), F.lit("processing"), note))
    done = extract(inline.select("request_id", "filename", "content", "file_ord"), scheme, output_mode).join(n, "request_id")
    kind = F.when(F.get_json_object("json", "$.detail").isNotNull(), "error").otherwise("result")
    body = F.concat(F.lit('data: {"type":"'), kind, F.lit('",'), F.substr("json", F.lit(2)), F.lit("\n\n"))
    steps = steps.union(done.select("request_id", (F.col("n") + 2).cast("int"), kind, body))
    queued = routes.where("route = 'queued'").select("request_id", F.lit(1), F.lit("job_queued"), frame("job_queued", F.col("request_id").cast("string").alias("request_id")))
    return steps.union(queued)


def structured(files: DataFrame) -> DataFrame:
    """(doc, plain_text, markdown, json, table_count) of files that a reader can open."""
    found = pdf.inputs(files)
    texts = P.structured_pages(found["pages"], found["words"], found["tables"], P.ocr_markdown(found["ocr"]).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda s: s["text"]), "\n\n").alias("text")))
    return P.structured_documents(texts, found["tables"])


def schemes(spark: SparkSession) -> DataFrame:
    return listing(spark).where("kind = 'scheme'")


def templates(spark: SparkSession) -> DataFrame:
    return listing(spark).where("kind = 'parser'")


def health(spark: SparkSession, lookup_path: str) -> dict:
    return {"ok": True, "lookup_exists": exists(spark, lookup_path), "lookup_path": lookup_path}


def version() -> dict:
    return {"service": "ledgerloom", "version": VERSION}


__all__ = ["events", "extract", "file_type", "health", "latest", "load_lookup", "save_lookup", "schemes", "structured", "templates", "version"]
