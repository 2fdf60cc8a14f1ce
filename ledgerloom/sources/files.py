"""Readers of bytes, strict JSON lines, indexes, ledgers, tails and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import parsed
from ..operators.rules import Rule, duplicates, violations
from ..operators.scan import Fold, running

#: Largest source, in bytes.
SOURCE_LIMIT = 100 << 20


def documents(spark: SparkSession, path: str, limit: int = SOURCE_LIMIT) -> DataFrame:
    """(path, length, content, sha256) of files, recursively; larger ones than the limit have null content.

    The length is filtered before the content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    read = files.where(F.col("length") <= limit).select("path", "length", "content", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > limit).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("sha256"))
    return read.unionByName(large)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files under a folder, for joins.inventory_diff."""
    return documents(spark, path).select("path", "sha256", F.col("length").alias("bytes"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, value): the lines of text files, numbered from zero in each file.

    Files are read in splits. Lines are counted by split, and a line is numbered within its split, so
    that a large file is neither one row nor one task's.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    counts = lines.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1
    both = lines.withColumn("inside", inside).join(counts.select("path", "block", before.alias("before")), ["path", "block"])
    return both.select("path", (F.col("before") + F.col("inside")).cast("long").alias("position"), "value")


def json_lines(spark: SparkSession, path: str, form: str = "row") -> DataFrame:
    """(path, position, value, ok, error, canonical, sha256): every line of numbered_lines(), strictly parsed."""
    return numbered_lines(spark, path).withColumn("p", parsed(F.col("value"), form)).select("path", "position", "value", "p.*")


def manifest_problems(lines: DataFrame, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, rule) where files differ from their manifest (path, sha256, rows).

    lines: json_lines(); files: inventory(). A file that is missing, has another hash or number of rows, or a
    line that is no strict JSON breaks a rule; so does a file that no manifest names.
    """
    counted = lines.groupBy("path").agg(F.count("*").alias("found"), F.count_if(~F.col("ok")).alias("bad"))
    both = manifest.select("path", F.col("sha256").alias("want"), "rows").join(files.select("path", F.col("sha256").alias("have"), F.lit(True).alias("there")), "path", "full_outer").join(counted, "path", "left")
    c = F.col
    broken = F.array_compact(F.array(
        F.when(c("there").isNull(), "missing"), F.when(c("rows").isNull(), "not_in_manifest"), F.when(c("want") != c("have"), "hash_differs"),
        F.when(c("there") & (c("rows") != F.coalesce("found", F.lit(0))), "rows_differ"), F.when(c("bad") > 0, "not_json"),
    ))
    return both.select("path", F.explode(broken).alias("rule"))


def framed_lines(chunks: DataFrame, key: str = "path", position: str = "position", column: str = "value", limit: int = 64 << 10) -> DataFrame:
    """(key, line, value) of text that arrives in chunks: lines end at newlines, in the order of the chunks.

    What stands open at the end is the last line. A line longer than `limit` characters is cut into pieces of
    that size, each a line, so that no row is larger; empty lines stay. Null chunks are empty.

    A key is never put together: each chunk learns from running values how many lines and characters came before it and where
    the open line began, and so to which piece of which line its parts belong. Only pieces are joined.
    """
    told = chunks.select(F.col(key).alias("_key"), F.col(position).alias("_at"), F.coalesce(column, F.lit("")).alias("_text"))
    told = told.withColumn("_parts", F.split("_text", "\n")).withColumn("_new", (F.size("_parts") - 1).cast("long"))
    told = running(told, ["_key"], ["_at"], {"_before": Fold("sum", F.length("_text").cast("long"), before=True), "_lines": Fold("sum", F.col("_new"), before=True)})
    told = told.withColumn("_before", F.coalesce("_before", F.lit(0))).withColumn("_lines", F.coalesce("_lines", F.lit(0)))
    open_from = F.when(F.col("_new") > 0, F.col("_before") + F.length("_text") - F.length(F.get("_parts", F.col("_new").cast("int"))))
    told = running(told, ["_key"], ["_at"], {"_open": Fold("max", open_from, before=True)})
    parts = told.select("_key", "_at", "_lines", "_new", (F.col("_before") - F.coalesce("_open", F.lit(0))).alias("_inside"), F.posexplode("_parts").alias("_k", "_part"))
    offset, size = F.when(F.col("_k") == 0, F.col("_inside")).otherwise(0), F.length("_part")
    parts = parts.where((F.col("_k") < F.col("_new")) | (size > 0)).withColumn("_from", offset)
    # A part without characters only says that its line is there.
    first = F.when(size > 0, F.floor(F.col("_from") / limit)).otherwise(F.floor(F.greatest(F.col("_from") - 1, F.lit(0)) / limit))
    last = F.when(size > 0, F.floor((F.col("_from") + size - 1) / limit)).otherwise(first)
    pieces = parts.select("*", F.explode(F.sequence(first, last)).alias("_piece"))
    begin, end = F.greatest(F.col("_piece") * limit, F.col("_from")), F.least((F.col("_piece") + 1) * limit, F.col("_from") + size)
    cut = F.substring(F.col("_part"), (begin - F.col("_from") + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))
    pieces = pieces.select("_key", (F.col("_lines") + F.col("_k")).alias("_line"), "_piece", F.struct("_at", cut.alias("text")).alias("x"))
    whole = pieces.groupBy("_key", "_line", "_piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "").alias("value"))
    numbered = running(whole, ["_key"], ["_line", "_piece"], {"line": Fold("count", before=True)})
    return numbered.select(F.col("_key").alias(key), "line", F.rtrim("value", F.lit("\r")).alias("value"))


# Forms of the index that are kept.
INDEX_FORMS = ("N-PX", "N-PX/A")


def index_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """(cik, registrant, form, filed, archive_path, accession) of five-part lines with a numeric key and a kept form."""
    parts = F.split(column, "\\|")
    found = lines.select(parts.alias("p")).where((F.size("p") == 5) & F.trim(F.get("p", F.lit(0))).rlike("^[0-9]+$") & F.get("p", F.lit(2)).isin(*INDEX_FORMS))
    at = lambda i: F.get("p", F.lit(i))
    return found.select(F.trim(at(0)).alias("cik"), at(1).alias("registrant"), at(2).alias("form"), at(3).alias("filed"), at(4).alias("archive_path"), F.regexp_extract(at(4), "([^/]*?)(\\.[^./]*)?$", 1).alias("accession"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """index_rows() of Latin-1 files; lines also end at the separators U+000B, U+000C, U+001C to U+001E and U+0085."""
    whole = spark.read.format("binaryFile").load(path).select(F.decode("content", "ISO-8859-1").alias("t"))
    return index_rows(whole.select(F.explode(F.split("t", "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85]")).alias("value")))


def ledger_rules() -> list[Rule]:
    """What a settled ledger row may not be."""
    return [
        Rule("started", F.col("status") == "STARTED", "an execution is still open", "status"),
        Rule("seconds", F.col("elapsed_seconds").isNull() | F.isnan("elapsed_seconds") | (F.col("elapsed_seconds") < 0), "seconds are not finite and non-negative", "elapsed_seconds"),
    ]


def ledger_problems(ledger: DataFrame, execution: str = "execution_id") -> DataFrame:
    """(execution, rule): ledger_rules() that rows break, and executions that stand there twice."""
    broken = violations(ledger, execution, ledger_rules()).select(F.col("entity_id").alias(execution), F.col("rule_id").alias("rule"))
    return broken.unionByName(duplicates(ledger, execution).select(F.col(execution).cast("string").alias(execution), F.lit("execution_twice").alias("rule")))


def read_until_broken(lines: DataFrame, schema: str, key: str = "path", position: str = "position", column: str = "value") -> DataFrame:
    """(key, position, row) of the JSON lines of a file before its first broken one."""
    bad = F.min(F.when(F.try_parse_json(F.col(column)).isNull(), F.col(position))).over(Window.partitionBy(key))
    return lines.withColumn("_bad", bad).where(F.col("_bad").isNull() | (F.col(position) < F.col("_bad"))).select(key, position, F.from_json(column, schema).alias("row"))


def tolerant_tail(lines: DataFrame, schema: str, key: str = "path", position: str = "position", column: str = "value") -> DataFrame:
    """Rows of JSON lines of which only the last of a file may be broken: `row` and `broken_before_end`."""
    read = F.from_json(column, schema)
    last = F.max(position).over(Window.partitionBy(key))
    ok = F.try_parse_json(F.col(column)).isNotNull()
    return lines.select(key, position, read.alias("row"), ok.alias("ok"), (F.col(position) == last).alias("is_last")).where(F.col("ok") | ~F.col("is_last")).select(key, position, "row", (~F.col("ok")).alias("broken_before_end"))


def server_events(lines: DataFrame, schema: str, column: str = "value", line_limit: int = 1 << 20, stream_limit: int = 16 << 20, token_limit: int | None = None) -> DataFrame:
    """Payloads of `data: ` lines before the end mark: (path, position, event, too_long).

    too_long: the line is over line_limit bytes, the stream up to it over stream_limit, or, with a
    token_limit, more payloads came than that.
    """
    is_data = F.col(column).startswith("data: ")
    size = F.octet_length(column)
    folds = {"_done": Fold("min", F.when(F.col(column) == "data: [DONE]", F.col("position"))), "_bytes": Fold("sum", (size + 1).cast("long")), "_n": Fold("sum", is_data.cast("long"))}
    told = running(lines, ["path"], ["position"], folds)
    told = told.where(is_data & F.col("_done").isNull())
    body = F.substring(F.col(column), F.lit(7), F.length(column))
    over = (size > line_limit) | (F.col("_bytes") > stream_limit)
    return told.select("path", "position", F.from_json(body, schema).alias("event"), (over if token_limit is None else over | (F.col("_n") > token_limit)).alias("too_long"))


def url_allowed(url: Column, hosts: tuple[str, ...]) -> Column:
    """True for https URLs of the hosts, without credentials, at no port or 443."""
    authority = F.regexp_extract(url, "^(?i:https)://([^/?#\\\\]*)", 1)
    host = F.lower(F.regexp_extract(authority, "^([^:@]+)(:443|:)?$", 1))
    return F.coalesce(host.isin(*hosts), F.lit(False))


def accession_ok(accession: Column) -> Column:
    return F.coalesce(accession.rlike("^[0-9]{10}-[0-9]{2}-[0-9]{6}$"), F.lit(False))


# The form of portable names, file names that one system reserves, and marks of a failure page.
PORTABLE = "^[a-z0-9][a-z0-9.-]{0,219}$"
RESERVED = ("con", "prn", "aux", "nul", *(f"{x}{i}" for x in ("com", "lpt") for i in range(1, 10)))
FAILURES = ("file unavailable", "undeclared automated tool", "request rate threshold exceeded")


def portable_name(name: Column) -> Column:
    """True for lower-case file names of up to 220 characters that every system takes."""
    stem = F.regexp_extract(name, "^([^.]*)", 1)
    return F.coalesce(name.rlike(PORTABLE) & ~F.contains(name, F.lit("..")) & ~name.endswith(".") & ~stem.isin(*RESERVED), F.lit(False))


def relative_path(path: Column) -> Column:
    """True for paths that stay below their root."""
    return F.coalesce(~path.startswith("/") & ~path.rlike("(^|/)\\.\\.(/|$)") & (F.length(path) > 0), F.lit(False))


def fetch_problem(content: Column, markers: tuple[str, ...] = FAILURES, window: int = 64 << 10) -> Column:
    """Why a download is no document: a failure page's marker at its head, or a submission cut at its end."""
    head = F.lower(F.decode(F.substring(content, 1, window), "ISO-8859-1"))
    end = F.lower(F.decode(F.substring(content, -window, window), "ISO-8859-1"))
    failed = F.array_contains(F.array(*[F.contains(head, F.lit(m)) for m in markers]), True)
    return F.when(F.octet_length(content) == 0, "empty").when(failed, "failure_page").when(F.contains(head, F.lit("<sec-document>")) & ~F.contains(end, F.lit("</sec-document>")), "cut_short")


def registrant(cik: Column, url: Column) -> tuple[Column, Column]:
    """The key as digits without leading zeros, from the field or else the URL, and whether both differ."""
    told = F.regexp_extract(url, "/[Dd]ata/([0-9]+)/", 1)
    from_url = F.when(told != "", told.cast("decimal(38,0)").cast("string"))
    own = cik.cast("decimal(38,0)").cast("string")
    return F.coalesce(own, from_url), F.coalesce(own != from_url, F.lit(False))
