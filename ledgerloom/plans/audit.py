"""Audit queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import blocks
from ..functions.markup import visible_text as visible_text_of
from ..functions.text import casefold, collapse
from ..operators import answers, datasets, holdout, joins, ordered, rules
from ..sources.files import url_allowed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (tables by name -> DataFrame) under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return add


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_answers(t):
    return joins.missing(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles, count(*) AS turns, min_by(role, turn) IN ('system', 'user') AS opens_well FROM conversations GROUP BY conv_id")
def role_order(t):
    turns = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    roles = F.transform("x", lambda r: r["role"])
    return turns.select("conv_id", F.array_join(roles, " ").alias("roles"), F.size("x").cast("long").alias("turns"), F.get(roles, F.lit(0)).isin("system", "user").alias("opens_well"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations")
def row_position(t):
    return ordered.positions(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn")])


@query("SELECT conv_id, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT turn) = max(turn) - min(turn) + 1 AS complete FROM conversations GROUP BY conv_id")
def position_coverage(t):
    span = F.max("turn") - F.min("turn") + 1
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), (F.count_distinct("turn") == span).alias("complete"))


@query("""WITH e AS (SELECT source, lang, count(*) AS n_expected FROM documents GROUP BY ALL),
f AS (SELECT source, lang, count(*) AS n_found FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY ALL)
SELECT coalesce(e.source, f.source) AS source, coalesce(e.lang, f.lang) AS lang, coalesce(n_expected, 0) AS n_expected, coalesce(n_found, 0) AS n_found
FROM e FULL JOIN f ON e.source = f.source AND e.lang = f.lang WHERE coalesce(n_expected, 0) <> coalesce(n_found, 0)""")
def coverage_by_source(t):
    docs = t("documents").select("doc_id", "source", "lang")
    return rules.coverage(docs, docs.join(t("labels").select("doc_id"), "doc_id", "left_semi"), ["source", "lang"])


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def content_identity(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(t):
    return rules.duplicates(t("documents").select(F.sha2("text", 256).alias("sha256")), "sha256")


@query("""SELECT sha256(text) AS sha256, min(source || '/' || doc_id) AS path, octet_length(encode(any_value(text)))::BIGINT AS bytes, count(DISTINCT source || '/' || lang)::BIGINT AS locations,
  'held' AS release FROM documents GROUP BY 1""")
def import_merge(t):
    """All documents imported into an empty inventory; a place is a source and a language."""
    none = F.lit(None).cast("string")
    files = t("documents").select(
        F.sha2("text", 256).alias("sha256"), F.concat_ws("/", "source", "doc_id").alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.concat_ws("/", "source", "lang").alias("sec_url"),
        *[none.alias(x) for x in datasets.LOCATION[1:]],
    )
    empty = files.where("false").groupBy("sha256").agg(F.first("path").alias("path"), F.first("bytes").alias("bytes"), F.collect_set(F.struct(*datasets.LOCATION)).alias("locations"), F.first("path").alias("release"))
    return datasets.imported(empty, files).withColumn("locations", F.size("locations").cast("long"))


_SPLITS = "CASE lang WHEN 'en' THEN 'training' WHEN 'de' THEN 'development' WHEN 'fr' THEN 'test' WHEN 'es' THEN 'excluded' ELSE 'odd' END"


def _assignments(t):
    """Documents as sources: the language is the split, equal texts are a group, toxic ones are exposed."""
    toxic = t("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = t("documents").join(toxic, "doc_id", "left")
    return docs.select(F.col("doc_id").cast("string").alias("accession"), F.expr(_SPLITS).alias("split"), F.substring(F.md5("text"), 1, 3).alias("group_id"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("development_exposed"))


_ASSIGNED = f"""a AS (SELECT d.doc_id::VARCHAR AS accession, {_SPLITS} AS split, left(md5(text), 3) AS group_id,
  coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = d.doc_id) = 1, false) AS exposed FROM documents d),
g AS (SELECT group_id, bool_or(exposed) AS exposed, count(DISTINCT split) FILTER (WHERE split <> 'excluded') AS splits FROM a GROUP BY group_id)"""


@query(f"""WITH {_ASSIGNED} SELECT accession, 'group_crosses_splits' AS rule FROM a JOIN g USING (group_id) WHERE splits > 1 AND split <> 'excluded'""")
def group_single_split(t):
    return holdout.assignment_problems(_assignments(t)).where("rule = 'group_crosses_splits'")


@query(f"""WITH {_ASSIGNED} SELECT accession, 'exposed_group_in_training' AS rule FROM a JOIN g USING (group_id) WHERE g.exposed AND split = 'training'
UNION ALL SELECT accession, 'unknown_split' FROM a WHERE split = 'odd'""")
def exposed_groups(t):
    return holdout.assignment_problems(_assignments(t)).where("rule <> 'group_crosses_splits'")


_KEYS = {"sha256": lambda: F.sha2("text", 256), "home": lambda: F.concat_ws("/", "source", "lang", "n_chars")}


def _reached(t):
    docs = t("documents").select("doc_id", "text", "source", "lang", "n_chars")
    keys = {k: f() for k, f in _KEYS.items()}
    toxic = docs.join(t("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return docs, joins.reached(docs, "doc_id", keys, joins.keyed(toxic, keys).distinct())


_PROTECTED = "p AS (SELECT sha256(text) AS h, concat_ws('/', source, lang, n_chars) AS o FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"


@query(f"WITH {_PROTECTED} SELECT DISTINCT doc_id FROM documents d WHERE sha256(text) IN (SELECT h FROM p) OR concat_ws('/', source, lang, n_chars) IN (SELECT o FROM p)")
def protected_semi(t):
    return _reached(t)[1]


@query(f"WITH {_PROTECTED} SELECT doc_id FROM documents d WHERE NOT (sha256(text) IN (SELECT h FROM p) OR concat_ws('/', source, lang, n_chars) IN (SELECT o FROM p))")
def protected_anti(t):
    docs, hit = _reached(t)
    return docs.select("doc_id").join(hit, "doc_id", "left_anti")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0")
def literal_support(t):
    return joins.quotations_in(t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def unsupported_quotes(t):
    return joins.missing(t("benchmark").select("item_id"), joins.quotations_in(t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text").distinct(), "item_id")


@query(r"""WITH c AS (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS cells FROM pages),
q AS (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS quote FROM pages)
SELECT c.page_id, len(list_filter(cells, lambda x: length(quote) > 0 AND contains(x, quote))) > 0 AS supported FROM c JOIN q USING (page_id)""")
def single_cell_support(t):
    cells = F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), 1)
    return t("pages").select("page_id", joins.supported(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1), cells).alias("supported"))


@query("""WITH a AS (SELECT doc_id, sha256(text) AS a FROM documents), b AS (SELECT turn * 1000 + conv_id AS doc_id, sha256(text) AS b FROM conversations)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.a IS DISTINCT FROM b.b""")
def inventory_diff(t):
    """All documents as one inventory, all turns as another, by number."""
    left = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    right = t("conversations").select((F.col("turn") * 1000 + F.col("conv_id")).alias("doc_id"), F.sha2("text", 256).alias("h"))
    return joins.inventory_diff(left, right, "doc_id", "h")


def _paragraphs(t):
    """Paragraphs of all pages, each as a source of its own."""
    found = t("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<p>.*?</p>"), 0)).alias("i", "c"))
    return found.select("page_id", F.col("i").cast("long").alias("block_index"), "c")


# What a reader shows of these pages' markup: they hold b, br and p, and five references.
_SHOWN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(c, '<(br|/?p)>', ' ', 'g'), '</?[a-z0-9]+>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;', '&'), '[\t\n\x0b\f\r \x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'))"""


@query(f"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p>.*?</p>')) AS c, generate_subscripts(regexp_extract_all(html, '(?s)<p>.*?</p>'), 1) - 1 AS block_index FROM pages),
k AS (SELECT *, len(regexp_extract_all(c, '<p>')) = 1 AS whole FROM p)
SELECT page_id, block_index, whole, CASE WHEN whole THEN sha256(c) END AS slice_sha256, CASE WHEN whole THEN {_SHOWN} END AS shown,
  CASE WHEN whole THEN octet_length(encode(c))::BIGINT END AS end_byte, CASE WHEN whole THEN len(string_split(c, chr(10)))::BIGINT END AS line_end FROM k""")
def block_cells(t):
    """Blocks of all paragraphs; one that holds another is refused."""
    raw = F.col("c").cast("binary")
    b = blocks(raw, F.lit(0).cast("long"), F.octet_length(raw).cast("long"), F.lit("block"), F.lit("utf-8"))
    found = _paragraphs(t).withColumn("b", b)
    cell = F.get("b.cells", F.lit(0))
    return found.select("page_id", "block_index", F.col("b.error").isNull().alias("whole"), F.col("b.source_slice_sha256").alias("slice_sha256"), cell["text"].alias("shown"), cell["end_byte"].alias("end_byte"), F.col("b.line_end").alias("line_end"))


_INNER = """p AS (SELECT page_id, octet_length(encode(url)) AS n, unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS c, generate_subscripts(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), 1) - 1 AS block_index, replace(url, '&', '&amp;') AS u FROM pages)"""


def _inner(t):
    """What stands in every paragraph, with its page's address as markup."""
    found = t("pages").select("page_id", F.replace("url", F.lit("&"), F.lit("&amp;")).alias("u"), F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), 1)).alias("i", "c"))
    return found.select("page_id", F.col("i").cast("long").alias("block_index"), "u", "c")


@query(f"""WITH {_INNER}, k AS (SELECT *, 4 + 19 + octet_length(encode(c)) + 5 AS one, octet_length(encode(u)) AS us FROM p WHERE page_id IS NOT NULL),
r AS (SELECT page_id, block_index, unnest([0, 1, 2]) AS cell_index, unnest([CASE WHEN block_index % 4 = 3 THEN NULL ELSE {_SHOWN} END, replace(u, '&amp;', '&'), '']) AS shown, unnest(['2', NULL, NULL]) AS colspan, unnest([NULL, '3', NULL]) AS rowspan,
  unnest([4, one, one + 16 + us + 5]) AS start_byte, unnest([one, one + 16 + us + 5, one + 16 + us + 5 + 9]) AS end_byte FROM k WHERE block_index % 4 <> 3)
SELECT page_id, block_index, NULL AS error, cell_index, shown, colspan, rowspan, start_byte::BIGINT AS start_byte, end_byte::BIGINT AS end_byte FROM r
UNION ALL SELECT page_id, block_index, '<tr> inside <td>', NULL, NULL, NULL, NULL, NULL, NULL FROM k WHERE block_index % 4 = 3""")
def row_cells(t):
    """A table row for every paragraph: its text over two columns, the page's address over three rows, and an empty cell; every fourth holds a row within a cell and is refused."""
    told = F.concat(F.lit('<tr><td colspan="2"   >'), "c", F.when(F.col("block_index") % 4 == 3, F.lit("<tr></td>")).otherwise("</td>"), F.lit("<th rowspan='3'>"), "u", F.lit("</th><td></td></tr>\n"))
    raw = F.col("row").cast("binary")
    found = _inner(t).withColumn("row", told).withColumn("b", blocks(raw, F.lit(0).cast("long"), F.octet_length(raw).cast("long"), F.lit("row"), F.lit("utf-8")))
    refused = F.when(F.col("b.error").isNotNull(), "<tr> inside <td>")
    cells = found.select("page_id", "block_index", refused.alias("error"), F.posexplode_outer("b.cells").alias("cell_index", "x"))
    return cells.select("page_id", "block_index", "error", "cell_index", F.col("x.text").alias("shown"), "x.colspan", "x.rowspan", "x.start_byte", "x.end_byte")


@query(f"""WITH {_INNER} SELECT page_id, block_index, block_index % 3 <> 2 AS held, CASE WHEN block_index % 3 <> 2 THEN {_SHOWN} END AS shown, CASE WHEN block_index % 3 <> 2 THEN (block_index % 3 + 1)::VARCHAR END AS rowspan,
  CASE WHEN block_index % 3 <> 2 THEN 3::BIGINT END AS start_byte, CASE WHEN block_index % 3 <> 2 THEN (3 + 14 + octet_length(encode(c)) + 5)::BIGINT END AS end_byte FROM p""")
def lone_cells(t):
    """A cell without its row for every paragraph, after three bytes that are not of it; every third has no whole number of rows and is refused."""
    span = F.when(F.col("block_index") % 3 == 2, F.lit("0")).otherwise((F.col("block_index") % 3 + 1).cast("string"))
    raw = F.col("cell").cast("binary")
    found = _inner(t).withColumn("cell", F.concat(F.lit("abc<th rowspan="), span, F.lit(">"), "c", F.lit("</th>")))
    found = found.withColumn("b", blocks(raw, F.lit(3).cast("long"), F.octet_length(raw).cast("long"), F.lit("cell"), F.lit("utf-8")))
    x = F.get("b.cells", F.lit(0))
    return found.select("page_id", "block_index", F.col("b.error").isNull().alias("held"), x["text"].alias("shown"), x["rowspan"].alias("rowspan"), x["start_byte"].alias("start_byte"), x["end_byte"].alias("end_byte"))


@query(f"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p>.*?</p>')) AS c, generate_subscripts(regexp_extract_all(html, '(?s)<p>.*?</p>'), 1) - 1 AS block_index FROM pages)
SELECT page_id, block_index, {_SHOWN} AS visible FROM p""")
def visible_text(t):
    """Text of every paragraph: decoded references, nested tags dropped."""
    return _paragraphs(t).select("page_id", "block_index", visible_text_of("c").alias("visible"))


@query("SELECT page_id, regexp_matches(html, '(?i)<(script|style|iframe|object)\\b') AS active, regexp_matches(html, '(?i)<table\\b') AS has_table FROM pages")
def active_markup(t):
    return t("pages").select("page_id", F.col("html").rlike("(?i)<(script|style|iframe|object)\\b").alias("active"), F.col("html").rlike("(?i)<table\\b").alias("has_table"))


_HOSTS = ("example.com", "blog.tionsh.example.net", "thther.example.org", "m.ththth.example.net", "www.ththhe.example.com")


@query(rf"""WITH p AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, replace(url, '://', '://me@') FROM pages UNION ALL SELECT page_id, regexp_replace(url, '^(https?://[^/?#]*)', '\1:443') FROM pages)
SELECT page_id, count(*) AS n, count(*) FILTER (WHERE regexp_extract(url, '^https://([^/?#:]*)(:443)?([/?#]|$)', 1) IN {_HOSTS}) AS allowed FROM p GROUP BY page_id""")
def url_allow_list(t):
    """Each page's URL as it is, with credentials, and with a port."""
    url = F.col("url")
    forms = F.array(url, F.replace(url, F.lit("://"), F.lit("://me@")), F.regexp_replace(url, "^(https?://[^/?#]*)", "$1:443"))
    each = t("pages").select("page_id", F.explode(forms).alias("url"))
    return each.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(url_allowed(F.col("url"), _HOSTS)).alias("allowed"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(text, '[\t\n\x0b\f\r \x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'))) AS plain_sha256 FROM documents""")
def normalize_text(t):
    return t("documents").select("doc_id", F.sha2(collapse(F.col("text")), 256).alias("plain_sha256"))


@query("SELECT lower(c_name) AS folded, count(*) AS n, min(c_custkey) AS first_key FROM customer GROUP BY 1")
def name_fold(t):
    return t("customer").groupBy(casefold("c_name").alias("folded")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


@query("""SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_returnflag) AS flags, string_agg(l_linestatus, '' ORDER BY l_linestatus) AS states,
  list_sort(list(l_returnflag)) = list_sort(list(l_linestatus)) AS same FROM lineitem GROUP BY l_orderkey""")
def multiset_equal(t):
    both = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_returnflag")).alias("a"), F.sort_array(F.collect_list("l_linestatus")).alias("b"))
    return both.select("l_orderkey", F.array_join("a", "").alias("flags"), F.array_join("b", "").alias("states"), (F.col("a") == F.col("b")).alias("same"))


@query("""WITH f AS (SELECT year(o_orderdate)::INT AS year, count(*) AS found FROM orders GROUP BY 1), e AS (SELECT * FROM (VALUES (1995, 100), (1996, 2), (2030, 1)) v(year, expected))
SELECT coalesce(f.year, e.year)::INT AS year, coalesce(found, 0)::BIGINT AS found, coalesce(expected, 0)::BIGINT AS expected FROM f FULL JOIN e ON f.year = e.year WHERE coalesce(found, 0) <> coalesce(expected, 0)""")
def year_slots(t):
    """Orders as filings: their years as a multiset against an expected one."""
    return holdout.year_mismatch(t("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date")), [1995] * 100 + [1996] * 2 + [2030])


@query("""WITH l AS (SELECT c_custkey || '|' || c_name || '|' || CASE WHEN c_custkey % 3 = 0 THEN 'N-PX' WHEN c_custkey % 3 = 1 THEN 'N-PX/A' ELSE '10-K' END
  || '|2024-01-01|edgar/data/' || c_custkey || '/' || c_custkey || '.txt' AS line FROM customer)
SELECT split_part(line, '|', 1) AS cik, split_part(line, '|', 3) AS form, regexp_extract(split_part(line, '|', 5), '([^/]*)\\.txt$', 1) AS accession
FROM l WHERE len(string_split(line, '|')) = 5 AND split_part(line, '|', 3) IN ('N-PX', 'N-PX/A') AND regexp_matches(split_part(line, '|', 1), '^[0-9]+$')""".replace("\\\\", "\\"))
def index_parse(t):
    from ..sources.files import index_rows

    form = F.when(F.col("c_custkey") % 3 == 0, "N-PX").when(F.col("c_custkey") % 3 == 1, "N-PX/A").otherwise("10-K")
    key = F.col("c_custkey").cast("string")
    lines = t("customer").select(F.concat_ws("|", key, "c_name", form, F.lit("2024-01-01"), F.concat(F.lit("edgar/data/"), key, F.lit("/"), key, F.lit(".txt"))).alias("value"))
    return index_rows(lines).select("cik", "form", "accession")


def document_rules() -> list[rules.Rule]:
    return [
        rules.Rule("text_present", F.length("text") == 0, "text is empty", "text"),
        rules.Rule("size_agrees", F.col("n_chars") != F.length("text"), "n_chars differs from the text", "n_chars"),
        rules.Rule("long_enough", F.col("n_chars") < 200, "text is short", "text"),
        rules.Rule("known_language", ~F.col("lang").isin("en", "de"), "language is not accepted", "lang"),
    ]


_BROKEN = """v AS (SELECT doc_id, 0 AS rule_order, 'text_present' AS rule_id FROM documents WHERE length(text) = 0
  UNION ALL SELECT doc_id, 1, 'size_agrees' FROM documents WHERE n_chars <> length(text)
  UNION ALL SELECT doc_id, 2, 'long_enough' FROM documents WHERE n_chars < 200
  UNION ALL SELECT doc_id, 3, 'known_language' FROM documents WHERE lang NOT IN ('en', 'de'))"""


@query(f"WITH {_BROKEN} SELECT doc_id::VARCHAR AS entity_id, rule_order, rule_id FROM v")
def rule_violations(t):
    return rules.violations(t("documents"), "doc_id", document_rules()).select("entity_id", "rule_order", "rule_id")


@query(f"WITH {_BROKEN} SELECT doc_id::VARCHAR AS entity_id, min_by(rule_id, rule_order) AS rule_id FROM v GROUP BY doc_id")
def first_violations(t):
    return rules.first_violation(rules.violations(t("documents"), "doc_id", document_rules())).select("entity_id", "rule_id")


_MERGE = """k AS (SELECT sha256(text) AS h, max(source) AS v FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
n AS (SELECT sha256(text) AS h, min(source) AS v, count(DISTINCT source) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)"""


def _merged(t):
    docs = t("documents").select("doc_id", F.sha2("text", 256).alias("h"), F.col("source").alias("v"))
    return joins.merge(docs.where("doc_id % 2 = 0").groupBy("h").agg(F.max("v").alias("v")), docs.where("doc_id % 2 = 1"), "h", "v")


@query(f"WITH {_MERGE} SELECT coalesce(k.h, n.h) AS h, CASE WHEN k.h IS NOT NULL THEN k.v ELSE n.v END AS v FROM k FULL JOIN n ON k.h = n.h")
def keyed_merge(t):
    return _merged(t)[0]


@query(f"WITH {_MERGE} SELECT n.h, k.v AS old, n.v AS new FROM n LEFT JOIN k ON k.h = n.h WHERE n.n > 1 OR (k.h IS NOT NULL AND k.v <> n.v)")
def merge_conflicts(t):
    return _merged(t)[1]


@query("""WITH w AS (SELECT doc_id, len(string_split(text, ' ')) AS p, len(string_split(text, chr(10))) AS a FROM documents)
SELECT doc_id, 'prompt' AS rule FROM w WHERE p > 200 UNION ALL SELECT doc_id, 'answer' FROM w WHERE a > 8 UNION ALL SELECT doc_id, 'context' FROM w WHERE p + a > 202""")
def length_gate(t):
    """Words as prompts, lines as answers: those over their limits."""
    docs = t("documents").select("doc_id", F.split("text", " ").alias("p"), F.split("text", "\n").alias("a"))
    found = rules.violations(docs, "doc_id", answers.limit_rules(F.col("p"), F.col("a"), context=202, prompts=200, answers=8))
    return found.select(F.col("entity_id").cast("long").alias("doc_id"), F.col("rule_id").alias("rule"))


@query("""WITH m AS (SELECT doc_id, octet_length(encode(text)) AS size, contains(text, 'password') OR contains(text, 'token') AS reserved, len(regexp_extract_all(text, 'the ')) AS b, len(regexp_extract_all(text, 'and ')) AS e,
  strpos(text, 'the ') AS at_b, strpos(text, 'and ') AS at_e FROM documents)
SELECT doc_id, 'size' AS rule FROM m WHERE size > 4000 UNION ALL SELECT doc_id, 'reserved' FROM m WHERE reserved UNION ALL SELECT doc_id, 'begin' FROM m WHERE b <> 1
UNION ALL SELECT doc_id, 'end' FROM m WHERE e <> 1 UNION ALL SELECT doc_id, 'order' FROM m WHERE at_e > 0 AND at_b > at_e""")
def marker_gate(t):
    """Documents as model inputs, with two words for the marks of a target."""
    found = rules.violations(t("documents"), "doc_id", answers.input_rules(F.col("text"), ("password", "token"), "the ", "and ", 4000))
    return found.select(F.col("entity_id").cast("long").alias("doc_id"), F.col("rule_id").alias("rule"))


@query("""WITH w AS (SELECT doc_id, doc_id // 16 AS batch, list_transform(string_split(text, ' '), lambda x: length(x)) AS w FROM documents),
m AS (SELECT batch, max(len(w)) AS longest FROM w GROUP BY batch)
SELECT doc_id, len(w)::BIGINT AS n_tokens, (longest - len(w))::BIGINT AS n_padding,
  sha256(array_to_string(w, ' ') || repeat(' 0', (longest - len(w))::BIGINT)) AS padded_sha256 FROM w JOIN m USING (batch)""")
def pad_and_mask(t):
    """Word lengths of each batch of sixteen documents, filled up to the batch's longest."""
    words = t("documents").select("doc_id", F.expr("doc_id div 16").alias("batch"), F.transform(F.split("text", " "), lambda x: F.char_length(x)).alias("w"))
    longest = words.groupBy("batch").agg(F.max(F.size("w")).alias("longest"))
    padded = F.transform(answers.padded(F.col("w"), F.col("longest"), 0), lambda x: x.cast("string"))
    both = words.join(longest, "batch")
    return both.select("doc_id", F.size("w").cast("long").alias("n_tokens"), (F.col("longest") - F.size("w")).cast("long").alias("n_padding"), F.sha2(F.array_join(padded, " "), 256).alias("padded_sha256"))


@query("""WITH a AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 2 = 1)
SELECT 'union' AS kind, source, lang FROM (FROM a UNION FROM b) UNION ALL SELECT 'both', source, lang FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'only_even', source, lang FROM (FROM a EXCEPT FROM b)""")
def set_operations(t):
    d = t("documents")
    a, b = (d.where(f"doc_id % 2 = {k}").select("source", "lang").distinct() for k in (0, 1))
    parts = [x.select(F.lit(k).alias("kind"), "source", "lang") for k, x in (("union", a.union(b).distinct()), ("both", a.intersect(b)), ("only_even", a.exceptAll(b)))]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH k AS (SELECT source, list_distinct(list(lang)) AS known FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND toxic = 0 GROUP BY source), n AS (SELECT source, list_distinct(list(lang)) AS new FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND quality = 1 GROUP BY source)
SELECT source, array_to_string(list_sort(list_distinct(list_concat(known, new))), ',') AS merged, list_has_all(known, new) AS covered FROM k JOIN n USING (source)""")
def sorted_union(t):
    """Languages of each source's harmless documents, with those of its good ones."""
    both = t("documents").select("doc_id", "source", "lang").join(t("labels"), "doc_id")
    k, n = (both.where(mark).groupBy("source").agg(F.collect_set("lang").alias(name)) for mark, name in (("toxic = 0", "known"), ("quality = 1", "new")))
    return k.join(n, "source").select("source", F.array_join(F.array_sort(F.array_union("known", "new")), ",").alias("merged"), (F.size(F.array_except("new", "known")) == 0).alias("covered"))
