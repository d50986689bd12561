"""Queries over the driver's tables, by name, and their DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import generate, sql_api, stats
from ..functions.spec import SpecError, TargetSpec
from ..operators import csvscan, filters, prefix, scan
from ..operators.csvscan import Dialect
from ..sources import csv_files
from ..streaming.carry import find_in_stream
from . import oracle

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spec(*parts: tuple) -> TargetSpec:
    b = TargetSpec.builder()
    for kind, *args in parts:
        getattr(b, kind)(*args)
    return b.build()


COMMA = _spec(("codepoints", "comma", ","))
PUNCTUATION = _spec(("codepoints", "comma", ","), ("codepoints", "stop", ".!?"), ("codepoints", "quote", "\"'"), ("codepoints", "space", " \t\r\n\f"))
MANY = _spec(*[("codepoints", f"t{i}", chr(97 + i)) for i in range(24)])
DIGITS = _spec(("range", "digit", "0", "9"))
MIXED = _spec(("range", "digit", "0", "9"), ("range", "comparison", "<", ">"), ("codepoints", "dash", "-_"), ("codepoints", "star", "*"))
E_ACUTE = _spec(("codepoint", "eacute", "é"))
SHARED = _spec(("codepoint", "eacute", "é"), ("codepoint", "oacute", "ó"), ("codepoint", "ntilde", "ñ"), ("codepoint", "itilde", "ĩ"))
ALL_KINDS = _spec(("codepoints", "space", " \n"), ("codepoint", "eacute", "é"), ("codepoint", "tm", "™"), ("codepoint", "smile", "😀"), ("range", "digit", "0", "9"))
STRUCTURE = _spec(("codepoints", "delimiter", ","), ("codepoints", "quote", '"'), ("codepoints", "lf", "\n"), ("codepoints", "cr", "\r"))
QUOTE = _spec(("codepoints", "quote", '"'))
BRACES = _spec(("codepoints", "open", "{"), ("codepoints", "close", "}"), ("codepoints", "quote", '"'))
TAGS = _spec(("codepoints", "open", "<"), ("codepoints", "close", ">"), ("codepoints", "quote", '"'))


def _find(name: str, table: str, key: str, text: str, spec: TargetSpec, quote: str | None = None, strategy: str = "auto") -> None:
    _add(name, lambda spark, d: scan.find(_table(spark, d, table), text, spec, keys=[key], quote_filter=quote, strategy=strategy), oracle.find(table, key, text, spec, quote))


for _name, _targets in {"find_single": COMMA, "find_groups": PUNCTUATION, "find_many_24": MANY, "find_range": DIGITS, "find_range_and_groups": MIXED, "find_2byte": E_ACUTE, "find_shared_lead": SHARED, "find_mixed": ALL_KINDS}.items():
    _find(_name, "documents", "doc_id", "text", _targets)
_find("find_groups_sql", "documents", "doc_id", "text", PUNCTUATION, strategy="sql")
_find("find_conversations", "conversations", "conv_id, turn", "text", PUNCTUATION)
_QUERIES["find_conversations"] = lambda spark, d: scan.find(_table(spark, d, "conversations"), "text", PUNCTUATION, keys=["conv_id", "turn"])
_find("quote_filter_documents", "documents", "doc_id", "text", STRUCTURE, quote="quote")
_find("quote_filter_pages", "pages", "page_id", "html", STRUCTURE, quote="quote")
_find("quote_filter_pages_sql", "pages", "page_id", "html", STRUCTURE, quote="quote", strategy="sql")

_LONG = "(SELECT doc_id, text || '™é 😀' || text || '日本9' AS text FROM documents)"
_WIDE = _spec(("codepoint", "tm", "™"), ("codepoint", "smile", "😀"), ("codepoint", "ri", "日"), ("codepoint", "eacute", "é"))
_add(
    "find_3_4byte_synthetic",
    lambda spark, d: scan.find(_table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("™é 😀"), "text", F.lit("日本9")).alias("text")), "text", _WIDE, keys=["doc_id"]),
    oracle.find(_LONG, "doc_id", "text", _WIDE),
)
_add(
    "find_binary",
    lambda spark, d: scan.find(_table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content")), "content", SHARED, keys=["doc_id"]),
    oracle.find("documents", "doc_id", "text", SHARED),
)


def _udtf(spark: SparkSession, d: str) -> DataFrame:
    sql_api.register(spark)
    _table(spark, d, "documents").createOrReplaceTempView("scan_documents")
    return spark.sql("SELECT t.doc_id, s.pos, s.lit, s.name FROM scan_documents t, LATERAL scan_bytes(t.text, 'comma=,;digit=0..9;eacute=é') s")


_add("scan_bytes_udtf", _udtf, oracle.find("documents", "doc_id", "text", sql_api.parse_spec("comma=,;digit=0..9;eacute=é")))

# counts and tests without taking a text apart

_M = oracle.matches("documents", "doc_id", "text", PUNCTUATION)
_add(
    "match_count",
    lambda spark, d: scan.count(_table(spark, d, "documents"), "text", PUNCTUATION, keys=["doc_id"]),
    f"WITH {_M} SELECT doc_id, CAST(count(pos) AS BIGINT) AS n_matches FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id",
)
_add(
    "match_histogram",
    lambda spark, d: scan.histogram(scan.find(_table(spark, d, "documents"), "text", PUNCTUATION, keys=["doc_id"])),
    f"WITH {_M} SELECT name, count(*) AS n_matches FROM m GROUP BY name",
)
_add("match_totals", lambda spark, d: scan.totals(_table(spark, d, "documents"), "text", PUNCTUATION), _SQL["match_histogram"])
_add("match_totals_wide", lambda spark, d: scan.totals(_table(spark, d, "documents"), "text", SHARED), f"WITH {oracle.matches('documents', 'doc_id', 'text', SHARED)} SELECT name, count(*) AS n_matches FROM m GROUP BY name")
_add(
    "first_last_match",
    lambda spark, d: scan.find(_table(spark, d, "documents"), "text", PUNCTUATION, keys=["doc_id"]).groupBy("doc_id").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min_by("name", "pos").alias("first_name")),
    f"WITH {_M} SELECT doc_id, min(pos) AS first_pos, max(pos) AS last_pos, arg_min(name, pos) AS first_name FROM m GROUP BY doc_id",
)
_add(
    "match_by_index",
    lambda spark, d: scan.index(scan.find(_table(spark, d, "documents"), "text", COMMA, keys=["doc_id"]), ["doc_id"]).where("idx = 3").select("doc_id", "idx", "pos"),
    f"WITH {oracle.matches('documents', 'doc_id', 'text', COMMA)}, n AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx FROM m) SELECT doc_id, idx, pos FROM n WHERE idx = 3",
)
_add(
    "match_density",
    lambda spark, d: scan.density(_table(spark, d, "documents"), "text", COMMA, keys=["doc_id"]),
    "SELECT doc_id, CAST(length(text) - length(replace(text, ',', '')) AS BIGINT) AS n_matches, CAST(strlen(text) AS BIGINT) AS n_bytes, CASE WHEN strlen(text) > 0 THEN (length(text) - length(replace(text, ',', ''))) / strlen(text) ELSE 0.0 END AS density FROM documents",
)
_add("has_match", lambda spark, d: scan.exists(_table(spark, d, "documents"), "text", QUOTE).select("doc_id"), "SELECT doc_id FROM documents WHERE contains(text, '\"')")
_add(
    "regex_parity",
    lambda spark, d: _table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([,.!?0-9é])"), F.lit(1))).alias("idx", "hit")),
    "WITH r AS (SELECT doc_id, regexp_extract_all(text, '[,.!?0-9é]') AS h FROM documents) SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, h[i] AS hit FROM r, unnest(range(1, len(h) + 1)) AS u(i)",
)

# bytes and characters

_C = oracle.characters("documents", "doc_id", "text")


def _chars(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")


_add("byte_class_histogram", lambda spark, d: _chars(spark, d).groupBy(scan.utf8_class(F.col("ch")).alias("n_bytes")).agg(F.count("*").alias("n")), f"WITH {_C} SELECT CAST(strlen(ch) AS INTEGER) AS n_bytes, count(*) AS n FROM p GROUP BY 1")
_add("non_ascii_rows", lambda spark, d: _table(spark, d, "documents").where(scan.non_ascii("text")).select("doc_id"), "SELECT doc_id FROM documents WHERE strlen(text) > length(text)")
_add(
    "nibble_histogram",
    lambda spark, d: _chars(spark, d).where("octet_length(ch) = 1").groupBy(F.shiftright(F.ascii("ch"), 4).alias("high"), F.ascii("ch").bitwiseAND(15).alias("low")).agg(F.count("*").alias("n")),
    f"WITH {_C} SELECT CAST(ord(ch) >> 4 AS INTEGER) AS high, CAST(ord(ch) & 15 AS INTEGER) AS low, count(*) AS n FROM p WHERE strlen(ch) = 1 GROUP BY ALL",
)
_add(
    "character_entropy",
    lambda spark, d: stats.entropy(_chars(spark, d)).select(F.round("entropy", 6).alias("entropy")),
    f"WITH {_C}, n AS (SELECT ch, count(*) AS n FROM p GROUP BY ch), t AS (SELECT sum(n) AS total FROM n) SELECT round(-sum(n / total * log2(n / total)), 6) AS entropy FROM n, t",
)

# prefix scans and filters


def _toggles(spark: SparkSession, d: str, table: str, key: str, text: str) -> DataFrame:
    found = scan.find(_table(spark, d, table), text, QUOTE, keys=[key])
    return prefix.toggle(found, F.lit(1), [key]).select(key, "pos", "inside")


for _name, _table_name, _key, _text in (("toggle_props", "events", "event_id", "props"), ("toggle_pages", "pages", "page_id", "html")):
    _add(
        _name,
        lambda spark, d, a=_table_name, b=_key, c=_text: _toggles(spark, d, a, b, c),
        f"WITH {oracle.matches(_table_name, _key, _text, QUOTE)} SELECT {_key}, pos, CAST(row_number() OVER (PARTITION BY {_key} ORDER BY pos) % 2 AS INTEGER) AS inside FROM m",
    )


def _depth_sql(spec: TargetSpec, table: str, key: str, text: str) -> str:
    return f"WITH {oracle.matches(table, key, text, spec)}, x AS (SELECT {key}, pos, name, CAST(sum(CASE name WHEN 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY {key} ORDER BY pos) AS BIGINT) AS depth FROM m WHERE name <> 'quote')"


def _depths(spark: SparkSession, d: str, spec: TargetSpec, table: str, key: str, text: str) -> DataFrame:
    return prefix.nesting(scan.find(_table(spark, d, table), text, spec, keys=[key]), "open", "close", [key]).select(key, "pos", "name", "depth")


_add("depth_braces", lambda spark, d: _depths(spark, d, BRACES, "events", "event_id", "props"), _depth_sql(BRACES, "events", "event_id", "props") + " SELECT event_id, pos, name, depth FROM x")
_add("depth_tags", lambda spark, d: _depths(spark, d, TAGS, "pages", "page_id", "html"), _depth_sql(TAGS, "pages", "page_id", "html") + " SELECT page_id, pos, name, depth FROM x")
_add("max_depth", lambda spark, d: _depths(spark, d, TAGS, "pages", "page_id", "html").groupBy("page_id").agg(F.max("depth").alias("max_depth")), _depth_sql(TAGS, "pages", "page_id", "html") + " SELECT page_id, max(depth) AS max_depth FROM x GROUP BY page_id")
_add(
    "string_mask_then_depth",
    lambda spark, d: prefix.mask_then_nesting(scan.find(_table(spark, d, "pages"), "html", TAGS, keys=["page_id"]), "quote", "open", "close", ["page_id"]).select("page_id", "pos", "name", "depth"),
    f"WITH {oracle.matches('pages', 'page_id', 'html', TAGS)}, q AS (SELECT *, sum(CASE WHEN name = 'quote' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) % 2 AS inside FROM m) SELECT page_id, pos, name, CAST(sum(CASE name WHEN 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS depth FROM q WHERE name <> 'quote' AND inside = 0",
)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """64-character chunks of pages."""
    pages = _table(spark, d, "pages").where("length(html) > 0")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("html") - 1) / 64).cast("int")), lambda k: F.substring(F.col("html"), k * 64 + 1, F.lit(64)))
    return pages.select("page_id", F.posexplode(cut).alias("seq", "data"))


def _chunk_matches(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    size = prefix.chunk_carry(chunks, F.octet_length("data"), ["page_id"]).select("page_id", "seq", F.col("carry").alias("base"))
    found = scan.find(chunks, "data", TAGS, keys=["page_id", "seq"])
    return found.join(size, ["page_id", "seq"])


_add(
    "chunk_carry_toggle",
    lambda spark, d: prefix.chunk_scan(_chunk_matches(spark, d).where("name = 'quote'"), F.lit(1), ["page_id"], xor=True).select("page_id", (F.col("pos") + F.col("base")).alias("pos"), F.col("state").cast("int").alias("inside")),
    _SQL["toggle_pages"],
)
_add(
    "chunk_carry_depth",
    lambda spark, d: prefix.chunk_scan(_chunk_matches(spark, d).where("name <> 'quote'"), F.when(F.col("name") == "open", 1).otherwise(-1), ["page_id"]).select("page_id", (F.col("pos") + F.col("base")).alias("pos"), "name", F.col("state").alias("depth")),
    _SQL["depth_tags"],
)
_add(
    "lane_shift",
    lambda spark, d: prefix.shift(scan.find(_table(spark, d, "documents"), "text", COMMA, keys=["doc_id"]), "pos", 3, ["doc_id"]).select("doc_id", "pos", "shifted"),
    f"WITH {oracle.matches('documents', 'doc_id', 'text', COMMA)} SELECT doc_id, pos, CAST(lag(pos, 3, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS shifted FROM m",
)

# CSV: cases with known rows

CSV_CASES = {
    "csv_simple": ("id,unit\n7,km\n8,mile\n", Dialect(), [["id", "unit"], ["7", "km"], ["8", "mile"]]),
    "csv_quoted": ('7,"north, east"\n"up\nand down",8\n', Dialect(), [["7", "north, east"], ["up\nand down", "8"]]),
    "csv_unescape": ('k,"a ""tall"" tree"\n"",""""\n', Dialect(), [["k", 'a "tall" tree'], ["", '"']]),
    "csv_tab": ("lake\t12,5\triver\n", Dialect(delimiter="\t"), [["lake", "12,5", "river"]]),
    "csv_single_quote": ("5,'six o''clock'\n", Dialect(quote="'"), [["5", "six o'clock"]]),
    "csv_crlf_mixed": ("one\r\ntwo\rthree\nfour", Dialect(), [["one"], ["two"], ["three"], ["four"]]),
    "csv_empty_fields": (",\n9,,\n", Dialect(), [["", ""], ["9", "", ""]]),
    "csv_ragged": ("p,q,r\ns\nt,u\n", Dialect(), [["p", "q", "r"], ["s"], ["t", "u"]]),
    "csv_blank_line": ("\nx\n\n", Dialect(), [[""], ["x"], [""]]),
    "csv_large_field": ("m" * 300 + ",1\n" + '"' + ",\n" * 150 + '",2\n', Dialect(), [["m" * 300, "1"], [",\n" * 150, "2"]]),
    "csv_mid_quote": ('5" pipe,"x,y",6"\n', Dialect(), [['5" pipe,"x', 'y",6"']]),
    "csv_unclosed": ('z,"open end', Dialect(), [["z", '"open end']]),
}


def _literal(text: str) -> str:
    return " || ".join(f"chr({ord(p)})" if p in "\n\r\t" else "'" + p.replace("'", "''") + "'" for p in _pieces(text)) or "''"


def _pieces(text: str) -> list[str]:
    out = [""]
    for ch in text:
        if ch in "\n\r\t":
            out += [ch, ""]
        else:
            out[-1] += ch
    return [p for p in out if p]


def _case(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(1, text.encode())], "case_id int, content binary")


for _name, (_content, _dialect, _rows) in CSV_CASES.items():
    _cells = [(r, c, v) for r, row in enumerate(_rows) for c, v in enumerate(row)]
    _add(
        _name,
        lambda spark, d, t=_content, x=_dialect: csvscan.fields(_case(spark, t), "content", keys=["case_id"], dialect=x).select("case_id", "row", "col", "value"),
        " UNION ALL ".join(f"SELECT 1 AS case_id, CAST({r} AS BIGINT) AS row, {c} AS col, {_literal(v)} AS value" for r, c, v in _cells),
    )
_HEADED = "city,river\nUlm,Danube\n\"Bonn, old\",Rhine\n"
_add("csv_header", lambda spark, d: csvscan.headers(_case(spark, _HEADED), "content", keys=["case_id"], dialect=Dialect(header=True)).select("case_id", F.concat_ws("|", "headers").alias("headers")), "SELECT 1 AS case_id, 'city|river' AS headers")
_add("csv_rows", lambda spark, d: csvscan.named(csvscan.rows(_case(spark, _HEADED), "content", keys=["case_id"], dialect=Dialect(header=True)), ["city", "river"]), "SELECT 1 AS case_id, CAST(0 AS BIGINT) AS row, 'Ulm' AS city, 'Danube' AS river UNION ALL SELECT 1, 1, 'Bonn, old', 'Rhine'")
_MIXED_ENDS = "p\r\nq\nr\rs\n"
_add("csv_row_count", lambda spark, d: csvscan.row_count(_case(spark, _MIXED_ENDS), "content", keys=["case_id"]), "SELECT 1 AS case_id, CAST(4 AS BIGINT) AS n_rows")
_add("csv_token_row_count", lambda spark, d: csvscan.token_row_count(_case(spark, _MIXED_ENDS), "content", keys=["case_id"]), "SELECT 1 AS case_id, CAST(3 AS BIGINT) AS n_rows")
_add(
    "csv_raw",
    lambda spark, d: csvscan.fields(_case(spark, 'v,"w,w"\n'), "content", keys=["case_id"]).select("case_id", "col", "start", "end", "quoted", F.decode("raw", "UTF-8").alias("raw")),
    "SELECT 1 AS case_id, 0 AS col, CAST(0 AS BIGINT) AS start, CAST(1 AS BIGINT) AS \"end\", false AS quoted, 'v' AS raw UNION ALL SELECT 1, 1, 2, 7, true, '\"w,w\"'",
)
_add("csv_tokens", lambda spark, d: csvscan.tokens(_table(spark, d, "pages"), "html", keys=["page_id"]), f"WITH {oracle.matches('pages', 'page_id', 'html', STRUCTURE)}, q AS (SELECT *, sum(CASE WHEN name = 'quote' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) % 2 AS inside FROM m) SELECT page_id, pos, CASE name WHEN 'lf' THEN 'newline' ELSE name END AS token FROM q WHERE name = 'quote' OR inside = 0")


def _roundtrip(spark: SparkSession, d: str, table: str, columns: list[str]) -> DataFrame:
    lines = csvscan.to_csv(_table(spark, d, table), columns)
    parsed = csvscan.rows(lines, "line", keys=[columns[0]])
    return csvscan.named(parsed.where("row = 0").withColumnRenamed(columns[0], "key"), columns).drop("key", "row")


_ORDERS, _DOCS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], ["doc_id", "text", "lang", "source"]
_add("csv_roundtrip_orders", lambda spark, d: _roundtrip(spark, d, "orders", _ORDERS), f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _ORDERS)} FROM orders")
_add("csv_roundtrip_documents", lambda spark, d: _roundtrip(spark, d, "documents", _DOCS), f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _DOCS)} FROM documents")
_add(
    "cost_model_fit",
    lambda spark, d: stats.linear_fit(_table(spark, d, "lineitem"), "l_extendedprice", "l_quantity").select(*[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")]),
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem",
)

# CSV over whole tables: counts by row ends outside quotes, and raw fields of the documents' CSV lines

_ENDS = f"WITH {oracle.matches('pages', 'page_id', 'html', STRUCTURE)}, q AS (SELECT *, sum(CASE WHEN name = 'quote' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) % 2 AS inside FROM m)"
_add(
    "csv_row_count_pages",
    lambda spark, d: csvscan.row_count(_table(spark, d, "pages"), "html", keys=["page_id"]),
    f"{_ENDS}, e AS (SELECT page_id, pos, name, lag(CASE WHEN name = 'cr' THEN pos END) OVER (PARTITION BY page_id ORDER BY pos) AS cr FROM q WHERE inside = 0 AND name IN ('lf', 'cr')), "
    "n AS (SELECT page_id, max(pos) AS last, count(*) FILTER (WHERE name = 'cr' OR cr IS NULL OR cr <> pos - 1) AS n FROM e GROUP BY page_id) "
    "SELECT page_id, CAST(coalesce(n, 0) + CASE WHEN strlen(html) > coalesce(last, -1) + 1 THEN 1 ELSE 0 END AS BIGINT) AS n_rows FROM pages LEFT JOIN n USING (page_id) WHERE strlen(html) > 0",
)
_add(
    "csv_token_row_count_pages",
    lambda spark, d: csvscan.token_row_count(_table(spark, d, "pages"), "html", keys=["page_id"]),
    f"{_ENDS} SELECT page_id, CAST(count(*) FILTER (WHERE name = 'lf') AS BIGINT) AS n_rows FROM q WHERE name = 'quote' OR inside = 0 GROUP BY page_id",
)


def _raw_documents(spark: SparkSession, d: str) -> DataFrame:
    lines = csvscan.to_csv(_table(spark, d, "documents"), _DOCS)
    return csvscan.fields(lines, "line", keys=["doc_id"]).select("doc_id", "col", "start", "end", "quoted", F.decode("raw", "UTF-8").alias("raw"))


_CELLS = ", ".join(f"CASE WHEN regexp_matches(v{i}, '[\",\\n\\r]') THEN '\"' || replace(v{i}, '\"', '\"\"') || '\"' ELSE v{i} END" for i in range(len(_DOCS)))
_add(
    "csv_raw_documents",
    _raw_documents,
    f"WITH v AS (SELECT doc_id, {', '.join(f"coalesce(CAST({c} AS VARCHAR), '') AS v{i}" for i, c in enumerate(_DOCS))} FROM documents), "
    f"c AS (SELECT doc_id, unnest([{_CELLS}]) AS raw, unnest(range({len(_DOCS)})) AS col FROM v), "
    "p AS (SELECT *, CAST(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY col) - strlen(raw) - 1 AS BIGINT) AS start FROM c) "
    "SELECT doc_id, CAST(col AS INTEGER) AS col, start, CAST(start + strlen(raw) AS BIGINT) AS \"end\", raw LIKE '\"%' AS quoted, raw FROM p",
)


_add(
    "csv_field_sizes",
    lambda spark, d: csvscan.field_sizes(csvscan.to_csv(_table(spark, d, "documents"), _DOCS), "line", keys=["doc_id"]),
    f"WITH v AS (SELECT doc_id, {', '.join(f"coalesce(CAST({c} AS VARCHAR), '') AS v{i}" for i, c in enumerate(_DOCS))} FROM documents), "
    f"c AS (SELECT doc_id, unnest([{_CELLS}]) AS raw FROM v) SELECT doc_id, count(*) AS n_fields, CAST(sum(strlen(raw)) AS BIGINT) AS n_bytes FROM c GROUP BY doc_id",
)
_add(
    "csv_field_count",
    lambda spark, d: csvscan.rows(csvscan.to_csv(_table(spark, d, "documents"), _DOCS), "line", keys=["doc_id"]).select("doc_id", "row", F.size("fields").alias("n_fields")),
    f"SELECT doc_id, CAST(0 AS BIGINT) AS row, {len(_DOCS)} AS n_fields FROM documents",
)
_add(
    "csv_empty",
    lambda spark, d: csvscan.rows(_table(spark, d, "documents").select("doc_id", F.lit("").alias("line")), "line", keys=["doc_id"]).select("doc_id", "row", F.size("fields").alias("n_fields")),
    "SELECT doc_id, CAST(0 AS BIGINT) AS row, 0 AS n_fields FROM documents WHERE false",
)


# CSV files, read in byte ranges

_SHARED: dict[str, str] = {}


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or in a local session without one under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _SHARED.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="bytesift-csv-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, d: str, table: str, columns: list[str]) -> list[str]:
    """The table as CSV files: their paths."""
    path = _folder(spark, table)
    csvscan.to_csv(_table(spark, d, table), columns, end="").select("line").write.text(path)
    return sorted(r.file for r in spark.read.format("binaryFile").load(path).select(F.col("path").alias("file")).collect())  # one row per file


#: small, so that even small files are read in many ranges
_RANGE = 1 << 18
_add(
    "csv_file_rows",
    lambda spark, d: csvscan.named(csv_files.read_rows(spark, _files(spark, d, "documents", _DOCS), range_bytes=_RANGE), _DOCS).drop("path", "row"),
    f"SELECT {', '.join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in _DOCS)} FROM documents",
)
_add(
    "csv_file_fields",
    lambda spark, d: csv_files.read_fields(spark, _files(spark, d, "orders", _ORDERS), range_bytes=_RANGE).groupBy("col").agg(F.count("*").alias("n_fields"), F.sum(F.col("end") - F.col("start")).alias("n_bytes"), F.countDistinct("value").alias("n_values")),
    " UNION ALL ".join(f"SELECT {i} AS col, count(*) AS n_fields, CAST(sum(strlen(CAST({c} AS VARCHAR))) AS BIGINT) AS n_bytes, count(DISTINCT {c}) AS n_values FROM orders" for i, c in enumerate(_ORDERS)),
)


def _source(spark: SparkSession, d: str) -> DataFrame:
    csv_files.register(spark)
    return spark.read.format("csvscan").load(",".join(_files(spark, d, "customer", ["c_custkey", "c_name", "c_mktsegment"]))).select("col", "value")


_add("csv_source", _source, " UNION ALL ".join(f"SELECT {i} AS col, CAST({c} AS VARCHAR) AS value FROM customer" for i, c in enumerate(["c_custkey", "c_name", "c_mktsegment"])))

# filters by protocol

_add(
    "filter_every_third",
    lambda spark, d: scan.find(_table(spark, d, "documents"), "text", PUNCTUATION, keys=["doc_id"], match_filter=filters.EveryNth(3)).select("doc_id", "pos", "name"),
    f"WITH {_M}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM m) SELECT doc_id, pos, name FROM n WHERE k % 3 = 0",
)
_add(
    "filter_quotes_then_every_second",
    lambda spark, d: scan.find(_table(spark, d, "pages"), "html", STRUCTURE, keys=["page_id"], match_filter=filters.Both(filters.QuoteFilter("quote"), filters.EveryNth(2))).select("page_id", "pos", "name"),
    f"WITH {oracle.matches('pages', 'page_id', 'html', STRUCTURE)}, q AS (SELECT *, sum(CASE WHEN name = 'quote' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) % 2 AS inside FROM m), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS k FROM q WHERE name = 'quote' OR inside = 0) SELECT page_id, pos, name FROM n WHERE k % 2 = 0",
)
_add("filter_none", lambda spark, d: scan.find(_table(spark, d, "documents"), "text", COMMA, keys=["doc_id"], match_filter=filters.NoFilter()), oracle.find("documents", "doc_id", "text", COMMA))

# bytes: every value, and sequences that the buffer's end cuts off

_add(
    "lut_all_bytes",
    lambda spark, d: scan.find(spark.range(256).select(F.col("id").cast("int").alias("byte"), F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("content")), "content", MIXED, keys=["byte"]).select("byte", "lit", "name"),
    f"WITH c AS (SELECT CAST(b AS INTEGER) AS byte, chr(CAST(b AS INTEGER)) AS ch FROM range(1, 128) AS r(b)) SELECT byte, {oracle.case(MIXED, False)} AS lit, {oracle.case(MIXED, True)} AS name FROM c WHERE {oracle.case(MIXED, False)} IS NOT NULL",
)
_CUT_AT = 1001
_add(
    "find_truncated",
    lambda spark, d: scan.find(_table(spark, d, "documents").select("doc_id", F.substring(F.encode("text", "UTF-8"), 1, _CUT_AT).alias("content")), "content", SHARED, keys=["doc_id"]),
    f"WITH {oracle.matches('documents', 'doc_id', 'text', SHARED)} SELECT doc_id, pos, lit, name FROM m WHERE pos + strlen(ch) <= {_CUT_AT}",
)
_LIMITS = range(1, 5)


def _limits(spark: SparkSession, d: str) -> DataFrame:
    """For every limit on the number of targets whether a set of three is taken."""

    def taken(limit: int) -> bool:
        try:
            _spec_of(limit)
        except SpecError:
            return False
        return True

    return spark.createDataFrame([(n, taken(n)) for n in _LIMITS], "max_literals int, taken boolean")


def _spec_of(limit: int) -> TargetSpec:
    b = TargetSpec.builder()
    for i in range(3):
        b.codepoints(f"t{i}", "abc"[i])
    return b.options(max_literals=limit).build()


_add("namespace_limit", _limits, " UNION ALL ".join(f"SELECT {n} AS max_literals, {'true' if n >= 3 else 'false'} AS taken" for n in _LIMITS))
_ERRORS: dict[str, Callable[[SparkSession], object]] = {
    "filter names an unknown target": lambda spark: scan.find(spark.createDataFrame([("a",)], "t string"), "t", COMMA, keys=[], quote_filter="quote"),
    "no target": lambda spark: TargetSpec.builder().build(),
    "range upside down": lambda spark: _spec(("range", "r", 9, 3)),
    "delimiter is the quote": lambda spark: Dialect(delimiter='"'),
    "no header in the dialect": lambda spark: csvscan.headers(spark.createDataFrame([("a",)], "t string"), "t", keys=[], dialect=Dialect()),
    "all in order": lambda spark: _spec(("range", "r", 3, 9)),
}


def _errors(spark: SparkSession, d: str) -> DataFrame:
    def raised(make) -> bool:
        try:
            make(spark)
        except SpecError:
            return True
        return False

    return spark.createDataFrame([(name, raised(make)) for name, make in _ERRORS.items()], "name string, raised boolean")


_add("spec_errors", _errors, " UNION ALL ".join(f"SELECT '{name}' AS name, {'false' if name == 'all in order' else 'true'} AS raised" for name in _ERRORS))

# streams: documents as chunks of 999 bytes, which cut characters in two


def _stream(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stream_id"), F.encode("text", "UTF-8").alias("content"))
    cut = F.expr("transform(sequence(0, cast(floor((octet_length(content) - 1) / 999) as int)), k -> substring(content, 999 * k + 1, 999))")
    chunks = docs.where("octet_length(content) > 0").select("stream_id", F.posexplode(cut).alias("seq", "data")).withColumn("seq", F.col("seq").cast("long"))
    folder, out = _folder(spark, "chunks"), _folder(spark, "stream-matches")
    chunks.write.parquet(folder)
    found = find_in_stream(spark.readStream.schema(chunks.schema).parquet(folder), SHARED)
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select(F.col("stream_id").cast("long").alias("doc_id"), "pos", "lit", "name")


_add("stream_find", _stream, oracle.find("documents", "doc_id", "text", SHARED))

# statistics

_add(
    "lag_correlation",
    lambda spark, d: stats.lag_correlation(_table(spark, d, "documents"), "n_chars", ["lang"], "doc_id").select(F.round("lag1", 6).alias("lag1")),
    "WITH l AS (SELECT n_chars AS y, lag(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS x FROM documents) SELECT round(corr(y, x), 6) AS lag1 FROM l",
)


def _plane_sql(table: str, y: str, a: str, b: str) -> str:
    return (
        f"WITH s AS (SELECT var_pop({a}) AS va, var_pop({b}) AS vb, covar_pop({a}, {b}) AS cab, covar_pop({y}, {a}) AS cya, covar_pop({y}, {b}) AS cyb, avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my, var_pop({y}) AS vy FROM {table}), "
        "f AS (SELECT *, (cya * vb - cyb * cab) / (va * vb - cab * cab) AS p, (cyb * va - cya * cab) / (va * vb - cab * cab) AS q FROM s) "
    )


_add(
    "cost_model_plane",
    lambda spark, d: stats.plane(_table(spark, d, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in ("l_extendedprice", "l_quantity", "l_discount")]), "l_extendedprice", ["l_quantity", "l_discount"]).select(F.round("b_l_quantity", 3).alias("b_quantity"), F.round("r2", 6).alias("r2")),
    _plane_sql("(SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b FROM lineitem)", "y", "a", "b") + "SELECT round(p, 3) AS b_quantity, round((p * cya + q * cyb) / vy, 6) AS r2 FROM f",
)
_add(
    "cost_model_quadratic",
    lambda spark, d: stats.quadratic(_table(spark, d, "lineitem"), "l_extendedprice", "l_quantity").select(F.round("b_x1", 2).alias("b_x1"), F.round("r2", 6).alias("r2")),
    _plane_sql("(SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS a, CAST(l_quantity AS DOUBLE) * l_quantity AS b FROM lineitem)", "y", "a", "b") + "SELECT round(p, 2) AS b_x1, round((p * cya + q * cyb) / vy, 6) AS r2 FROM f",
)


def _generated(spark: SparkSession, d: str) -> DataFrame:
    """For some densities: the bytes made, and whether the share of targets is within a hundredth."""
    out = None
    for density in (0.05, 0.5):
        made = generate.byte_buffers(spark, 32, 1 << 14, b",.", density)
        found = scan.totals(made, "content", _spec(("codepoints", "sign", ",."))).agg(F.sum("n_matches").alias("n"))
        one = made.agg(F.sum(F.octet_length("content")).alias("n_bytes")).join(found).select(F.lit(density).alias("density"), "n_bytes", (F.abs(F.col("n") / F.col("n_bytes") - density) < 0.01).alias("near"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


_add("generated_density", _generated, " UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS density, CAST({32 << 14} AS BIGINT) AS n_bytes, true AS near" for x in (0.05, 0.5)))
_add(
    "generated_csv",
    lambda spark, d: csvscan.rows(generate.csv_buffers(spark, 8, 500, 7, quoted=0.4, crlf=True), "content", keys=["id"]).groupBy("id").agg(F.count("*").alias("n_rows"), F.min(F.size("fields")).alias("least"), F.max(F.size("fields")).alias("most")),
    "SELECT i AS id, CAST(500 AS BIGINT) AS n_rows, 7 AS least, 7 AS most FROM range(8) AS r(i)",
)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
