"""File sources and sinks: CSV with header aliases, checked registries, JSON of several shapes, XML feeds."""

from __future__ import annotations

import codecs
import csv
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions.text import guarded_cell, header_key, header_label, strip


HEAD_BYTES, OPENERS = 1 << 14, 16
# Byte order marks and the encodings they stand for.
MARKS = {b"\xff\xfe": "UTF-16", b"\xfe\xff": "UTF-16", b"\xef\xbb\xbf": "UTF-8"}


def _head(spark: SparkSession, file: str, encoding: str | None) -> tuple[str, str] | None:
    """Encoding and first line that is not blank of one file, of which no more is read; None where there is none."""
    conf = spark._jsc.hadoopConfiguration()
    place = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = place.getFileSystem(conf).open(place)
    try:
        if codec := spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place):
            stream = codec.createInputStream(stream)
        data, more = b"", True
        while more:
            more = bytes(stream.readNBytes(HEAD_BYTES))
            data += more
            found = encoding or next((e for mark, e in MARKS.items() if data.startswith(mark)), "UTF-8")
            lines = re.split(r"\r\n|\r|\n", codecs.getincrementaldecoder(found)("replace").decode(data, not more).removeprefix("\ufeff"))
            if line := next((x for x in (lines[:-1] if more else lines) if x.strip()), None):
                return found, line
        return None
    finally:
        stream.close()


def headers(spark: SparkSession, paths: str | list[str], encoding: str | None = "UTF-8") -> dict[tuple[str, str], list[str]]:
    """(encoding, header line) and the files that begin so; of each file only its beginning is read, several files at once.

    ``encoding`` None: that of each file's byte order mark, else UTF-8. Files without a line are left out.
    """
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    names = sorted(to_path(spark._jvm.java.net.URI(f)).toString() for f in spark.read.text(paths).inputFiles())
    with ThreadPoolExecutor(OPENERS) as pool:
        heads = list(pool.map(lambda f: _head(spark, f, encoding), names))
    found: dict[tuple[str, str], list[str]] = {}
    for name, head in zip(names, heads, strict=True):
        if head:
            found.setdefault(head, []).append(name)
    return found


def read_csv(spark: SparkSession, paths: str | list[str], columns: list[str], aliases: dict[str, str] | None = None, encoding: str | None = "UTF-8", multi_line: bool = True) -> DataFrame:
    """CSV files as ``columns`` of text: headers in any spelling, unknown columns dropped, missing ones and nulls blank.

    Files are read by groups of one encoding and header, so files of different shapes may lie in one folder. ``encoding`` None: as each
    file's byte order mark says, else UTF-8. ``multi_line``: cells may hold line breaks, and each file is one task; without it large files
    in UTF-8 are split. Files without a line give no rows.
    """
    parts = []
    for (found_in, _), files_of in headers(spark, paths, encoding).items():
        raw = spark.read.csv(files_of, header=True, encoding=found_in, multiLine=multi_line or found_in != "UTF-8", escape='"')
        found: dict[str, str] = {}
        for c in raw.columns:
            key = (aliases or {}).get(header_key(c), header_key(c))
            found.setdefault(key, c)
        parts.append(raw.select(*(F.coalesce(F.col(f"`{found[c]}`"), F.lit("")).alias(c) if c in found else F.lit("").alias(c) for c in columns)))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def read_registry(spark: SparkSession, paths: str | list[str], required: list[str], encoding: str = "UTF-8", header: str | None = None) -> DataFrame:
    """A CSV registry whose header must have ``required``; rows of another width than the header are left out.

    ``header``: the header line of files that have none themselves. All columns are parsed, whichever are asked for: a row's width shows
    only then. Missing columns are an error that names them all, and so is a header with two columns of one name.
    """
    names = next(csv.reader([header])) if header is not None else None
    if names is None:
        lines = list(headers(spark, paths, encoding))
        names = next(csv.reader([lines[0][1]]), []) if lines else []
    keys = [header_key(n) for n in names]
    if twice := sorted({k for k in keys if k and keys.count(k) > 1}):
        raise ValueError(f"duplicate columns: {', '.join(twice)}")
    if missing := [c for c in required if c not in keys]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    raw = spark.read.schema(schema).option("columnPruning", "false").csv(paths, header=header is None, enforceSchema=True, encoding=encoding, mode="DROPMALFORMED", escape='"')
    return raw.select(*(F.coalesce(F.col(f"c{keys.index(c)}"), F.lit("")).alias(c) for c in required))


def write_csv(df: DataFrame, path: str, labels: bool = True, guard: bool = True) -> None:
    """Text cells guarded against formulas, headers as display labels; part files in a folder."""
    cells = [guarded_cell(F.col(c)) if guard else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(*(x.alias(header_label(c) if labels else c) for x, c in zip(cells, df.columns, strict=True))).write.csv(path, header=True, lineSep="\n", escape='"', emptyValue="")


def json_list(c: Column, keys: list[str], element: str) -> Column:
    """An array under the first of several keys, as ``array<element>``; a single object is a list of one, other things are empty."""
    schema = f"array<{element}>"
    found = F.coalesce(*(F.get_json_object(c, f"$.{k}") for k in keys))
    several = F.from_json(found, schema)
    single = F.from_json(found, element)
    return F.when(F.ltrim(found).startswith("["), several).when(F.ltrim(found).startswith("{"), F.array(single)).otherwise(F.array().cast(schema))


def json_in_text(c: Column) -> Column:
    """JSON text out of a fenced block or between the outermost braces or brackets; null if none of them parses."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    brackets = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    ok = [F.when((x != "") & F.try_parse_json(x).isNotNull(), x) for x in (strip(c), strip(fenced), braces, brackets)]
    return F.coalesce(*ok)


def script_json(html: Column, word: str) -> Column:
    """The first script block of JSON-LD that holds ``word``, line breaks and tabs inside strings made spaces."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    return F.regexp_replace(F.try_element_at(F.filter(blocks, lambda b: F.contains(b, F.lit(word))), F.lit(1)), r"[\x00-\x1f]", " ")


def script_variable(html: Column, name: str, schema: str) -> Column:
    """An array assigned to a script variable."""
    return F.from_json(F.regexp_extract(html, rf"(?s)var\s+{name}\s*=\s*(\[.*?\])\s*;", 1), schema)


def double_encoded(c: Column, key: str, schema: str) -> Column:
    return F.from_json(F.get_json_object(c, f"$.{key}"), schema)


def read_xml(spark: SparkSession, path: str, row: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): elements ``row`` of XML files, attributes and children by ``schema``; what does not parse, as ``raw``.

    Files are cut where an element begins, which the line reader does, so a large file is read by several tasks, whether its
    elements are lines or not. A document whose end is missing still gives its whole elements; its last one is rejected.
    Elements do not hold others of their name, and their begin tag does not stand in comments or quoted text.
    """
    pieces = spark.read.text(path, lineSep=f"<{row}").select(F.concat(F.lit(f"<{row}"), "value").alias("raw")).where(F.col("raw").rlike(rf"^<{row}[\s/>]"))
    whole = F.regexp_extract("raw", rf"(?s)^<{row}(?:\s[^>]*)?/>|^<{row}\b.*?</{row}\s*>", 0)
    parsed = pieces.select("raw", F.from_xml(F.nullif(whole, F.lit("")), f"{schema}, _raw string", {"attributePrefix": "", "rowTag": row, "columnNameOfCorruptRecord": "_raw"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._raw").isNull()
    return parsed.where(good).select("r.*").drop("_raw"), parsed.where(~good).select("raw")


def team(c: Column, won: bool) -> Column:
    """The name of the first team of a JSON list that won (or did not)."""
    teams = F.from_json(c, "array<struct<n:string,won:boolean>>")
    return F.try_element_at(F.filter(teams, lambda t: t["won"] == F.lit(won)), F.lit(1))["n"]


def file_day(path: Column) -> Column:
    """The date an input file's name begins with (yyyyMMdd)."""
    return F.try_to_timestamp(F.regexp_extract(path, r"([0-9]{8})[^/]*$", 1), F.lit("yyyyMMdd")).cast("date")


def chunks(text: Column, size: int) -> Column:
    """array<struct<label,text>> of fixed-width pieces; an empty text is one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.char_length(text) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.concat(F.lit("Part "), (i + 1).cast("string"), F.lit("/"), n.cast("string")).alias("label"), F.substring(text, i * size + 1, F.lit(size)).alias("text")))


def days(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))


def mondays(first: Column, last: Column) -> Column:
    """The Mondays of a range, or its first day where it has none."""
    start = F.next_day(F.date_sub(first, 1), "MO")
    return F.when(start <= last, F.sequence(start, F.greatest(start, last), F.expr("INTERVAL 7 DAYS"))).otherwise(F.array(first))


def object_list(c: Column, element: str) -> Column:
    """A JSON object as a list of one, a list as it is; anything else is empty, and so are elements that are no objects."""
    whole = F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).when(F.ltrim(c).startswith("{"), F.array(c))
    objects = F.filter(F.coalesce(whole, F.array().cast("array<string>")), lambda x: F.ltrim(x).startswith("{"))
    return F.transform(objects, lambda x: F.from_json(x, element))


def any_case(c: Column, key: str) -> Column:
    """The value under a key of a JSON object in any spelling of case, the first such key; blank if absent or null."""
    entries = F.map_entries(F.from_json(c, "map<string,string>"))
    hit = F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == key.lower()), F.lit(1))
    return F.coalesce(hit["value"], F.lit(""))


def xml_or_json(c: Column, key: str) -> Column:
    """One scalar of an XML document's root, else of a JSON object; blank if neither has it."""
    xml = F.when(F.ltrim(c).startswith("<"), F.from_xml(c, f"{key} string", {"ignoreNamespace": "true"})[key])
    return F.coalesce(F.nullif(F.trim(xml), F.lit("")), F.when(F.ltrim(c).startswith("{"), F.get_json_object(c, f"$.{key}")), F.lit(""))


def rows_per_folder(spark: SparkSession, path: str, part: str, columns: str) -> DataFrame:
    """Rows of the CSV files in each folder ``part=...`` under a path."""
    rows = spark.read.schema(columns).csv(path, header=True, recursiveFileLookup=True)
    return rows.groupBy(F.regexp_extract("_metadata.file_path", rf"/{part}=([^/]*)/", 1).alias(part)).agg(F.count("*").alias("n"))


def write_csv_if_any(df: DataFrame, path: str) -> str:
    """The path of a CSV folder, or an empty text, and no folder, where there are no rows."""
    if df.isEmpty():
        return ""
    write_csv(df, path)
    return path


def url_kind(url: Column, sheet_host: str, list_path: str) -> Column:
    """What an input URL is: a sheet of links, a page that lists pages, or a page itself; null for a blank one."""
    u = F.trim(url)
    host = F.lower(F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1))
    return F.when(u == "", None).when(F.contains(host, F.lit(sheet_host)), "sheet").when(F.contains(u, F.lit(list_path)), "list").when(u.isNotNull(), "page")
