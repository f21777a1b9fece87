"""File sources S-01..S-06 and S-10.

Readers return partitioned DataFrames; nothing is read whole on the driver.
The robust CSV reader tests the encoding on every line in one distributed
scan, takes header and delimiter from the head of the first file, and then
reads with those options.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import col, is_datetime, is_numeric, is_string, quote
from tabulon.functions.dates import parse_timestamp
from tabulon.operators.clean import unique_names

# Encodings tried in order by the robust reader (S-02).
ENCODINGS = ["utf-8", "utf-8-sig", "utf-16", "cp1252", "latin-1"]
DELIMITERS = [",", ";", "\t", "|"]

HEADER_BYTES = 65_536   # of the first file, read for its header line


def _cp1252(code: int) -> str | None:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return None


_BLOCK = [(chr(c), _cp1252(c)) for c in range(0x80, 0xA0)]
CP1252_CODES = "".join(a for a, b in _BLOCK if b)
CP1252_TEXT = "".join(b for _, b in _BLOCK if b)
CP1252_UNDEFINED = "".join(f"\\x{{{ord(a):x}}}" for a, b in _BLOCK if not b)


def _head_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """First ``n`` bytes of the first data file under ``path`` through the
    Hadoop FileSystem API, so object stores work the same as local disks."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(conf)
    statuses = fs.globStatus(hpath) or []
    files = []
    for st in statuses:
        if st.isDirectory():
            files += [c.getPath() for c in fs.listStatus(st.getPath()) if c.isFile()
                      and not c.getPath().getName().startswith(("_", "."))]
        else:
            files.append(st.getPath())
    if not files:
        raise FileNotFoundError(path)
    files.sort(key=lambda p: p.toString())
    stream = fs.open(files[0])
    try:
        bounded = jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(bounded))
    finally:
        stream.close()


def read_csv(spark: SparkSession, path: str, header: bool = True, infer_schema: bool = True, **options) -> DataFrame:
    """S-01: CSV scan (files, folders and globs); a missing path raises."""
    df = spark.read.options(**options).csv(path, header=header, inferSchema=infer_schema)
    if not header:
        return df
    encoding = {k.lower(): v for k, v in options.items()}.get("encoding", "utf-8")
    return _own_header(df, _head_bytes(spark, path, HEADER_BYTES).decode(encoding, "replace"),
                       options.get("sep", options.get("delimiter", ",")))


def _own_header(df: DataFrame, text: str, sep: str) -> DataFrame:
    """Column names as the file has them; Spark numbers repeated ones (x0, x1), here the
    second ``x`` becomes ``x_1``."""
    lines = text.lstrip("\ufeff").splitlines()
    names = next(csv.reader(lines[:1], delimiter=sep), []) if lines else []
    if len(names) != len(df.columns) or len({c.lower() for c in names}) == len(names):
        return df
    return df.toDF(*unique_names(names))


UTF16_ZEROS = 0.2   # share of zero bytes from which a text is UTF-16


def choose_encoding(spark: SparkSession, path: str, head: bytes) -> str:
    """First of ENCODINGS that decodes the whole input: byte-order marks decide at once,
    the others, and UTF-16 without a mark, are tested on every line of every file in one scan."""
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    raw = F.col("value").cast("binary")
    as_latin = F.decode(raw, "ISO-8859-1")
    valid, undefined, size, zeros = spark.read.text(path).agg(
        F.min(F.is_valid_utf8("value").cast("int")),
        F.max(F.regexp_like(as_latin, F.lit(f"[{CP1252_UNDEFINED}]")).cast("int")),
        F.sum(F.length(raw)), F.sum(F.length(as_latin) - F.length(F.replace(as_latin, F.lit("\0"), F.lit(""))))).first()
    if zeros and zeros >= UTF16_ZEROS * size:
        # text mostly of Latin letters without a mark: the high bytes are zero, and their side tells the order
        return "utf-16-le" if head[1::2].count(0) >= head[::2].count(0) else "utf-16-be"
    if valid is None or valid == 1:
        return "utf-8-sig" if head.startswith(b"\xef\xbb\xbf") else "utf-8"
    return "latin-1" if undefined else "cp1252"


def choose_delimiter(text: str) -> str:
    """Delimiter of the first line: csv.Sniffer's, else the most frequent candidate."""
    first = text.lstrip("\ufeff").split("\n", 1)[0]
    try:
        return csv.Sniffer().sniff(first or ",", delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        return max(DELIMITERS, key=first.count)


def read_csv_robust(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """S-02: CSV with an unknown encoding/delimiter; malformed lines are dropped.

    The whole input decides the encoding; the head of the first file gives the
    header and the delimiter.
    """
    head = _head_bytes(spark, path, HEADER_BYTES)
    enc = choose_encoding(spark, path, head)
    text = head.decode(enc, "replace")
    delim = choose_delimiter(text)
    # Windows-1252 is Latin-1 but for a block of control codes, which are put right after the scan
    spark_enc = {"utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE",
                 "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}.get(enc, "UTF-8")
    reader = spark.read.options(encoding=spark_enc, sep=delim, mode="DROPMALFORMED", header=str(header).lower(),
                                inferSchema="true")
    if enc.startswith("utf-16"):
        reader = reader.option("multiLine", "true")
    df = reader.csv(path)
    if enc == "cp1252":
        fix = str.maketrans(CP1252_CODES, CP1252_TEXT)
        df = df.select(*[(F.translate(col(f.name), CP1252_CODES, CP1252_TEXT) if is_string(f.dataType)
                          else col(f.name)).alias(f.name.translate(fix)) for f in df.schema.fields])
    first = df.columns[0] if df.columns else None
    if first and first.startswith("\ufeff"):
        df = df.withColumnRenamed(first, first.lstrip("\ufeff"))
    return _own_header(df, text, delim) if header else df


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs -> top-level columns named with dotted paths."""
    def walk(prefix: str, dtype: T.DataType, path: list[str]):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield from walk(f"{prefix}{sep}{f.name}" if prefix else f.name, f.dataType, path + [f.name])
        else:
            c = F.col(quote(path[0]))
            for p in path[1:]:
                c = c.getField(p)
            yield c.alias(prefix)
    cols = []
    for f in df.schema.fields:
        cols += list(walk(f.name, f.dataType, [f.name]))
    return df.select(*cols)


def read_json_flat(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S-03: JSON array -> one row per element; JSON object -> one row; nested
    objects flattened to dotted column names."""
    return flatten(spark.read.option("multiLine", str(multi_line).lower()).json(path))


def infer_types(df: DataFrame) -> DataFrame:
    """S-06: numeric / datetime / categorical per column.  A text column is a
    datetime when every non-null value parses (one aggregate for all text columns)."""
    texts = [f.name for f in df.schema.fields if is_string(f.dataType)]
    row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(texts)],
                 *[F.count(parse_timestamp(col(c))).alias(f"p{i}") for i, c in enumerate(texts)]).first() if texts else None
    rows = []
    for i, f in enumerate(df.schema.fields):
        if is_numeric(f.dataType):
            kind = "numeric"
        elif is_datetime(f.dataType):
            kind = "datetime"
        elif is_string(f.dataType):
            j = texts.index(f.name)
            kind = "datetime" if row[f"n{j}"] == row[f"p{j}"] else "categorical"
        else:
            kind = "categorical"
        rows.append((f.name, kind, i))
    return df.sparkSession.createDataFrame(rows, "column_name string, kind string, position int")


def preview(df: DataFrame, order_by: Sequence[str], n: int = 30, tail: bool = False) -> DataFrame:
    """S-10: first (or last) ``n`` rows under ``order_by`` (a distributed top-k)."""
    order = [col(c).desc() if tail else col(c).asc() for c in order_by]
    return df.orderBy(*order).limit(n)
