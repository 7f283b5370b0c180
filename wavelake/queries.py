"""The registered queries of the recording engine, each with the DuckDB SQL of its result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import status as ST
from .functions import text as T
from .functions import ticks as K
from .operators import annotations as A
from .operators import envelope as E
from .operators import samples as SA
from .operators import timeline as L
from .operators import triggers as G
from .plans import adapters as X
from .plans.adapters import D, MINUTE, S
from .recording import register
from .sources.bytesource import open_source
from .sources.header import Header, read_header

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: DuckDB's view of adapter X.
EV = f"""ev AS (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '{X.EPOCH}')) * 10 AS ticks, user_id, event_type, value,
CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(round(value * 100) AS INTEGER) AS digital FROM events)"""
MI = f"""{EV}, mi AS (SELECT row_number() OVER (ORDER BY m) - 1 AS record_index, m * {MINUTE} AS onset_ticks FROM (SELECT DISTINCT ticks // {MINUTE} AS m FROM ev))"""
SEG = f"""{MI}, st AS (SELECT *, CASE WHEN onset_ticks = lag(onset_ticks) OVER (ORDER BY record_index) + {MINUTE} THEN 0 ELSE 1 END AS b FROM mi),
gr AS (SELECT *, sum(b) OVER (ORDER BY record_index) - 1 AS segment_index FROM st),
seg AS (SELECT CAST(segment_index AS INTEGER) AS segment_index, min(record_index) AS record_start, count(*) AS record_count, min(onset_ticks) AS start_ticks,
count(*) * {MINUTE} AS duration_ticks, min(onset_ticks) + count(*) * {MINUTE} AS end_ticks FROM gr GROUP BY segment_index)"""
NOTE = f"""{EV}, note AS (SELECT event_id, ticks AS onset_ticks, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(k AS BIGINT) * {D} END AS duration_ticks, event_type AS text FROM ev)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return X.events(spark, d).select("event_id", "path", F.lit(0).alias("signal_index"), "event_id", F.col("event_id").alias("record_index"), F.lit(0).alias("byte_offset_in_record"), F.col("ticks").alias("onset_ticks"), F.col("ticks").alias("onset_ticks_from_first_record"), F.when(F.col("event_type") != "view", F.col("k").cast("bigint") * D).alias("duration_ticks"), F.col("event_type").alias("text"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return L.segments(X.minutes(spark, d), MINUTE)


# -- ticks and fields ------------------------------------------------------------------------------------------
@query(f"WITH {EV} SELECT event_id, ticks FROM ev")
def ticks_from_timestamp(spark, d):
    return X.events(spark, d).select("event_id", "ticks")


@query(f"WITH {EV} SELECT event_id, CAST((ticks - 7000000007) // {D} AS DOUBLE) + CAST((ticks - 7000000007) % {D} AS DOUBLE) / 10000000.0::DOUBLE AS seconds FROM ev")
def ticks_to_seconds(spark, d):
    return X.events(spark, d).select("event_id", K.to_seconds_col(F.col("ticks") - 7_000_000_007).alias("seconds"))


@query("SELECT event_id, CAST(floor((value - 9.87654321) * 1e7) AS BIGINT) + CASE WHEN (value - 9.87654321) * 1e7 - floor((value - 9.87654321) * 1e7) >= 0.5 THEN 1 ELSE 0 END AS ticks FROM (SELECT event_id, CAST(value AS DOUBLE) AS value FROM events) q".replace("9.87654321", "9.87654321::DOUBLE").replace("1e7", "1e7::DOUBLE"))
def seconds_to_ticks(spark, d):
    return X.events(spark, d).select("event_id", K.from_seconds_col(F.col("value") - F.lit(9.87654321)).alias("ticks"))


@query("SELECT event_id, CAST(floor(CAST(n AS DOUBLE) / d) AS BIGINT) AS low, CAST(ceil(CAST(n AS DOUBLE) / d) AS BIGINT) AS high FROM (SELECT event_id, event_id * 7919 - 5000000 AS n, 1000 + event_id % 97 AS d FROM events)")
def floor_ceil_div(spark, d):
    n, by = F.col("event_id") * 7919 - 5_000_000, 1000 + F.col("event_id") % 97
    return X.events(spark, d).select("event_id", K.floor_div_col(n, by).alias("low"), K.ceil_div_col(n, by).alias("high"))


@query("SELECT event_id, CAST(least(greatest(n, -9223372036854775808::HUGEINT), 9223372036854775807::HUGEINT) AS BIGINT) AS ticks FROM (SELECT event_id, (CAST(event_id AS HUGEINT) - 500) * 1000000000000000000 AS n FROM events)")
def saturate_ticks(spark, d):
    n = (F.col("event_id") - 500).cast("decimal(18,0)") * F.lit("1000000000000000000").cast("decimal(19,0)")
    return X.events(spark, d).select("event_id", K.saturate_col(n).alias("ticks"))


_TIMES = "CASE event_id % 6 WHEN 0 THEN '+' || event_id || '.' || lpad(CAST(k AS VARCHAR), 2, '0') WHEN 1 THEN '-' || event_id WHEN 2 THEN CAST(event_id AS VARCHAR) || '.5' WHEN 3 THEN '+' || event_id || '.' WHEN 4 THEN '+' || event_id || '.123456789' ELSE '+' END"


@query(f"""WITH {EV}, t AS (SELECT event_id, {_TIMES} AS s FROM ev)
SELECT event_id, CASE WHEN regexp_full_match(s, '[+-][0-9]+(\\.[0-9]+)?') THEN (CASE WHEN s[1] = '-' THEN -1 ELSE 1 END) *
(CAST(regexp_extract(s, '[+-]([0-9]+)', 1) AS BIGINT) * {D} + CAST(rpad(left(regexp_extract(s, '\\.([0-9]+)', 1), 7), 7, '0') AS BIGINT)) END AS ticks FROM t""")
def parse_signed_ticks(spark, d):
    return X.events(spark, d).select("event_id", K.parse_signed_col(F.expr(_TIMES.replace("VARCHAR", "STRING"))).cast("bigint").alias("ticks"))


_FIELDS = "CASE event_id % 8 WHEN 0 THEN CAST(event_id AS VARCHAR) || '   ' WHEN 1 THEN '  ' || event_id WHEN 2 THEN '12,' || event_id WHEN 3 THEN '' WHEN 4 THEN '-' || event_id || '.25' WHEN 5 THEN 'x' || event_id WHEN 6 THEN '1e2 ' ELSE '1,000,0' END"


@query(f"""SELECT event_id, CASE WHEN event_id % 8 IN (0, 1) THEN CAST(event_id AS DOUBLE) WHEN event_id % 8 = 4 THEN -(CAST(event_id AS DOUBLE) + 0.25) WHEN event_id % 8 = 6 THEN 100.0 END AS value,
CASE event_id % 8 WHEN 1 THEN 'not-left-justified' WHEN 2 THEN 'comma-decimal' WHEN 3 THEN 'empty' WHEN 5 THEN 'malformed' WHEN 7 THEN 'malformed' ELSE 'none' END AS problem FROM events""")
def parse_number_field(spark, d):
    n = T.parse_number_col(F.expr(_FIELDS.replace("VARCHAR", "STRING")))
    return X.events(spark, d).select("event_id", n["value"].alias("value"), n["problem"].alias("problem"))


@query(f"""SELECT event_id, CASE WHEN event_id % 8 IN (0, 1) THEN event_id END AS value,
CASE event_id % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'not-left-justified' WHEN 2 THEN 'comma-decimal' WHEN 3 THEN 'empty' ELSE 'malformed' END AS problem FROM events""")
def parse_integer_field(spark, d):
    n = T.parse_number_col(F.expr(_FIELDS.replace("VARCHAR", "STRING")), integral=True)
    return X.events(spark, d).select("event_id", n["value"].alias("value"), n["problem"].alias("problem"))


@query("SELECT p_partkey, p_name AS trimmed, 'u' || p_brand AS unit, '.' || p_name || '.' AS shown, length(p_name) % 2 = 0 AS odd_byte FROM part")
def header_text(spark, d):
    name, brand = F.col("p_name"), F.col("p_brand")
    padded = F.concat(F.lit(" \x00 "), name, F.lit("\x00  "))
    return X.table(spark, d, "part").select("p_partkey", T.trim_field_col(T.latin1_col(F.encode(padded, "ISO-8859-1"))).alias("trimmed"), T.normalise_unit_col(F.concat(F.lit("µ"), brand, F.lit(" "))).alias("unit"), T.printable_col(F.concat(F.lit("\x14"), name, F.lit("\x7f"))).alias("shown"), T.has_non_printable_col(F.when(F.length(name) % 2 == 0, F.concat(name, F.lit("\x01"))).otherwise(name)).alias("odd_byte"))


@query("SELECT p_partkey, '\\x07' || p_name || '\\x85é' AS escaped FROM part")
def escape_control_characters(spark, d):
    return X.table(spark, d, "part").select("p_partkey", T.escape_controls_col(F.concat(F.lit("\x07"), F.col("p_name"), F.lit("\x85é"))).alias("escaped"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_custkey % 100 >= 85 THEN 1900 ELSE 2000 END + o_custkey % 100 AS BIGINT) AS year FROM orders")
def two_digit_year(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", T.resolve_year_col(F.col("o_custkey") % 100).cast("bigint").alias("year"))


@query("""SELECT o_orderkey, TRY_CAST(lpad(CAST(CASE WHEN y >= 85 THEN 1900 + y ELSE 2000 + y END AS VARCHAR), 4, '0') || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(dd AS VARCHAR), 2, '0') AS DATE) AS start_date
FROM (SELECT o_orderkey, o_orderkey % 33 AS dd, o_custkey % 14 AS m, o_custkey % 100 AS y FROM orders)""")
def header_date_validity(spark, d):
    raw = F.format_string("%02d.%02d.%02d", F.col("o_orderkey") % 33, F.col("o_custkey") % 14, F.col("o_custkey") % 100)
    return X.table(spark, d, "orders").select("o_orderkey", T.parse_start_date_col(raw).alias("start_date"))


@query("""SELECT o_orderkey, CASE WHEN h <= 23 AND m <= 59 AND s <= 59 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || ':' || lpad(CAST(s AS VARCHAR), 2, '0') || '.000' END AS start_time
FROM (SELECT *, o_orderkey % 26 AS h, o_custkey % 62 AS m, (o_orderkey + o_custkey) % 61 AS s FROM orders)""")
def start_time_naive(spark, d):
    clock = F.format_string("%02d.%02d.%02d", F.col("o_orderkey") % 26, F.col("o_custkey") % 62, (F.col("o_orderkey") + F.col("o_custkey")) % 61)
    return X.table(spark, d, "orders").select("o_orderkey", T.naive_start_col(F.to_date("o_orderdate"), T.parse_start_time_col(clock)).alias("start_time"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'C' || c_custkey END AS code, CASE c_custkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS sex,
CASE WHEN c_custkey % 3 = 0 THEN DATE '1951-05-02' END AS birth_date, replace(c_name, '#', '_') AS name, c_custkey % 4 <> 3 AND c_custkey % 3 <> 1 AS conformant FROM customer""")
def patient_id_subfields(spark, d):
    key = F.col("c_custkey")
    code = F.when(key % 5 == 0, F.lit("X")).otherwise(F.concat(F.lit("C"), key))
    sex = F.element_at(F.array(*[F.lit(x) for x in ("F", "M", "X", "f")]), (key % 4 + 1).cast("int"))
    born = F.element_at(F.array(*[F.lit(x) for x in ("02-MAY-1951", "31-FEB-1951", "X")]), (key % 3 + 1).cast("int"))
    p = T.patient_col(F.rpad(F.concat_ws(" ", code, sex, born, F.replace(F.col("c_name"), F.lit("#"), F.lit("_"))), 80, " "))
    return X.table(spark, d, "customer").select("c_custkey", p["code"].alias("code"), p["sex"].alias("sex"), p["birth_date"].alias("birth_date"), p["name"].alias("name"), p["conformant"].alias("conformant"))


@query("SELECT event_id, event_type || CASE event_id % 4 WHEN 2 THEN '@@' WHEN 3 THEN '@@E' || user_id ELSE '' END AS text, CASE event_id % 4 WHEN 1 THEN 'E' || user_id WHEN 3 THEN 'c' END AS channel_label FROM events")
def annotation_channel_label(spark, d):
    kind, user = F.col("event_type"), F.col("user_id")
    run = F.concat(kind, F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("@@E"), user)).otherwise(""), F.when(F.col("event_id") % 4 == 2, F.lit("@@")).when(F.col("event_id") % 4 == 3, F.lit("@@c")).otherwise(""))
    text, channel = T.split_channel_col(run)
    return X.events(spark, d).select("event_id", text.alias("text"), channel.alias("channel_label"))


# -- samples ---------------------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, bv * (off + CAST(l_quantity AS INTEGER)) AS physical FROM (SELECT *, (400.5::DOUBLE + 100.25::DOUBLE) / 4095 AS bv, 400.5::DOUBLE / ((400.5::DOUBLE + 100.25::DOUBLE) / 4095) - 2047 AS off FROM lineitem)")
def physical_scaling(spark, d):
    s = SA.scale_col(F.lit(-100.25), F.lit(400.5), F.lit(-2048), F.lit(2047), F.lit("uV"))
    rows = X.table(spark, d, "lineitem").withColumn("s", s)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", SA.physical(F.col("l_quantity").cast("int"), F.col("s.bit_value"), F.col("s.offset")).alias("physical"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 NOT IN (0, 1, 2) THEN (p_retailprice - lo) / (2047.0 + 2048) END AS bit_value FROM
(SELECT p_partkey, p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice, CASE p_size % 7 WHEN 1 THEN CAST(p_retailprice AS DOUBLE) ELSE -CAST(p_retailprice AS DOUBLE) END AS lo FROM part)""")
def scale_from_ranges(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    s = SA.scale_col(F.when(size % 7 == 1, price).otherwise(-price), price, F.when(size % 7 == 0, 2047).otherwise(-2048).cast("double"), F.lit(2047.0), F.when(size % 7 == 2, "Filtered").otherwise("uV"))
    return X.table(spark, d, "part").select("p_partkey", s["bit_value"].alias("bit_value"))


@query(f"WITH {EV} SELECT event_id, least(greatest(digital, 500), 4000) AS clamped FROM ev")
def clamp_digital(spark, d):
    return X.events(spark, d).select("event_id", SA.clamp(F.col("digital"), 4000, 500).alias("clamped"))


@query(f"WITH {EV} SELECT event_id // {S} AS record_index, count(*) FILTER (WHERE digital < 100 OR digital > 9000) AS out_of_range_count FROM ev GROUP BY 1")
def out_of_range_count(spark, d):
    blocks = X.events(spark, d).groupBy(K.div(F.col("event_id"), F.lit(S)).alias("record_index")).agg(F.collect_list("digital").alias("digital"))
    return blocks.select("record_index", SA.out_of_range_count(F.col("digital"), 9000, 100).alias("out_of_range_count"))


# -- files -----------------------------------------------------------------------------------------------------
KINDS = {"edf": X.edf, "gaps": X.edf_gaps, "bdf": X.bdf, "notes": X.edf_notes, "late": X.edf_late}


def _read(spark: SparkSession, d: str, kind: str, mode: str = "blocks", at: str | None = None, **options) -> DataFrame:
    """A mode of an archive, by its folder or at the paths given."""
    folder = at or X.archive(spark, d, kind, KINDS[kind])
    return register(spark).read.format("biosignal").options(path=folder, mode=mode, **options).load()


def per_file(files: DataFrame, rows: Callable[[str, object, Header], list[tuple]], schema: str) -> DataFrame:
    """path and the columns of schema that rows(path, source, header) gives for each file of files, by tasks."""
    columns = ["path", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                source = open_source(path)
                try:
                    yield pd.DataFrame([(path, *r) for r in rows(path, source, read_header(source))], columns=columns)
                finally:
                    source.close()

    return files.select("path").mapInPandas(run, f"path string, {schema}")


#: The files of an archive with their numbers of samples and records, for DuckDB.
FL = f"fl AS (SELECT event_id // {S * X.FILE_RECORDS} AS file, count(*) AS n, CAST(ceil(count(*) / {S}.0) AS BIGINT) AS records FROM events GROUP BY 1)"


def _global(column: str) -> Column:
    return F.col(column) + X.file_part(F.col("path")) * (S * X.FILE_RECORDS)


def _samples(blocks: DataFrame, signals: tuple[int, ...] = (0, 1)) -> DataFrame:
    return SA.explode(blocks, dict.fromkeys(signals, S), D)


def _wide(spark: SparkSession, d: str, blocks: DataFrame, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Blocks of edf with whole values: the upper words of those beyond 16 bits are in an archive of their own, which read(folder) gives as blocks."""
    folder = X.upper_words(spark, d)
    if folder is None:
        return blocks
    upper = read(folder) if read else _read(spark, d, "upper", at=folder)
    kept = upper.where(F.exists("digital", lambda x: x != 0)).select(X.file_part(F.col("path")).alias("_file"), F.col("record_index").alias("_record"), F.col("signal_index").alias("_signal"), F.col("digital").alias("_upper"))
    joined = blocks.join(kept, (X.file_part(F.col("path")) == F.col("_file")) & (F.col("record_index") == F.col("_record")) & (F.col("signal_index") == F.col("_signal")), "left")
    whole = F.when(F.col("_upper").isNull(), F.col("digital")).otherwise(F.zip_with("digital", "_upper", lambda low, high: low + high * 65536))
    return joined.withColumn("digital", whole).select(*blocks.columns)


@query(f"WITH {EV} SELECT event_id AS sample_index, digital - 32768 AS value, CAST(user_id % 30000 AS INTEGER) AS user FROM ev")
def edf_roundtrip_samples(spark, d):
    rows = _samples(_wide(spark, d, _read(spark, d, "edf"))).select("signal_index", _global("sample_index").alias("sample_index"), "digital")
    wide = rows.groupBy("sample_index").agg(F.max(F.when(F.col("signal_index") == 0, F.col("digital"))).alias("value"), F.max(F.when(F.col("signal_index") == 1, F.col("digital"))).alias("user"))
    return _whole(spark, d, wide)


def _whole(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """Without the padding of the last record."""
    return rows.where(F.col("sample_index") < X.table(spark, d, "events").count())


def _unpadded(spark: SparkSession, d: str, blocks: DataFrame) -> DataFrame:
    """Blocks without the padding of the last record."""
    left = X.table(spark, d, "events").count() - X.file_part(F.col("path")) * (S * X.FILE_RECORDS)
    return blocks.withColumn("digital", F.slice("digital", F.lit(1), F.greatest(F.lit(0), F.least(F.size("digital"), left - F.col("first_sample_index"))).cast("int")))


@query(f"WITH {EV} SELECT event_id AS sample_index, digital FROM ev")
def bdf_roundtrip_samples(spark, d):
    rows = _samples(_read(spark, d, "bdf", signals="A1")).select(_global("sample_index").alias("sample_index"), "digital")
    return _whole(spark, d, rows)


@query(f"WITH {EV} SELECT event_id AS sample_index, bv * (655.35::DOUBLE / bv - 32767 + (digital - 32768)) AS physical FROM ev, (SELECT 655.35::DOUBLE / 65535 AS bv)")
def edf_roundtrip_physical(spark, d):
    s = _read(spark, d, "edf", "headers").select("path", F.col("signals")[0]["scale"].alias("s"))
    rows = _samples(_wide(spark, d, _read(spark, d, "edf", signals="EEG value"))).join(s, "path")
    return _whole(spark, d, rows.select(_global("sample_index").alias("sample_index"), SA.physical(F.col("digital"), F.col("s.bit_value"), F.col("s.offset")).alias("physical")))


@query(f"""SELECT 'EDF' AS variant, CAST(ceil(count(*) / {S}.0) AS BIGINT) AS record_count, 768 AS header_byte_length, 1.0::DOUBLE AS record_duration_seconds, 'P001' AS patient_code, 'F' AS sex, DATE '1951-05-02' AS birth_date, 'recordingIdField' AS date_source FROM events
GROUP BY event_id // {S * X.FILE_RECORDS}""")
def header_roundtrip(spark, d):
    h = _read(spark, d, "edf", "headers")
    born = F.col("patient.birth_date")
    return h.select("variant", "record_count", F.col("header_byte_length").cast("int").alias("header_byte_length"), "record_duration_seconds", F.col("patient.code").alias("patient_code"), F.col("patient.sex").alias("sex"), F.make_date(born["year"], born["month"], born["day"]).alias("birth_date"), F.col("start_time.date_source").alias("date_source"))


@query(f"""SELECT s.signal_index, s.label, s.kind, {S} AS samples_per_record, 100.0::DOUBLE AS sample_rate_hz, CAST(sum(s.n) AS BIGINT) AS sample_count, s.unit FROM
(SELECT * FROM (SELECT CAST(ceil(count(*) / {S}.0) AS BIGINT) * {S} AS n FROM events GROUP BY event_id // {S * X.FILE_RECORDS}), (VALUES (0, 'EEG value', 'data', 'uV'), (1, 'EEG user', 'data', 'uV')) v(signal_index, label, kind, unit)) s GROUP BY ALL""")
def signals_listing(spark, d):
    s = _read(spark, d, "edf", "headers").select(F.explode("signals").alias("s")).select("s.*")
    return s.groupBy("signal_index", "label", "kind", F.col("samples_per_record").cast("int").alias("samples_per_record"), "sample_rate_hz", "unit").agg(F.sum("sample_count").alias("sample_count"))


@query(f"WITH {FL} SELECT file, lookup, signal_index FROM fl, (VALUES ('exact', 0), ('pattern', 0), ('pattern', 1), ('status', 1)) v(lookup, signal_index)")
def signal_lookup(spark, d):
    """Signals of every file by label, pattern and status."""
    from .recording import find_signals, match_signals, status_signal

    plain = per_file(_read(spark, d, "edf", "headers"), lambda path, source, h: [("exact", s.index) for s in find_signals(h, "EEG value")] + [("pattern", s.index) for s in match_signals(h, "^EEG")], "lookup string, signal_index int")
    status = per_file(_read(spark, d, "bdf", "headers"), lambda path, source, h: [("status", status_signal(h).index)], "lookup string, signal_index int")
    return _file(plain.union(status), "lookup", "signal_index")


def _first(spark: SparkSession, d: str, kind: str) -> str:
    import os

    folder = X.archive(spark, d, kind, KINDS[kind])
    return os.path.join(folder, sorted(os.listdir(folder))[0])


def _open(spark: SparkSession, d: str, kind: str):
    from .recording import open_recording

    return open_recording(spark, _first(spark, d, kind))


@query(f"WITH {EV} SELECT event_id AS sample_index, event_id // {S} AS record_index, digital - 32768 AS digital FROM ev WHERE event_id >= 3 * {S} AND event_id < 7 * {S}")
def window_read(spark, d):
    """Whole records that a window touches: [3.5, 6.25) seconds."""
    return _samples(_open(spark, d, "edf").read_window(3.5, 2.75, [0])).select("sample_index", "record_index", "digital")


@query(f"WITH {EV} SELECT event_id AS sample_index, event_id * {D // S} AS start_ticks, digital - 32768 AS digital FROM ev WHERE event_id * {D // S} >= 35000001 AND event_id * {D // S} < 62500001")
def window_trim_exact(spark, d):
    return _open(spark, d, "edf").read_samples(3.5000001, 2.75, [0]).select("sample_index", "start_ticks", "digital")


_GAPS = f"(event_id // {S}) + 10 * (event_id // {S} // 20)"


@query(f"WITH {EV} SELECT event_id AS sample_index, digital - 32768 AS digital, CASE WHEN event_id // {S} < 20 THEN 0 ELSE 1 END AS run_id FROM ev WHERE {_GAPS} >= 15 AND {_GAPS} < 35 AND event_id < {S * X.FILE_RECORDS}")
def window_across_gap(spark, d):
    r = _open(spark, d, "gaps")
    r.build_index()
    blocks = r.read_window(15, 20, [0])
    return _samples(blocks).join(blocks.select("record_index", "run_id"), "record_index").select("sample_index", "digital", "run_id")


@query(f"""WITH r AS (SELECT DISTINCT event_id // {S} AS record_index FROM events WHERE event_id < {S * X.FILE_RECORDS}), w AS (SELECT * FROM (VALUES (22, 5), (15, 10), (28, 2), (0, 40)) v(begin, length))
SELECT begin, length, (SELECT count(*) FROM r WHERE record_index + 10 * (record_index // 20) < begin + length AND record_index + 10 * (record_index // 20) + 1 > begin) AS n FROM w""")
def window_in_gap(spark, d):
    """Windows of a recording inside a gap, into one, at the end of one and across one; a gap gives no records."""
    r = _open(spark, d, "gaps")
    r.build_index()
    found = None
    for begin, length in ((22, 5), (15, 10), (28, 2), (0, 40)):
        one = r.read_window(begin, length, [0]).agg(F.count("*").alias("n")).select(F.lit(begin).alias("begin"), F.lit(length).alias("length"), "n")
        found = one if found is None else found.union(one)
    return found


@query(f"""WITH r AS (SELECT DISTINCT event_id // {S * X.FILE_RECORDS} AS file, event_id % {S * X.FILE_RECORDS} // {S} AS record_index FROM events),
g AS (SELECT file, record_index // 20 AS k, min(record_index) AS record_start, max(record_index) + 1 AS stop FROM r GROUP BY 1, 2)
SELECT file, count(*) AS segments, sum(stop - record_start) AS records, max(record_start + 10 * k) * {D} AS last_start_ticks FROM g GROUP BY file""")
def segments_of_file(spark, d):
    """What the index of each recording holds."""
    found = L.segments(_read(spark, d, "gaps", "records"), D)
    return _file(found.groupBy("path").agg(F.count("*").alias("segments"), F.sum("record_count").alias("records"), F.max("start_ticks").alias("last_start_ticks")), "segments", "records", "last_start_ticks")


@query(f"""WITH {EV} SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'E' || event_id % 7 END AS channel_label, event_type AS text, (event_id % {S * X.FILE_RECORDS}) * {D // S} AS onset_ticks,
CASE WHEN event_type = 'view' THEN NULL ELSE CAST(k AS BIGINT) * {D} END AS duration_ticks FROM ev""")
def annotations_roundtrip(spark, d):
    a = _read(spark, d, "notes", "annotations")
    return a.select((K.div(F.col("onset_ticks"), F.lit(D // S)) + X.file_part(F.col("path")) * (S * X.FILE_RECORDS)).alias("event_id"), "channel_label", "text", "onset_ticks", "duration_ticks")


@query(f"""WITH {EV}, w AS (SELECT event_id // {S * X.FILE_RECORDS} AS file, event_id % {S * X.FILE_RECORDS} AS pos, k % 2 = 1 AS new_epoch, k // 10 AS trigger FROM ev),
z AS (SELECT file, n AS pos, false AS new_epoch, 0 AS trigger FROM (SELECT file, max(pos) + 1 AS n FROM w GROUP BY 1) WHERE n % {S} > 0),
p AS (SELECT *, lag(trigger) OVER (PARTITION BY file ORDER BY pos) AS b FROM (SELECT * FROM w UNION ALL SELECT * FROM z))
SELECT file, pos AS sample_index, pos * {D // S} AS ticks, CAST(trigger AS INTEGER) AS trigger, new_epoch FROM p WHERE b IS NULL OR trigger <> b""")
def triggers_file(spark, d):
    """Triggers of every recording, whole; the last record is padded with zeros."""
    blocks = _read(spark, d, "bdf", signals="Status").withColumn("run_id", F.lit(0))
    rows = SA.explode(blocks, {1: S}, D).withColumn("run_id", F.lit(0))
    return _file(G.triggers(rows), "sample_index", "ticks", "trigger", "new_epoch")


@query(f"""WITH {EV}, f AS (SELECT event_id // {S * X.FILE_RECORDS} AS file, event_id % {S * X.FILE_RECORDS} AS pos, CAST(user_id % 30000 AS INTEGER) AS v FROM ev),
t AS (SELECT file, count(*) AS n, CAST(ceil(count(*) / {S}.0) AS BIGINT) * {S} AS total FROM f GROUP BY 1),
p AS (SELECT * FROM f UNION ALL SELECT file, unnest(range(n, total)), 0 FROM t)
SELECT file, CAST(least(pos * {D // S} // 77777777, CAST(ceil(total * {D // S}::DOUBLE / 77777777) AS BIGINT) - 1) AS INTEGER) AS bucket, min(v) AS min, max(v) AS max, count(*) AS count FROM p JOIN t USING (file) GROUP BY 1, 2""")
def envelope_file(spark, d):
    """Each recording's whole span in buckets of a fixed width; the last record is padded with zeros."""
    blocks = _read(spark, d, "edf", signals="EEG user").withColumn("run_id", F.lit(0)).withColumn("first_position", F.col("first_sample_index"))
    runs = _read(spark, d, "edf", "headers").select("path", F.ceil(F.col("record_count") * D / F.lit(77_777_777)).alias("buckets"))
    return _file(E.fold_blocks(blocks.join(runs, "path"), F.lit(D), F.lit(77_777_777 * S), F.col("buckets")), "bucket", "min", "max", "count")


@query(f"""WITH {EV} SELECT 0 AS signal_index, count(*) AS sample_count, min(digital) - 32768 AS lo, max(digital) - 32768 AS hi, 0::BIGINT AS out_of_range FROM ev
UNION ALL SELECT 1, count(*), CAST(min(user_id % 30000) AS INTEGER), CAST(max(user_id % 30000) AS INTEGER), count(*) FILTER (WHERE user_id % 30000 > 32000) FROM ev""")
def signal_stats(spark, d):
    """Of all samples but the padding of the last record; counts out of range are of the words that the files hold."""
    s = SA.signal_stats(_unpadded(spark, d, _wide(spark, d, _read(spark, d, "edf"))))
    return s.groupBy("signal_index").agg(F.sum("sample_count").alias("sample_count"), F.min("observed_digital_min").alias("lo"), F.max("observed_digital_max").alias("hi"), F.sum("out_of_range_count").alias("out_of_range"))


@query(f"WITH {EV} SELECT event_id // {S * X.FILE_RECORDS} AS file, CAST(ceil(count(*) / {S}.0) AS BIGINT) AS records, CAST(sum(user_id % 30000) AS BIGINT) AS total, count(*) FILTER (WHERE user_id % 30000 > 32000) AS out_of_range FROM ev GROUP BY 1")
def merge_chunks(spark, d):
    """Chunks of seven records of every recording, each read by itself and all merged again."""
    chunks = [_read(spark, d, "edf", signals="EEG user").where(K.div(F.col("record_index"), F.lit(7)) % 3 == k) for k in range(3)]
    merged = SA.merge(chunks[0].union(chunks[1]).union(chunks[2]), D)
    total = F.aggregate("digital", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return _file(merged, F.col("record_count").alias("records"), total.alias("total"), F.col("out_of_range_count").alias("out_of_range"))


@query(f"WITH {EV} SELECT event_id AS sample_index, CAST(user_id % 30000 AS INTEGER) AS digital FROM ev")
def stream_equals_window(spark, d):
    """Every recording as a stream in chunks of 17 records."""
    from .streaming.chunks import stream_files

    rows = _samples(stream_files(_read(spark, d, "edf", "headers"), "EEG user", 17), (1,))
    return _whole(spark, d, rows.select(_global("sample_index").alias("sample_index"), "digital"))


@query(f"""WITH {FL} SELECT kind, code, severity, CAST(per * (SELECT count(*) FROM fl) AS BIGINT) AS n FROM (VALUES ('edf', 'DATE_CLIPPED_TO_1985_2084', 'info', 1), ('gaps', 'DATE_CLIPPED_TO_1985_2084', 'info', 1),
('bdf', 'DATE_CLIPPED_TO_1985_2084', 'info', 1), ('bdf', 'LABEL_CONVENTION_NONCONFORMANT', 'warning', 2)) v(kind, code, severity, per)""")
def validate_summary(spark, d):
    """Findings in all recordings of each kind, by code; every file is validated by a task."""
    from .operators.validate import validate_files

    found = None
    for kind in ("edf", "gaps", "bdf"):
        rows = validate_files(lambda mode, kind=kind: _read(spark, d, kind, mode)).groupBy("code", "severity").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "code", "severity", "n")
        found = rows if found is None else found.union(rows)
    return found


# -- archives: the same operators over every record of every file -------------------------------------------------
_FILE = f"event_id // {S * X.FILE_RECORDS}"


def _file(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(X.file_part(F.col("path")).alias("file"), *columns)


@query(f"WITH {EV} SELECT event_id AS sample_index, digital - 32768 AS digital FROM ev")
def stream_archive(spark, d):
    from .streaming.chunks import stream_files

    stream = lambda folder: stream_files(_read(spark, d, "upper", "headers", at=folder), None, 3)
    rows = _samples(_wide(spark, d, stream_files(_read(spark, d, "edf", "headers"), "EEG value", 3), stream), (0,))
    return _whole(spark, d, rows.select(_global("sample_index").alias("sample_index"), "digital"))


@query(f"WITH {EV} SELECT {_FILE} AS file, CAST(ceil(count(*) / {S}.0) AS BIGINT) * {S} AS n, CAST(sum(digital - 32768) AS BIGINT) AS total FROM ev GROUP BY 1")
def merge_archive(spark, d):
    """The chunks of each file merged; the last record is padded with zeros."""
    first, rest = (_wide(spark, d, _read(spark, d, "edf", signals="EEG value")) for _ in range(2))  # a reader each, as filters reach it
    merged = SA.merge(first.where("record_index < 4").union(rest.where("record_index >= 4")), D)
    return _file(merged, F.size("digital").cast("bigint").alias("n"), F.aggregate("digital", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query(f"""WITH {EV}, f AS (SELECT {_FILE} AS file, event_id % {S * X.FILE_RECORDS} AS pos, digital - 32768 AS v FROM ev),
t AS (SELECT file, count(*) AS n, CAST(ceil(count(*) / {S}.0) AS BIGINT) * {S} AS total FROM f GROUP BY 1),
p AS (SELECT * FROM f UNION ALL SELECT file, unnest(range(n, total)), 0 FROM t)
SELECT file, CAST(pos * 64 // total AS INTEGER) AS bucket, min(v) AS min, max(v) AS max, count(*) AS count FROM p JOIN t USING (file) GROUP BY 1, 2""")
def envelope_archive(spark, d):
    """Each file's whole span in 64 buckets; the last record is padded with zeros."""
    blocks = _wide(spark, d, _read(spark, d, "edf", signals="EEG value")).withColumn("run_id", F.lit(0))
    return _file(E.of_blocks(blocks, 64), "bucket", "min", "max", "count")


_CUT = 12_345_678


@query(f"""WITH {EV}, s AS (SELECT {_FILE} AS file, event_id % {S * X.FILE_RECORDS} AS pos, digital - 32768 AS v FROM ev)
SELECT file, pos // {S} AS record_index, min(pos) AS first_sample_index, min((pos // {S}) * {D} + pos % {S} * {D // S}) AS start_ticks, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, count(*) FILTER (v < -32768 OR v > 32767) AS out_of_range_count
FROM s WHERE (pos // {S}) * {D} + pos % {S} * {D // S} >= {_CUT} GROUP BY 1, 2""")
def trim_archive(spark, d):
    """Blocks of every file cut at a time inside a record: what begins later, with first sample, start and count anew. The padding of the last record goes."""
    signal = _read(spark, d, "edf", "headers").select(F.explode("signals").alias("s")).where("s.label = 'EEG value'").select("s.digital_minimum", "s.digital_maximum").first()
    blocks = SA.trim(_wide(spark, d, _read(spark, d, "edf", signals="EEG value")), _CUT, 2**62, {0: (S, signal[0], signal[1])}, D)
    rows = _unpadded(spark, d, blocks)
    total = F.aggregate("digital", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return _file(rows, "record_index", "first_sample_index", "start_ticks", F.size("digital").cast("bigint").alias("n"), total.alias("total"), "out_of_range_count")


@query(f"""WITH r AS (SELECT DISTINCT {_FILE} AS file, event_id % {S * X.FILE_RECORDS} // {S} AS record_index FROM events)
SELECT file, CAST(record_index // 20 AS INTEGER) AS segment_index, min(record_index) AS record_start, count(*) AS record_count, min(record_index + 10 * (record_index // 20)) * {D} AS start_ticks FROM r GROUP BY 1, 2""")
def segments_archive(spark, d):
    return _file(L.segments(_read(spark, d, "gaps", "records"), D), "segment_index", "record_start", "record_count", "start_ticks")


@query(f"""SELECT kind, file, true AS ok, 1::BIGINT AS info, 0::BIGINT AS warning, 0::BIGINT AS error, n AS sample_count FROM (VALUES ('edf', 2), ('gaps', 2), ('bdf', 2)) v(kind, signals),
(SELECT {_FILE} AS file, CAST(ceil(count(*) / {S}.0) AS BIGINT) * {S} * 2 AS n FROM events GROUP BY 1) f""")
def validate_archive(spark, d):
    """A row for each file: its findings by severity, without those on labels, and the samples that were looked at."""
    from .operators.validate import audited, findings_of, statistics

    found = None
    for kind in ("edf", "gaps", "bdf"):
        read = lambda mode, kind=kind: _read(spark, d, kind, mode)
        seen = audited(read)
        findings = findings_of(seen)
        number = lambda severity: F.count(F.when((F.col("severity") == severity) & ~F.col("code").startswith("LABEL_"), 1)).alias(severity)
        totals = findings.groupBy("path").agg(*map(number, ("info", "warning", "error")), F.count(F.when(F.col("severity") == "error", 1)).alias("_bad"))
        samples = statistics(seen).groupBy("path").agg(F.sum("sample_count").alias("sample_count"))
        rows = seen.select("path").distinct().join(totals, "path", "left").join(samples, "path", "left").na.fill(0)
        rows = _file(rows, F.lit(kind).alias("kind"), (F.col("_bad") == 0).alias("ok"), "info", "warning", "error", "sample_count")
        found = rows if found is None else found.unionByName(rows)
    return found


def _damaged() -> list[tuple[str, bytes]]:
    """Headers with one thing wrong each."""
    from .testing import writer as Wr

    def file(plus=None, signals=None, **more) -> bytes:
        return Wr.write(Wr.Spec(plus=plus, signals=signals or [Wr.SignalSpec("Fp1")], **more))

    signal = lambda **raw: [Wr.SignalSpec("Fp1", raw=raw)]
    good = file()
    return [
        ("good", good),
        ("short", good[:100]),
        ("no header", good[:400]),
        ("not one", b"1" + good[1:]),
        ("no signals", good[:252] + b"0   " + good[256:]),
        ("comma", file(signals=signal(physical_minimum="-0,5"))),
        ("text", file(signals=signal(digital_maximum="x"))),
        ("no samples", file(signals=[Wr.SignalSpec("Fp1", 0)])),
        ("truncated", good[:-20]),
        ("partial", good[:-5]),
        ("trailing", good + b"\x00" * 45),
        ("open", file(declared_record_count=-1)),
        ("size", file(raw={"header_byte_length": 999})),
        ("zero duration", file(record_duration=0)),
        ("bad date", file(start_date="31.02.20")),
        ("bad time", file(start_time="25.00.00")),
        ("flat digital", file(signals=signal(digital_minimum="5", digital_maximum="5"))),
        ("flat physical", file(signals=signal(physical_minimum="5", physical_maximum="5"))),
        ("inverted digital", file(signals=signal(digital_minimum="5", digital_maximum="-5"))),
        ("inverted physical", file(signals=signal(physical_minimum="5", physical_maximum="-5"))),
        ("log", file(signals=signal(physical_dimension="Filtered"))),
        ("twins", file(signals=[Wr.SignalSpec("Fp1"), Wr.SignalSpec("Fp1")])),
        ("padded", file(signals=signal(samples_per_record="      10"))),
        ("reserved", file(raw={"reserved": "hello"})),
        ("wide", file(signals=signal(digital_minimum="-40000"))),
        ("no plus", file(annotations=[Wr.AnnotationSpec()])),
        ("no notes", file(raw={"reserved": "EDF+C"})),
        ("plus id", file(plus="C", patient_id="Jane Doe")),
        ("latin", file(patient_id="M\xfcller")),
        ("endless", file(record_duration="9e11", record_count=2)),
    ]


#: The codes of each fault in order of the list above, after the note on the two-digit year that every header with a date has.
_CODES = """('good', NULL), ('short', 'SOURCE_TOO_SMALL'), ('no header', 'SOURCE_TOO_SMALL'), ('not one', 'NOT_AN_EDF_FILE'), ('no signals', 'SIGNAL_COUNT_INVALID'),
('comma', 'COMMA_DECIMAL_SEPARATOR'), ('text', 'NUMERIC_FIELD_INVALID'), ('no samples', 'RECORD_SIZE_ZERO'), ('no samples', 'ZERO_SAMPLES_PER_RECORD'), ('truncated', 'TRUNCATED_FILE'), ('partial', 'TRUNCATED_FILE'), ('partial', 'PARTIAL_FINAL_RECORD'),
('trailing', 'TRAILING_BYTES'), ('open', 'RECORD_COUNT_RECOVERED'), ('size', 'HEADER_SIZE_MISMATCH'), ('zero duration', 'ZERO_RECORD_DURATION'), ('bad date', 'DATE_UNPARSEABLE'), ('bad time', 'STARTTIME_UNPARSEABLE'),
('flat digital', 'DEGENERATE_DIGITAL_RANGE'), ('flat physical', 'DEGENERATE_PHYSICAL_RANGE'), ('inverted digital', 'INVERTED_DIGITAL_RANGE'), ('inverted physical', 'INVERTED_PHYSICAL_RANGE'), ('log', 'LOG_TRANSFORMED_CHANNEL'),
('twins', 'DUPLICATE_SIGNAL_LABEL'), ('padded', 'NUMERIC_FIELD_NOT_LEFT_JUSTIFIED'), ('reserved', 'NONSTANDARD_RESERVED_FIELD'), ('wide', 'DIGITAL_RANGE_EXCEEDS_FORMAT'), ('no plus', 'MISSING_EDFPLUS_MARKER'),
('no notes', 'EDFPLUS_WITHOUT_ANNOTATION_SIGNAL'), ('plus id', 'PATIENT_ID_NONCONFORMANT'), ('latin', 'NON_ASCII_HEADER_FIELD'), ('endless', 'RECORDING_SPAN_UNREPRESENTABLE')"""
_NAMES = [name for name, _ in _damaged()]
_FAULTY = f"fa AS (SELECT p_partkey, list_extract([{', '.join(repr(n) for n in _NAMES)}], CAST(p_partkey % {len(_NAMES)} AS INTEGER) + 1) AS fault FROM part)"


def _inspected(spark: SparkSession, d: str) -> DataFrame:
    """fault, code, severity of what an inspection finds in a damaged header, one header for each row of part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .recording import inspect

        files = _damaged()
        for batch in batches:
            found = []
            for key in batch["p_partkey"]:
                name, data = files[key % len(files)]
                found += [(name, x.code, x.severity) for x in inspect(data)["diagnostics"]] or [(name, None, None)]
            yield pd.DataFrame(found, columns=["fault", "code", "severity"])

    register(spark)
    return X.table(spark, d, "part").select("p_partkey").mapInPandas(run, "fault string, code string, severity string")


@query(f"WITH {_FAULTY}, c AS (SELECT * FROM (VALUES {_CODES}) v(fault, code)) SELECT fault, code, count(*) AS n FROM fa JOIN c USING (fault) WHERE code IS NOT NULL GROUP BY ALL")
def header_diagnostics_matrix(spark, d):
    found = _inspected(spark, d).where("code <> 'DATE_CLIPPED_TO_1985_2084'").groupBy("fault", "code")
    return found.agg(F.count("*").alias("n"))


@query(f"""WITH {_FAULTY}, n AS (SELECT fault, count(*) AS n FROM fa GROUP BY 1), c AS (SELECT * FROM (VALUES ('short', 'SOURCE_TOO_SMALL', 'error'), ('no header', 'SOURCE_TOO_SMALL', 'error'), ('text', 'NUMERIC_FIELD_INVALID', 'error'), ('comma', 'COMMA_DECIMAL_SEPARATOR', 'error'),
('truncated', 'TRUNCATED_FILE', 'warning'), ('partial', 'TRUNCATED_FILE', 'warning'), ('inverted physical', 'INVERTED_PHYSICAL_RANGE', 'info')) v(fault, code, severity))
SELECT code, severity, CAST(sum(n) AS BIGINT) AS n FROM c JOIN n USING (fault) GROUP BY 1, 2""")
def diagnostic_counts(spark, d):
    """Totals by code, as `summarize` gives them for one file, over a header for each row of part."""
    kept = ("SOURCE_TOO_SMALL", "NUMERIC_FIELD_INVALID", "COMMA_DECIMAL_SEPARATOR", "TRUNCATED_FILE", "INVERTED_PHYSICAL_RANGE")
    return _inspected(spark, d).where(F.col("code").isin(*kept)).groupBy("code", "severity").agg(F.count("*").alias("n"))


# -- time ------------------------------------------------------------------------------------------------------
@query(f"WITH {SEG} SELECT * FROM seg")
def segments(spark, d):
    return _segments(spark, d).drop("path")


@query(f"WITH {SEG}, g AS (SELECT segment_index AS before_segment_index, lead(segment_index) OVER (ORDER BY segment_index) AS after_segment_index, end_ticks AS start_ticks, lead(start_ticks) OVER (ORDER BY segment_index) AS end_ticks FROM seg) SELECT *, end_ticks - start_ticks AS duration_ticks FROM g WHERE after_segment_index IS NOT NULL")
def gaps(spark, d):
    return L.gaps(_segments(spark, d)).drop("path")


_LONG = 3 * MINUTE


@query(f"""WITH {MI}, g AS (SELECT CAST(record_index AS INTEGER) AS before_record, lead(onset_ticks) OVER (ORDER BY record_index) - onset_ticks - {_LONG} AS duration_ticks FROM mi) SELECT * FROM g WHERE duration_ticks < 0""")
def overlap_gaps(spark, d):
    """With records said to last three minutes, neighbours overlap; a negative gap says by how much."""
    found = L.segments(X.minutes(spark, d), _LONG)
    g = L.gaps(found).join(found.select("segment_index", (F.col("record_start") + F.col("record_count") - 1).cast("int").alias("before_record")), F.col("before_segment_index") == F.col("segment_index"))
    return g.where("duration_ticks < 0").select("before_record", "duration_ticks")


_POINT = "(event_id * 7919000000 + 123) % 432000000000"
_POINTS = f"points AS (SELECT event_id, ({_POINT}) AS ticks FROM events)"


def _points(spark: SparkSession, d: str, path: str = "minutes") -> DataFrame:
    return X.table(spark, d, "events").select("event_id", F.lit(path).alias("path"), F.expr(_POINT).alias("ticks"))


@query(f"WITH {SEG}, {_POINTS} SELECT event_id, segment_index FROM points p LEFT JOIN seg ON p.ticks >= start_ticks AND p.ticks < end_ticks")
def segment_at(spark, d):
    return L.first_interval_at(_points(spark, d), _segments(spark, d), "event_id", "segment_index").select("event_id", "segment_index")


@query(f"WITH {SEG}, g AS (SELECT segment_index AS before_segment_index, end_ticks AS a, lead(start_ticks) OVER (ORDER BY segment_index) AS b FROM seg), {_POINTS} SELECT event_id, before_segment_index FROM points p JOIN g ON p.ticks >= a AND p.ticks < b")
def gap_at(spark, d):
    found = L.gaps(_segments(spark, d))
    return L.intervals_at(_points(spark, d), found).select("event_id", "before_segment_index")


@query(f"WITH {MI}, {_POINTS} SELECT event_id, record_index, ticks - onset_ticks AS offset_in_record_ticks FROM points p LEFT JOIN mi ON p.ticks >= onset_ticks AND p.ticks < onset_ticks + {MINUTE}")
def locate(spark, d):
    p = _points(spark, d).withColumn("seconds", F.col("ticks") / F.lit(float(D)))
    return L.locate(p, X.minutes(spark, d), MINUTE).select("event_id", "record_index", "offset_in_record_ticks")


@query(f"WITH {MI}, {_POINTS} SELECT event_id, record_index * 256 + (ticks - onset_ticks) * 256 // {MINUTE} AS sample_index FROM points p LEFT JOIN mi ON p.ticks >= onset_ticks AND p.ticks < onset_ticks + {MINUTE}")
def sample_at(spark, d):
    p = _points(spark, d).withColumn("seconds", F.col("ticks") / F.lit(float(D)))
    return L.sample_at(L.locate(p, X.minutes(spark, d), MINUTE), 256, MINUTE).select("event_id", "sample_index")


@query(f"""WITH {SEG}, s AS (SELECT event_id AS sample_index, event_id // 7 AS record_index FROM events)
SELECT sample_index, start_ticks + ((sample_index - record_start * 7) * {MINUTE} + 6) // 7 AS ticks FROM s JOIN seg ON s.record_index >= record_start AND s.record_index < record_start + record_count""")
def sample_start_ticks(spark, d):
    samples = X.table(spark, d, "events").select(F.col("event_id").alias("sample_index"), F.lit("minutes").alias("path"))
    return L.sample_start_ticks(samples, _segments(spark, d), 7, MINUTE).select("sample_index", F.col("start_ticks").alias("ticks"))


@query(f"SELECT event_id, CAST(floor(((event_id - 500) * 123457 * 256)::DOUBLE / {D}) AS BIGINT) AS sample_index, CAST(ceil(((event_id - 500) * {D})::DOUBLE / 256) AS BIGINT) AS start_ticks FROM events")
def grid_index(spark, d):
    i = F.col("event_id") - 500
    return X.events(spark, d).select("event_id", L.grid_index(i * 123_457, 256, D).alias("sample_index"), L.grid_start_ticks(i, 256, D).alias("start_ticks"))


@query(f"WITH {MI} SELECT count(*) AS record_count, min(onset_ticks) AS start_offset_ticks, max(onset_ticks) + {MINUTE} - min(onset_ticks) AS span_ticks, count(*) * {MINUTE} AS covered_ticks, max(onset_ticks) + {MINUTE} - min(onset_ticks) - count(*) * {MINUTE} AS drift_ticks FROM mi")
def timeline_summary(spark, d):
    return L.summary(X.minutes(spark, d), MINUTE).drop("path")


@query(f"WITH {SEG} SELECT CASE WHEN count(*) > 1 THEN 'discontinuous' ELSE 'contiguous' END AS contiguity FROM seg")
def contiguity(spark, d):
    return L.contiguity(_segments(spark, d)).select("contiguity")


_ASKED = f"asked AS (SELECT event_id AS asked, ticks - (event_id % 3) * {MINUTE} AS since, ticks - (event_id % 3) * {MINUTE} + (event_id % 7) * 130 * {D} AS till FROM ev)"


@query(f"""WITH {SEG}, {_ASKED}, r AS (SELECT asked, segment_index, min(record_index) AS first, count(*) AS count FROM asked JOIN gr ON onset_ticks < till AND onset_ticks + {MINUTE} > since WHERE till > since GROUP BY 1, 2)
SELECT asked, CAST(row_number() OVER (PARTITION BY asked ORDER BY segment_index) - 1 AS INTEGER) AS run_id, first, count FROM r""")
def window_planning(spark, d):
    """Record ranges of a window around each event over the segments of the minutes with events."""
    from .plans.windows import plan

    begin = F.col("ticks") - F.col("event_id") % 3 * MINUTE
    windows = X.events(spark, d).select(F.lit("minutes").alias("path"), F.col("event_id").alias("window_id"), begin.alias("start_ticks"), (begin + F.col("event_id") % 7 * (130 * D)).alias("end_ticks"))
    found = _segments(spark, d).withColumn("record_duration_ticks", F.lit(MINUTE).cast("bigint"))
    return plan(windows, found).select(F.col("window_id").alias("asked"), "run_id", "first", "count")


_PLACE = f"(event_id % {S * X.FILE_RECORDS} // {S})"
_SINCE = f"({_PLACE} + 10 * ({_PLACE} // 20)) * {D} + (event_id % 5 - 2) * {D // 4}"


@query(f"""WITH {EV}, w AS (SELECT event_id AS window_id, {_FILE} AS file, {_SINCE} AS since, {_SINCE} + (event_id % 9) * {3 * D // 2} AS till FROM ev),
r AS (SELECT {_FILE} AS file, {_PLACE} AS record_index, count(*) AS n, sum(digital - 32768) AS total FROM ev GROUP BY 1, 2),
o AS (SELECT *, (record_index + 10 * (record_index // 20)) * {D} AS onset FROM r)
SELECT window_id, count(*) AS records, count(DISTINCT record_index // 20) AS runs, CAST(sum(total) AS BIGINT) AS total FROM w JOIN o ON o.file = w.file AND onset < till AND onset + {D} > since WHERE till > since GROUP BY 1""")
def windows_archive(spark, d):
    """A window around each event's place in its file, over all files with gaps; records that windows share are read and added up once."""
    from .plans.windows import read_windows

    folder = X.archive(spark, d, "gaps", KINDS["gaps"])
    place = F.call_function("div", F.col("event_id") % (S * X.FILE_RECORDS), F.lit(S))
    begin = (place + 10 * F.call_function("div", place, F.lit(20))) * D + (F.col("event_id") % 5 - 2) * (D // 4)
    files = _read(spark, d, "gaps", "headers").select("path", X.file_part(F.col("path")).alias("file"))
    asked = X.table(spark, d, "events").select(F.call_function("div", F.col("event_id"), F.lit(S * X.FILE_RECORDS)).alias("file"), F.col("event_id").alias("window_id"), begin.alias("start_ticks"), (begin + F.col("event_id") % 9 * (3 * D // 2)).alias("end_ticks"))
    total = F.aggregate("digital", F.lit(0).cast("bigint"), lambda s, x: s + x)
    summed = lambda blocks: _wide(spark, d, blocks).select("path", "record_index", total.alias("total"))
    blocks = read_windows(spark, folder, asked.join(files, "file"), "EEG value", then=summed)
    return blocks.groupBy("window_id").agg(F.count("*").alias("records"), F.countDistinct("run_id").alias("runs"), F.sum("total").alias("total"))


# -- annotations -----------------------------------------------------------------------------------------------
def _overlap(a: str, b: str) -> str:
    return f"onset_ticks < {b} AND (onset_ticks + coalesce(duration_ticks, 0) > {a} OR (coalesce(duration_ticks, 0) = 0 AND onset_ticks >= {a}))"


@query(f"WITH {NOTE} SELECT * FROM note WHERE {_overlap(str(36000 * D), str(43200 * D))}")
def annotations_in_window(spark, d):
    return A.in_window(_notes(spark, d), 36_000, 7_200).select("event_id", "onset_ticks", "duration_ticks", "text")


@query(f"WITH {NOTE}, w AS (SELECT DISTINCT (user_id * 17 % 20000) * {D} AS a, (user_id * 17 % 20000 + user_id % 60) * {D} AS b, user_id FROM ev WHERE user_id % 60 > 0) SELECT user_id, event_id FROM note JOIN w ON {_overlap('a', 'b')}")
def annotations_in_windows(spark, d):
    user = F.col("user_id")
    windows = X.events(spark, d).where(user % 60 > 0).select("path", user, ((user * 17 % 20_000) * D).alias("start_ticks"), ((user * 17 % 20_000 + user % 60) * D).alias("end_ticks")).distinct()
    return A.in_windows(_notes(spark, d), windows).select("user_id", "event_id")


@query(f"""WITH {NOTE}, w AS (SELECT DISTINCT (user_id * 17 % 20000) * {D} AS a, (user_id * 17 % 20000 + user_id % 60) * {D} AS b, user_id FROM ev WHERE user_id % 60 > 0)
SELECT user_id, count(*) AS n FROM note JOIN w ON text = 'error' AND onset_ticks < b GROUP BY 1""")
def annotations_without_end(spark, d):
    """Errors that last as long as 64 bits can say: each window has those that began before its end."""
    user = F.col("user_id")
    windows = X.events(spark, d).where(user % 60 > 0).select("path", user, ((user * 17 % 20_000) * D).alias("start_ticks"), ((user * 17 % 20_000 + user % 60) * D).alias("end_ticks")).distinct()
    notes = _notes(spark, d).where("text = 'error'").withColumn("duration_ticks", F.lit(2**63 - 1))
    return A.count_in_windows(notes, windows).where("n > 0").groupBy("user_id").agg(F.sum("n").alias("n"))


_AT = "(SELECT onset_ticks FROM note WHERE event_id = (SELECT count(*) // 2 FROM note))"


@query(f"WITH {NOTE} SELECT event_id, text FROM note WHERE (coalesce(duration_ticks, 0) = 0 AND onset_ticks = {_AT}) OR (coalesce(duration_ticks, 0) > 0 AND onset_ticks <= {_AT} AND onset_ticks + duration_ticks > {_AT})")
def annotations_at(spark, d):
    """What is in force when the event in the middle begins."""
    middle = X.table(spark, d, "events").count() // 2
    ticks = X.events(spark, d).where(F.col("event_id") == middle).select("ticks").first()[0]
    return A.at(_notes(spark, d), K.to_seconds(ticks)).select("event_id", "text")


@query(f"WITH {NOTE} SELECT event_id, text FROM note WHERE text = 'error' OR regexp_matches(text, '^s.*p$')")
def annotations_text_filter(spark, d):
    notes = _notes(spark, d)
    return A.by_text(notes, "error").union(A.by_text(notes, "^s.*p$", regex=True)).select("event_id", "text")


@query(f"WITH {NOTE} SELECT text, count(*) AS count FROM note GROUP BY text")
def annotation_counts(spark, d):
    return A.counts_by_text(_notes(spark, d))


@query(f"WITH {NOTE} SELECT event_id, onset_ticks - 12345 AS onset_ticks_from_first_record FROM note")
def annotations_rebase(spark, d):
    return A.rebase(_notes(spark, d).drop("onset_ticks_from_first_record"), 12_345).select("event_id", "onset_ticks_from_first_record")


# -- envelopes and triggers ------------------------------------------------------------------------------------
def _sampled(spark: SparkSession, d: str, sparse: bool = False) -> DataFrame:
    e = X.events(spark, d).withColumn("signal_index", F.lit(0)).withColumn("position", F.col("event_id"))
    return e.where(F.col("event_type") == "signup") if sparse else e


_TOTAL = f"{EV}, n AS (SELECT *, (SELECT count(*) FROM ev) AS total FROM ev)"


@query(f"WITH {_TOTAL} SELECT CAST(least(event_id * 1000 // total, 999) AS INTEGER) AS bucket, min(digital) AS min, max(digital) AS max, count(*) AS count FROM n GROUP BY 1")
def envelope_even(spark, d):
    return E.fold(_sampled(spark, d), E.even_bucket(F.col("position"), X.table(spark, d, "events").count(), 1000)).select("bucket", "min", "max", "count")


_WIDTH = 3_333_333


@query(f"WITH {_TOTAL} SELECT CAST(least(event_id * {D // S} // {_WIDTH}, CAST(ceil(total * {D // S}::DOUBLE / {_WIDTH}) AS BIGINT) - 1) AS INTEGER) AS bucket, min(digital) AS min, max(digital) AS max, count(*) AS count FROM n GROUP BY 1")
def envelope_resolution(spark, d):
    n = X.table(spark, d, "events").count()
    buckets, kept = E.resolution(n * (D // S), _WIDTH, n)
    assert kept
    return E.fold(_sampled(spark, d), E.resolution_bucket(F.col("position"), S, D, _WIDTH, buckets)).select("bucket", "min", "max", "count")


@query(f"WITH {_TOTAL}, e AS (SELECT CAST(least(event_id * 500 // total, 499) AS INTEGER) AS bucket, min(digital) AS lo, max(digital) AS hi FROM n GROUP BY 1) SELECT bucket, -0.25::DOUBLE * (10.0::DOUBLE + hi) AS phys_min, -0.25::DOUBLE * (10.0::DOUBLE + lo) AS phys_max FROM e")
def envelope_physical(spark, d):
    e = E.fold(_sampled(spark, d), E.even_bucket(F.col("position"), X.table(spark, d, "events").count(), 500))
    return E.physical(e, -0.25, 10.0).select("bucket", "phys_min", "phys_max")


@query(f"""WITH {_TOTAL}, e AS (SELECT CAST(least(event_id * 3000 // total, 2999) AS INTEGER) AS bucket, min(digital) AS min, max(digital) AS max, count(*) AS count FROM n WHERE event_type = 'signup' GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bucket, coalesce(min, 0) AS min, coalesce(max, 0) AS max, coalesce(count, 0) AS count FROM range(3000) r(b) LEFT JOIN e ON e.bucket = b""")
def envelope_empty_buckets(spark, d):
    e = E.fold(_sampled(spark, d, sparse=True), E.even_bucket(F.col("position"), X.table(spark, d, "events").count(), 3000))
    return E.with_empty(e, 3000).select("bucket", "min", "max", "count")


_WORD = "(k // 10) | ((k % 2) << 16) | ((CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) << 20) | ((CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) << 22)"


def _status(spark: SparkSession, d: str) -> DataFrame:
    word = F.expr(_WORD.replace("k // 10", "k div 10"))
    return X.events(spark, d).select("path", "run_id", "sample_index", (F.col("sample_index") * (D // S)).alias("start_ticks"), (word.cast("int") - F.when(F.col("event_id") % 2 == 1, F.lit(1 << 24)).otherwise(0)).alias("digital"))


@query(f"WITH {EV} SELECT event_id AS sample_index, CAST(k // 10 AS INTEGER) AS trigger, k % 2 = 1 AS new_epoch, k % 3 = 0 AS cms_in_range, k % 5 = 0 AS battery_low FROM ev")
def status_word_flags(spark, d):
    s = ST.status_col(F.col("digital"))
    return _status(spark, d).select("sample_index", s["trigger"].alias("trigger"), s["new_epoch"].alias("new_epoch"), s["cms_in_range"].alias("cms_in_range"), s["battery_low"].alias("battery_low"))


_TRIG = f"{EV}, p AS (SELECT event_id, k // 10 AS t, lag(k // 10) OVER (ORDER BY event_id) AS b FROM ev)"


@query(f"WITH {_TRIG} SELECT event_id AS sample_index, event_id * {D // S} AS ticks, CAST(t AS INTEGER) AS trigger FROM p WHERE b IS NULL OR t <> b")
def triggers(spark, d):
    return G.triggers(_status(spark, d)).select("sample_index", "ticks", "trigger")


@query(f"WITH {_TRIG}, i AS (SELECT * FROM p WHERE event_id * {D // S} >= 25500000 AND event_id * {D // S} < 85500000) SELECT event_id AS sample_index, CAST(t AS INTEGER) AS trigger, event_id = (SELECT min(event_id) FROM i) AS first_of_run FROM i WHERE t <> b OR event_id = (SELECT min(event_id) FROM i)")
def triggers_window(spark, d):
    return G.triggers(_status(spark, d), 2.55, 6.0).select("sample_index", "trigger", "first_of_run")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Physical minimum and maximum of a channel in buckets over each recording that was written from a table."""
    s = _open(spark, d, "edf").header.signals[0]
    blocks = _read(spark, d, "edf", signals=s.label).withColumn("run_id", F.lit(0))
    return E.physical(E.of_blocks(blocks, 1000), s.scale.bit_value, s.scale.offset)
